import os

import pytest

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", memory="3g", **{"spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield session
    session.stop()
