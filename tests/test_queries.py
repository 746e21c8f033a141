"""Every registered query of the engine against its SQL, and the driver's entry points."""

import importlib

import pytest

from pairwright.plans import catalog

from .oracle import assert_same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, DATA), catalog.ORACLE_SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    module = importlib.import_module("__spark_entry__")
    assert module.entry(spark).count() == 4
    assert set(module.oracle_sql()) <= set(module.queries())


def test_pushdown_and_pruning(spark):
    plan = catalog.QUERIES["weighted_rate"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "l_quantity" in schema and "l_shipdate" not in schema


def test_range_join_is_an_equi_join(spark):
    plan = catalog.QUERIES["range_energy"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
