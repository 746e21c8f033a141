"""The tensor container: headers without data, rows into files and back, malformed files."""

import io
import json
import struct

import pytest

from pairwright.sources import container


def text(value):
    return struct.pack("<Q", len(value.encode())) + value.encode()


def sample(n_data=0):
    pairs = [
        text("general.name") + struct.pack("<I", 8) + text("é😀"),
        text("a.f32") + struct.pack("<If", 6, 1.5),
        text("a.flag") + struct.pack("<I?", 7, True),
        text("a.list") + struct.pack("<IIQ3i", 9, 5, 3, -1, 2, 3),
        text("a.words") + struct.pack("<IIQ", 9, 8, 2) + text("x") + text(""),
        text("a.big") + struct.pack("<IQ", 10, 1 << 63),
    ]
    tensors = [text("w1") + struct.pack("<I2QIQ", 2, 64, 3, 2, 0), text("w2") + struct.pack("<I1QIQ", 1, 5, 999, 32)]
    return b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(pairs)) + b"".join(pairs + tensors) + b"\0" * n_data


def test_header_values():
    rows = list(container.Header(io.BytesIO(sample()), "x").rows())
    assert [(r[1], r[2], r[3], r[4]) for r in rows[:6]] == [
        ("pair", "general.name", "text", "é😀"), ("pair", "a.f32", "f32", "1.5"), ("pair", "a.flag", "bool", "true"),
        ("pair", "a.list", "array", "[-1, 2, 3]"), ("pair", "a.words", "array", json.dumps(["x", ""])), ("pair", "a.big", "u64", str(1 << 63)),
    ]
    assert [r[2:] for r in rows[6:]] == [("w1", "q4_0", None, [64, 3], 0, 108), ("w2", "999", None, [5], 32, None)]


def test_tensors_are_not_read():
    header = container.Header(io.BytesIO(sample(10 << 20)), "x")
    assert len(list(header.rows())) == 8 and header.read <= 2 * container.BLOCK


@pytest.mark.parametrize(
    "data, says",
    [
        (b"GGUX" + sample()[4:], "not a container"),
        (sample()[:-9], "ends early"),
        (b"GGUF" + struct.pack("<IQQ", 3, 1 << 60, 0), "a count of"),
        (b"GGUF" + struct.pack("<IQQ", 3, 0, 2) + (text("a") + struct.pack("<IB", 0, 1)) * 2, "occurs twice"),
        (b"GGUF" + struct.pack("<IQQ", 3, 0, 1) + text("a") + struct.pack("<I", 77), "unknown type"),
    ],
)
def test_malformed(data, says):
    with pytest.raises(ValueError, match=says):
        list(container.Header(io.BytesIO(data), "x").rows())


def test_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"v{k}", [float(k + i) for i in range(k % 5)]) for k in range(53)], "name string, values array<float>").repartition(3)
    container.write_tensors(rows, str(tmp_path / "c"), per_file=10)
    assert all(f.suffix == ".gguf" for f in (tmp_path / "c").iterdir()) and len(list((tmp_path / "c").iterdir())) >= 6
    found = container.read_headers(spark, f"file:{tmp_path}/c")
    assert {(r.name, tuple(r.dims), r.bytes) for r in found.where("kind = 'tensor'").collect()} == {(f"v{k}", (k % 5,), 4 * (k % 5)) for k in range(53)}
    assert found.where("name = 'table.rows'").selectExpr("sum(cast(value as int))").first()[0] == 53
    file = sorted((tmp_path / "c").iterdir())[0]
    one = [r for r in container.read_headers(spark, str(file)).collect() if r.kind == "tensor"]
    data, head = file.read_bytes(), container.Header(io.BytesIO(file.read_bytes()), "x")
    list(head.rows())
    end = head.read - (len(head.held) - head.at)
    start = end + -end % container.ALIGN
    for r in one:
        k = int(r.name[1:])
        assert struct.unpack_from(f"<{r.dims[0]}f", data, start + r["at"]) == tuple(float(k + i) for i in range(k % 5))
