"""Record audits, snapshots, Parquet batches, optional fields, pattern counts, orders of conditions, on small tables."""

import datetime
import hashlib
import json
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pairwright.operators import integrity, records, selection
from pairwright.sources import readers, slices, snapshots

ROW = {
    "id": "item_7", "gold": 12.0, "sampler_seed": 107, "api_error": None, "retry_error": None, "retried": False,
    "scoring_content": "So\nAnswer: 12", "parsed_answer": 12.0, "truncated": False, "completion_tokens": 9, "thinking_tokens": 3, "correct": True,
}
KINDS = (
    "id string, gold double, sampler_seed bigint, api_error string, retry_error string, retried boolean, scoring_content string, parsed_answer double, "
    "truncated boolean, completion_tokens bigint, thinking_tokens bigint, correct boolean, raw_response string, extra int"
)


def reply(content="one two three</think> So\nAnswer: 12 ", reasoning=None, finish="stop", tokens=9, model="m"):
    message = {"content": content, "reasoning_content": reasoning}
    return json.dumps({"model": model, "choices": [{"message": message, "finish_reason": finish}], "usage": {"completion_tokens": tokens}})


FAILED = {"api_error": '{"kind":"http","status":503,"attempts":2}', "scoring_content": "", "parsed_answer": None, "correct": False, "completion_tokens": None}
BAD = '{"kind":"http","status":200,"attempts":2}'
CASES = [
    ({}, reply(), []),
    ({"sampler_seed": 106}, reply(), ["seed"]),
    ({"sampler_seed": None}, reply(), ["seed"]),
    ({"retried": True}, reply(), ["retry flag"]),
    ({"retried": True, "retry_error": FAILED["api_error"]}, reply(), []),
    ({"retried": True, "retry_error": BAD}, reply(), ["retry error"]),
    ({"scoring_content": None}, reply(), ["content"]),
    ({"parsed_answer": None, "correct": False}, reply(), ["answer", "correct"]),
    ({"gold": 13.0}, reply(), ["correct"]),
    ({}, reply(finish="length"), ["truncated"]),
    ({}, reply(tokens=10), ["tokens"]),
    ({}, reply(reasoning="a b c d"), ["thinking"]),
    ({"thinking_tokens": 5}, reply(reasoning="a b c d"), []),
    ({}, reply(model="other"), ["raw"]),
    ({}, None, ["raw"]),
    ({}, '{"model": "m", "choices": []}', ["raw"]),
    ({}, reply().replace("9}", "NaN}"), ["raw"]),
    ({}, reply()[:-1] + ', "more": [1, {"x": NaN}]}', ["raw"]),
    ({}, reply()[:-1] + ', "more": [1, {"x": 2}]}', []),
    ({"scoring_content": "", "parsed_answer": None, "correct": False, "thinking_tokens": 0}, reply(content=None), []),
    (FAILED, None, []),
    (FAILED, reply(), []),
    (FAILED, reply()[:-1] + ', "x": NaN}', ["raw"]),
    (FAILED | {"api_error": BAD}, None, ["error"]),
    (FAILED | {"api_error": "oops", "scoring_content": "x", "parsed_answer": 1.0, "correct": True}, reply(model="z"), ["error", "raw", "content", "answer", "correct"]),
]


def test_records_are_recomputed_from_raw_replies(spark):
    rows = [{**ROW, **change, "raw_response": raw, "extra": i} for i, (change, raw, _) in enumerate(CASES)]
    table = spark.createDataFrame(rows, KINDS)
    found = {r.extra: r.findings for r in records.record_findings(table, "m", 100, key="extra").collect()}
    assert found == {i: want for i, (_, _, want) in enumerate(CASES)}
    assert records.record_findings(table.limit(0), "m", 100).count() == 0


def test_a_filter_on_findings_parses_twice_at_most(spark):
    rows = spark.createDataFrame([{**ROW, "raw_response": reply(), "extra": 1}], KINDS)
    plan = records.record_findings(rows, "m", 100).where(F.size("findings") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(choices") <= 4  # answered and failed rows, in the filter and above it


def test_processor_rows(spark):
    sound = "0, card, id-0, 61, 81.25, 512, 12288, 99.5, 1.8e3"
    lines = [sound, sound.replace("81.25", "[N/A]"), sound.replace("99.5", "100.5"), sound.replace("99.5", "nan"), sound + ", 1", "", sound.replace("512", "1e999"), sound.replace("0, card", "0.5, card"), sound.replace("61", "61d")]
    table = spark.createDataFrame([(i, x, "mine") for i, x in enumerate([*lines, None])], "line_no int, line string, tag string")
    found = {r.line_no: r for r in snapshots.processor_rows(table, strict=False).collect()}
    assert [found[i].problem for i in range(len(lines))] == [None, "number", "range", "number", "fields", "fields", "number", "number", "number"]
    assert found[0].utilization_percent == 99.5 and found[0].graphics_clock_mhz == 1800.0 and found[0].tag == "mine"
    assert found[2].power_w is None and found[len(lines)].problem == "fields"
    assert snapshots.processor_rows(table.where("line_no = 0")).count() == 1
    with pytest.raises(Exception, match="malformed row .number"):
        snapshots.processor_rows(table.where("line_no <= 1")).collect()


def test_memory_tables_from_files(spark, tmp_path):
    (tmp_path / "a").write_text("MemTotal:       32 kB\nMemFree:  1 kB\nSlab: 9 kB\nMemFree:  2 kB\nBuffers:\n\nno colon\n")
    (tmp_path / "b").write_text("SwapFree:        0 kB\n")
    lines = readers.read_lines(spark, str(tmp_path))
    found = {readers_name(r.file): r for r in snapshots.memory_rows(lines, ["file"], "line_no").collect()}
    assert (found["a"].total, found["a"].free, found["a"].buffers, found["a"].cached) == (32768, 2048, None, None)
    assert (found["b"].swap_free, found["b"].total) == (0, None)


def readers_name(path):
    return path.rsplit("/", 1)[1]


def parquet_file(path, n, group):
    held = pa.table({
        "id": pa.array(range(n), pa.int64()),
        "words": pa.array([None if i % 5 == 0 else [f"w{i}", None] for i in range(n)], pa.list_(pa.string())),
        "at": pa.array([datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i) for i in range(n)], pa.timestamp("us", "UTC")),
        "wide": pa.array(["x" * 50] * n),
    })
    pq.write_table(held, path, row_group_size=group)


def test_batches_by_position(spark, tmp_path):
    parquet_file(tmp_path / "a.parquet", 1000, 70)
    parquet_file(tmp_path / "b.parquet", 30, 70)
    parquet_file(tmp_path / "c.parquet", 0, 70)
    path = str(tmp_path)
    plain = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos"), "words", "id", "at")
    want = {(readers_name(r.file), r.pos, r.pos // 64, str(r.words), r.id, r.at) for r in plain.where("pos < 150").collect()}
    rows = slices.read_batches(spark, path, ["words", "id", "at"], 150, 64)
    assert rows.columns == ["file", "pos", "batch_no", "words", "id", "at"]
    found = [(readers_name(r.file), r.pos, r.batch_no, str(r.words), r.id, r.at) for r in rows.collect()]
    assert len(found) == 180 and set(found) == want
    assert slices.read_batches(spark, path, ["id"], 0).count() == 0
    with pytest.raises(ValueError, match="150 rows asked for"):
        slices.read_batches(spark, path, ["id"], 150, exact=True)
    assert slices.read_batches(spark, str(tmp_path / "a.parquet"), ["id"], 1000, exact=True).count() == 1000


def test_row_groups_behind_the_last_row_are_not_opened(spark, tmp_path):
    path = tmp_path / "a.parquet"
    parquet_file(path, 1000, 100)
    assert [(r.row_group, r.first, r.n) for r in slices.row_groups(spark, str(path), 250).orderBy("first").collect()] == [(0, 0, 100), (1, 100, 100), (2, 200, 100)]
    assert slices.row_groups(spark, str(path)).count() == 10
    # damage what comes behind them: it is never read
    start = pq.ParquetFile(path).metadata.row_group(3).column(0).dictionary_page_offset
    data = bytearray(path.read_bytes())
    data[start : start + 200] = b"\xff" * 200
    path.write_bytes(data)
    assert slices.read_batches(spark, str(path), ["id"], 300).count() == 300
    with pytest.raises(Exception):
        slices.read_batches(spark, str(path), ["id"], 400).collect()


def test_batch_columns_are_named_apart(spark, tmp_path):
    pq.write_table(pa.table({"pos": [1]}), tmp_path / "a.parquet")
    with pytest.raises(ValueError, match="named apart"):
        slices.read_batches(spark, str(tmp_path), ["pos"], 1)


def test_truthiness_of_every_kind(spark):
    kinds = "s string, i int, d double, b boolean, a array<int>, m map<string,int>, n struct<x: int>, y binary"
    full = ("x", 2, math.nan, True, [0], {"k": 0}, (None,), b"0")
    empty = ("", 0, 0.0, False, [], {}, None, b"")
    rows = spark.createDataFrame([full, empty, (None,) * 8], kinds)
    names = [*rows.columns, "absent"]
    found = [tuple(r) for r in rows.select(*[integrity.truthy(rows, c).alias(c) for c in names]).collect()]
    assert found == [(True,) * 8 + (False,), (False,) * 9, (False,) * 9]


def test_pattern_counts_with_and_without_needles(spark):
    patterns = {"pair": "a+b", "mail": "[a-z]+@[a-z]+"}
    rows = spark.createDataFrame([("ab aab",), ("x@y ab",), (None,), ("",)], "t string")
    want = {("pair", 2, 3), ("mail", 1, 1)}
    for needles in (None, {"mail": "@"}, {"mail": "@", "pair": "b"}):
        assert {tuple(r) for r in integrity.pattern_counts(rows, "t", patterns, needles).collect()} == want
    assert {tuple(r) for r in integrity.pattern_counts(rows.limit(0), "t", patterns).collect()} == {("pair", 0, 0), ("mail", 0, 0)}


def test_orders_of_conditions(spark):
    rows = spark.createDataFrame([("q1", 0), ("q1", 1), (None, 2)], "qid string, place int")
    found = {r.place: r.order for r in selection.condition_orders(rows, ["qid", "place"], ["O", "A", "E"], "s").collect()}
    assert found[1] == sorted(["O", "A", "E"], key=lambda c: hashlib.sha256(f"s|q1|1|{c}".encode()).hexdigest())
    assert all(sorted(x) == ["A", "E", "O"] for x in found.values())
