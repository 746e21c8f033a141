"""Readers and sinks that no registered query covers, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from pairwright.functions import text as tx
from pairwright.operators import aggregates, integrity, joins, pairing, selection
from pairwright.sources import readers, sinks
from pairwright.streaming import telemetry


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_whole_json_and_manifest(spark, tmp_path):
    path = put(tmp_path, "m.json", json.dumps({"artifacts": [{"path": "a", "bytes": 5_000_000_000}, {"path": "b", "bytes": 1}]}, indent=1))
    document = readers.read_json(spark, path, "artifacts ARRAY<STRUCT<path: STRING, bytes: BIGINT>>")
    assert {(r.path, r.bytes) for r in readers.manifest_items(document, "artifacts").collect()} == {("a", 5_000_000_000), ("b", 1)}


def test_csv(spark, tmp_path):
    path = put(tmp_path, "g.csv", "t,power_w\n1.5,80\n2.5,\n")
    rows = readers.read_csv(spark, path, "t DOUBLE, power_w DOUBLE")
    assert [(r.t, r.power_w) for r in rows.orderBy("t").collect()] == [(1.5, 80.0), (2.5, None)]
    bad = put(tmp_path, "bad.csv", "t,power_w\nx,80\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|cast"):
        readers.read_csv(spark, bad, "t DOUBLE, power_w DOUBLE").collect()


def test_first_rows_by_position(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).selectExpr("id", "id * 2 as twice").coalesce(1).write.parquet(path)
    rows = readers.read_first_rows(spark, path, ["twice"], 3)
    assert rows.columns == ["twice", "pos"] and sorted(r.twice for r in rows.collect()) == [0, 2, 4]


def test_suite_filter_only_where_rows_name_one(spark):
    named, bare = spark.createDataFrame([("a", 1), ("b", 2)], "suite string, x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert readers.of_suite(named, "a").count() == 1 and readers.of_suite(bare, "a").count() == 2


def test_log_lookups(spark, tmp_path):
    put(tmp_path, "logs/a.log", "load 7 MiB\nload 9 MiB\ngpu 3/5\n")
    put(tmp_path, "logs/b.log", "gpu 3/5\ngpu 4/5\n")
    lines = readers.read_lines(spark, str(tmp_path / "logs"))
    name = readers.path_part(F.col("file"), 1)
    assert {(r.n, r.value) for r in readers.first_match(lines, r"load (\d+) MiB").select(name.alias("n"), "value").collect()} == {("a.log", "7")}
    sole = {r.n: (r.n_values, r.value) for r in readers.sole_value(lines, r"gpu (\S+)").select(name.alias("n"), "n_values", "value").collect()}
    assert sole == {"a.log": (1, "3/5"), "b.log": (2, None)}


def test_events_by_kind(spark):
    rows = spark.createDataFrame([("load", 1, None), ("run", None, 2.0), (None, 3, 3.0)], "step string, mib int, s double")
    found = readers.by_kind(rows, "step")
    assert list(found) == ["load", "run"] and found["load"].columns == ["step", "mib"] and found["run"].columns == ["step", "s"]


def test_appended_rows_and_summary(spark, tmp_path):
    rows = spark.createDataFrame([("l", "s", True, 2.0, 10), ("l", "s", False, 4.0, None)], "label string, suite string, correct boolean, wall_s double, tokens int")
    path = str(tmp_path / "out")
    sinks.append_jsonl(rows, path)
    sinks.append_jsonl(rows, path)
    back = readers.read_jsonl(spark, path, "label STRING, correct BOOLEAN, wall_s DOUBLE")
    assert back.count() == 4
    summary = sinks.suite_summary(rows).first()
    assert (summary.n, summary.k, summary.mean_wall, summary.correct_per_minute) == (2, 1, 3.0, 10.0)
    cell = aggregates.cell_summary(rows, ["label"], F.col("correct"), F.col("wall_s"), F.col("tokens")).first()
    assert cell.mean_tokens == 10.0
    sinks.write_partitioned(rows, str(tmp_path / "parts"), ["suite"])
    assert spark.read.parquet(str(tmp_path / "parts")).where("suite = 's'").count() == 2
    assert json.loads(sinks.report_json(rows.limit(1)).first().value)["label"] == "l"
    sinks.write_csv(rows.select("wall_s", "tokens"), str(tmp_path / "csv"), {"wall_s": sinks.fixed(F.col("wall_s"), 3)})
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "csv")).collect())
    assert "2.000,10" in lines and "4.000," in lines


def test_positional_zip_and_members(spark):
    a, b = (spark.createDataFrame(rows, "pos int, x string") for rows in ([(0, "p"), (1, "q")], [(1, "q"), (2, "r")]))
    assert sorted((r.pos, r.x_a, r.x_b) for r in joins.positional_zip(a, b, "pos").collect()) == [(0, "p", None), (1, "q", "q"), (2, None, "r")]
    known = spark.createDataFrame([("q",), ("q",)], "x string")
    assert [r.x for r in joins.members(a, known, "x").collect()] == ["q"]


def test_short_and_long_items_by_containment(spark, monkeypatch):
    monkeypatch.setattr(joins, "AUTOMATON_CHARS", 6)
    text = "ab cd " * 30 + "é😀 end"
    items = [(1, "cd a"), (2, "é😀"), (3, "zz"), (4, text[7:90]), (5, ""), (6, None), (7, "end")]
    small, large = spark.createDataFrame(items, "i int, x string"), spark.createDataFrame([(10, text), (11, "end"), (12, None)], "j int, y string")
    want = {(i, j) for i, x in items for j, y in ((10, text), (11, "end")) if x and x in y}
    assert {(r.i, r.j) for r in joins.contains_join(small, large, "i", "j", "x", "y").collect()} == want


def test_strict_cells_and_whitelist(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, cell string")
    with pytest.raises(ValueError, match="fewer than 2"):
        selection.first_per_cell(rows, ["cell"], "s", ["k"], 2, strict=True)
    with pytest.raises(ValueError, match="no column z"):
        integrity.whitelist(rows, ["k", "z"])


def test_tolerance_redaction_and_verdict(spark):
    row = spark.range(1).select(
        integrity.close(F.lit(1.0), F.lit(1.05), 0.1).alias("near"),
        integrity.redact(F.lit("see /home/jo/x"), [r"/home/[a-z]+"]).alias("text"),
        pairing.verdict(F.lit(0.01), F.lit(0.2), 0.05).alias("verdict"),
        tx.last_code_block(F.lit("```py\na\n```\n```\nb\n```")).alias("code"),
        tx.low_confidence_share(F.array(F.lit(-0.1), F.lit(-1.0))).alias("low"),
    ).first()
    assert (row.near, row.text, row.verdict, row.code, row.low) == (True, "see [redacted]/x", "better", "b\n", 0.5)


def test_running_accuracy_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("s", True), ("s", False), ("t", True)], "suite string, correct boolean").coalesce(1).write.parquet(src)
    stream = telemetry.stream_table(spark, src, spark.read.parquet(src).schema)
    out = telemetry.run_updates(telemetry.running_accuracy(stream, ["suite"]), ["suite"], str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(r.suite, r.n, r.k, r.accuracy) for r in out.collect()} == {("s", 2, 1, 0.5), ("t", 1, 1, 1.0)}


def test_code_spans():
    # the quotes from the fence's last one on are one match, which begins in the fence and so doesn't count
    assert tx.strip_code_spans("a ```x\n``` b TypeError c `defg` d") == "a  b  c `defg` d"
    assert tx.strip_code_spans("a `defg` d KeyError") == "a  d "
    # a span around earlier ones counts, and takes their length from behind it, too
    assert tx.code_mask("`see KeyError` 12345678 tail") == [(0, 14), (5, 13)]
    assert tx.strip_code_spans("`see KeyError` 12345678 tail") == "8 tail"
