import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import aggregates, integrity, joins, segments, selection, timeseries
from pairwright.sources import readers, sinks
from pairwright.streaming import telemetry


def test_range_join_equals_nested_loop(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(0, 100)) for i in range(300)]
    spans = [(i, s := rng.uniform(0, 95), s + rng.uniform(0, 12)) for i in range(60)]
    a = spark.createDataFrame(points, "p int, t double")
    b = spark.createDataFrame(spans, "s int, t0 double, t1 double")
    got = sorted((r.p, r.s) for r in timeseries.range_join(a, b, "t", "t0", "t1", 5.0).collect())
    assert got == sorted((p, s) for p, t in points for s, t0, t1 in spans if t0 <= t <= t1)


def test_energy(spark):
    rows = spark.createDataFrame([("a", 0.0, 10.0), ("a", 2.0, 20.0), ("a", 3.0, 0.0), ("b", 5.0, 9.0)], "k string, t double, w double")
    out = {r.k: r for r in timeseries.energy(rows, "t", "w", ["k"]).collect()}
    assert out["a"].energy == 40.0 and out["a"].mean_power == pytest.approx(40 / 3)
    assert out["b"].energy == 0.0 and out["b"].mean_power is None


def test_gate_resets(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, None, 1, 1, 1, 9, 1])], "i int, v int").withColumn("k", F.lit(0))
    out = timeseries.consecutive(rows, F.col("v") < 5, ["i"], ["k"], 3).orderBy("i").collect()
    assert [r.streak for r in out] == [1, 2, 0, 1, 2, 3, 0, 1]
    assert [r.i for r in out if r.gate_open] == [5]


def test_latest_keeps_admitted_rows(spark):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False)], "k string, pos int, partial boolean")
    got = timeseries.latest(rows, ["k"], ["pos"], ~F.col("partial")).collect()
    assert sorted((r.k, r.pos) for r in got) == [("a", 1), ("b", 1)]


def test_nearest_rank_forms_agree(spark):
    values = [5, 1, 9, 7, 7, 3, 2]
    rows = spark.createDataFrame([(v,) for v in values], "v int").withColumn("k", F.lit("x"))
    small = rows.groupBy("k").agg(aggregates.nearest_rank("v", 0.5).alias("a"), aggregates.nearest_rank("v", 0.9).alias("b")).first()
    large = aggregates.nearest_rank_counts(rows, "v", ["k"], [0.5, 0.9]).first()
    want = [sorted(values)[min(6, int(p * 7))] for p in (0.5, 0.9)]
    assert [small.a, small.b] == want == [large.q50, large.q90]


def test_terciles_put_the_remainder_last(spark):
    rows = spark.range(500).withColumn("k", F.lit(0))
    sizes = {r.tercile: r.n for r in selection.terciles(rows, ["id"], ["k"]).groupBy("tercile").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 166, 1: 166, 2: 168}


def test_recovered_count(spark):
    rows = spark.createDataFrame([(0.72, 25), (0.333, 10)], "a double, n int")
    assert [r.k for r in rows.select(aggregates.recovered_count(F.col("a"), F.col("n")).alias("k")).collect()] == [18, None]


def test_budget_segments(spark):
    sizes = spark.createDataFrame([([3, 4, 5, 1, 1],)], "s array<bigint>")
    got = sizes.select(segments.budget_segments(F.col("s"), 7).alias("x")).first().x
    assert [(r.start, r.stop, r.chars) for r in got] == [(0, 2, 7), (2, 5, 7)]


def test_packing_drops_the_remainder(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (0, [9]), (2, [4, 5])], "i int, t array<int>")
    got = sorted((r.row_no, r.tokens) for r in segments.pack(rows, "i", "t", 4).collect())
    assert got == [(0, [9, 1, 2, 3])]


def test_packing_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(segments, "ROWS_PER_RANGE", 3)
    rows = spark.createDataFrame([(i * 7, list(range(i % 4))) for i in range(20)], "i int, t array<int>")
    flat = [x for i in range(20) for x in range(i % 4)]
    got = sorted((r.row_no, r.tokens) for r in segments.pack(rows, "i", "t", 4).collect())
    assert got == [(k, flat[4 * k : 4 * k + 4]) for k in range(len(flat) // 4)]


def test_leak_candidates_lose_nothing(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    small = [(i, text[s : s + 48] if i % 2 else "z" * 60) for i, s in enumerate(range(0, 400, 17))]
    a = spark.createDataFrame(small, "i int, x string")
    b = spark.createDataFrame([(0, text), (1, text[200:450])], "d int, y string")
    got = {(r.i, r.d) for r in joins.contains_join(a, b, "i", "d", "x", "y").collect()}
    assert got == {(i, d) for i, x in small for d, y in ((0, text), (1, text[200:450])) if x in y}


def test_nearest_position_ties_low(spark):
    marks = spark.createDataFrame([("a", 5)], "k string, m int")
    tokens = spark.createDataFrame([("a", 3, "x"), ("a", 7, "y"), ("a", 20, "z")], "k string, o int, v string")
    assert joins.nearest_position(marks, tokens, "k", "m", "o", "v").first().v == "x"


def test_checks_are_data(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "n int, s string")
    out = {r.name: (r.ok, r.n_bad) for r in integrity.check_rows(rows, {"n": F.col("n") > 0, "s": F.col("s") != ""}).collect()}
    assert out == {"n": (False, 1), "s": (True, 0)}
    assert integrity.forbidden_fields(spark.sql("select array(struct(1 as secret)) as x").schema, {"secret"}) == ["x[].secret"]
    bits = rows.select(integrity.has_bit(F.lit("0x0000000000000004"), 4).alias("x"), integrity.has_bit(F.lit("0x8"), 4).alias("y")).first()
    assert (bits.x, bits.y) == (True, False)


def test_manifest(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one")
    (tmp_path / "b").write_bytes(b"two")
    files = readers.file_digests(spark, str(tmp_path), f"{tmp_path}/")
    listed = files.where("path = 'a'").select("path", "sha256").unionAll(spark.createDataFrame([("c", "0"), ("b", "0")], "path string, sha256 string"))
    out = {r.path: r.status for r in integrity.verify_manifest(files, listed).collect()}
    assert out == {"a": "ok", "b": "changed", "c": "missing"}


def test_outcome_reader(spark, tmp_path):
    folder = tmp_path / "LABEL-1"
    folder.mkdir()
    (folder / "math25.jsonl").write_text('{"id": "m2", "correct": true}\n\n{"id": "m1", "correct": false, "wall_s": 2.5}\n')
    out = readers.read_outcomes(spark, str(tmp_path / "*" / "*.jsonl")).orderBy("pos").collect()
    assert [(r.label, r.suite, r.pos, r.id, r.correct, r.wall_s) for r in out] == [
        ("LABEL-1", "math25", 0, "m2", True, None),
        ("LABEL-1", "math25", 1, "m1", False, 2.5),
    ]
    (folder / "bad.jsonl").write_text('{"id": "x"}\n{"id": \n')
    bad = readers.bad_lines(spark, str(folder / "bad.jsonl"), readers.OUTCOME).collect()
    assert [r.line_no for r in bad] == [2]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        readers.read_jsonl(spark, str(folder / "bad.jsonl"), readers.OUTCOME).collect()


def test_log_readers(spark, tmp_path):
    (tmp_path / "log").write_text("x 12 tokens generated in\n 2.0 seconds (Generate: 6.0 T/s)\nslot | eval time = 500.0 ms / 10 tokens\nlayer a: 1\nlayer a: 2\n")
    rates = readers.generation_rates(spark, str(tmp_path / "log")).collect()
    assert sorted((r.tokens, r.seconds, r.rate) for r in rates) == [(10, 0.5, 20.0), (12, 2.0, 6.0)]
    lines = readers.read_lines(spark, str(tmp_path / "log"))
    assert [(r.key, r.value) for r in readers.last_per_key(lines, r"layer (\w+): (\d+)", 1, 2).collect()] == [("a", "2")]
    parsed = readers.metrics_lines(lines, {"n": r"([0-9,]+) tokens generated"}).where("n is not null").collect()
    assert [r.n for r in parsed] == [12.0]


def test_general_format(spark):
    values = [1.0, 0.5, 1234567.0, 0.00001234, 123.456, 0.0, None, 100.0, 0.000123]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.x for r in rows.select(sinks.general(F.col("v")).alias("x")).collect()]
    assert got == ["" if v is None else "%g" % v for v in values]


def test_selection(spark):
    assert selection.seeded_indices(42, 100, 5) == sorted(__import__("random").Random(42).sample(range(100), 5))
    rows = spark.range(60).withColumn("c", F.col("id") % 6).withColumn("g", F.lit(1))
    spread = selection.spread_over_clusters(rows, ["g"], "c", "s", ["id"], 6)
    assert spread.select("c").distinct().count() == 6


def test_streaming_gate_and_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, float(i), v) for i, v in enumerate([9.0, 9.0, 1.0, 9.0, 9.0, 9.0])]
    spark.createDataFrame(rows, "k bigint, t double, value double").coalesce(1).write.parquet(src)
    stream = telemetry.stream_table(spark, src, spark.read.parquet(src).schema)
    hot = telemetry.hot_streaks(stream, "k", "t", "value", 5.0, 3)
    telemetry.run_to_parquet(hot, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [(r.k, r.at, r.streak) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 5.0, 3)]
