"""Ordered folds, nearest positions and canonical JSON against plain Python."""

import hashlib
import json
import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwright.functions.canonical import canonical, row_digest
from pairwright.operators import folds, joins, segments


def test_digests(spark):
    rng = random.Random(3)
    rows = [(g, k, f"text {rng.random()}") for g in ("a", "b", None) for k in range(300)] + [("a", 5, None), ("c", 1, "x")]
    df = spark.createDataFrame(rows, "g string, k int, t string").withColumn("data", F.coalesce("t", F.lit("")).cast("binary")).repartition(7)
    got = {r.g: (r.n, r.sha256) for r in folds.ordered_digests(df, ["g"], ["k"], "data", b"|").collect()}
    for g in ("a", "b", None, "c"):
        own = sorted((k, (t or "").encode()) for h, k, t in rows if h == g)
        assert got[g] == (len(own), hashlib.sha256(b"|".join(x for _, x in own)).hexdigest())
    keys = {r.g: (r.n, r.sha256) for r in folds.set_digests(df, ["g"], "k").collect()}
    assert keys["a"] == (300, hashlib.sha256("\n".join(sorted(str(k) for k in range(300))).encode()).hexdigest())


def test_memory_does_not_grow_with_a_group():
    """A group of 100 times the rows takes no more memory."""

    def peak(n):
        schema = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("sha256", pa.string())])

        def batches():
            for _ in range(n):
                yield pa.RecordBatch.from_arrays([pa.array([1] * 500), pa.array([b"x" * 100] * 500)], ["g", "data"])

        tracemalloc.start()
        list(folds.stream_fold(batches(), 1, folds.Digest, schema))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    peak(2)
    assert peak(400) < 1.5 * peak(4)


def test_segments_of_a_long_conversation(spark):
    rng = random.Random(9)
    turns = [(1, k, "w" * rng.randrange(0, 50)) for k in range(4000)] + [(2, 0, "short"), (2, 1, None)]
    df = spark.createDataFrame(turns, "conv long, turn long, text string")
    got = sorted(tuple(r) for r in segments.segment_turns(df, "conv", "turn", "text", {"S": 90, "L": 1000}).collect())
    want = []
    for conv in (1, 2):
        for name, budget in (("L", 1000), ("S", 90)):
            start, held = 0, []
            own = [t or "" for c, _, t in turns if c == conv]
            for k, text in enumerate([*own, None]):
                if text is not None:
                    held.append(text)
                if text is None or sum(map(len, held)) >= budget:
                    if len(held) >= 3 and sum(map(len, held)) >= 0.6 * budget:
                        want.append((conv, name, start, start + len(held), len(held), "\n\n".join(held).strip(" ")))
                    start, held = k + 1, []
    assert got == sorted(want) and len(got) > 500


def test_chained_log(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 7, "c")], "log int, pos int, body string")
    got = {(r.log, r["at"]): (r.link, r["sum"]) for r in folds.chained_log(df, ["log"], "pos", "body").collect()}
    first = hashlib.sha256(b"\na").hexdigest()
    assert got[1, 1] == ("", first) and got[1, 2] == (first, hashlib.sha256(f"{first}\nb".encode()).hexdigest()) and got[2, 7][0] == ""


def test_nearest_position_by_brute_force(spark):
    rng = random.Random(8)
    marks = [(rng.choice("abc"), rng.randrange(60)) for _ in range(150)] + [("d", 3), ("a", None)]
    tokens = [(rng.choice("ab"), rng.randrange(0, 60, 3), f"t{k}") for k in range(60)] + [("c", 40, "only"), ("a", None, "null")]
    got = joins.nearest_position(
        spark.createDataFrame(marks, "k string, m int"), spark.createDataFrame(tokens, "k string, o int, v string"), "k", "m", "o", "v"
    )
    want = set()
    for k, m in marks:
        near = sorted((abs(m - o), o, v) for h, o, v in tokens if h == k and o is not None) if m is not None else []
        want |= {(k, m, *near[0][1:])} if near else set()
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_canonical_json(spark):
    rows = [
        ("é \"\\\n\t\b\f\r\x00\x1f\x7f/😀", 7, [1.0, -0.0, 1e16, 1.5e-5, 123456.789, 0.0001, 1e22, 5e-324, 1.7976931348623157e308, 100.0, 12345678901234567.0], {"b": [{"z": None, "a": True}], "a": [], "é": None}, ({"y": 2}, None)),
        (None, None, None, None, None),
        ("", -(1 << 62), [], {}, (None, [[1.25], [], None])),
    ]
    df = spark.createDataFrame(rows, "s string, n long, d array<double>, m map<string,array<struct<z:string,a:boolean>>>, t struct<b:map<string,int>,a:array<array<double>>>")

    def dumps(value):
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    got = df.select(canonical(F.struct("*"), df.schema).alias("j"), row_digest(df, df.columns).alias("h")).collect()
    for row, r in zip(rows, got):
        s, n, d, m, t = row
        plain = {"s": s, "n": n, "d": d, "m": m, "t": None if t is None else {"b": t[0], "a": t[1]}}
        assert r.j == dumps(plain) and r.h == hashlib.sha256(dumps(plain).encode()).hexdigest()


def test_canonical_numbers(spark):
    rng = random.Random(2)
    values = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-25, 25) for _ in range(3000)] + [float(rng.randrange(1 << 53)) for _ in range(500)]
    values += [math.inf, -math.inf, math.nan, 9999999999999998.0, 1e15, 0.001, 0.00012]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(canonical(F.col("x"), df.schema["x"].dataType)).collect()]
    assert [(v, g) for v, g in zip(values, got) if g != json.dumps(v)] == []


@pytest.mark.parametrize("order", [["k"], []])
def test_empty(spark, order):
    df = spark.createDataFrame([], "g string, k int, data binary")
    assert folds.ordered_digests(df, ["g"], order, "data").count() == 0
