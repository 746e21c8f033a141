"""Claim operators on small tables with odd cases: empty groups, missing sides, ties, nulls."""

import hashlib
import math
import os
import random
import re
import struct

from pyspark.sql import functions as F

from pairwright.functions import text as tx
from pairwright.operators import claims
from pairwright.plans import catalog
from pairwright.sources.readers import verify_log

from .oracle import TABLES, assert_same

DATA = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_reconciliation_names_each_case(spark):
    told = spark.createDataFrame([("whole", 4, 0.5), ("part", 4, 0.5), ("off", 2, 1.0), ("none", 3, 1 / 3), ("odd", 3, 0.4)], "k string, n bigint, accuracy double")
    rows = [("whole", c) for c in (True, False, True, False)] + [("part", True), ("off", True), ("off", False), ("odd", True)] + [("odd", False)] * 2
    got = claims.reconcile(told, spark.createDataFrame(rows, "k string, ok boolean"), ["k"], F.col("ok"))
    want = {("whole", "complete"), ("part", "partial"), ("off", "contradiction"), ("none", "no_rows"), ("odd", "contradiction")}
    assert set(rows_of(got, "k", "status")) == want


def test_comparison_record_says_why_there_is_no_pairing(spark):
    outcomes = spark.createDataFrame([(c, i, i % 2 == 0) for c in "xy" for i in range(6)] + [("z", 1, True)], "config string, item int, ok boolean")
    specs = spark.createDataFrame([("a", "x", "y"), ("b", "x", "z"), ("c", "x", "w")], "name string, config_a string, config_b string")
    got = {r.name: r for r in claims.comparison_records(specs, outcomes, "config", "item", F.col("ok")).collect()}
    assert (got["a"].unavailable, got["b"].unavailable, got["c"].unavailable) == (None, "items differ", "no rows")
    assert got["a"].mcnemar_p == 1.0 and got["b"].mcnemar_p is None and got["c"].fisher_p is None and got["b"].fisher_p is not None


def test_identity_by_both_denominators(spark):
    rows = [("g", "s", "s", 5, 5), ("g", "s", "t", 5, 6), ("g", None, "s", 0, 0), ("g", None, None, None, 2)]
    pairs = spark.createDataFrame(rows, "g string, a string, b string, x int, y int")
    r = claims.identity_rates(pairs, ["g"], "a", "b", "x", "y").first()
    assert (r.n_pairs, r.n_hashed, r.identity_hashed, r.identity_all, r.same_tokens_positive, r.same_tokens) == (4, 2, 0.5, 0.25, 1, 2)


def test_energy_and_scaling_guard_zero(spark):
    runs = spark.createDataFrame([("a", 100, 50.0, 10.0, 1.0), ("b", 100, 5.0, 10.0, 1.0), ("c", 1, 0.0, 0.0, 0.0)], "k string, n int, e double, span double, idle double")
    got = {r.k: r for r in claims.energy_rates(runs, "n", "e", "span", "idle").collect()}
    assert (got["a"].tokens_per_joule, got["a"].net_tokens_per_joule) == (2.0, 2.5)
    assert got["b"].net_tokens_per_joule is None and got["c"].tokens_per_joule is None
    rates = spark.createDataFrame([("d", 1, 40.0), ("d", 4, 90.0), ("u", 2, 5.0)], "k string, c int, r double")
    assert rows_of(claims.scaling(rates, ["k"], "c", "r"), "k", "scale", "per_stream") == [("d", 1.0, 40.0), ("d", 2.25, 22.5), ("u", None, 2.5)]


def test_order_kept_across_ranges(spark):
    before = spark.range(200_000).select(F.col("id").alias("k"), F.col("id").alias("pos"))
    moved = before.select("k", F.when(F.col("k") == 65_536, -1).otherwise(F.col("pos")).alias("pos"))
    assert claims.order_kept(before, before, "k", "pos").first().out_of_order == 0
    assert claims.order_kept(before, moved, "k", "pos").first().out_of_order == 1


def test_ordered_digest_prefixes_lengths(spark):
    rows = spark.createDataFrame([(1, 2, "é", None), (1, 1, "a", "bc"), (2, 1, "", "")], "g int, i int, x string, y string")
    frame = lambda *xs: b"".join(struct.pack(">Q", len(x.encode())) + x.encode() for x in xs)
    want = [(1, hashlib.sha256(frame("a", "bc", "é", "")).hexdigest()), (2, hashlib.sha256(frame("", "")).hexdigest())]
    assert rows_of(claims.ordered_digest(rows, ["g"], ["i"], ["x", "y"]), "g", "sha256") == want


def test_bands_chains_and_divergence(spark):
    bands = spark.createDataFrame([(None, 1.0, "low"), (1.0, None, "high")], "low double, high double, verdict string")
    values = spark.createDataFrame([(0.5,), (1.0,), (None,)], "v double")
    assert rows_of(claims.banded(values, "v", bands), "v", "verdict") == sorted([(0.5, "low"), (1.0, "high"), (None, None)], key=str)
    cells = spark.createDataFrame([("g", "O", 3.0), ("g", "A", 1.0), ("h", "O", 1.0), ("h", "A", 2.0), ("i", "O", 1.0)], "k string, c string, v double")
    assert rows_of(claims.ordered_values(cells, ["k"], "c", "v", ["O", "A"]), "k", "falls") == [("g", True), ("h", False), ("i", None)]
    rows = spark.createDataFrame([("g", 3, 0.1), ("g", 9, 5.0), ("g", None, 0.0)], "k string, place int, gap double")
    r = claims.divergence_summary(rows, ["k"], "place", "gap", 1.0).first()
    assert (r.n, r.diverged, r.median_place, r.near_tie_share) == (3, 2, 6.0, 0.5)


def test_log_findings(spark):
    def line(log, n, previous, x, spoil=""):
        body = f'{previous}\n{{"x":{x if x is not None else "null"}}}'
        return (log, n, previous, hashlib.sha256(body.encode()).hexdigest() + spoil, x)

    a1 = line("a", 1, "", 5)
    a2 = line("a", 2, a1[3], None)
    b1 = line("b", 1, "", 7, "x")
    c1 = line("c", 1, "zz", 8)
    rows = spark.createDataFrame([a1, a2, b1, c1], "log string, at int, previous string, checksum string, x int")
    heads = spark.createDataFrame([("a", 2, a2[3]), ("b", 1, "other"), ("c", 2, c1[3]), ("d", 1, "gone")], "log string, n bigint, checksum string")
    got = rows_of(verify_log(rows, "log", "at", "previous", "checksum", ["x"], heads), "log", "finding")
    assert got == [("b", "digest"), ("b", "head"), ("c", "link"), ("c", "torn"), ("d", "torn")]


def test_texts_of_values(spark):
    row = spark.range(1).select(
        tx.scientific(F.lit(3.2e-7)).alias("p"), tx.scientific(F.lit(0.0123)).alias("q"), tx.percent(F.lit(0.1234)).alias("s"),
        tx.gibibytes(F.lit(3 << 30)).alias("g"), tx.has_form(F.lit("a" * 40), "sha1").alias("sha"), tx.has_form(F.lit("gsm8k_7"), "item").alias("item"),
        tx.canonical_json(F.struct(F.lit(2).alias("b"), F.lit(None).cast("string").alias("a")), ["b", "a"]).alias("json"),
        tx.sentinel(F.lit("None"), F.lit("x")).alias("none"), tx.prompt("gsm8k_500", F.lit("why?")).alias("prompt"),
    ).first()
    assert (row.p, row.q, row.s, row.g) == ("3.2×10^-7", "0.012", "12.3%", "3.00 GiB")
    assert row.sha and row.item and row.json == '{"a":null,"b":2}' and row.none == "x" and row.prompt.endswith("\n\nwhy?")


def test_question_pairs_need_both_lines(spark):
    reply = "Q1: first?\nA1: one\nQ2: second?\nQ3:  third? \nA3: three"
    got = spark.range(1).select(F.inline(tx.question_pairs(F.lit(reply)))).collect()
    assert [tuple(r) for r in got] == [(1, "first?", "one"), (3, "third?", "three")]


def slow_pairs(reply, source):
    """The pairs by Python's own methods, with the source's normal form held against the answer's."""

    def form(value):
        return re.sub(r"\s+", " ", value.casefold()).strip().strip("\"'`.,:;")

    found = []
    for n, (question, answer) in enumerate(re.findall(r"Q\d\s*:\s*(.+?)\s*\nA\d\s*:\s*(.+?)(?:\n|$)", reply)[:2], 1):
        question, answer = question.strip(), answer.strip()
        sound = 13 <= len(question) <= 500 and 2 <= len(answer) <= 80 and len(answer.split()) <= 8 and form(answer)
        if sound and answer in source and form(answer) in form(source):
            found.append((n, question, answer))
    return found


def test_verified_pairs_are_pythons(spark):
    rng = random.Random(4)
    gaps = ["", "", " ", "\n", "\r\n", "\t", "\xa0", "\u2028", "\x1c ", "  "]
    words = ["ΑΣ", "Straße", "ﬁx", "İ", "...", "'", '"so"', "x", "one", "Q1:", "A2: ", "😀", "w" * 30, "b;"]

    def gap():
        return rng.choice(gaps)

    rows = []
    for _ in range(1500):
        source = "".join(rng.choice(words) + rng.choice(gaps[2:]) for _ in range(rng.randrange(14)))
        reply = gap() + "Well."
        for n in range(rng.randrange(4)):
            at, size = rng.randrange(len(source) or 1), rng.choice([1, 2, 5, 9, 20, 82])
            answer = source[at : at + size] if rng.random() < 0.9 else "nowhere"
            question = rng.choice(["and what comes then?", "is it what it was?", "too short", "q" * 501, ""])
            mark = rng.choice(["1", "٢", "12"]) if rng.random() < 0.2 else str(n)
            line = rng.choice(["\n", "\n", "\r\n", "\t\n", " \n", "\n\n", ""])
            reply += f"{rng.choice([chr(10), gap()])}Q{mark}{gap()}:{gap()}{question}{line}A{mark}{gap()}:{gap()}{answer}{gap()}"
        rows.append((len(rows), reply, source))
    rows += [(len(rows), "Q1: and what comes then?\nA1: it\n", None), (len(rows) + 1, None, "it")]
    df = spark.createDataFrame(rows, "i int, r string, s string").select("i", F.inline(tx.verified_pairs("r", "s")))
    want = [(i, *pair) for i, r, s in rows if r is not None and s is not None for pair in slow_pairs(r, s)]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and len(want) > 200
    assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_verified_pairs_of_odd_texts_equal_sql(spark, tmp_path):
    texts = [
        None, "", "  ", "two words", "\tone two\tTWO TWO\tX", "one\r\ntwo three\r", "so it ... goes", "' ' ''", "\xa0a\u2028b c\x1c d", "a b c C CX", "a b c nowhere at all",
        "Q1: A1: Q2 : A2: x", "one  two three", "one\ntwo three", "w" * 79 + " v w", "w" * 78 + " v w", "a " + "\t".join("bcdefghijk") + " \tk", "😀 😀 😀😀",
    ]
    rows = [(conv, turn, "user", text) for text in texts for conv in (-1, 0, 1, 2, None) for turn in (1, None, 10**18)]
    for name in TABLES:
        if name != "conversations":
            os.symlink(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert_same(catalog.QUERIES["verified_pairs"](spark, str(tmp_path)), catalog.ORACLE_SQL["verified_pairs"], str(tmp_path))


def test_error_records(spark):
    texts = [None, "", '{"kind":"http","status":503,"attempts":1}', '{"kind":"http","status":503,"exception":"E","attempts":1}', '{"kind":"exception","exception":"E","attempts":0}', '{"kind":"x"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c.reason for r in df.select("i", claims.error_contract(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [None, "not a record", None, "both kinds", "no attempts", "unknown kind"]


def test_hazard_and_means(spark):
    from pairwright.operators import aggregates

    r = spark.range(1).select(aggregates.hazard(F.lit(1), F.lit(4), F.lit(2.0)).alias("h")).first()
    assert math.isclose(r.h, -math.log(0.25) / 2)
    rows = spark.createDataFrame([("g", [1.0, 3.0]), ("g", [2.0, None, 7.0])], "k string, v array<double>")
    assert rows_of(claims.position_means(rows, ["k"], "v"), "place", "n", "mean") == [(0, 2, 1.5), (1, 1, 3.0), (2, 1, 7.0)]
