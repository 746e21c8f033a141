"""Greedy quotas, case folding, normalised containment and early exits against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pairwright.functions.folding import casefold, normalized, survival_form
from pairwright.operators import folds, joins, selection
from pairwright.plans import sequences


def test_case_folding_is_pythons(spark):
    chars = [chr(c) for c in range(32, 0x11000) if not 0xD800 <= c < 0xE000] + ["ΑΣ", "ΑΣ Β", "Straße", "ẞ", "ﬁﬀﬃ", "İI", "😀É"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = df.select("c", casefold(F.col("c")).alias("f")).collect()
    wrong = [(r.c, r.f, r.c.casefold()) for r in got if r.f != r.c.casefold()]
    # characters of a later Unicode version than this Python's
    assert all(unicodedata.category(c) == "Cn" for c, *_ in wrong), wrong[:5]


def slow_form(value):
    return re.sub(r"\s+", " ", value.casefold()).strip().strip("\"'`.,:;!?()[]{}")


def test_forms(spark):
    texts = ["  A\t\nB  ", "(“Straße”!) ", " x\xa0y　", "'`. ,", "", "ΣΑΣ\x1c\x1dend?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", normalized(F.col("t")).alias("n"), survival_form(F.col("t")).alias("s")).collect()
    assert [(r.n, r.s) for r in got] == [(re.sub(r"\s+", " ", t.casefold()).strip(), slow_form(t)) for t in texts]


@pytest.mark.parametrize("limit", [1 << 19, 200])
def test_normalised_containment(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "AUTOMATON_CHARS", limit)
    rng = random.Random(6)
    docs = [(k, "".join(rng.choice("abcß .,\n\tÉ") for _ in range(rng.randrange(400)))) for k in range(25)] + [(99, None), (98, "")]
    items = []
    for k in range(90):
        source = docs[rng.randrange(25)][1] or "x"
        at, size = rng.randrange(len(source) or 1), 1 + k % 75
        items.append((k, f"({source[at : at + size].upper().replace(' ', '  ')}!"))
    items += [(200, ""), (201, None), (202, "?!"), (203, "zz")]
    small, large = spark.createDataFrame(items, "i int, x string"), spark.createDataFrame(docs, "d int, y string")
    got = joins.contains_join(small, large, "i", "d", "x", "y", form=survival_form).collect()
    want = {(i, d) for i, x in items for d, y in docs if x is not None and y is not None and slow_form(x) and slow_form(x) in slow_form(y)}
    assert {(r.i, r.d) for r in got} == want and len(got) == len(want) and len(want) > 100


def test_leak_audit(spark):
    rng = random.Random(16)
    plain = lambda t: re.sub(r"\s+", " ", t.casefold()).strip()
    docs = [(k, "".join(rng.choice("abc  d7É\n") for _ in range(600))) for k in range(12)]
    items = [(k, docs[k % 12][1][k : k + 5 + k % 80].upper() + ("zq" * 30 if k % 7 == 0 else "")) for k in range(120)]
    got = joins.leak_audit(spark.createDataFrame(items, "i int, x string"), spark.createDataFrame(docs, "d int, y string"), "i", "d", "x", "y").collect()
    want = set()
    for i, x in items:
        n = plain(x)
        for d, y in docs:
            y = plain(y)
            if len(n) >= 48 and any(n[s : s + 48] in y for s in range(len(n) - 47)):
                want.add((i, d, "grams"))
            telling = len(n) >= 20 or (len(n) >= 12 and (any(c.isdigit() for c in n) or len(n.split()) >= 3))
            if len(n) < 48 and telling and n in y:
                want.add((i, d, "whole"))
    assert {tuple(r) for r in got} == want and {k for *_, k in want} == {"grams", "whole"}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_quota_equals_the_greedy_on_all_rows(spark, seed):
    rng = random.Random(seed)
    clusters = {w: rng.randrange(1 + 9 * seed) for w in range(150)}
    rows = [(k, rng.choice("abc"), w, clusters[w]) for k in range(500) for w in [rng.randrange(150)]]
    df = spark.createDataFrame(rows, "id long, s string, w long, c long")
    quotas = {"b": 7, "a": 4, "c": 11}
    ranks = {r.id: r.h for r in df.select("id", selection.hash_order("seed", "id").alias("h")).collect()}
    full = selection.greedy_quota([(s, (ranks[k], k), w, c) for k, s, w, c in rows], list(quotas), quotas)
    got = selection.distinct_cluster_quota(df, "s", "w", "c", "seed", ["id"], quotas, strict=False).orderBy("place").collect()
    assert [(r.id, r.place, r.phase) for r in got] == [(row[1][1], n + 1, phase) for n, (row, phase) in enumerate(full)]
    assert {phase for _, phase in full} == ({"distinct", "fill"} if seed < 2 else {p for _, p in full})


def test_greedy_quota_checks(spark):
    df = spark.createDataFrame([(1, "a", 1, 1), (2, "a", 1, 2)], "id long, s string, w long, c long")
    with pytest.raises(ValueError, match="more than one cluster"):
        selection.distinct_cluster_quota(df, "s", "w", "c", "x", ["id"], {"a": 1})
    with pytest.raises(ValueError, match="quotas ask for 3"):
        selection.distinct_cluster_quota(df.where("c = 1"), "s", "w", "c", "x", ["id"], {"a": 3})


def exits(segments, **rule):
    fold = folds.EarlyExit(folds.ExitRule(**{"budget": 100, "threshold": 0.9, "probe_tokens": 5, **rule}))
    for s in segments:
        fold.step(*s)
    return fold.close()[0]


@pytest.mark.parametrize(
    "segments, rule, want",
    [
        ([(10, True, False, 0.95, "x")], {}, ("early_exit", 15, 1, 1)),
        ([(10, True, False, 0.5, "x"), (10, True, False, 0.95, "x")], {"gap": 20}, ("eos", 25, 1, 2)),
        ([(10, True, False, 0.5, "x"), (30, True, False, 0.95, "x")], {"gap": 20}, ("early_exit", 50, 2, 2)),
        ([(10, True, False, 0.95, "x")], {"least": 11}, ("eos", 10, 0, 1)),
        ([(10, False, False, None, None), (10, False, True, None, None)], {}, ("natural", 20, 0, 2)),
        ([(70, False, False, None, None), (70, False, False, None, None)], {}, ("budget", 100, 0, 2)),
        ([(70, False, False, None, None), (70, False, False, None, None)], {"force_share": 0.8}, ("forced_exit", 85, 1, 2)),
        ([(10, True, False, 0.91, "x"), (10, True, False, 0.91, "x")], {"rule": "consistent", "high": 0.99}, ("early_exit", 30, 2, 2)),
        ([(10, True, False, 0.91, "x"), (10, True, False, 0.91, "y")], {"rule": "consistent", "high": 0.99}, ("eos", 30, 2, 2)),
        ([], {}, ("eos", 0, 0, 0)),
    ],
)
def test_early_exit(segments, rule, want):
    assert exits(segments, **rule) == want


def test_the_query_meets_several_ends(spark):
    found = {r.exit for r in sequences.early_exits(spark, "/root/testdata/sf0.01").select("exit").distinct().collect()}
    assert {"early_exit", "natural", "eos"} <= found


def test_normal_forms_are_computed_once(spark):
    items = spark.createDataFrame([(1, "GRÜSSE an die  ganze Straße"), (2, "x" * 60)], "i int, x string")
    docs = spark.createDataFrame([(7, "oh, grüße AN die ganze\tSTRASSE!"), (8, None), (9, "y" + "X" * 60)], "d int, y string")
    for found in (joins.leak_audit(items, docs, "i", "d", "x", "y"), joins.contains_join(items, docs, "i", "d", "x", "y", form=survival_form)):
        plan = found._jdf.queryExecution().toString()
        assert "_normalized" not in plan and "regexp_replace" not in plan
        assert sorted((r.i, r.d) for r in found.collect()) == [(1, 7), (2, 9)]
