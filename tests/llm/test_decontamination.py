import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pairwright.llm import decontamination as d

from .messy import documents, empty_documents, prose, texts


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(text, items, width=10):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - width + 1) if v else 0):
            piece = v[i : i + width]
            for j in range(len(w) - len(piece) + 1):
                if w[j : j + len(piece)] == piece:
                    hit.update(range(j, j + len(piece)))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, prose(1, 14)), (10, prose(1, 40)), (2, "Two, WORDS!"), (3, ""), (4, None), (5, "ünï çødé ﬀ"), (6, prose(103, 60)), (7, "absent words here"), (2, "one")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_contract(spark):
    got = sorted(tuple(r)[:6] for r in d.contamination(documents(spark), bench(spark)).fillna(-1, ["doc_id"]).collect())
    assert got == sorted((-1 if i is None else i, *slow(t, ITEMS)) for i, t in texts())


def slow_near(text, items, slop=5):
    """Items with a window whose words occur in order within its length and ``slop`` words."""
    w, out = words(text), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            piece = v[i : i + 10]
            for start in (k for k, x in enumerate(w) if x == piece[0]):
                at = start
                for x in piece[1:]:
                    at = next((k for k in range(at + 1, min(len(w), start + len(piece) + slop)) if w[k] == x), None)
                    if at is None:
                        break
                if at is not None:
                    out.add(str(item))
    return sorted(out)


def test_against_brute_force_over_few_words(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice("abcd") + rng.choice("xy") for _ in range(n))
    items = [(i, line(rng.choice((3, 9, 10, 11, 14)))) for i in range(12)] + [(90, None), (91, "?!")]
    rows = [(i, line(60)) for i in range(40)]
    for i, (_, t) in enumerate(items[:12]):  # whole items with words put in or left out
        w = t.split()
        rows += [(100 + i, " ".join([line(5), *w[: len(w) // 2], "zz", *w[len(w) // 2 :], line(5)])), (200 + i, f"q {t} q {t}"), (200 + i, f"q {t} q {t}")]
    got = {(r.doc_id, tuple(r.near_items)) + tuple(r)[1:6] for r in d.contamination(documents(spark, rows), bench(spark, items)).collect()}
    assert got == {(i, tuple(slow_near(t, items)), *slow(t, items)) for i, t in rows}


def test_passages_keep_all_columns(spark):
    docs = documents(spark).withColumn("h1", F.lit("h")).withColumn("runs", F.lit(3))
    found = d.find_passages(docs, bench(spark))
    assert found.select("in.*").columns == docs.columns and found.count() == docs.count()
    assert d.drop_contaminated(docs, bench(spark)).columns == docs.columns


def test_proximity_needs_order_and_nearness(spark):
    item = [(1, "a1 b1 c1 d1 e1 f1 g1 h1 i1 j1")]
    rows = [
        (1, "a1 b1 x c1 d1 e1 f1 y g1 h1 i1 j1"),
        (2, "a1 b1 c1 d1 e1 x x x x x x x f1 g1 h1 i1 j1"),
        (3, "j1 i1 h1 g1 f1 e1 d1 c1 b1 a1"),
    ]
    got = {r.doc_id: (r.n_near, r.contaminated) for r in d.contamination(documents(spark, rows), bench(spark, item)).collect()}
    assert got == {1: (1, False), 2: (0, False), 3: (0, False)}


def test_proximity_searches_every_window(spark):
    v = [f"w{i}" for i in range(19)]
    items = [(n, " ".join(x + f"of{n}" for x in v[:n])) for n in range(11, 20)]
    rows = []
    for n, text in items:  # the last ten words of the item, with another word among them
        w = text.split()[-10:]
        rows.append((n, " ".join([*w[:5], "x", *w[5:]])))
    got = d.contamination(documents(spark, rows), bench(spark, items)).collect()
    assert {r.doc_id: (r.near_items, r.n_near, r.contaminated) for r in got} == {n: ([str(n)], 1, False) for n, _ in items}


def test_dropping(spark):
    docs = documents(spark)
    out = d.drop_contaminated(docs, bench(spark))
    assert out.columns == docs.columns
    clean = [i for i, t in texts() if not slow(t, ITEMS)[4]]
    assert sorted((r.doc_id or -1) for r in out.collect()) == sorted((i or -1) for i in clean)
    assert {r["items"] for r in out.collect()} == {"x"}


def test_empty(spark):
    assert d.contamination(empty_documents(spark), bench(spark)).count() == 0
    assert d.contamination(documents(spark), bench(spark, [])).where("contaminated").count() == 0


@pytest.mark.parametrize("width", [62, 63, 64, 70, 130])
def test_long_windows(spark, width):
    """Windows of any length, beside items of fewer words."""
    items = [(1, prose(300, 80)), (2, prose(301, 140)), (3, prose(302, 65)), (4, prose(303, 3))]
    rows = [(1, "x " + prose(300, 80) + " y"), (2, prose(301, 140)), (3, "a " + prose(302, 65)), (4, prose(303, 3)), (5, prose(300, 60)), (6, prose(304, 300))]
    got = sorted(tuple(r)[:6] for r in d.contamination(documents(spark, rows), bench(spark, items), window=width).collect())
    assert got == sorted((i, *slow(t, items, width)) for i, t in rows)
    assert sum(r[5] for r in got) >= 3


def test_finder_equals_a_dictionary():
    rng = random.Random(12)
    pool = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 40]))) for _ in range(400)]
    listed = sorted({w for t in pool[:200] for w in d.words(t.encode())})
    # same ends and length as a listed word, another middle
    pool += [w[:8].decode("utf-8", "ignore") + "zz" + w[-9:].decode("utf-8", "ignore") for w in listed if len(w) > 19]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))).encode() for _ in range(50)] + [b"", b" ", b"X"]
    number = {w: i for i, w in enumerate(listed)}
    sizes, ids = d.Finder(listed).find(texts)
    assert sizes.tolist() == [len(d.words(t)) for t in texts]
    assert ids.tolist() == [number.get(w, -1) for t in texts for w in d.words(t)] and (ids >= 0).any() and (ids < 0).any()
    assert (d.Finder([]).find(texts)[1] == -1).all()
