import math
import random

import numpy as np

from pairwright.llm.ann import Index, nearest_neighbours


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8:
            good.setdefault(i, np.array(v, dtype=np.float32).astype(float))
    out = {}
    for q, v in good.items():
        if q % every == 0:
            scored = sorted(((-(v * w).sum(), i) for i, w in good.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def vectors(n=400, seed=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)]
    same = rows[3][1]
    rows += [(i, list(same)) for i in range(n, n + 90)]  # a large group of copies
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as node", "2 as cell", "'x' as query")
    out = {}
    for r in nearest_neighbours(df, **options).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(x)] for q, x in out.items()}


def test_recall_ties_and_odd_vectors(spark):
    odd = [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [1.0] * 5), (1080, [float("nan")] + [1.0] * 7), (1100, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows = vectors() + odd + [(20, vectors()[20][1])]
    got, want = run(spark, rows), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert sum(hits) / len(hits) >= 0.9
    for q, found in got.items():
        assert len(found) == 20 and q not in {v for v, _ in found}
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    copies = [q for q in got if q >= 400]
    assert copies and all(got[q] == want[q] for q in copies)  # ties go to smaller ids


def test_fewer_candidates_than_k(spark):
    rows = vectors(6)[:6]
    assert {q: len(x) for q, x in run(spark, rows).items()} == {0: 5}


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(20, None)]) == {}


def test_distance_tables_equal_decoded_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    index = Index.train(x, 6, 20)
    cell, codes = index.encode(x)
    rows = np.flatnonzero(cell == cell[0])
    decoded = np.concatenate([w[codes[rows, m]] for m, w in enumerate(index.codewords)], axis=1) + index.centroids[cell[0]]
    assert np.allclose(index.approximate(x[:5], int(cell[0]), codes[rows]), x[:5] @ decoded.T)


def test_recall_of_queries_unlike_the_other_rows(spark):
    g = np.random.default_rng(1)
    centres = g.normal(size=(45, 16))
    x = centres[g.integers(0, 45, 2000)] + 0.05 * g.normal(size=(2000, 16))
    x[::20] = g.normal(size=(100, 16))
    scores = x[::20] @ x.T
    scores[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>")
    got = {}
    for r in nearest_neighbours(rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[20 * i] & set(best)) / 20 for i, best in enumerate(want.tolist())]) >= 0.95
