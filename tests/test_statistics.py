import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairwright.functions import statistics as S
from pairwright.operators import clustered, pairing


@pytest.mark.parametrize("b, c, p", [(9, 0, 0.00390625), (0, 7, 0.015625), (4, 11, 0.11846923828125), (0, 0, 1.0), (5, 5, 1.0)])
def test_mcnemar(b, c, p):
    assert S.binomial_two_sided_exact(b, c) == p


def test_mcnemar_beyond_double_range():
    assert 0 < S.binomial_two_sided_exact(900, 1200) < 1e-9


@pytest.mark.parametrize(
    "table, p",
    [((16, 9, 23, 2), 0.037430), ((14, 6, 18, 2), 0.235116), ((30, 15, 41, 4), 0.008597), ((9, 16, 2, 23), 0.037430)],
)
def test_fisher(table, p):
    assert S.fisher_exact(*table) == pytest.approx(p, abs=1e-6)


@given(st.tuples(*[st.integers(0, 8)] * 4))
def test_fisher_against_fractions(t):
    a, b, c, d = t
    n, r, k = a + b + c + d, a + b, a + c
    prob = {
        x: Fraction(math.comb(r, x) * math.comb(n - r, k - x), math.comb(n, k))
        for x in range(max(0, k - (n - r)), min(r, k) + 1)
    }
    assert S.fisher_exact(*t) == pytest.approx(float(sum(p for p in prob.values() if p <= prob[a])))


@pytest.mark.parametrize(
    "df, t", [(2.6033, 3.475186228426227), (5, 2.570581835636314), (20, 2.0859634472658364), (60, 2.00029782201426)]
)
def test_t_critical(df, t):
    assert S.t_critical(df) == pytest.approx(t, rel=1e-10)


def test_student_t_known_points():
    assert S.student_t_two_sided(1, 1) == pytest.approx(0.5)
    assert S.student_t_two_sided(2, 2) == pytest.approx(1 - 2 / math.sqrt(6))
    assert S.student_t_two_sided(1.96, 1e7) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-5)


def test_sign_flip():
    assert S.sign_flip_exact([1] * 6) == 2 / 64
    assert S.sign_flip_exact([0, 0]) == 1.0
    assert S.sign_flip_exact([3, -1, 2]) == 4 / 8


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-4, 4), min_size=1, max_size=9))
def test_sign_flip_by_enumeration(sums):
    total = abs(sum(sums))
    flips = [sum(s if m >> i & 1 else -s for i, s in enumerate(sums)) for m in range(1 << len(sums))]
    assert S.sign_flip_exact(sums) == pytest.approx(sum(abs(f) >= total for f in flips) / len(flips))


def test_wilson_edges(spark):
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (3, 7)], "k int, n int")
    out = rows.select("k", "n", S.wilson("k", "n").alias("w"), S.wilson("k", "n", empty="zero").alias("z")).collect()
    assert out[0].w.low is None and out[0].z.low == 0.0
    assert out[1].w.low == 0.0 and out[2].w.high == pytest.approx(1.0)
    assert 0 < out[3].w.low < 3 / 7 < out[3].w.high < 1


def test_newcombe_without_discordance(spark):
    rows = spark.createDataFrame([(10, 0, 0, 0), (4, 1, 2, 3)], "e int, f int, g int, h int")
    first, second = [r.x for r in rows.select(S.newcombe_paired("e", "f", "g", "h").alias("x")).collect()]
    assert first.phi == 0.0 and first.diff == 0.0 and first.low < 0 < first.high
    assert second.diff == pytest.approx(-0.1) and second.low < -0.1 < second.high


def matrix_cr2(sizes, values):
    """Variance and df by the matrix definition."""
    import numpy as np

    n = sum(sizes)
    mean = sum(map(sum, values)) / n
    h = [s / n for s in sizes]
    v = sum((sum(x) - len(x) * mean) ** 2 / (1 - k) for x, k in zip(values, h)) / n**2
    g = np.zeros((len(sizes), len(sizes)))
    for i, a in enumerate(h):
        for j, b in enumerate(h):
            own = a * n * (i == j) - a * b * n
            g[i, j] = own / math.sqrt((1 - a) * (1 - b))
    return v, np.trace(g) ** 2 / (g**2).sum()


def test_cr2_against_matrix_form(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for family in range(25):
        values = [[rng.choice((-1, 0, 1, 2)) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(3, 12))]
        rows += [(family, i, v) for i, x in enumerate(values) for v in x]
        want[family] = matrix_cr2([len(x) for x in values], values)
    df = spark.createDataFrame(rows, "family int, cluster int, z int")
    fitted = clustered.cr2(clustered.cluster_sums(df, F.col("z"), "cluster", ["family"]), ["family"])
    for r in fitted.collect():
        assert (r.variance, r.df) == pytest.approx(want[r.family])


@pytest.mark.parametrize(
    "sizes, df", [([2] * 56 + [1] * 5, 58.77738950065), ([2] * 59 + [1] * 2, 59.50423758990), ([2] * 10, 9.0)]
)
def test_satterthwaite(spark, sizes, df):
    rows = spark.createDataFrame([(s, 0) for s in sizes], "n_g long, s_g long")
    assert clustered.cr2(rows).first().df == pytest.approx(df, abs=1e-9)


def test_inference_policies(spark):
    zero = spark.createDataFrame([(2, 0)] * 8, "n_g long, s_g long")
    one = spark.createDataFrame([(2, 2)] * 8, "n_g long, s_g long")
    few = spark.createDataFrame([(2, 1)] * 2, "n_g long, s_g long")
    a, b, c = (clustered.inference(clustered.cr2(x)).first() for x in (zero, one, few))
    assert (a.p_cr2, a.ci_low, a.ci_high) == (1.0, 0.0, 0.0)
    assert b.p_cr2 is None and b.ci_low is None
    assert c.variance is None and c.p_cr2 is None


def test_histogram_rebuilds_clusters(spark):
    rows = spark.createDataFrame([(2, 1), (2, 1), (3, 0)], "n_g long, s_g long")
    back = clustered.from_histogram(clustered.histogram(rows))
    assert sorted(map(tuple, back.collect())) == [(2, 1), (2, 1), (3, 0)]


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "k string, p double")
    out = {r.k: (round(r.p_holm, 10), r.holm_reject) for r in pairing.holm(rows, "p", "k").collect()}
    assert out == {"d": (0.02, True), "a": (0.03, True), "c": (0.06, False), "b": (0.06, False)}


def test_strict_pairing_fails_closed(spark):
    a = spark.createDataFrame([("x", True), ("y", False)], "id string, correct boolean")
    b = spark.createDataFrame([("x", True)], "id string, correct boolean")
    with pytest.raises(ValueError, match="key sets differ"):
        pairing.strict_paired(a, b)
    with pytest.raises(ValueError, match="repeat"):
        pairing.strict_paired(a, a.unionAll(b))
    assert pairing.strict_paired(a, a).count() == 2


def test_errors_drop_the_pair(spark):
    a = spark.createDataFrame([("x", True, None), ("y", False, True)], "id string, correct boolean, errored boolean")
    b = spark.createDataFrame([("x", True, False), ("y", False, False)], "id string, correct boolean, errored boolean")
    assert [r.id for r in pairing.paired(a, b, drop_errors="errored").collect()] == ["x"]


@pytest.mark.parametrize("seed", range(5))
def test_fisher_walks_to_the_same_sum(seed):
    rng = random.Random(seed)
    for _ in range(60):
        t = [rng.randrange(0, 40) for _ in range(4)]
        row, column, total = t[0] + t[1], t[0] + t[2], sum(t)
        ways = [math.comb(row, x) * math.comb(total - row, column - x) for x in range(max(0, column - total + row), min(row, column) + 1)]
        here = math.comb(row, t[0]) * math.comb(total - row, column - t[0])
        assert S.fisher_exact(*t) == (sum(w for w in ways if w <= here) / math.comb(total, column) if total else 1.0)


def test_exact_tests_at_scale():
    """100,000 items a side and 10,000 clusters take seconds."""
    began = time.time()
    assert 0.02 < S.fisher_exact(50_000, 50_000, 50_450, 49_550) < 0.06
    assert S.fisher_exact(60_000, 40_000, 40_000, 60_000) == 0.0
    rng = random.Random(3)
    sums = [rng.randrange(-20, 21) for _ in range(10_000)]
    p = S.sign_flip_exact(sums)
    z = abs(sum(sums)) / math.sqrt(sum(s * s for s in sums))
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=0.01)
    assert time.time() - began < 40


@pytest.mark.parametrize("seed", range(6))
def test_sign_flips_in_floating_point_equal_whole_numbers(seed, monkeypatch):
    rng = random.Random(seed)
    sums = [rng.randrange(-9, 12) * (1 + seed) for _ in range(20 + 60 * seed)]
    exact = S.sign_flip_exact(sums)
    monkeypatch.setattr(S, "EXACT_WORK", -1)
    assert S.sign_flip_exact(sums) == pytest.approx(exact, rel=1e-15)
    assert S.sign_flip_exact([1] * 900) == pytest.approx(2.0**-899, rel=1e-15)


@pytest.mark.parametrize("sums", [[4, 6, 6, 10] * 30, [3] * 301, [1, 1000] * 40, list(range(1, 120)), [5, 5, 7], [2]])
def test_sign_flips_inverted_equal_counted(sums, monkeypatch):
    sizes, times = (x.tolist() for x in np.unique(sums, return_counts=True))
    for observed in {1, sum(sums) // 20, sum(sums) // 3, sum(sums) * 9 // 10, sum(sums) - 1, sum(sums)}:
        want = S.sign_flip_counts(sizes, times, observed)
        with monkeypatch.context() as m:
            m.setattr(S, "COUNTED_WORK", 0)
            assert S.sign_flip_counts(sizes, times, observed) == pytest.approx(want, rel=1e-11)


def test_sign_flips_of_many_clusters_take_no_quadratic_time():
    start = time.perf_counter()
    assert S.sign_flip_counts([1, 3, 7, 67], [1 << 18] * 4, 80_000) == pytest.approx(math.erfc(80_000 / math.sqrt(2 * 4548 * 2**18)), rel=0.01)
    assert S.sign_flip_counts([1, 3, 7, 67], [1 << 18] * 4, 1 << 24) == 0.0
    assert time.perf_counter() - start < 20
