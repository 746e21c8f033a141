"""Interval and test statistics on count columns.

Closed forms are plain column expressions. Exact combinatorial tests are Arrow
UDFs over integers; they run on aggregated rows, so their cost follows the number
of groups, not of items.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: 97.5 % point of the standard normal distribution; 1.96 is the usual short form.
Z975 = 1.959963984540054


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rate(k: Column | str, n: Column | str) -> Column:
    """k/n, null for n = 0."""
    return F.try_divide(_col(k).cast("double"), _col(n).cast("double"))


def wilson(k: Column | str, n: Column | str, z: float = Z975, clamp: bool = True, empty: str = "null") -> Column:
    """Wilson interval as struct<low, high>; n = 0 gives nulls, or zeros with ``empty='zero'``."""
    k, n = _col(k).cast("double"), _col(n).cast("double")
    p, zz = F.try_divide(k, n), F.lit(z * z)
    spread = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(zz, 4 * n * n))
    scale = 1 + F.try_divide(zz, n)
    low, high = (p + F.try_divide(zz, 2 * n) - spread) / scale, (p + F.try_divide(zz, 2 * n) + spread) / scale
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    if empty == "zero":
        low, high = F.when(n == 0, F.lit(0.0)).otherwise(low), F.when(n == 0, F.lit(0.0)).otherwise(high)
    elif clamp:  # greatest and least skip nulls
        low, high = F.when(n > 0, low), F.when(n > 0, high)
    return F.struct(low.alias("low"), high.alias("high"))


def newcombe_paired(
    both: Column | str, a_only: Column | str, b_only: Column | str, neither: Column | str, z: float = Z975, clamp: bool = False
) -> Column:
    """Newcombe's method 10 for a paired difference (A less B): struct<diff, low, high, phi>; phi is 0 where undefined."""
    e, f, g, h = (_col(c).cast("double") for c in (both, a_only, b_only, neither))
    n = e + f + g + h
    pa, pb = F.try_divide(e + f, n), F.try_divide(e + g, n)
    wa, wb = wilson(e + f, n, z), wilson(e + g, n, z)
    product = (e + f) * (g + h) * (e + g) * (f + h)
    phi = F.when(product > 0, (e * h - f * g) / F.sqrt(F.when(product > 0, product))).otherwise(F.lit(0.0))
    la, ua = pa - wa["low"], wa["high"] - pa
    lb, ub = pb - wb["low"], wb["high"] - pb
    diff = pa - pb
    zero = F.lit(0.0)
    low = diff - F.sqrt(F.greatest(la * la - 2 * phi * la * ub + ub * ub, zero))
    high = diff + F.sqrt(F.greatest(ua * ua - 2 * phi * ua * lb + lb * lb, zero))
    if clamp:
        low, high = F.greatest(low, F.lit(-1.0)), F.least(high, F.lit(1.0))
    return F.struct(diff.alias("diff"), low.alias("low"), high.alias("high"), phi.alias("phi"))


def binomial_two_sided_exact(b: int, c: int) -> float:
    """Two-sided sign test of b against c, in whole numbers."""
    n = b + c
    if n == 0:
        return 1.0
    term = tail = 1
    for i in range(1, min(b, c) + 1):
        term = term * (n - i + 1) // i
        tail += term
    return min(1.0, 2 * tail / (1 << n))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of the table ((a, b), (c, d)): all tables of these margins that are no likelier.

    Tables' weights rise to one peak and fall, so both tails are walked inward, each weight from its neighbour's by a ratio of
    small numbers, until they pass the observed one. All in whole numbers.
    """
    row, column, total = a + b, a + c, a + b + c + d
    if total == 0:
        return 1.0
    rest = total - row
    least, most = max(0, column - rest), min(row, column)
    here = math.comb(row, a) * math.comb(rest, column - a)

    def tail(start: int, step: int) -> tuple[int, int]:
        """Sum of the weights from one end up to the first that is likelier, and where that is."""
        x, w, found = start, math.comb(row, start) * math.comb(rest, column - start), 0
        while w <= here:
            found += w
            if x == (most if step > 0 else least):
                return found, x + step
            if step > 0:
                w = w * ((row - x) * (column - x)) // ((x + 1) * (rest - column + x + 1))
            else:
                w = w * (x * (rest - column + x)) // ((row - x + 1) * (column - x + 1))
            x += step
        return found, x

    low, end = tail(least, 1)
    if end > most:
        return 1.0
    return (low + tail(most, -1)[0]) / math.comb(total, column)


@lru_cache(maxsize=1)
def _nodes() -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(240)


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| > t). With x = sqrt(df) tan(angle) the tail is an integral of cos^(df-1) over the angle."""
    t = abs(t)
    if t == 0:
        return 1.0
    if math.isinf(t):
        return 0.0
    start = math.atan(t / math.sqrt(df))
    power = df - 1
    log_start = power * math.log(math.cos(start))
    # beyond this angle the integrand is e-50 of its start
    stop = math.acos(math.cos(start) * math.exp(-50 / power)) if power > 0.05 else math.pi / 2
    if power < 1:  # the integrand may rise or be flat; substitute to keep it smooth at the right end
        stop = math.pi / 2
    x, w = _nodes()
    if power < 1:
        # angle = pi/2 - s^m smooths cos^power near pi/2
        m = 8.0
        top = (math.pi / 2 - start) ** (1 / m)
        s = (x + 1) / 2 * top
        values = np.sin(s**m) ** power * m * s ** (m - 1)
        area, log_scale = float((w * values).sum() * top / 2), 0.0
    else:
        angle = start + (x + 1) / 2 * (stop - start)
        values = np.exp(power * np.log(np.cos(angle)) - log_start)
        area, log_scale = float((w * values).sum() * (stop - start) / 2), log_start
    log_constant = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    return min(1.0, 2 * area * math.exp(log_constant + log_scale))


def t_critical(df: float, level: float = 0.95) -> float:
    """t with P(|T| > t) = 1 - level."""
    low, high, target = 0.0, 1.0, 1 - level
    while student_t_two_sided(high, df) > target:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if student_t_two_sided(middle, df) > target else (low, middle)
    return (low + high) / 2


#: Additions of 64-bit digits up to which sign flips are counted in whole numbers.
EXACT_WORK = 1 << 27
#: Additions up to which they are counted at all; beyond that their law is inverted.
COUNTED_WORK = 1 << 27


def _sign_flips_inverted(sizes: np.ndarray, times: np.ndarray, observed: int) -> float:
    """P(|total| >= observed > 0) from the characteristic function, tilted so that the observed total is the mean.

    With sizes s, times k and tilt a, P(total >= t) = exp(sum k log cosh(as) - at) E[exp(-a(total - t)); total >= t], the
    mean being over flips that come out positive with chance 1 / (1 + exp(-2as)). That law is read off at 2^m points, over 80 standard
    deviations wide, by one transform; so the work grows with the distinct sizes and the root of the clusters. The factor
    before it holds the smallness of p, which keeps its relative error near 1e-12 in far tails too.
    """
    # totals are whole - 2 x (sum of the negative part): sizes with a common divisor leave a coarser lattice
    unit = int(np.gcd.reduce(sizes))
    sizes, observed, whole = sizes // unit, -(-observed // unit), int((sizes // unit * times).sum())
    observed += (whole - observed) % 2
    if observed > whole:
        return 0.0
    s, k = sizes.astype(np.longdouble), times.astype(np.longdouble)
    if observed == whole:
        return float(np.exp2(1 - k.sum()))
    low, high = np.longdouble(0), np.longdouble(1)
    while (k * s * np.tanh(high * s)).sum() < observed:
        high *= 2
    for _ in range(120):
        middle = (low + high) / 2
        low, high = (middle, high) if (k * s * np.tanh(middle * s)).sum() < observed else (low, middle)
    a = low
    # log cosh without overflow
    scale = (k * (a * s + np.log1p(np.exp(-2 * a * s)) - np.log(np.longdouble(2)))).sum() - a * observed
    if scale < -760:  # Chernoff's bound: p is below half of the least double
        return 0.0
    positive = 1 / (1 + np.exp(-2 * a * s))
    spread = float(np.sqrt((k * s * s * positive * (1 - positive)).sum()))
    n = 1 << max(10, math.ceil(math.log2(80 * spread + 4 * float(s.max()))))
    # j counts totals from the observed one on, in steps of two
    w = 2 * np.pi * np.fft.fftfreq(n)
    size, law = np.zeros(n), np.zeros(n)
    for one, many, up in zip(sizes.tolist(), times.tolist(), positive.astype(float).tolist()):
        # a flip's place in steps of two, about its mean: one * (1 - up) with chance up, else -one * up
        z = up * np.exp(1j * w * one * (1 - up)) + (1 - up) * np.exp(-1j * w * one * up)
        size += many * np.log(np.maximum(np.abs(z), 1e-300))
        law += many * np.angle(z)
    mean = float((k * s * (2 * positive - 1)).sum() - observed) / 2
    chance = np.fft.fft(np.exp(size) * np.exp(1j * (law + w * mean))).real / n
    ahead = np.maximum(chance[: n // 2], 0.0) * np.exp(-2 * float(a) * np.arange(n // 2))
    return min(1.0, float(2 * np.exp(scale) * np.longdouble(ahead[::-1].sum())))


def sign_flip_counts(sizes: list[int], times: list[int], observed: int) -> float:
    """Share of all sign assignments of the absolute cluster sums ``sizes`` (each ``times`` times) whose total is at least as far from 0
    as ``observed``.

    Assignments are counted by the sum of their negative part, up to the sum where the total comes down to the observed one; each
    cluster adds the counts shifted by its size. Small cases are counted in whole numbers, larger ones in extended
    floating point (64 bits of mantissa or more), whose terms are all positive: n clusters err by n x 5e-20 at most, relatively.
    Beyond ``COUNTED_WORK`` additions, which grow with the square of the clusters, the law of the total is inverted instead.
    """
    pairs = [(abs(int(s)), int(n)) for s, n in zip(sizes, times) if s and n]
    observed, whole, n = abs(int(observed)), sum(s * k for s, k in pairs), sum(k for _, k in pairs)
    if observed == 0:
        return 1.0
    reach = (whole - observed) // 2 + 1
    if n * reach > COUNTED_WORK:
        return _sign_flips_inverted(*np.array(pairs, dtype=np.int64).T, observed)
    exact = n * reach * (n // 64 + 1) <= EXACT_WORK
    ways = np.zeros(reach, dtype=object if exact else np.longdouble)
    ways[0] = 1
    top = 1
    for size, k in sorted(pairs):
        for _ in range(k):
            top = min(reach, top + size)
            if top > size:
                ways[size:top] = ways[size:top] + ways[: top - size]
            if not exact:
                ways[:top] *= 0.5
    if exact:
        return min(1.0, 2 * int(ways.sum()) / (1 << n))
    # from the smallest on
    return min(1.0, float(2 * np.sort(ways).sum()))


def sign_flip_exact(sums: list[int]) -> float:
    """``sign_flip_counts`` of single clusters."""
    sizes, times = np.unique(np.abs(np.array(sums, dtype=np.int64)), return_counts=True)
    return sign_flip_counts(sizes.tolist(), times.tolist(), sum(int(s) for s in sums))


def _over(function, kinds: tuple, *columns: pd.Series) -> pd.Series:
    out = [
        None if any(pd.isna(v) for v in row) else function(*(k(v) for k, v in zip(kinds, row))) for row in zip(*columns)
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact McNemar p of the two discordant counts."""
    return _over(binomial_two_sided_exact, (int, int), b, c)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _over(fisher_exact, (int,) * 4, a, b, c, d)


@F.pandas_udf(DoubleType())
def student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _over(student_t_two_sided, (float, float), t, df)


@F.pandas_udf(DoubleType())
def t_critical_975(df: pd.Series) -> pd.Series:
    return _over(t_critical, (float,), df)


@F.pandas_udf(DoubleType())
def sign_flip_p(sizes: pd.Series, times: pd.Series, observed: pd.Series) -> pd.Series:
    """p from a histogram of absolute cluster sums and their total."""
    return pd.Series([sign_flip_counts(s, n, o) for s, n, o in zip(sizes, times, observed)], dtype="float64")
