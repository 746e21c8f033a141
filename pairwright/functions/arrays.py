"""Array expressions over token probabilities: filtered softmax, entropy, overlap, early exit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    """Probabilities of logits; the largest is taken off first, so nothing overflows."""
    scaled = F.transform(_col(logits), lambda x: x.cast("double") / temperature)
    weights = F.transform(scaled, lambda x: F.exp(x - F.array_max(scaled)))
    return F.transform(weights, lambda w: w / _sum(weights))


def kept_by_top_p(probabilities: Column | str, p: float, k: int | None = None) -> Column:
    """Indices (from 0) kept by top-k and then top-p: likeliest first, while the mass before an entry is p at most."""
    c = _col(probabilities)
    ranked = F.array_sort(F.transform(c, lambda x, i: F.struct((-x).alias("m"), i.alias("i"))))
    ranked = F.slice(ranked, 1, k) if k else ranked
    kept = F.filter(ranked, lambda _, at: -_sum(F.transform(F.slice(ranked, 1, at), lambda e: e["m"])) <= p)
    return F.transform(kept, lambda e: e["i"])


def filtered(probabilities: Column | str, kept: Column) -> Column:
    """Probabilities renormalised over the kept indices, zero elsewhere."""
    masked = F.transform(_col(probabilities), lambda x, i: F.when(F.array_contains(kept, i), x).otherwise(F.lit(0.0)))
    return F.transform(masked, lambda x: F.try_divide(x, _sum(masked)))


def entropy(probabilities: Column | str) -> Column:
    return -_sum(F.transform(_col(probabilities), lambda x: F.when(x > 0, x * F.ln(F.when(x > 0, x))).otherwise(F.lit(0.0))))


def overlap(p: Column | str, q: Column | str) -> Column:
    """Sum of the lesser of two distributions' values: the chance that a draft from one is accepted by the other."""
    return _sum(F.zip_with(_col(p), _col(q), lambda x, y: F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0)))))


def residual(p: Column | str, q: Column | str) -> Column:
    """What is left of p beyond q, renormalised: the distribution of a token that replaces a refused draft."""
    over = F.zip_with(_col(p), _col(q), lambda x, y: F.greatest(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), F.lit(0.0)))
    return F.transform(over, lambda x: F.try_divide(x, _sum(over)))


def top_gap(top: Column | str) -> Column:
    """Difference of the two largest log probabilities at a position (an array of them)."""
    ranked = F.sort_array(_col(top), asc=False)
    return F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))


def early_exit(probes: Column | str, threshold: float, least: int = 1) -> Column:
    """First index from ``least`` on whose probe (an array of log probabilities) is confident enough; null if none is."""
    ok = F.transform(
        _col(probes), lambda probe, i: (i >= least) & F.coalesce(F.try_divide(_sum(F.transform(probe, lambda x: F.exp(x))), F.size(probe)) >= threshold, F.lit(False))
    )
    at = F.array_position(ok, F.lit(True))
    return F.when(at > 0, at - 1)


def derived_seed(item_id: Column | str, base: int) -> Column:
    """``base`` plus the number that an id ends in."""
    return F.regexp_extract(_col(item_id), r"_([0-9]+)$", 1).try_cast("long") + F.lit(base)


def median_of_ratios(a: str, b: str) -> Column:
    """Median over rows of b / max(1, a); not the ratio of the means."""
    return F.median(F.col(b) / F.greatest(F.lit(1), F.col(a)))
