"""Difference-in-differences with cluster-robust (CR2) variance from sufficient statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.statistics import sign_flip_p, student_t_p, t_critical_975


def interaction(low_base: Column, low_other: Column, ref_base: Column, ref_other: Column) -> Column:
    """(base - other) in the low setting less the same in the reference setting."""
    as_number = [c.cast("int") for c in (low_base, low_other, ref_base, ref_other)]
    return (as_number[0] - as_number[1]) - (as_number[2] - as_number[3])


def cluster_sums(rows: DataFrame, value: Column, cluster: str, by: list[str] | None = None) -> DataFrame:
    """Size and sum of each cluster; all that the variance needs."""
    return rows.groupBy(*(by or []), cluster).agg(F.count(value).alias("n_g"), F.sum(value).alias("s_g"))


def cr2(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """estimate, variance and Satterthwaite df of the mean, from cluster sizes and sums.

    The df needs no pairs of clusters: with h = n_g / n and u = h^2 / (1 - h) it is
    1 / (sum h^2 + (sum u)^2 - sum u^2). Fewer than three clusters give null.
    """
    by = by or []
    totals = sums.groupBy(*by).agg(
        F.sum("n_g").alias("n"), F.sum("s_g").alias("s"), F.count("*").alias("clusters"), F.max("n_g").alias("largest")
    )
    # totals has one row a group of tests
    keyed, one = (sums, totals) if by else (sums.withColumn("_all", F.lit(0)), totals.withColumn("_all", F.lit(0)))
    joined = keyed.join(one, by or ["_all"])
    h = F.col("n_g") / F.col("n")
    gap = F.col("s_g") - F.col("n_g") * F.col("s") / F.col("n")
    u = F.try_divide(h * h, 1 - h)
    out = joined.groupBy(*by, "n", "s", "clusters").agg(
        F.sum(F.try_divide(gap * gap, 1 - h)).alias("q"), F.sum(h * h).alias("hh"), F.sum(u).alias("su"), F.sum(u * u).alias("uu")
    )
    enough = F.col("clusters") >= 3
    return out.select(
        *by,
        "n",
        "clusters",
        (F.col("s") / F.col("n")).alias("estimate"),
        F.when(enough, F.col("q") / (F.col("n") * F.col("n"))).alias("variance"),
        F.when(enough, F.try_divide(F.lit(1.0), F.col("hh") + F.col("su") * F.col("su") - F.col("uu"))).alias("df"),
    )


def inference(fitted: DataFrame) -> DataFrame:
    """Adds se, t, p_cr2, ci_low, ci_high. A zero SE gives p = 1 for a zero estimate and null otherwise."""
    se = F.sqrt("variance")
    fitted = fitted.withColumn("se", se).withColumn("t", F.when(F.col("se") > 0, F.col("estimate") / F.col("se")))
    half = t_critical_975("df") * F.col("se")
    none = F.col("se") == 0
    zero = none & (F.col("estimate") == 0)
    return (
        fitted.withColumn("p_cr2", F.when(zero, F.lit(1.0)).when(~none, student_t_p("t", "df")))
        .withColumn("ci_low", F.when(zero | ~none, F.col("estimate") - half))
        .withColumn("ci_high", F.when(zero | ~none, F.col("estimate") + half))
    )


def sign_flip(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact sign-flip p per group. Clusters are summed up as a histogram of their absolute sums, so what one call gets grows with the
    number of distinct sums."""
    by = by or []
    size = F.abs(F.col("s_g").cast("long")).alias("_size")
    counted = sums.groupBy(*by, size).agg(F.count("*").alias("_times"), F.sum(F.col("s_g").cast("long")).alias("_part"))
    held = counted.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_size", "_times"))).alias("_h"), F.sum("_part").alias("_sum"))
    return held.select(*by, sign_flip_p("_h._size", "_h._times", "_sum").alias("p_sign_flip"))


def histogram(sums: DataFrame) -> DataFrame:
    """Clusters by (size, sum) with their multiplicity: the table from which everything above can be rebuilt."""
    return sums.groupBy("n_g", "s_g").agg(F.count("*").alias("multiplicity"))


def from_histogram(counted: DataFrame) -> DataFrame:
    """The cluster rows behind a histogram."""
    return counted.select("n_g", "s_g", F.explode(F.sequence(F.lit(1), F.col("multiplicity"))).alias("copy")).drop("copy")
