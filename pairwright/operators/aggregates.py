"""Aggregations of the engine beyond plain counts and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_summary(rows: DataFrame, by: list[str], correct: Column, wall: Column, tokens: Column | None = None) -> DataFrame:
    """n, k, accuracy, mean and total wall time, correct per minute and accuracy per minute of mean wall; with ``tokens`` their
    mean over the rows that have any."""
    more = [] if tokens is None else [F.avg(tokens).alias("mean_tokens")]
    return rows.groupBy(*by).agg(
        *more,
        F.count("*").alias("n"),
        F.count_if(correct).alias("k"),
        F.avg(correct.cast("int")).alias("accuracy"),
        F.avg(wall).alias("mean_wall"),
        F.sum(wall).alias("total_wall"),
        F.try_divide(60.0 * F.count_if(correct), F.sum(wall)).alias("correct_per_minute"),
        F.try_divide(F.avg(correct.cast("int")), F.avg(wall) / 60.0).alias("accuracy_per_minute"),
    )


def ratio_of_sums(numerator: Column, denominator: Column) -> Column:
    """A weighted rate; never the mean of ratios."""
    return F.try_divide(F.sum(numerator), F.sum(denominator))


def nearest_rank(value: str, p: float) -> Column:
    """The element at index min(n - 1, floor(p n)) of the sorted values of a group (bounded groups)."""
    held = F.array_sort(F.collect_list(value))
    return F.get(held, F.least(F.size(held) - 1, F.floor(F.lit(p) * F.size(held)).cast("int")))


def nearest_rank_counts(rows: DataFrame, value: str, by: list[str], ps: list[float]) -> DataFrame:
    """The same from value counts: groups of any size, one cumulative sum over distinct values."""
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    marked = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = [
        F.min(F.when(F.col("_upto") > F.least(F.col("_all") - 1, F.floor(F.lit(p) * F.col("_all"))), F.col(value))).alias(
            f"q{int(round(p * 100))}"
        )
        for p in ps
    ]
    return marked.groupBy(*by).agg(F.max("_all").alias("n"), *at)


def delta_bucket(delta: Column) -> Column:
    """Buckets of an absolute difference: 0, 1-5, 6-50, >50."""
    d = F.abs(delta)
    return F.when(d == 0, "0").when(d <= 5, "1-5").when(d <= 50, "6-50").otherwise(">50")


def hazard(identical: Column, n: Column, length: Column) -> Column:
    """-ln(identity rate) per unit of length."""
    return F.try_divide(-F.ln(F.try_divide(identical, n)), length)


def relative_change(a: Column, b: Column) -> Column:
    """mean(b) / mean(a) - 1."""
    return F.try_divide(F.avg(b), F.avg(a)) - 1


def set_fingerprint(key: str) -> Column:
    """sha-256 of the sorted distinct keys as text, one a line."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "\n").cast("binary"), 256)


def shares(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Sum per group and its share of the grand total."""
    summed = rows.groupBy(*by).agg(F.sum(value).alias("total"))
    grand = summed.agg(F.sum("total").alias("_grand"), F.lit(0).alias("_all"))
    return summed.withColumn("_all", F.lit(0)).join(grand, "_all").withColumn(
        "share", F.try_divide("total", "_grand")
    ).drop("_all", "_grand")


def weighted_least_squares(rows: DataFrame, x0: Column, x1: Column, y: Column, by: list[str]) -> DataFrame:
    """Two coefficients without an offset, relative errors weighted alike (weights 1 / y^2), from five sums."""
    w = F.try_divide(F.lit(1.0), y * y)
    sums = rows.groupBy(*by).agg(
        F.sum(w * x0 * x0).alias("a"),
        F.sum(w * x0 * x1).alias("b"),
        F.sum(w * x1 * x1).alias("c"),
        F.sum(w * x0 * y).alias("d"),
        F.sum(w * x1 * y).alias("e"),
    )
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    return sums.select(
        *by,
        F.try_divide(F.col("c") * F.col("d") - F.col("b") * F.col("e"), det).alias("c0"),
        F.try_divide(F.col("a") * F.col("e") - F.col("b") * F.col("d"), det).alias("c1"),
    )


def recovered_count(accuracy: Column, n: Column, tolerance: float = 1e-8) -> Column:
    """Whole number of successes behind a stored accuracy; null if none is within the tolerance."""
    k = F.bround(accuracy * n)
    return F.when(F.abs(k / n - accuracy) <= tolerance, k.cast("long"))


def envelope(rows: DataFrame, value: str, inner: list[str], outer: list[str]) -> DataFrame:
    """Least and largest value per outer group, and the largest spread among its inner groups."""
    spread = rows.groupBy(*outer, *inner).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("spread")
    )
    return spread.groupBy(*outer).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("spread").alias("largest_spread")
    )
