"""Aligning two result sets item by item, and what follows from the aligned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.statistics import mcnemar_p, newcombe_paired, rate, wilson


def paired(a: DataFrame, b: DataFrame, on: str | list[str] = "id", drop_errors: str | None = None) -> DataFrame:
    """Inner join of two result sets on the item key; other columns get the suffixes _a and _b.

    ``drop_errors`` names a boolean column: an item is left out if either side has it set.
    """
    keys = [on] if isinstance(on, str) else on
    if drop_errors:
        a, b = (x.where(~F.coalesce(F.col(drop_errors), F.lit(False))) for x in (a, b))
    a = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in a.columns if c not in keys])
    b = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    return a.join(b, keys)


def unmatched(a: DataFrame, b: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """Symmetric difference of two key sets: the keys with side 'a' or 'b' that the other side lacks."""
    keys = [on] if isinstance(on, str) else on
    left = a.select(*keys).distinct().withColumn("_in_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("_in_b", F.lit(True))
    full = left.join(right, keys, "full_outer").where(F.col("_in_a").isNull() | F.col("_in_b").isNull())
    return full.select(*keys, F.when(F.col("_in_b").isNull(), "a").otherwise("b").alias("side"))


def strict_paired(a: DataFrame, b: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """Like ``paired`` but fails unless the key sets are equal and unique on both sides."""
    keys = [on] if isinstance(on, str) else on
    if (odd := unmatched(a, b, keys).limit(1).collect()) or (odd := duplicates(a, keys).limit(1).collect()):
        raise ValueError(f"key sets differ or repeat, as at {odd[0]}")
    if odd := duplicates(b, keys).limit(1).collect():
        raise ValueError(f"a key repeats on the right, as at {odd[0]}")
    return paired(a, b, keys)


def duplicates(rows: DataFrame, on: str | list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    keys = [on] if isinstance(on, str) else on
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def common_keys(rows: DataFrame, key: str | list[str], member: str, members: int) -> DataFrame:
    """Keys present under all ``members`` distinct values of ``member``: an n-way intersection without joins."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.count_distinct(member).alias("_seen")).where(F.col("_seen") == members).select(*keys)


def paired_counts(rows: DataFrame, a: Column, b: Column, by: list[str]) -> DataFrame:
    """2x2 table per group: n, both, a_only, b_only, neither."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(a & b).alias("both"),
        F.count_if(a & ~b).alias("a_only"),
        F.count_if(~a & b).alias("b_only"),
        F.count_if(~a & ~b).alias("neither"),
    )


def compare(tables: DataFrame) -> DataFrame:
    """Accuracies with Wilson intervals, Newcombe's difference and the exact McNemar p of 2x2 tables."""
    k_a, k_b = F.col("both") + F.col("a_only"), F.col("both") + F.col("b_only")
    return (
        tables.withColumn("wa", wilson(k_a, "n"))
        .withColumn("wb", wilson(k_b, "n"))
        .withColumn("nc", newcombe_paired("both", "a_only", "b_only", "neither"))
        .select(
            *tables.columns,
            rate(k_a, "n").alias("acc_a"),
            F.col("wa.low").alias("a_low"),
            F.col("wa.high").alias("a_high"),
            rate(k_b, "n").alias("acc_b"),
            F.col("wb.low").alias("b_low"),
            F.col("wb.high").alias("b_high"),
            F.col("nc.diff").alias("diff"),
            F.col("nc.low").alias("diff_low"),
            F.col("nc.high").alias("diff_high"),
            F.col("nc.phi").alias("phi"),
            mcnemar_p("a_only", "b_only").alias("p"),
        )
    )


def holm(rows: DataFrame, p: str, key: str | list[str], family: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Adds holm_rank, holm_threshold, p_holm and holm_reject within each family, ties by key.

    A family is one set of related tests, so its size is the number of tests, not of items.
    """
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*(family or [F.lit(0)])).orderBy(F.col(p), *keys)
    whole = Window.partitionBy(*(family or [F.lit(0)]))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("holm_rank", F.row_number().over(order))
        .withColumn("_left", F.count("*").over(whole) - F.col("holm_rank") + 1)
        .withColumn("holm_threshold", F.lit(alpha) / F.col("_left"))
        .withColumn("p_holm", F.max(F.least(F.lit(1.0), F.col("_left") * F.col(p))).over(upto))
        .withColumn("holm_reject", F.min((F.col(p) <= F.col("holm_threshold")).cast("int")).over(upto) == 1)
        .drop("_left")
    )


def verdict(diff_low: Column, diff_high: Column, margin: float) -> Column:
    """Where an interval of a difference lies against a margin."""
    return (
        F.when(diff_low > 0, "better")
        .when(diff_high < 0, "worse")
        .when((diff_low > -margin) & (diff_high < margin), "equivalent")
        .otherwise("open")
    )
