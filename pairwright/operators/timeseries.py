"""Ordered operators over telemetry: range joins, energy, run-relative windows, gates, latest rows, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str | Column) -> Column:
    """Epoch seconds with fractions; a timestamp without zone counts as UTC (the session's zone)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


def range_join(
    points: DataFrame, spans: DataFrame, t: str, start: str, end: str, width: float, by: list[str] | None = None
) -> DataFrame:
    """Points with start <= t <= end, as an equi-join on time bins of ``width`` seconds.

    A span is listed under each bin it touches, a point under one, so every pair
    meets exactly once; spans should not be much longer than ``width``.
    """
    keys = by or []
    left = points.withColumn("_bin", F.floor(F.col(t) / width))
    right = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return left.join(right, [*keys, "_bin"]).where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))).drop("_bin")


def energy(samples: DataFrame, t: str, power: str, by: list[str]) -> DataFrame:
    """Trapezoid energy, span and mean power per group; fewer than two samples give zero energy."""
    order = Window.partitionBy(*by).orderBy(t, power)
    step = samples.withColumn("_dt", F.lead(t).over(order) - F.col(t)).withColumn("_next", F.lead(power).over(order))
    out = step.groupBy(*by).agg(
        F.count("*").alias("n_samples"),
        F.coalesce(F.sum(F.col("_dt") * (F.col(power) + F.col("_next")) / 2), F.lit(0.0)).alias("energy"),
        (F.max(t) - F.min(t)).alias("span"),
    )
    return out.withColumn("mean_power", F.try_divide("energy", "span"))


def tumbling(rows: DataFrame, t: str, width: float, by: list[str]) -> DataFrame:
    """Adds window_no, counted from each group's first row (not from the clock)."""
    origin = rows.groupBy(*by).agg(F.min(t).alias("_origin"))
    joined = rows.join(origin, by)
    return joined.withColumn("window_no", F.floor((F.col(t) - F.col("_origin")) / width).cast("long")).drop("_origin")


def consecutive(rows: DataFrame, passed: Column, order: list[str], by: list[str], need: int) -> DataFrame:
    """Adds streak (passes in a row so far, 0 on a failure) and gate_open (streak has reached ``need``)."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("_ok", F.coalesce(passed, F.lit(False)))
    marked = marked.withColumn("_island", F.sum((~F.col("_ok")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "_island").orderBy(*order)
    run = F.sum(F.col("_ok").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("streak", F.when(F.col("_ok"), run).otherwise(F.lit(0))).withColumn(
        "gate_open", F.col("streak") >= need
    ).drop("_ok", "_island")


def latest(rows: DataFrame, by: list[str], order: list[str], keep: Column | None = None) -> DataFrame:
    """The last row of each group by ``order`` among those that ``keep`` admits, in one aggregation (no sort)."""
    rows = rows if keep is None else rows.where(keep)
    rest = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*by, "_row.*")


def chain_breaks(rows: DataFrame, by: list[str], order: str, previous: str, checksum: str, first: str = "") -> DataFrame:
    """Rows whose ``previous`` isn't the checksum of the row before (``first`` at the start of a chain)."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("expected", F.coalesce(F.lag(checksum).over(w), F.lit(first))).where(
        ~F.col(previous).eqNullSafe(F.col("expected"))
    )


def neighbour_delta(rows: DataFrame, value: str, index: str, by: list[str]) -> DataFrame:
    """Adds delta to the row whose index is one less; null if there is none."""
    w = Window.partitionBy(*by).orderBy(index)
    near = F.lag(index).over(w) == F.col(index) - 1
    return rows.withColumn("delta", F.when(near, F.col(value) - F.lag(value).over(w)))


def trailing_mean(rows: DataFrame, value: str, order: list[str], by: list[str], size: int) -> DataFrame:
    """Mean of the ``size`` rows before the current one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-size, -1)
    return rows.withColumn("trailing_mean", F.avg(value).over(w))


def running_before(rows: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Exclusive prefix sum, zero on the first row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))
