"""Ordered folds over turns and tokens: greedy budgets and fixed-width packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Segments, fold_sorted


def budget_segments(sizes: Column, budget: int) -> Column:
    """Cuts an array of sizes greedily: a segment takes elements until it has reached the budget.

    Returns array<struct<start, stop, chars>> (stop exclusive), one fold over the array.
    """
    start = F.struct(
        F.expr("cast(array() as array<struct<start:int,stop:int,chars:bigint>>)").alias("done"),
        F.lit(0).alias("start"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("chars"),
    )

    def step(acc: Column, size: Column) -> Column:
        full = acc["chars"] + size >= budget
        closed = F.struct(acc["start"].alias("start"), (acc["at"] + 1).alias("stop"), (acc["chars"] + size).alias("chars"))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(closed))).otherwise(acc["done"]).alias("done"),
            F.when(full, acc["at"] + 1).otherwise(acc["start"]).alias("start"),
            (acc["at"] + 1).alias("at"),
            F.when(full, F.lit(0).cast("bigint")).otherwise(acc["chars"] + size).alias("chars"),
        )

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["start"].alias("start"), acc["at"].alias("stop"), acc["chars"].alias("chars"))
        return F.when(acc["at"] > acc["start"], F.concat(acc["done"], F.array(rest))).otherwise(acc["done"])

    return F.aggregate(sizes, start, step, finish)


def segment_turns(
    turns: DataFrame, conversation: str, turn: str, text: str, budgets: dict[str, int], least_turns: int = 3, least_share: float = 0.6
) -> DataFrame:
    """Non-overlapping windows of turns per budget, kept with enough turns and characters. Turns stream through in order; a task holds
    one open segment a budget."""
    rows = turns.withColumn("_text", F.coalesce(text, F.lit("")))
    out = "stratum string, segment_start bigint, segment_end bigint, n_msgs bigint, text_o string"
    return fold_sorted(rows, [conversation], [turn, "_text"], ["_text"], lambda: Segments(budgets, least_turns, least_share), out)


ROWS_PER_RANGE = 100_000
MOST_RANGES = 4096


def pack(rows: DataFrame, order: str, tokens: str, width: int) -> DataFrame:
    """Concatenates token arrays by a numeric order column and cuts them into rows of ``width``; an incomplete last row is dropped.

    Offsets come from running sums in two steps: within ranges of the order
    column, and over the sums of the ranges (``MOST_RANGES`` of them at most), so
    no single task sees all rows. Rows of the same order key follow each other by
    their tokens, one by one.
    """
    rows = rows.withColumn("_key", F.struct(F.col(order), F.xxhash64(tokens)))
    repeats = rows.groupBy("_key", tokens).agg(F.count("*").alias("_copies"))
    rows = repeats.select(F.col(f"_key.{order}").alias(order), "_key", tokens, "_copies")
    low, high, total = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    ranges = max(1, min(MOST_RANGES, -(-total // ROWS_PER_RANGE)))
    span = (((high - low) if total else 0) + 1) / ranges
    sizes = rows.select(order, "_key", (F.size(tokens) * F.col("_copies")).alias("_n")).withColumn("_range", F.floor((F.col(order) - F.lit(low)) / span))
    upto = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_in", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    sums = sizes.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    placed = sizes.join(sums, "_range").select("_key", (F.col("_in") + F.col("_base")).alias("_at"))
    copied = rows.select("_key", F.size(tokens).alias("_n"), tokens, F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))).alias("_copy"))
    placed = copied.join(placed, "_key").select((F.col("_at") + F.col("_copy") * F.col("_n")).alias("_at"), F.posexplode(tokens).alias("_i", "_token"))
    placed = placed.withColumn("_place", F.col("_at") + F.col("_i"))
    return (
        placed.groupBy(F.floor(F.col("_place") / width).cast("long").alias("row_no"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_token"))), lambda x: x["_token"]).alias("tokens"))
        .where(F.size("tokens") == width)
    )
