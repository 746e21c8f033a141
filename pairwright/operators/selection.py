"""Deterministic selection: hash order, quotas, strata, interleaving, ranks in parts."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.session import scratch


def hash_order(seed: str, *columns: str) -> Column:
    """Hex sha-256 of the seed and the columns, joined by '|': an order that any engine can repeat."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]).cast("binary"), 256)


def first_per_cell(rows: DataFrame, cell: list[str], seed: str, key: list[str], k: int, strict: bool = False) -> DataFrame:
    """The ``k`` rows of each cell that come first in hash order, with their place (from 1). ``strict`` fails on a cell that has fewer."""
    if strict and (short := rows.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") < k).limit(1).collect()):
        raise ValueError(f"a cell has fewer than {k} rows: {short[0]}")
    w = Window.partitionBy(*cell).orderBy(hash_order(seed, *key), *key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def hash_sample(rows: DataFrame, seed: str, key: list[str], k: int) -> DataFrame:
    """The ``k`` rows first in hash order over the whole table (a top-k, no full sort)."""
    return rows.withColumn("order_hash", hash_order(seed, *key)).orderBy("order_hash", *key).limit(k)


def condition_orders(items: DataFrame, key: list[str], conditions: list[str], seed: str) -> DataFrame:
    """``items`` with ``order``: the conditions in an order of each item's own, that of the hashes of seed, item and condition."""
    each = [F.struct(F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in key], F.lit(x)).cast("binary"), 256).alias("h"), F.lit(x).alias("x")) for x in conditions]
    return items.withColumn("order", F.transform(F.array_sort(F.array(*each)), lambda e: e["x"]))


def min_by_hash(rows: DataFrame, by: list[str], seed: str, key: list[str]) -> DataFrame:
    """One row per group: the one of the least hash."""
    rest = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(hash_order(seed, *key), *key)).alias("_row"))
    return picked.select(*by, "_row.*")


def stratified_fill(rows: DataFrame, strata: list[str], seed: str, key: list[str], per_stratum: int, total: int) -> DataFrame:
    """``per_stratum`` rows of each stratum, then others in hash order up to ``total``; column part is 'stratum' or 'fill'."""
    chosen = first_per_cell(rows, strata, seed, key, per_stratum).drop("place").withColumn("part", F.lit("stratum"))
    missing = max(0, total - chosen.count())
    rest = rows.join(chosen.select(*key), key, "left_anti")
    fill = hash_sample(rest, seed + "-fill", key, missing).drop("order_hash").withColumn("part", F.lit("fill"))
    return chosen.unionByName(fill)


def interleave(rows: DataFrame, stratum: str, order: list[str]) -> DataFrame:
    """Adds turn (place within the stratum); rows by (turn, stratum) take one row of each stratum in a round."""
    w = Window.partitionBy(stratum).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(w))


def dense_ids(rows: DataFrame, by: str, prefix: str, width: int) -> DataFrame:
    """Adds dense_id: prefix and the zero-padded rank of distinct ``by`` values from 0. The values are ranked once, not the rows."""
    values = rows.select(by).distinct()
    ranked = values.withColumn("_rank", F.row_number().over(Window.orderBy(by)) - 1)
    label = F.concat(F.lit(prefix), F.lpad(F.col("_rank").cast("string"), width, "0"))
    return rows.join(ranked.select(by, label.alias("dense_id")), by)


def with_positions(rows: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """``rows`` with their place (from 0) in a total order, without one task that sees them all: rows are sorted by ranges and written, a
    place is the number of rows in the ranges before and the place within its own."""
    held = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    path = f"{scratch(rows.sparkSession, 'ranked')}/rows"
    held.write.parquet(path)
    held = rows.sparkSession.read.parquet(path)
    part = F.shiftright("_id", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range
    starts = held.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_base") + within).drop("_part", "_base", "_id")


def seeded_indices(seed: int, n: int, k: int) -> list[int]:
    """Sorted sample of positions by Python's generator, for results that must equal such a sample."""
    return sorted(random.Random(seed).sample(range(n), k))


def take_positions(rows: DataFrame, pos: str, positions: list[int]) -> DataFrame:
    """Rows at given positions of an explicit position column."""
    spark = rows.sparkSession
    return rows.join(F.broadcast(spark.createDataFrame([(p,) for p in positions], f"{pos} bigint")), pos)


def terciles(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds tercile 0, 1, 2 by rank; n // 3 rows in the first two, the remainder in the last."""
    part = Window.partitionBy(*(by or [F.lit(0)]))
    n, rank = F.count("*").over(part), F.row_number().over(part.orderBy(*order)) - 1
    third = F.floor(n / 3)
    return rows.withColumn(
        "tercile", F.when(rank < third, 0).when(rank < 2 * third, 1).otherwise(2)
    )


def spread_over_clusters(rows: DataFrame, quota_by: list[str], cluster: str, seed: str, key: list[str], k: int) -> DataFrame:
    """Up to ``k`` rows per group, spread over clusters: each cluster's first row in hash order, then its second, and so on."""
    inside = Window.partitionBy(*quota_by, cluster).orderBy(hash_order(seed, *key), *key)
    across = Window.partitionBy(*quota_by).orderBy("_round", hash_order(seed, *key), *key)
    ranked = rows.withColumn("_round", F.row_number().over(inside)).withColumn("place", F.row_number().over(across))
    return ranked.where(F.col("place") <= k).drop("_round")


def greedy_quota(candidates: list[tuple], strata: list, quotas: dict) -> list[tuple]:
    """Picks in order from (stratum, rank, window, cluster), ranked within strata: rounds over the strata take one row each, of a window and a
    cluster not taken yet; then each stratum is filled in order of rank from windows not taken. Returns (candidate, phase)."""
    ranked = {s: sorted(c for c in candidates if c[0] == s) for s in strata}
    picked, windows, clusters, held = [], set(), set(), dict.fromkeys(strata, 0)
    going = True
    while going:
        going = False
        for s in strata:
            row = next((c for c in ranked[s] if c[2] not in windows and c[3] not in clusters), None) if held[s] < quotas[s] else None
            if row is not None:
                picked.append((row, "distinct"))
                windows.add(row[2])
                clusters.add(row[3])
                held[s], going = held[s] + 1, True
    for s in strata:
        for row in ranked[s]:
            if held[s] < quotas[s] and row[2] not in windows:
                picked.append((row, "fill"))
                windows.add(row[2])
                held[s] += 1
    return picked


def distinct_cluster_quota(
    rows: DataFrame, stratum: str, window: str, cluster: str, seed: str, key: list[str], quotas: dict, strict: bool = True
) -> DataFrame:
    """The rows that a greedy selection takes, with place (order of picking, from 1) and phase (distinct or fill).

    Strata take turns in the order of ``quotas``; see ``greedy_quota``. Picks depend on all earlier ones, so they are made one after
    another, but on few rows: with Q picks in all, at most Q windows and clusters are ever taken. So of a stratum
    the first row of each of the first Q clusters can be picked in rounds, and the first row of each of the first
    2 Q windows in filling; these are at most 3 Q rows a stratum, whatever the table's size. A window belongs to
    one cluster; that is checked, and with ``strict`` a quota that can't be met fails.
    """
    several = rows.groupBy(window).agg(F.min(cluster).alias("a"), F.max(cluster).alias("b")).where("a <> b").limit(1).collect()
    if several:
        raise ValueError(f"a window belongs to more than one cluster: {several[0][0]}")
    total = sum(quotas.values())
    ranked = rows.where(F.col(stratum).isin(list(quotas))).select(
        F.col(stratum).alias("s"), F.struct(hash_order(seed, *key).alias("h"), *[F.col(c) for c in key]).alias("rank"), F.col(window).alias("w"), F.col(cluster).alias("c")
    )

    def first(of: str, most: int) -> DataFrame:
        once = ranked.groupBy("s", of).agg(F.min_by(F.struct("rank", "w", "c"), "rank").alias("x"))
        place = F.row_number().over(Window.partitionBy("s").orderBy("x.rank"))
        return once.withColumn("n", place).where(F.col("n") <= most).select("s", "x.rank", "x.w", "x.c")

    few = first("c", total).unionByName(first("w", 2 * total)).distinct()
    found = greedy_quota([(r.s, tuple(r.rank), r.w, r.c) for r in few.collect()], list(quotas), quotas)
    if strict and len(found) < total:
        raise ValueError(f"{len(found)} rows where quotas ask for {total}")
    types = {f.name: f.dataType.simpleString() for f in rows.select(*key).schema.fields}
    picks = [(*row[1][1:], place + 1, phase) for place, (row, phase) in enumerate(found)]
    spark = rows.sparkSession
    chosen = spark.createDataFrame(picks, ", ".join([*(f"`{c}` {types[c]}" for c in key), "place int", "phase string"]))
    return rows.join(F.broadcast(chosen), key)


def top_k(rows: DataFrame, value: str, ties: list[str], k: int) -> DataFrame:
    """The ``k`` rows of the largest value, ties by key: a heap per task, no full sort."""
    return rows.orderBy(F.desc(value), *ties).limit(k)


def head_in_order(rows: DataFrame, order: DataFrame, key: str, pos: str, n: int) -> DataFrame:
    """Rows of the first ``n`` items in the order that a table of positions gives (not in the order that rows happen to lie)."""
    return rows.join(order.where(F.col(pos) < n).select(key, pos), key)
