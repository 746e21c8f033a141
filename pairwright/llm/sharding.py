"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are numbered once and fall into buckets by a hash of that number, the id and the text. How many
rows each bucket sends to each shard is drawn first, as a random matrix whose row sums are the bucket
sizes and whose column sums are the shard sizes (a multivariate hypergeometric
draw), so shard sizes hold exactly. Each bucket then permutes its rows and deals
them by its row of the matrix; each shard permutes what it received.

Draws follow the hypergeometric law at every size: numpy's generator below its limit of 10**9, above it
the inverse of the distribution function, summed over all counts of more than about 1e-30 of its weight.

Edge cases: an empty table gives an empty result; a null text has size 1 and
checksum 0; a null id hashes like any other; repeated rows are rows of their own, in
buckets of their own; extra columns are not read. Nothing but counts (``MAX_BUCKETS`` x shards at
most) reaches the driver, and no shuffle carries texts. From ``MAX_BUCKETS`` x ``ROWS_PER_BUCKET`` rows
on buckets grow with the table; their rows of a few numbers go through a sort that spills.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MAX_BUCKETS = 1 << 16
ROWS_PER_BUCKET = 8192
#: numpy draws from urns of fewer balls than this.
URN = 10**9


def shard_sizes(total: int, shards: int) -> np.ndarray:
    """Row counts that differ by one at most."""
    return np.full(shards, total // shards, dtype=np.int64) + (np.arange(shards) < total % shards)


def _by_inversion(generator: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """The count at a uniform share of the distribution function, which is summed from the ratios of neighbouring counts."""
    total = good + bad
    least, most = max(0, drawn - bad), min(good, drawn)
    mean = drawn * good / total
    spread = (mean * (bad / total) * ((total - drawn) / max(total - 1, 1))) ** 0.5
    low, high = max(least, int(mean - 12 * spread) - 50), min(most, int(mean + 12 * spread) + 50)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(ratio)))
    upto = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(upto, generator.random() * upto[-1], side="right").clip(0, high - low))


def draw(generator: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good rows among ``drawn`` of ``good + bad``."""
    if good + bad < URN:
        return int(generator.hypergeometric(good, bad, drawn))
    return _by_inversion(generator, good, bad, drawn)


def communication_matrix(row_counts: list[int], column_counts: np.ndarray, seed: int) -> np.ndarray:
    """Random matrix with these margins, as a uniform permutation would give."""
    generator = np.random.default_rng(seed)
    left = column_counts.astype(np.int64).copy()
    matrix = np.zeros((len(row_counts), len(left)), dtype=np.int64)
    for i, count in enumerate(row_counts):
        need, rest = int(count), int(left.sum())
        for j, room in enumerate(left.tolist()):
            rest -= room
            matrix[i, j] = taken = draw(generator, room, rest, need) if need else 0
            need -= taken
        left -= matrix[i]
    return matrix


def _deal(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """``rows`` (a written table with id, text_crc32 and a number ``row``) with shard and slot."""
    spark = rows.sparkSession
    total = rows.count()
    buckets = min(MAX_BUCKETS, max(1, -(-total // ROWS_PER_BUCKET)))

    def mixed(salt: int) -> Column:
        return F.xxhash64(F.lit(seed + salt), F.col("id"), F.col("text_crc32"), F.col("row"))

    keyed = rows.withColumn("bucket", F.pmod(mixed(0), F.lit(buckets)).cast("int"))
    held = {r["bucket"]: r["n"] for r in keyed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([held.get(b, 0) for b in range(buckets)], shard_sizes(total, shards), seed)
    ends = spark.createDataFrame([(b, np.cumsum(matrix[b]).tolist()) for b in range(buckets)], "bucket int, ends array<bigint>")
    local = Window.partitionBy("bucket").orderBy(mixed(1), "row")
    dealt = (
        keyed.withColumn("place", F.row_number().over(local))
        .join(F.broadcast(ends), "bucket")  # MAX_BUCKETS rows of one number a shard
        .withColumn("shard", F.size(F.filter("ends", lambda x: x < F.col("place"))))
        .drop("bucket", "ends", "place")
    )
    parts = min(MAX_BUCKETS // shards + 1, max(1, -(-total // (shards * ROWS_PER_BUCKET))))
    dealt = written(dealt.withColumn("part", F.pmod(mixed(2), F.lit(parts)).cast("int")))
    counts = sorted(tuple(r) for r in dealt.groupBy("shard", "part").agg(F.count("*")).collect())
    offsets, before = [], {}
    for shard, part, n in counts:
        offsets.append((shard, part, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    within = Window.partitionBy("shard", "part").orderBy(mixed(3), "row")
    starts = spark.createDataFrame(offsets, "shard int, part int, start bigint")  # one row a part of a shard
    placed = dealt.withColumn("place", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "part"])
    return placed.withColumn("slot", F.col("start") + F.col("place") - 1).drop("part", "place", "start")


def _numbered(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
            *more,
        )
    )


def hypergeometric_shuffle(
    docs: DataFrame, shards: int = 16, seed: int = 20240501, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Columns id, size, text_crc32, shard, slot; slots of a shard are 0 .. size-1 in random order."""
    dealt = _deal(_numbered(docs, id_col, text_col), shards, seed)
    return dealt.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 20240501) -> None:
    """Write whole documents as ``path/shard=N`` in slot order within each file, with columns shard and slot.

    Columns of ``docs`` with these names are written as shard_in and slot_in.
    """
    rows = _numbered(docs, "doc_id", "text", F.struct("*").alias("in"))
    plan = _deal(rows.select("id", "text_crc32", "row"), shards, seed).select("row", "shard", "slot")
    own = [F.col(f"in.`{c}`").alias(f"{c}_in" if c in ("shard", "slot") else c) for c in docs.columns]
    (
        rows.join(plan, "row")
        .select(*own, "shard", "slot")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
