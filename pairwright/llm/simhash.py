"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 majority bits of the XXH64 hashes of a text's 4-word
shingles. Two fingerprints link at ``DISTANCE`` (4) or fewer differing bits.
Cut into three segments, two linked fingerprints must have a segment in which
they differ in one bit at most, as three segments with two differences each make
six. So every distinct fingerprint is indexed under each segment with one bit
turned into a wildcard (64 variants), variants are matched by equality, and
pairs are verified on all bits.

Equal fingerprints are one node, so copies are never paired. A variant's bucket
doesn't emit pairs but a spanning forest of the links in it, found by a search
that drops a node once it is reached, so a bucket of m close fingerprints gives
m - 1 edges. A bucket over ``BUCKET`` fingerprints is cut into blocks and each pair
of blocks is searched on its own, which loses no link.

Edge cases: null and empty texts have fingerprint zero and link like any other;
texts of one to three words have one shingle; long texts are read whole in
pieces; repeated rows share a component; a null id stays null and is never
another row's component id; rows that share an id are rows of their own, each with
its fingerprint; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, extend, map_chunks, texts_of, written
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
BUCKET = 4096
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PIECE = 1 << 16
#: Keys under which a fingerprint's component is listed, so that many copies don't meet in one task.
SALTS = 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text's bytes."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) >= width:
        starts, ends = starts[: len(found) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), PIECE):
        pairs = zip(starts[k : k + PIECE].tolist(), ends[k : k + PIECE].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    majority = np.packbits(total * 2 > len(starts), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``id_cols`` and fp (signed long)."""
    rows = docs.select(*id_cols, F.col(text_col).alias("_text"))

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            fps = [fingerprint(t) for t in texts_of(piece, "_text")]
            return pa.RecordBatch.from_arrays([*(piece.column(c) for c in id_cols), pa.array(fps, pa.int64())], [*id_cols, "fp"])

        return work

    return map_chunks(rows, make, extend(rows.select(*id_cols).schema, "fp bigint"), "_text")


def _variants(fp: str = "fp"):
    """Array of the keys of a fingerprint: segment, wildcard bit and the segment's other bits."""
    keys = []
    for s, (first, size) in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned(F.col(fp), first).bitwiseAND(F.lit((1 << size) - 1))
        for bit in range(size):
            tag = (s * 32 + bit) << 32
            keys.append(segment.bitwiseAND(F.lit(~(1 << bit) & ((1 << size) - 1))).bitwiseOR(F.lit(tag)))
    return F.array(*keys)


def _heavy_buckets(nodes: DataFrame, bucket: int) -> DataFrame:
    """Keys of buckets that may hold more than ``bucket`` fingerprints, with their number of blocks.

    A bucket joins the two values of one segment that differ in the wildcard, so
    one of them alone has more than half of it. Only these values are counted up.
    """
    values = []
    for s, (first, size) in enumerate(SEGMENTS):
        part = F.shiftrightunsigned(F.col("fp"), first).bitwiseAND(F.lit((1 << size) - 1))
        values.append(F.struct(F.lit(s).alias("s"), part.alias("value")))
    counts = (
        nodes.select(F.explode(F.array(*values)).alias("x"))
        .groupBy("x.s", "x.value")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > bucket // 2)
    )
    bits = F.when(F.col("s") == 0, F.lit(SEGMENTS[0][1])).otherwise(F.lit(SEGMENTS[1][1]))
    return (
        counts.withColumn("bit", F.explode(F.sequence(F.lit(0), bits - 1)))
        .select(
            F.expr("(value & ~shiftleft(1L, bit)) | shiftleft(cast(s * 32 + bit AS bigint), 32)").alias("key"),
            "n",
        )
        .groupBy("key")
        .agg((F.sum("n") + bucket // 2).alias("n"))
        .select("key", F.ceil(F.col("n") / bucket).cast("int").alias("blocks"))
        .where("blocks > 1")
    )


def _first_key(x: np.ndarray) -> np.ndarray:
    """The first variant (segment, bit) in which two fingerprints with difference ``x`` meet."""
    out = np.full(len(x), -1, dtype=np.int64)
    for s in reversed(range(len(SEGMENTS))):
        first, size = SEGMENTS[s]
        part = (x >> np.uint64(first)) & np.uint64((1 << size) - 1)
        ones = np.bitwise_count(part)
        bit = np.where(ones == 1, np.log2(np.maximum(part, 1).astype(np.float64)).astype(np.int64), 0)
        out = np.where(ones <= 1, s * 32 + bit, out)
    return out


def _forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among ``fps``."""
    out, left = [], fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            hit = np.bitwise_count(left ^ at) <= distance
            if hit.any():
                reached = left[hit]
                out.append((np.full(len(reached), at), reached))
                frontier.extend(reached)
                left = left[~hit]
    return out


def _link(distance: int, small: int = 24):
    """Reads (key, pair, fp) sorted by key and pair; gives edges a, b."""

    def edges(key: np.ndarray, pair: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        change = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        starts = np.concatenate(([0], change))
        size = np.diff(np.concatenate((starts, [len(key)])))
        group = np.repeat(np.arange(len(starts)), size)
        found = []
        few = size[group] <= small
        for step in range(1, min(int(size[size <= small].max(initial=1)), len(key))):
            same = np.flatnonzero((group[step:] == group[:-step]) & few[:-step])
            a, b = fp[same], fp[same + step]
            x = a ^ b
            ok = (np.bitwise_count(x) <= distance) & (_first_key(x) == key[same] >> 32)
            found.append((a[ok], b[ok]))
        for g in np.flatnonzero(size > small):
            found += _forest(fp[starts[g] : starts[g] + size[g]], distance)
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, dtype=np.uint64)
        if not len(a):
            return None
        b = np.concatenate([x for _, x in found])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            new = tuple(np.asarray(batch.column(i)) for i in range(3))
            if not batch.num_rows:
                continue
            held.append((new[0], new[1], new[2].view(np.uint64)))
            key, pair = new[0], new[1]
            if held[0][0][0] == key[-1] and held[0][1][0] == pair[-1]:
                continue  # one bucket so far; its size is bounded by its blocks
            whole = tuple(np.concatenate(x) for x in zip(*held))
            last = int(np.flatnonzero((whole[0] != key[-1]) | (whole[1] != pair[-1]))[-1]) + 1
            held = [tuple(x[last:] for x in whole)]
            if (out := edges(*(x[:last] for x in whole))) is not None:
                yield out
        if held and (out := edges(*(np.concatenate(x) for x in zip(*held)))) is not None:
            yield out

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges a, b among distinct fingerprints (column fp) that keep every linked pair connected."""
    if distance >= 2 * len(SEGMENTS):
        raise ValueError(f"{len(SEGMENTS)} segments find distances under {2 * len(SEGMENTS)} only")
    heavy = _heavy_buckets(nodes, bucket)
    # the few rows of an aggregate become 64 each, so they are dealt to all tasks first
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.repartition(spread).select("fp", F.explode(_variants()).alias("key")).join(heavy, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.when(
        F.col("blocks").isNotNull(),
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda c: (F.least(own, c) * F.col("blocks") + F.greatest(own, c)).cast("int"),
        ),
    ).otherwise(F.array(F.lit(0)))
    return (
        rows.select("key", F.explode(pairs).alias("pair"), "fp")
        .repartition("key", "pair")
        .sortWithinPartitions("key", "pair")
        .mapInArrow(_link(distance), "a bigint, b bigint")
    )


def _marked(docs: DataFrame, id_cols: tuple[str, ...], least: str, distance: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """``id_cols`` and fp of every row; and fp (as of_fp) with the smallest ``least`` of its component, as top."""
    marked = checkpoint(fingerprints(docs, id_cols))
    nodes = marked.groupBy("fp").agg(F.min(least).alias("least"))
    roots = components(links(nodes.select("fp"), distance, bucket))
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    tops = linked.groupBy("root").agg(F.min("least").alias("top"))
    linked = linked.join(tops, "root").select(F.col("fp").alias("linked_fp"), "top")
    of = nodes.join(linked, F.col("fp") == F.col("linked_fp"), "left")
    return marked, of.select(F.col("fp").alias("of_fp"), F.coalesce("top", "least").alias("top"))


def simhash_components(docs: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    marked, of = _marked(docs.select("doc_id", "text"), ("doc_id",), "doc_id", distance, bucket)
    # copies of one text share a fingerprint, so the join to the fingerprints' components is by a key that may be hot:
    # each fingerprint has one row there, listed under SALTS keys of which a document takes one
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    spread = of.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = marked.withColumn("salt", salt)
    return rows.join(spread, (rows["fp"] == spread["of_fp"]) & (rows["salt"] == spread["of_salt"])).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("top").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: that of the smallest id and, among rows that share it, the first of them; rows without an id
    stay. Columns of ``docs``.

    Rows are told apart by a number, as ids may repeat, so the numbered table is written once.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    rows = written(named.select(F.struct("*").alias("in"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row")))
    texts = rows.select(F.struct("id", "row").alias("key"), F.col("in.text").alias("text"))
    marked, of = _marked(texts, ("key",), "key", distance, BUCKET)
    first = of.select("top.id", "top.row").distinct()
    kept = rows.join(first, ["id", "row"], "left_semi").select("in.*")
    return kept.unionAll(docs.where(F.col("doc_id").isNull()))
