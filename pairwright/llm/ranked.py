"""Ranked lexical search over a two-level quantised inverted index.

The index is made of blocks of documents. Level two of a block holds its postings (term, document, number of occurrences)
sorted by term, with the documents' lengths; level one holds one byte for each posting, its impact
rounded up to a multiple of ``STEP``. A term's impact is the part of the score that is a whole number
below 10**6 and depends on the document alone, so the bytes hold for every query.

A search reads level one twice. Bytes times weights sum up to an upper bound of a document's score,
and with each byte less one to a lower bound. The first reading finds, for each item, the k-th largest lower bound
of all documents: every task keeps k a block, Spark ranks what they kept. The second rescores, exactly and in whole numbers, every
document whose upper bound reaches that; no document below it can be among the k best, as a true score is
above its lower bound. Each task keeps its k best by score and id, and Spark ranks these.

The number of documents and of terms, and the number of documents with a term, are counted over the whole
index. Items are searched in blocks of at most ``MAX_ITEMS`` items and ``MAX_TERMS`` terms (or one item),
so what a search broadcasts is bounded; all documents are read for each block. A block of documents is a row of up to some
megabytes; files are written and read, and rows passed to Python, ``GROUP_ROWS`` at a time. Terms are named by 64 bits of a hash.

Edge cases: null and empty texts have no terms and are in no result; an item without terms, or whose terms
no document has, has no rows; repeated items are items of their own; a null doc_id comes first among equal scores, and rows of the same id
in no particular order; texts of any length are read whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, extend, map_chunks, ordered, release, rows_a_batch, texts_of, written
from .repeats import Hashes

TOP = 10
CHUNK = 4 << 20
BLOCK_DOCS = 4096
GROUP_ROWS = 2
MAX_ITEMS = 512
MAX_TERMS = 1 << 20
#: An impact is below 10**6, so 255 steps hold it.
STEP = -(-1_000_000 // 255)
#: Lower-cases A-Z and turns what isn't a letter, digit or byte of a wider character into spaces.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(n_docs: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held + 1)))


def dampings(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents by their numbers of terms."""
    return 10 + (90 * lengths * n_docs) // max(n_terms, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Index:
    """Blocks: seqs and lengths of documents; terms and how many postings each has; of the postings document, tf, and impact byte."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


_BLOCK = "held bigint, total bigint, seqs array<bigint>, lengths array<bigint>, terms array<bigint>, counts array<int>, docs array<int>, tfs array<int>"


def _postings(texts: list[bytes], memo: Hashes) -> tuple[np.ndarray, ...]:
    """Lengths; names of terms, sorted, and numbers of postings; documents and occurrences of the postings."""
    found = [terms(t) for t in texts]
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    distinct = list(set(chain.from_iterable(found)))
    names = memo.of(distinct).view(np.int64)
    order = np.argsort(names)
    number = {distinct[i]: rank for rank, i in enumerate(order.tolist())}
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(lengths.sum()))
    key = np.sort(ids * len(texts) + np.repeat(np.arange(len(texts)), lengths))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf, key = np.diff(np.append(first, len(key))), key[first]
    return lengths, names[order], np.bincount(key // len(texts), minlength=len(names)), key % len(texts), tf


def build_index(docs: DataFrame) -> Index:
    """The index of ``docs`` (seq, text), all documents and all terms, as a table in the shared folder."""
    fields = [(f.name, pa.int64() if f.dataType.typeName() == "long" else None) for f in extend(docs.select().schema, _BLOCK).fields]

    def make():
        memo = Hashes()

        def one(piece: pa.RecordBatch) -> dict:
            lengths, names, counts, doc, tf = _postings(texts_of(piece), memo)
            columns = (np.asarray(piece.column("seq")), lengths, names, counts.astype(np.int32), doc.astype(np.int32), tf.astype(np.int32))
            row = [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
            return row + [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns]

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            parts = [one(piece.slice(i, BLOCK_DOCS)) for i in range(0, piece.num_rows, BLOCK_DOCS)]
            arrays = [pa.concat_arrays(x) for x in zip(*parts)]
            return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])

        return work

    raw = written(map_chunks(docs.select("seq", "text"), make, _BLOCK, limit=CHUNK), GROUP_ROWS)
    n_docs, n_terms = raw.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    schema = extend(raw.drop("held", "total").schema, "bytes binary")

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                lengths, doc, tf = (_list(row, c, 0) for c in ("lengths", "docs", "tfs"))
                impact = impacts(tf.astype(np.int64), dampings(lengths, n_docs, n_terms)[doc])
                level = pa.array([(-(-impact // STEP)).astype(np.uint8).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*row.columns, level], schema.fieldNames())

    with rows_a_batch(docs.sparkSession, GROUP_ROWS):
        blocks = written(raw.drop("held", "total").mapInArrow(quantise, schema), GROUP_ROWS)
    discard(raw)
    release(docs)
    return Index(blocks, n_docs, n_terms)


def _list(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return np.asarray(batch.column(name)[k].values)


class Queries:
    """Items of one block: their terms as numbers, the items of each term, the terms' weights."""

    def __init__(self, items: list[list[int]], held: dict[int, int], n_docs: int):
        self.size = len(items)
        self.names = np.array(sorted(held), dtype=np.int64)
        self.weights = np.array([weight(n_docs, held[t]) for t in self.names.tolist()], dtype=np.int64)
        number = {t: i for i, t in enumerate(self.names.tolist())}
        self.items = [np.array(sorted({number[t] for t in own if t in number}), dtype=np.int64) for own in items]
        by_term: list[list[int]] = [[] for _ in number]
        for item, own in enumerate(self.items):
            for t in own.tolist():
                by_term[t].append(item)
        self.by_term = [np.array(x, dtype=np.int64) for x in by_term]

    def known(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``names`` of the queries' terms, and their numbers."""
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        place = np.flatnonzero(self.names[at] == names)
        return place, at[place]

    def bounds(self, batch: pa.RecordBatch, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, dict[int, int]]:
        """Upper and lower bounds (item by document, in steps) of a block; where each term's postings begin and end; places of terms by number."""
        names, counts, doc = (_list(batch, c, k) for c in ("terms", "counts", "docs"))
        level = np.frombuffer(batch.column("bytes")[k].as_py(), dtype=np.uint8).astype(np.int64)
        cuts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        n = len(batch.column("seqs")[k]) if "seqs" in batch.schema.names else batch.column("n")[k].as_py()
        high = np.zeros((self.size, n), dtype=np.int64)
        low = np.zeros_like(high) if lower else None
        place, number = self.known(names)
        for p, t in zip(place.tolist(), number.tolist()):
            own, w = slice(cuts[p], cuts[p + 1]), self.weights[t]
            cells = np.ix_(self.by_term[t], doc[own])
            high[cells] += w * level[own]
            if lower:
                low[cells] += w * np.maximum(level[own] - 1, 0)
        return high, low, cuts, dict(zip(number.tolist(), place.tolist()))

    def exact(self, item: int, some: np.ndarray, m: np.ndarray, doc: np.ndarray, tf: np.ndarray, cuts: np.ndarray, places: dict[int, int]) -> np.ndarray:
        """Scores of the documents ``some`` (by number in the block) for an item."""
        asked, score = np.zeros(len(m), dtype=bool), np.zeros(len(m), dtype=np.int64)
        asked[some] = True
        for t in self.items[item].tolist():
            if (p := places.get(t)) is not None:
                own = doc[cuts[p] : cuts[p + 1]]
                on = asked[own]
                own = own[on]
                score[own] += self.weights[t] * impacts(tf[cuts[p] : cuts[p + 1]][on].astype(np.int64), m[own])
        return score[some]


def _lower_bounds(queries, k: int) -> Callable:
    """A task's ``k`` largest lower bounds of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        best = np.full((own.size, k), -1, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                high, low, *_ = own.bounds(batch, row, True)
                every = np.concatenate([best, np.where(high > 0, low, -1)], axis=1)
                best = -np.partition(-every, k - 1, axis=1)[:, :k]
        item, column = np.nonzero(best >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(best[item, column])], ["item", "low"])

    return run


def _rescored(queries, least: np.ndarray, k: int, n_docs: int, n_terms: int) -> Callable:
    """A task's ``k`` best documents of each item, of those whose upper bound reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        best = {}
        for batch in batches:
            for row in range(batch.num_rows):
                high, _, cuts, places = own.bounds(batch, row, False)
                some = (high > 0) & (high >= least[:, None])
                if not some.any():
                    continue
                seqs, lengths, doc, tf = (_list(batch, c, row) for c in ("seqs", "lengths", "docs", "tfs"))
                m = dampings(lengths, n_docs, n_terms)
                for item in np.flatnonzero(some.any(axis=1)).tolist():
                    asked = np.flatnonzero(some[item])
                    score, seq = own.exact(item, asked, m, doc, tf, cuts, places), seqs[asked]
                    if item in best:
                        score, seq = (np.concatenate(x) for x in zip(best[item], (score, seq)))
                    order = np.lexsort((seq, -score))[:k]
                    best[item] = score[order], seq[order]
        for item, (score, seq) in best.items():
            arrays = [pa.array(np.full(len(seq), item), pa.int32()), pa.array(seq), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "seq", "score"])

    return run


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """q, item_id and terms (names) of every row; written."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    schema = extend(rows.select("item_id").schema, "terms array<bigint>")

    def make():
        memo = Hashes()

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            names = [memo.of(list(set(terms(t)))).view(np.int64) for t in texts_of(piece)]
            return pa.RecordBatch.from_arrays([piece.column("item_id"), pa.array(names, pa.list_(pa.int64()))], ["item_id", "terms"])

        return work

    found = map_chunks(rows, make, schema).where(F.size("terms") > 0)
    return written(found.select(F.monotonically_increasing_id().alias("q"), "item_id", "terms"))


def _item_blocks(items: DataFrame, max_items: int, max_terms: int) -> list[DataFrame]:
    """``items`` cut by hash until no part exceeds the limits, but for parts of one item."""
    parts = 1
    while True:
        part = F.pmod(F.xxhash64("q"), F.lit(parts))
        sizes = items.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("t"))
        if sizes.where((F.col("n") > max_items) | ((F.col("n") > 1) & (F.col("t") > max_terms))).isEmpty():
            return [items.where(part == k) for k in range(parts)]
        parts *= 2


def search(index: Index, items: DataFrame, k: int = TOP, max_items: int = MAX_ITEMS, max_terms: int = MAX_TERMS) -> DataFrame:
    """item_id, rank, seq and score: the ``k`` best documents of each of ``items`` (from ``_items``)."""
    spark = items.sparkSession
    results = []
    for block in _item_blocks(items, max_items, max_terms):
        rows = block.select("q", "terms").collect()
        if not rows:
            continue
        asked = block.select(F.explode("terms").alias("term")).distinct()
        each = index.blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("x.terms", "x.counts")
        held = each.join(asked, F.col("terms") == F.col("term")).groupBy("term").agg(F.sum("counts").alias("held"))
        queries = spark.sparkContext.broadcast(Queries([r.terms for r in rows], dict(map(tuple, held.collect())), index.n_docs))
        level = index.blocks.select("terms", "counts", "docs", F.size("seqs").alias("n"), "bytes")
        lows = level.mapInArrow(_lower_bounds(queries, k), "item int, low bigint")
        kth = lows.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("r") <= k)
        least = np.zeros(len(rows), dtype=np.int64)
        with rows_a_batch(spark, GROUP_ROWS):
            for item, low in kth.where(F.col("r") == k).select("item", "low").collect():
                least[item] = low
        best = index.blocks.mapInArrow(_rescored(queries, least, k, index.n_docs, index.n_terms), "item int, seq bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "seq"))
        best = best.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)
        number = spark.createDataFrame([(i, r.q) for i, r in enumerate(rows)], "item int, q bigint")
        named = best.join(F.broadcast(number), "item").select("q", "rank", "seq", "score")
        with rows_a_batch(spark, GROUP_ROWS):
            results.append(written(named.join(block.select("q", "item_id"), "q").select("item_id", "rank", "seq", "score")))
    if not results:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("score")).limit(0)
    return reduce(DataFrame.unionAll, results)


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = TOP, item_col: str = "item_id", max_items: int = MAX_ITEMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of ``docs`` (doc_id, text) for every item."""
    rows = ordered(docs.select("doc_id", "text"))
    index = build_index(rows)
    items = _items(benchmark, item_col, "text")
    found = search(index, items, k, max_items)
    discard(index.blocks, items)
    # found holds at most k rows an item
    return rows.select("seq", "in.doc_id").join(found, "seq").select("item_id", "rank", "doc_id", "score")


__all__ = ["Index", "build_index", "rank_documents", "search", "terms"]
