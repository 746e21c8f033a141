"""Substring dedup: passages of ``WINDOW`` words that stand earlier in the corpus are removed.

Words are runs of bytes other than ASCII white space, unchanged. Every window of consecutive
words of a document has a Rabin-Karp hash (a polynomial over the words' hashes, 64 bits, and 16 more
of a second one). Of the windows of a chunk of texts that share a hash only the first goes on,
packed with its document and place; the others repeat it and are noted at once. Spark deals the
packed hashes out by hash range, where each range's hashes are sorted and counted: all but the
first occurrence of a hash are repeats. Repeats meet by document and merge into maximal intervals
of words, and these are cut out.

A window is judged on the input, not on what is left: it repeats if its words also start earlier (in a document of
smaller id, or at an earlier place of the same one), whether or not that other place is removed as well.

A hash's range holds about ``PER_BUCKET`` windows, so the number of ranges follows the corpus; a window that
stands in a third of all documents reaches its range once a chunk.

Edge cases: null and empty texts and texts shorter than a window lose nothing; a null id is the smallest;
rows of the same id are documents of their own, in no particular order, so one of repeated rows keeps its words; texts of any
length are read whole; an empty table gives an empty result; extra columns stay aside, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, extend, map_chunks, ordered, release, texts_of, written

WINDOW = 20
CHUNK = 4 << 20
PER_BUCKET = 2_000_000
LEAST_BUCKETS = 64
#: Words whose hash a task remembers.
MEMO = 1 << 18
# Odd multipliers of the two polynomials and of the mixing step.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MIX = 0xBF58476D1CE4E5B9

words = bytes.split


def rolling(ids: np.ndarray, window: int, base: int) -> np.ndarray:
    """Polynomial of every ``window`` consecutive numbers modulo 2**64, mixed; by doubling, as size a + size b is one product and sum."""

    def joined(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
        return left * np.uint64(pow(base, size, 1 << 64)) + right

    total, held, block, size = None, 0, ids, 1
    while window:
        if window & 1:
            n = max(len(ids) - held - size + 1, 0)
            total = block if total is None else joined(total[:n], block[held : held + n], size)
            held += size
        window >>= 1
        if window:
            n = max(len(block) - size, 0)
            block, size = joined(block[:n], block[size : size + n], size), size * 2
    total = (total ^ (total >> np.uint64(31))) * np.uint64(MIX)
    return total ^ (total >> np.uint64(29))


class Hashes(dict):
    """Word to its hash; forgets all when it would hold too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def _pack(*arrays: np.ndarray) -> tuple[bytes, list[int]]:
    """Arrays of one length as bytes, by significance of the byte, compressed."""
    raw = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    whole = b"".join(raw)
    return pa.compress(whole, codec="zstd", asbytes=True), len(whole)


def _unpack(data: bytes, size: int, n: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    whole = np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd"), dtype=np.uint8)
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        planes = whole[at : at + n * kind.itemsize].reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


_PACKED = "bucket int, local boolean, n_docs int, n int, docs binary, docs_size int, places binary, places_size int"
_DOC, _PLACE, _HASHED = ("<i8", "<u4"), ("<u4",), ("<u4", "<u8", "<u2")


def _rows(doc: np.ndarray, place: np.ndarray, hashes: tuple[np.ndarray, ...], seqs: np.ndarray) -> tuple:
    """One packed row: the documents in it with their numbers of places, then places (as steps within a document) and hashes."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    counts = np.diff(np.append(first, len(doc)))
    docs, docs_size = _pack(seqs[doc[first]].astype("<i8"), counts.astype("<u4"))
    places, places_size = _pack(step.astype("<u4"), *hashes)
    return len(first), len(doc), docs, docs_size, places, places_size


def _unrow(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """seq and place of each window of a packed row, and its hashes."""
    seqs, counts = _unpack(row["docs"], row["docs_size"], row["n_docs"], _DOC)
    step, *hashes = _unpack(row["places"], row["places_size"], row["n"], _PLACE if row["local"] else _HASHED)
    total = np.cumsum(step, dtype=np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(seqs, counts), total - np.repeat(total[first] - step[first], counts), hashes


def _scan(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed rows of the windows of ``docs`` (seq, text)."""

    def make():
        memo = Hashes()
        names = [c.split()[0] for c in _PACKED.split(", ")]
        schema = pa.schema(zip(names, (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32())))

        def work(piece: pa.RecordBatch) -> pa.RecordBatch | None:
            seqs = np.asarray(piece.column("seq"))
            order = np.argsort(seqs)
            seqs, texts = seqs[order], texts_of(piece)
            found = [words(texts[i]) for i in order]
            del texts
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ids = np.concatenate([memo.of(x) for x in found]) if found else np.zeros(0, np.uint64)
            del found
            ends = np.cumsum(sizes)
            start = np.flatnonzero(np.arange(len(ids)) + window <= np.repeat(ends, sizes))
            if not len(start):
                return None
            h, g = (rolling(ids, window, base)[start] for base in BASES)
            g = (g >> np.uint64(48)).astype("<u2")
            doc = np.searchsorted(ends, start, side="right")
            place = start - (ends - sizes)[doc]
            order = np.argsort(h, kind="stable")
            new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])))
            rows, again = [], np.sort(order[~new])
            if len(again):
                rows.append((int(h[0] % np.uint64(buckets)), True, *_rows(doc[again], place[again], (), seqs)))
            once = np.sort(order[new])
            bucket = ((h[once] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            once = once[np.argsort(bucket, kind="stable")]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                own = once[cuts[k] : cuts[k + 1]]
                rows.append((k, False, *_rows(doc[own], place[own], (h[own].astype("<u8"), g[own]), seqs)))
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

        return work

    return map_chunks(docs.select("seq", "text"), make, _PACKED, limit=CHUNK)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, places) of the windows of one range that repeat an earlier one, and of those noted before."""
    parts = []

    def emit(seq: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """Rows of one document each, from windows in order of document."""
        first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        offsets = pa.array(np.append(first, len(seq)), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(seq[first]), lists], ["seq", "places"])

    for batch in batches:
        for row in batch.to_pylist():
            seq, place, hashes = _unrow(row)
            if row["local"]:
                yield emit(seq, place)
            else:
                parts.append((seq, place.astype(np.uint32), *hashes))
    if parts:
        seq, place, h, g = (np.concatenate(x) for x in zip(*parts))
        del parts
        # only hashes that stand more than once need the order of their places
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        many = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        seq, place, h, g = seq[many], place[many], h[many], g[many]
        order = np.lexsort((place, seq, g, h))
        again = order[1:][(h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])]
        if len(again):
            again = again[np.argsort(seq[again], kind="stable")]
            yield emit(seq[again], place[again])


def _merge(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(seq, lists of places) to (seq, runs): maximal intervals of words."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        runs = []
        for lists in batch.column("places"):
            at = np.sort(np.concatenate([np.asarray(x.values) for x in lists.values]))
            cut = np.flatnonzero(np.diff(at) > window)
            first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + window
            runs.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist())])
        yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(runs, kind)], ["seq", "runs"])


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """seq and runs (word ranges, end exclusive) of every document of ``docs`` (seq, text) that repeats a window."""
    bytes_in = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(bytes_in // (6 * PER_BUCKET)))
    again = _scan(docs, window, buckets).groupBy("bucket").applyInArrow(_repeats, "seq bigint, places array<int>")
    again = written(again)
    release(docs)
    lists = again.groupBy("seq").agg(F.collect_list("places").alias("places"))
    runs = written(lists.mapInArrow(lambda b: _merge(b, window), "seq bigint, runs array<struct<start:int,end:int>>"))
    discard(again)
    release(docs)
    return runs


def _kept(docs: DataFrame, window: int, columns: str, finish: Callable[..., tuple]) -> DataFrame:
    """``in`` of every row with what ``finish`` makes of its words and those that stay."""
    rows = ordered(docs)
    runs = repeated_passages(rows.select("seq", "text"), window).withColumnRenamed("seq", "run_seq")
    joined = rows.join(runs, F.col("seq") == F.col("run_seq"), "left").select("in", "text", "runs")
    schema = extend(joined.select("in").schema, columns)

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, runs in zip(piece.column("text").to_pylist(), piece.column("runs").to_pylist()):
                raw = (text or "").encode()
                if runs is None:
                    out.append(finish(text, words(raw), None))
                    continue
                found, kept, at = words(raw), [], 0
                for run in runs:
                    kept += found[at : run["start"]]
                    at = run["end"]
                out.append(finish(text, found, kept + found[at:]))
            arrays = [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(zip(*out), schema.fields[1:])]
            return pa.RecordBatch.from_arrays([piece.column("in"), *arrays], schema.fieldNames())

        return work

    return map_chunks(joined, make, schema)


def repeat_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (the words that stay, joined by one space) of every row of ``docs``."""

    def finish(text: str | None, found: list[bytes], kept: list[bytes] | None) -> tuple:
        rest = found if kept is None else kept
        return len(found), len(found) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest()

    rows = _kept(docs.select("doc_id", "text"), window, "n_words bigint, n_removed bigint, kept_sha256 string", finish)
    return rows.select("in.doc_id", "n_words", "n_removed", "kept_sha256")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words that stay in ``text``, joined by one space where any word went; n_chars, if there, is recounted."""

    def finish(text: str | None, found: list[bytes], kept: list[bytes] | None) -> tuple:
        return (text if kept is None else b" ".join(kept).decode(),)

    rows = _kept(docs, window, "kept_text string", finish)
    out = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[out.get(c, F.col(f"in.`{c}`")).alias(c) for c in docs.columns])


__all__ = ["drop_repeats", "repeat_report", "repeated_passages", "rolling"]
