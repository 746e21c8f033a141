"""Benchmark decontamination by a distributed positional inverted index.

Words are maximal runs of bytes other than ASCII separators after A-Z is
lower-cased. A phrase is a window of ten consecutive words of an item (the whole
item if shorter). One pass over the training texts stores postings (term, text, position)
of the test set's terms as a table dealt out and sorted by term. Of these only
positions are stored around which enough terms stand to hold a window, one of them a window's
anchor, which loses no match. A window's anchor is the term that is rarest in a sample of the texts; any
choice gives the same matches, a rare one a smaller index.

A window takes the posting list of its rarest term, shifted by the term's offset,
and so has its candidate places. The candidates and the lists of their other terms then meet by
text, where the shifted lists are intersected, rarest first; what is left is
every exact occurrence. Proximity matches chain the lists outward from the rarest
term and keep spans of bounded length, the window's and ``SLOP`` words more.

Texts are named by two 64-bit hashes of all their bytes and terms by one of theirs, so copies of
a text are indexed and searched once. Windows are never collected: joins by term and by text
distribute them. What travels to all tasks is the test set's vocabulary, 24 bytes a distinct word and the word.

Edge cases: null and empty texts have no words and no hits; an item without
words gives no window; repeated items each count; a null item id is left out;
long texts are indexed whole; repeated rows give equal results; an empty table gives an empty
result; extra columns are kept aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, extend, map_chunks, texts_of, written

WINDOW = 10
SLOP = 5
#: Bytes of text whose words a task holds at a time.
CHUNK = 2 << 20
#: One text in so many, by its hash, tells which terms are rare.
SAMPLE = 64
LIST_PARTS = 32
#: Lower-cases A-Z and turns 00-2F, 3A-60 (after lower-casing) and 7B-7F into spaces.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c
    for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def term(word: bytes) -> int:
    """A word's name: 64 bits, signed."""
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def _windows(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """w, terms, words and items (all that have it, as text) of every distinct window; written."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")
    )

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            items, found = [], []
            for item, text in zip(piece.column("item").to_pylist(), texts_of(piece)):
                own = words(text)
                if own:
                    each = [own[i : i + width] for i in range(max(1, len(own) - width + 1))]
                    found += each
                    items += [item] * len(each)
            names = [[term(w) for w in x] for x in found]
            columns = [pa.array(items, pa.string()), pa.array(names, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["item", "terms", "words"])

        return work

    each = map_chunks(rows, make, "item string, terms array<bigint>, words array<binary>")
    distinct = each.groupBy("terms").agg(F.collect_set("item").alias("items"), F.first("words").alias("words"))
    return written(distinct.select(F.monotonically_increasing_id().alias("w"), "terms", "words", "items"))


class Finder:
    """Numbers of the words of texts that stand in a list, found for all words of a chunk at once.

    A word's key is its length and its first and last eight bytes, which are all of it up to 16 bytes; longer words whose key is
    known are looked up whole. Keys are mixed to 64 bits, of which 16 tell at once that most words aren't in the list.
    """

    def __init__(self, listed: list[bytes]):
        self.numbers = {w: i for i, w in enumerate(listed)}
        data = b" " * 8 + b" ".join(listed) + b" " * 8
        sizes = np.fromiter(map(len, listed), dtype=np.int64, count=len(listed))
        ends = 8 + np.cumsum(sizes + 1) - 1
        self.first, self.last, self.size, self.mixed = self._keys(data, ends - sizes, ends)
        order = np.argsort(self.mixed, kind="stable")
        self.order = order
        self.sorted = self.mixed[order]
        self.known = np.zeros(1 << 16, dtype=bool)
        self.known[self.mixed >> np.uint64(48)] = True

    @staticmethod
    def _keys(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        view = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        size = ends - starts
        short = np.minimum(size, 8).astype(np.uint64)
        first = view[starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
        last = np.where(size > 8, view[ends - 8], np.uint64(0))
        mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (last * np.uint64(0xD1342543DE82EF95) + size.astype(np.uint64))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return first, last, size, mixed ^ (mixed >> np.uint64(29))

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text; for all words, one text after the other, their number in the list or -1."""
        data = b" " * 8 + b" ".join(t.translate(FOLD) for t in texts) + b" " * 8
        filled = np.frombuffer(data, dtype=np.uint8) != 0x20
        starts = np.flatnonzero(filled[1:] & ~filled[:-1]) + 1
        ends = np.flatnonzero(filled[:-1] & ~filled[1:]) + 1
        begin = 8 + np.cumsum([0, *(len(t) + 1 for t in texts)])
        sizes = np.diff(np.searchsorted(starts, begin))
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.sorted) or not len(starts):
            return sizes, out
        first, last, size, mixed = self._keys(data, starts, ends)
        some = np.flatnonzero(self.known[mixed >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.sorted, mixed[some]), len(self.sorted) - 1)
        same = self.sorted[at] == mixed[some]
        some, number = some[same], self.order[at[same]]
        sure = (size[some] <= 16) & (first[some] == self.first[number]) & (last[some] == self.last[number]) & (size[some] == self.size[number])
        out[some[sure]] = number[sure]
        # long words, and keys that mix alike
        for i in some[~sure].tolist():
            out[i] = self.numbers.get(data[starts[i] : ends[i]], -1)
        return sizes, out


class Vocabulary:
    """The test set's terms, sorted, and for each length of windows which terms stand in such a window and which are anchors of one."""

    def __init__(self, terms: np.ndarray, listed: list[bytes], lengths: dict[int, np.ndarray], anchors: dict[int, np.ndarray], slop: int):
        self.terms, self.slop, self.sizes = terms, slop, sorted(lengths)
        self.lengths, self.anchors = ({k: self._marks(found.get(k)) for k in self.sizes} for found in (lengths, anchors))
        self.pad = max(self.sizes, default=1) + slop
        self.finder = Finder(listed)

    def _marks(self, numbers: np.ndarray | None) -> np.ndarray:
        out = np.zeros(len(self.terms), dtype=bool)
        if numbers is not None:
            out[numbers] = True
        return out

    def kept(self, place: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which of the terms at these places a window may need: those in some span of a window's length and ``slop`` that
        begins at one and holds as many terms of such windows, an anchor among them."""
        out = np.zeros(len(place), dtype=bool)
        for size in self.sizes:
            own = np.flatnonzero(self.lengths[size][number])
            if len(own) < size:
                continue
            at, span = place[own], size + self.slop
            first = np.flatnonzero(at[size - 1 :] - at[: len(at) - size + 1] < span)
            last = np.searchsorted(at, at[first] + span)
            anchors = np.concatenate(([0], np.cumsum(self.anchors[size][number[own]])))
            held = anchors[last] > anchors[first]
            edges = np.bincount(first[held], minlength=len(at) + 1) - np.bincount(last[held], minlength=len(at) + 1)
            out[own[np.cumsum(edges[:-1]) > 0]] = True
        return out

    def postings(self, texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text; number of stored postings of each; their terms and positions."""
        sizes, ids = self.finder.find(texts)
        begin = np.cumsum(sizes) - sizes
        place = np.flatnonzero(ids >= 0)
        text = np.searchsorted(begin, place, side="right") - 1
        # nothing spans two texts
        keep = np.flatnonzero(self.kept(place + text * self.pad, ids[place]))
        place, text = place[keep], text[keep]
        return sizes.tolist(), np.bincount(text, minlength=len(texts)), self.terms[ids[place]], (place - begin[text]).astype(np.int32)


def _term_counts(docs: DataFrame, names: np.ndarray, listed: list[bytes]) -> DataFrame:
    """term, n of the terms in a sample of the texts."""
    shared = docs.sparkSession.sparkContext.broadcast((names, listed))

    def make():
        names, finder = shared.value[0], Finder(shared.value[1])

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            _, ids = finder.find(texts_of(piece))
            number, n = np.unique(ids[ids >= 0], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(names[number]), pa.array(n)], ["term", "n"])

        return work

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    return map_chunks(some, make, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _vocabulary(docs: DataFrame, windows: DataFrame) -> tuple[np.ndarray, list[bytes], dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Names of all terms, sorted, with their words, and by length of window the numbers of the terms in such windows and of their anchors."""
    each = windows.select("w", F.size("terms").alias("size"), F.explode(F.arrays_zip("terms", "words")).alias("x"))
    each = each.select("w", "size", F.col("x.terms").alias("term"), F.col("x.words").alias("word"))
    known = each.groupBy("term").agg(F.first("word").alias("word")).orderBy("term").toArrow()
    names, listed = np.asarray(known["term"]).astype(np.int64), known["word"].to_pylist()
    pairs = each.select("size", "term").distinct().toArrow()
    counted = each.join(_term_counts(docs, names, listed), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    anchors = counted.groupBy("w", "size").agg(F.min_by("term", F.struct("n", "term")).alias("term"))

    def by_size(found: pa.Table) -> dict[int, np.ndarray]:
        sizes, numbers = np.asarray(found["size"]), np.searchsorted(names, np.asarray(found["term"]).astype(np.int64))
        return {size: numbers[sizes == size] for size in np.unique(sizes).tolist()}

    return names, listed, by_size(pairs), by_size(anchors.select("size", "term").distinct().toArrow())


def _scan(docs: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """h1, h2 (the text's name), n_words, terms, places for every row of ``docs`` (with its other columns); written."""
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(docs, windows))
    rows = _named(docs)
    names = [c for c in rows.columns if c != "text"]

    def make():
        vocabulary = Vocabulary(*shared.value, slop)

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            sizes, counts, terms, places = vocabulary.postings(texts_of(piece))
            offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (terms, places)]
            return pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in names), pa.array(sizes, pa.int64()), *lists], [*names, "n_words", "terms", "places"]
            )

        return work

    schema = extend(rows.select(*names).schema, "n_words bigint, terms array<bigint>, places array<int>")
    return written(map_chunks(rows, make, schema, limit=CHUNK))


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with the name of the text: two hashes of all its bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(text, F.lit(1))})


class Lists:
    """Posting lists of one text: sorted (term, position) keys over terms numbered from 0."""

    def __init__(self, terms: np.ndarray, places: np.ndarray):
        self.names, ids = np.unique(terms, return_inverse=True)
        self.span = int(places.max(initial=0)) + 2
        self.keys = np.sort(ids * self.span + places)
        self.count = np.bincount(ids, minlength=len(self.names) + 1)

    def numbers(self, table: np.ndarray) -> np.ndarray:
        """Term names of windows as numbers; of a term without postings one that has none."""
        place = np.minimum(np.searchsorted(self.names, table), len(self.names) - 1)
        return np.where(self.names[place] == table, place, len(self.names))

    def has(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = number * self.span + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (place >= 0) & (place < self.span) & (self.keys[at] == key)

    def phrases(self, table: np.ndarray, length: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Rows of ``table`` whose terms all follow one another from ``start``."""
        order = np.argsort(np.where(table >= 0, self.count[table], np.iinfo(np.int64).max), axis=1, kind="stable")
        row = np.arange(len(table))
        for step in range(table.shape[1]):
            column = order[row, step]
            number = table[row, column]
            row = row[(number < 0) | self.has(number, start[row] + column)]
        return row

    def near(self, table: np.ndarray, length: np.ndarray, offset: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Rows whose terms follow in order, chained outward from ``place``, within their number and ``slop`` words."""
        low, high, alive = place.copy(), place.copy(), np.ones(len(table), dtype=bool)
        for step in range(1, table.shape[1]):
            for sign, edge in ((-1, low), (1, high)):
                column = offset + sign * step
                on = np.flatnonzero(alive & (column >= 0) & (column < length))
                number = table[on, column[on]]
                at = np.searchsorted(self.keys, number * self.span + edge[on], side="right" if sign > 0 else "left")
                at = at if sign > 0 else at - 1
                key = self.keys[np.clip(at, 0, len(self.keys) - 1)]
                ok = (at >= 0) & (at < len(self.keys)) & (key // self.span == number)
                edge[on] = np.where(ok, key % self.span, edge[on])
                alive[on] = ok
                alive &= high - low < length + slop
        return np.flatnonzero(alive)


def _cut(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets of a list column and its values."""
    return np.asarray(column.offsets), column.values


def _match(batches: Iterator[pa.RecordBatch], slop: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, terms, places, candidates) to (h1, h2, runs, exact, near): hit word ranges and numbers of windows."""
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        runs, exact, near = [], [], []
        (cut, terms), (_, places), (asked, fields) = (_cut(batch.column(c)) for c in ("terms", "places", "candidates"))
        terms, places, fields = np.asarray(terms), np.asarray(places).astype(np.int64), fields.flatten()
        w, offset, place = (np.asarray(x).astype(np.int64) for x in fields[:3])
        edges, names = _cut(fields[3])
        length, names = np.diff(edges), np.asarray(names)
        for k in range(batch.num_rows):
            own, mine = slice(cut[k], cut[k + 1]), slice(asked[k], asked[k + 1])
            lists, size = Lists(terms[own], places[own]), length[mine]
            table = np.full((len(size), int(size.max())), -1, dtype=np.int64)
            table[np.arange(table.shape[1]) < size[:, None]] = lists.numbers(names[edges[asked[k]] : edges[asked[k + 1]]])
            start = place[mine] - offset[mine]
            row = lists.phrases(table, size, start)
            merged: list[list[int]] = []
            for a, b in sorted(set(zip(start[row].tolist(), (start + size)[row].tolist()))):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            runs.append([{"start": a, "end": b} for a, b in merged])
            exact.append(np.unique(w[mine][row]))
            near.append(np.unique(w[mine][lists.near(table, size, offset[mine], place[mine], slop)]))
        columns = [pa.array(runs, run_type), *(pa.array(x, pa.list_(pa.int64())) for x in (exact, near))]
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), *columns], ["h1", "h2", "runs", "exact", "near"])


def build_index(scanned: DataFrame) -> DataFrame:
    """The stored index: term, h1, h2, place, each text once, dealt out and sorted by term; a term's list is cut into
    ``LIST_PARTS`` by text, as one passage may be in a third of all texts."""
    once = scanned.where(F.size("terms") > 0).groupBy("h1", "h2").agg(F.first(F.struct("terms", "places")).alias("p"))
    each = once.select("h1", "h2", F.explode(F.arrays_zip("p.terms", "p.places")).alias("x"))
    rows = each.select(F.col("x.terms").alias("term"), "h1", "h2", F.col("x.places").alias("place"))
    part = F.pmod("h1", F.lit(LIST_PARTS))
    return written(rows.repartition(F.col("term"), part).sortWithinPartitions("term", "h1", "h2", "place"))


def search(index: DataFrame, windows: DataFrame, slop: int = SLOP) -> DataFrame:
    """h1, h2, runs, items, near_items of every text in which a window occurs, exactly or nearly."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    each = windows.select("w", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    anchors = each.join(counts, "term").groupBy("w", "length").agg(
        F.count("*").alias("known"), F.min_by(F.struct("term", "offset"), F.struct("n", "offset")).alias("rarest")
    )
    # a window with a term that no text has is nowhere
    anchors = anchors.where("known = length").select("w", "rarest.term", "rarest.offset")
    asked = anchors.join(index, "term").join(windows.select("w", "terms"), "w")
    asked = asked.groupBy("h1", "h2").agg(F.collect_list(F.struct("w", "offset", "place", "terms")).alias("candidates"))
    # a text's postings are as many as it has words at most
    lists = index.groupBy("h1", "h2").agg(F.collect_list("term").alias("terms"), F.collect_list("place").alias("places"))
    schema = "h1 bigint, h2 bigint, runs array<struct<start:int,end:int>>, exact array<bigint>, near array<bigint>"
    matched = written(lists.join(asked, ["h1", "h2"]).mapInArrow(lambda b: _match(b, slop), schema).where("size(exact) + size(near) > 0"))

    def marked(column: str, exact: bool):
        return F.transform(column, lambda w: F.struct(w.alias("w"), F.lit(exact).alias("exact")))

    marks = F.concat(marked("exact", True), marked("near", False))
    hits = matched.select("h1", "h2", F.explode(marks).alias("m")).select("h1", "h2", "m.w", "m.exact")
    hits = hits.join(windows.select("w", "items"), "w").select("h1", "h2", "exact", F.explode("items").alias("item"))
    named = hits.groupBy("h1", "h2").agg(
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"),
        F.array_sort(F.collect_set(F.when(~F.col("exact"), F.col("item")))).alias("near_items"),
    )
    return written(matched.select("h1", "h2", "runs").join(named, ["h1", "h2"]))


def _found(scanned: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    index = build_index(scanned)
    found = search(index, windows, slop)
    discard(index, windows)
    return found


def _with_passages(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (h1, h2 and others) with what was found in their text; the found side has each text once."""
    found = found.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "runs", "items", "near_items")
    return rows.join(found, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left").drop("h1", "h2", "f1", "f2")


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slop: int = SLOP,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """in (a struct of all columns of ``docs``), n_words, runs (hit word ranges), items and near_items (ids as strings, sorted;
    null where nothing was found)."""
    windows = _windows(benchmark, window, item_col, item_text)
    scanned = _scan(docs.select(F.struct("*").alias("in"), F.col(text_col).alias("text")), windows, slop)
    found = _found(scanned, windows, slop)
    return _with_passages(scanned.drop("terms", "places"), found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """The contract's digest, one row a document, plus n_near and near_items (items with a proximity match)."""
    windows = _windows(benchmark, window, "item_id", "text")
    scanned = _scan(docs.select("doc_id", "text"), windows, slop)
    rows = _with_passages(scanned.drop("terms", "places"), _found(scanned, windows, slop))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"]).cast("long"))
    none = F.expr("cast(array() as array<string>)")
    items, near = F.coalesce("items", none), F.coalesce("near_items", none)
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(items) > 0).alias("contaminated"),
        F.size(near).cast("long").alias("n_near"),
        near.alias("near_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents that hold no window of any item, with their own columns. A text decides alike for all its copies."""
    windows = _windows(benchmark, window, "item_id", "text")
    scanned = _scan(docs.select("text"), windows, 0)
    found = _found(scanned, windows, 0).where(F.size("items") > 0).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"))
    discard(scanned)
    rows = _named(docs.select(F.struct("*").alias("in"), "text"))
    return rows.join(found, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left_anti").select("in.*")


__all__ = ["build_index", "contamination", "drop_contaminated", "find_passages", "search", "words"]
