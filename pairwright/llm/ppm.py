"""Language-model scoring by prediction by partial matching over bytes, with a unigram baseline.

The model is a byte-context trie of order ``ORDER`` counted over all training
documents. A symbol is coded in the longest context of the trie that has it; on
the way down each context pays its escape probability (method C: distinct
symbols over total plus distinct) and the symbols it has are excluded below it.
Below order 0 all bytes not yet seen share the rest evenly. As the trie is
frozen, a text's code length is a sum over its positions. A text ends with an
end symbol (byte FF) and starts behind start symbols (FE); neither occurs in
UTF-8.

A position's score depends on its gram alone, the ``ORDER`` bytes before it and
its own. So grams of the whole corpus are counted, each distinct gram is scored
once by the whole trie, and positions look their gram up. Contexts that share
their last three bytes meet in one task, where the trie of these contexts is built;
contexts of up to two bytes (2**24 entries at most) travel to all tasks. No context
is left out, so what is gathered grows with the corpus.

The most frequent grams (``HEAD_GRAMS`` at most, by a count of the scored texts)
travel as a hash table; positions of rarer ones are joined to the scores by gram.
Words of the baseline go the same way (``HEAD_WORDS``). As what isn't in a head is
rare, neither join has a hot key. Words of more than ``LONG_WORD`` bytes are named by a digest.

Edge cases: a null or empty text has the end token and end symbol only; without
training documents every byte has probability 1/256 and N = V = 0; long texts
are read whole; repeated rows are counted and scored each; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, extend, map_chunks, remainder, slices, texts_of, trim, written

START, END = 0xFE, 0xFF
ORDER = 5
HEAD_GRAMS = 1 << 20
HEAD_WORDS = 1 << 17
LONG_WORD = 64
#: Bytes of text worked on at a time, and counts held before they are passed on.
CHUNK = 2 << 20
HOLD_GRAMS, HOLD_WORDS = 1 << 21, 1 << 18
#: Grams from which the trie of some endings is built.
PART_GRAMS = 1 << 16
#: Classes a doubling of a count is cut into when a head is chosen.
STEPS = 8


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with their marks, and each text's first position."""
    mark = bytes([START] * ORDER)
    data = b"".join(x for t in texts for x in (mark, t, bytes([END])))
    sizes = np.fromiter((len(t) + ORDER + 1 for t in texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(data, dtype=np.uint8), np.cumsum(sizes) - sizes


def grams(symbols: np.ndarray) -> np.ndarray:
    """Codes of ``ORDER`` bytes of context and the symbol after them, for every symbol but start marks."""
    code = np.zeros(max(len(symbols) - ORDER, 0), dtype=np.int64)
    for k in range(ORDER + 1):
        code = (code << 8) | symbols[k : len(symbols) - ORDER + k]
    return code[symbols[ORDER:] != START]


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their counts."""
    unique, place = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(place, weights=n, minlength=len(unique)).astype(np.int64) for n in counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(learn, asked, text) to (gram, n, m): occurrences in texts to learn from, and in texts to score."""
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        return _summed(*(np.concatenate(x) for x in zip(*held)))

    for batch in batches:
        for piece in slices(batch, limit=CHUNK):
            texts, flags = texts_of(piece), list(zip(piece.column("learn").to_pylist(), piece.column("asked").to_pylist()))
            for learn, asked in set(flags):
                some = [t for t, f in zip(texts, flags) if f == (learn, asked)]
                keys, n = np.unique(grams(stream(some)[0]), return_counts=True)
                held.append((keys, n * bool(learn), n * bool(asked)))
            if sum(len(x[0]) for x in held) > HOLD_GRAMS:
                held = [merged()]
                if len(held[0][0]) > HOLD_GRAMS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["gram", "n", "m"])
                    held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["gram", "n", "m"])
    del held
    trim()


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), long ones by a digest behind a byte that no text has."""
    found = text.lower().split()
    if len(text) > LONG_WORD:
        found = [w if len(w) <= LONG_WORD else b"\xff" + hashlib.blake2b(w, digest_size=16).digest() for w in found]
    return found


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(learn, asked, text) to (word, n, m)."""
    learnt: Counter = Counter()
    scored: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = list(learnt.keys() | scored.keys())
        columns = [pa.array([c[w] for w in words], pa.int64()) for c in (learnt, scored)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *columns], ["word", "n", "m"])

    for batch in batches:
        for piece in slices(batch, limit=CHUNK):
            for text, learn, asked in zip(texts_of(piece), piece.column("learn").to_pylist(), piece.column("asked").to_pylist()):
                found = words_of(text)
                if learn:
                    learnt.update(found)
                if asked:
                    scored.update(found)
            if len(learnt) + len(scored) > HOLD_WORDS:
                yield out()
                learnt.clear()
                scored.clear()
    if learnt or scored:
        yield out()


def _find(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and which are there."""
    if not len(held):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    place = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return place, held[place] == keys


@dataclass
class Level:
    """All contexts of ``size`` bytes: their symbols' counts, totals, distinct symbols, and what these symbols count one level below."""

    size: int
    key: np.ndarray  # context and symbol, sorted
    count: np.ndarray
    context: np.ndarray  # sorted
    total: np.ndarray
    kinds: np.ndarray
    covered: np.ndarray

    @staticmethod
    def of(gram: np.ndarray, n: np.ndarray, size: int, below: Level | None) -> Level:
        key, count = _summed(gram & ((1 << 8 * (size + 1)) - 1), n)
        context, place = np.unique(key >> 8, return_inverse=True)

        def sums(weights: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(place, weights=weights, minlength=len(context)).astype(np.float64)

        covered = sums(below.counts(key)) if below else np.zeros(len(context))
        return Level(size, key, count, context, sums(count), sums(), covered)

    def counts(self, gram: np.ndarray) -> np.ndarray:
        place, there = _find(self.key, gram & ((1 << 8 * (self.size + 1)) - 1))
        return np.where(there, self.count[place] if len(self.count) else 0, 0)


def base_levels(pair: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of no, one and two bytes of context from counts of the last."""
    levels: list[Level] = []
    for size in range(3):
        levels.append(Level.of(pair, n, size, levels[-1] if levels else None))
    return levels


def gram_scores(asked: np.ndarray, gram: np.ndarray, n: np.ndarray, base: list[Level]) -> np.ndarray:
    """log10 probability of each asked gram's last symbol; ``gram`` and ``n`` are all counts that share its three-byte endings."""
    levels = list(base)
    for size in range(3, ORDER + 1):
        levels.append(Level.of(gram, n, size, levels[-1]))
    score, todo = np.zeros(len(asked)), np.ones(len(asked), dtype=bool)
    kinds_above, covered_above = np.zeros(len(asked)), np.zeros(len(asked))
    for level in reversed(levels):
        place, there = _find(level.context, (asked >> 8) & ((1 << 8 * level.size) - 1))
        if not len(level.context):
            continue
        # what contexts above have is excluded; they hold a part of this one's symbols
        distinct = np.where(there, level.kinds[place] - kinds_above, 0)
        bottom = np.where(there, level.total[place] - covered_above, 0) + distinct
        count = level.counts(asked)
        coded = todo & there & (count > 0)
        score[coded] += np.log10(count[coded] / bottom[coded])
        todo &= ~coded
        down = todo & there & (distinct > 0)
        score[down] += np.log10(distinct[down] / bottom[down])
        kinds_above = np.where(there, level.kinds[place], kinds_above)
        covered_above = np.where(there, level.covered[place], covered_above)
    rest = 256 - (int(levels[0].kinds[0]) if len(levels[0].kinds) else 0)
    return np.where(todo, score - np.log10(max(rest, 1)), score)


def scored_grams(counted: DataFrame) -> DataFrame:
    """gram, m and score of every gram in ``counted`` (gram, n, m) by the whole trie of the counts n."""
    known = counted.where("n > 0")
    # two bytes of context and a symbol: 2**24 rows at most
    pairs = known.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    shared = counted.sparkSession.sparkContext.broadcast(tuple(np.asarray(pairs[c]).astype(np.int64) for c in ("pair", "n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = base_levels(*shared.value)
        held, size = [], 0

        def out(part: np.ndarray) -> pa.RecordBatch:
            _, gram, n, m = part
            value = gram_scores(gram, gram[n > 0], n[n > 0], base)
            return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(m), pa.array(value)], ["gram", "m", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
            if size >= PART_GRAMS:
                part = np.concatenate(held, axis=1)
                ready = int(np.searchsorted(part[0], part[0, -1]))  # the last ending may go on in the next batch
                if ready:
                    yield out(part[:, :ready])
                held, size = [part[:, ready:]], part.shape[1] - ready
        if size:
            yield out(np.concatenate(held, axis=1))

    ending = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("ending")
    rows = counted.select(ending, "gram", "n", "m").repartition("ending").sortWithinPartitions("ending")
    return rows.mapInArrow(run, "gram bigint, m bigint, score double")


def _head(rows: DataFrame, m: Column, limit: int) -> DataFrame:
    """The rows of the largest ``m``, whole classes of counts, ``limit`` rows at most."""
    step = F.floor(F.log2(F.greatest(m, F.lit(1))) * STEPS)
    held, least = 0, None
    for r in sorted(rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > limit:
            break
        least = r["step"]
    return rows.where(step >= least) if least is not None else rows.where(F.lit(False))


@dataclass
class Table:
    """Open-addressing hash table from gram to score."""

    key: np.ndarray
    value: np.ndarray
    shift: int

    @staticmethod
    def of(key: np.ndarray, value: np.ndarray) -> Table:
        bits = max(4, int(2 * len(key)).bit_length())
        table = Table(np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits), 64 - bits)
        slot, left = table._slot(key), np.arange(len(key))
        while len(left):
            free = table.key[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            table.key[slot[put]], table.value[slot[put]] = key[left[put]], value[left[put]]
            rest = np.ones(len(left), dtype=bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(table.key) - 1)
        return table

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Scores, nan for grams that aren't held."""
        slot = self._slot(key)
        found = self.key[slot]
        value = np.where(found == key, self.value[slot], np.nan)
        left = np.flatnonzero((found != key) & (found >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.key) - 1)
            found = self.key[slot]
            hit = found == key[left]
            value[left[hit]] = self.value[slot[hit]]
            on = ~hit & (found >= 0)
            left, slot = left[on], slot[on]
        return value

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's sum over the grams held, all other grams, and how many of these each text has."""
        symbols, start = stream(texts)
        code = grams(symbols)
        got = self.get(code)
        far = np.isnan(got)
        place = np.flatnonzero(symbols[ORDER:] != START) + ORDER
        value = np.zeros(len(symbols))
        value[place] = np.where(far, 0.0, got)
        text = np.searchsorted(start, place[far], side="right") - 1
        return np.add.reduceat(value, start), code[far], np.bincount(text, minlength=len(texts))


#: What tasks of one worker process share: grams and words of the heads.
_HELD: dict[str, tuple[Table, dict[bytes, tuple[int, float]]]] = {}


def score_texts(
    docs: DataFrame, training: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """``keep`` with n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``, learning from ``training``."""
    learn = training.select(F.lit(True).alias("learn"), F.lit(False).alias("asked"), F.col(text_col).alias("text"))
    asked = docs.select(F.lit(False).alias("learn"), F.lit(True).alias("asked"), F.col(text_col).alias("text"))
    return _scored(docs, learn.unionAll(asked), keep, text_col)


def _scored(docs: DataFrame, rows: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """As ``score_texts``; ``rows`` (learn, asked, text) holds both sides."""
    context = docs.sparkSession.sparkContext
    ends = rows.where("learn").count()
    counted = written(
        rows.mapInArrow(_count_grams, "gram bigint, n bigint, m bigint").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    )
    scores = written(scored_grams(counted).where("m > 0"))
    discard(counted)
    words = rows.mapInArrow(_count_words, "word binary, n bigint, m bigint")
    words = written(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    tokens, kinds = total + ends, distinct + (1 if ends else 0)
    bottom = tokens + 0.1 * (kinds + 1)

    def log_share(count: int) -> float:
        return float(np.log10((count + 0.1) / bottom))

    # both heads are bounded tables: HEAD_GRAMS pairs of numbers, HEAD_WORDS words of LONG_WORD bytes at most
    head = _head(scores, F.col("m"), HEAD_GRAMS).select("gram", "score").toArrow()
    table = Table.of(np.asarray(head["gram"]).astype(np.int64), np.asarray(head["score"]).astype(np.float64))
    head = _head(words.where("m > 0"), F.col("m"), HEAD_WORDS).select("word", "n").toArrow()
    shares = {w: (int(n > 0), log_share(n)) for w, n in zip(head["word"].to_pylist(), head["n"].to_pylist())}
    shared, name, end_share = context.broadcast((table, shares)), uuid.uuid4().hex, log_share(ends)
    del head, table, shares
    kept_names = [f"_keep_{c}" for c in keep]
    numbered = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        *[F.col(c).alias(k) for c, k in zip(keep, kept_names)],
        F.col(text_col).alias("_text"),
    )

    def make():
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = shared.value
        model, known_words = _HELD[name]

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(piece, "_text")
            n_tokens, n_known, base, tail, times, sizes = [], [], [], [], [], []
            for text in texts:
                found = words_of(text)
                known, score, before = (1 if ends else 0), end_share, len(tail)
                for word, n in Counter(found).items():
                    if (held := known_words.get(word)) is None:
                        tail.append(word)
                        times.append(n)
                    else:
                        known += n * held[0]
                        score += n * held[1]
                n_tokens.append(len(found) + 1)
                n_known.append(known)
                base.append(score)
                sizes.append(len(tail) - before)
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            scored, far, far_sizes = model.scores(texts)
            columns = [
                piece.column("_row"),
                *(piece.column(c) for c in kept_names),
                pa.array(n_tokens, pa.int64()),
                pa.array(n_known, pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(scored, pa.float64()),
                pa.ListArray.from_arrays(offsets, pa.array(tail, pa.binary())),
                pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *far_sizes]), pa.int32()), pa.array(far)),
            ]
            names = ["_row", *kept_names, "n_tokens", "n_known", "base", "score", "tail", "times", "far"]
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    added = "n_tokens bigint, n_known bigint, base double, score double, tail array<binary>, times array<bigint>, far array<bigint>"
    near = written(map_chunks(numbered, make, extend(numbered.select("_row", *kept_names).schema, added), "_text", CHUNK))
    rare = near.select("_row", F.explode(F.arrays_zip("tail", "times")).alias("x"))
    rare = rare.select("_row", F.col("x.tail").alias("word"), F.col("x.times").alias("times")).join(words, "word")
    share = F.col("times") * F.log10((F.col("n") + F.lit(0.1)) / F.lit(float(bottom)))
    known = F.when(F.col("n") > 0, F.col("times")).otherwise(F.lit(0))
    far = near.select("_row", F.explode("far").alias("gram")).join(scores.select("gram", F.col("score").alias("value")), "gram")
    zero = F.lit(0.0)
    found = rare.select("_row", known.alias("known"), share.alias("share"), zero.alias("value")).unionAll(
        far.select("_row", F.lit(0).cast("bigint"), zero, "value")
    )
    found = found.groupBy("_row").agg(F.sum("known").alias("more_known"), F.sum("share").alias("more"), F.sum("value").alias("far_score"))
    out = near.drop("tail", "times", "far").join(found, "_row", "left")
    return out.select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept_names)],
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("far_score", zero)).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns: learns from documents whose remainder modulo 10 is not 0, scores all."""
    docs = docs.select("doc_id", "text")
    rows = docs.select((remainder("doc_id", 10) != 0).alias("learn"), F.lit(True).alias("asked"), "text")
    return _scored(docs, rows, ("doc_id",), "text").select(
        "doc_id",
        (remainder("doc_id", 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
