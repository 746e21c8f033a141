"""Toxicity by compression distance: two zstandard dictionaries, one per class.

A window of eight words is compressed with a dictionary trained on ordinary text
and with one trained on toxic text; where the second gives a shorter result the
window is nearer to toxic text. Both dictionaries end in the same common part,
so they differ only in what is toxic text's own: words, or beginnings of words,
that stand behind many different words in toxic text and are rare in ordinary text (copies of one
passage have one context only, so they don't count as many). A text's window
differences become four numbers (largest, two largest, share and count of large
ones), calibrated to a probability on labelled texts that the dictionaries
didn't see.

Training: at most ``MAX_TOXIC`` and ``MAX_ORDINARY`` labelled rows that aren't held
out, in hash order. Of a text over ``MAX_TRAIN_TEXT`` bytes blocks of ``BLOCK_WORDS``
words from all over it, in hash order, up to that size take part; the common part is trained on
``COMMON_WINDOWS`` distinct windows in hash order. These bound the driver's memory; they are
parameters of the fit alone. Scoring reads every window of every whole text.

Edge cases: null and empty texts have one empty window and get a score; with
labels of one class only every score is that class's share, with none 0.5;
repeated rows score alike; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, fit_logistic, labelled_sample, logistic, map_chunks, remainder, texts_of

WINDOW_WORDS = 8
MAX_TOXIC, MAX_ORDINARY = 1500, 5000
MAX_TRAIN_TEXT, BLOCK_WORDS = 32 << 10, 64
COMMON_WINDOWS = 80_000
COMMON_BYTES, OWN_BYTES = 60_000, 1_500
LEAST_CONTEXTS, LEAST_RATIO = 4, 5.0
STEMS = (4, 5, 6)
LARGE = 4


def windows(text: bytes, width: int = WINDOW_WORDS) -> list[bytes]:
    found = text.lower().split()
    return [b" " + b" ".join(found[i : i + width]) + b" " for i in range(0, max(1, len(found)), width)]


def _contexts(texts: list[bytes]) -> dict[bytes, int]:
    """For each word and each word beginning of ``STEMS`` bytes, behind how many different words it stands."""
    seen: dict[bytes, set[bytes]] = defaultdict(set)
    for text in texts:
        before = b""
        for word in text.lower().split():
            for key in _keys(word):
                seen[key].add(before)
            before = word
    return {w: len(x) for w, x in seen.items()}


def _keys(word: bytes) -> list[bytes]:
    return [word + b" ", *(word[:n] for n in STEMS if len(word) > n)]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary, most useful last; of few samples simply their end."""
    samples = [s for s in samples if len(s) >= 8]
    plain = b"".join(samples)[-size:]
    try:
        data = zstandard.train_dictionary(size, samples, k=32, d=6, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return plain
    # what precedes the content are entropy tables, which mean nothing in a content dictionary
    return data[-(size * 9 // 10) :] if len(data) > size * 9 // 10 else data[len(data) // 8 :]


@dataclass
class Compressors:
    """Both dictionaries, compressors made on first use in each process."""

    common: bytes
    own: bytes
    made: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"common": self.common, "own": self.own, "made": None}

    def pair(self) -> tuple:
        if self.made is None:
            size = len(self.common) + len(self.own)
            how = zstandard.ZstdCompressionParameters.from_level(
                3, source_size=128, dict_size=size, min_match=5,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            made = []
            # equal lengths, or the two would run under different table sizes
            for content in (bytes(len(self.own)) + self.common, self.own + self.common):
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=how)
                made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress)
            self.made = tuple(made)
        return self.made

    def features(self, text: bytes) -> list[float]:
        ordinary, toxic = self.pair()
        gain = sorted((len(ordinary(w)) - len(toxic(w)) for w in windows(text)), reverse=True)
        large = sum(1 for g in gain if g >= LARGE)
        top = max(gain[0], 0)
        return [top, top + max(gain[1], 0) if len(gain) > 1 else top, 10 * large / (len(gain) + 3), np.log1p(large)]


def train_compressors(toxic: list[bytes], ordinary: list[bytes]) -> Compressors:
    ours, theirs = _contexts(toxic), _contexts(ordinary)
    n, m = max(sum(ours.values()), 1), max(sum(theirs.values()), 1)
    least = LEAST_CONTEXTS if len(toxic) >= 100 else 2
    own = {w for w, k in ours.items() if k >= least and k / n > LEAST_RATIO * (theirs.get(w, 0) + 1) / m}
    mine = [dict.fromkeys(w for w in t.lower().split() if not own.isdisjoint(_keys(w))) for t in toxic]
    only = [b" " + b" ".join(words) + b" " for words in mine]
    shared = sorted({w for t in ordinary for w in windows(t, 12)}, key=lambda w: (zlib.crc32(w), w))[:COMMON_WINDOWS]
    return Compressors(_trained(shared, COMMON_BYTES), _trained(only, OWN_BYTES))


@dataclass
class ToxicityModel:
    compressors: Compressors | None
    weights: np.ndarray | None
    share: float = 0.5

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.compressors is None:
            return np.full(len(texts), self.share)
        x = np.array([self.compressors.features(t) for t in texts], dtype=np.float64).reshape(-1, 4)
        return logistic(x, self.weights)


def training_text(text: bytes) -> bytes:
    """A text to learn from: itself, or of a long one blocks from all over it in the order of their hashes, then as they stand."""
    if len(text) <= MAX_TRAIN_TEXT:
        return text
    blocks = windows(text, BLOCK_WORDS)
    order = sorted(range(len(blocks)), key=lambda i: (zlib.crc32(blocks[i]), i))
    sizes = np.cumsum([len(blocks[i]) for i in order])
    return b"".join(blocks[i] for i in sorted(order[: max(1, int(np.searchsorted(sizes, MAX_TRAIN_TEXT)))]))


def _sample(docs: DataFrame, labels: DataFrame, label: str, value: int, limit: int) -> list[bytes]:
    """Training texts of one class: ``limit`` of ``MAX_TRAIN_TEXT`` bytes at most, whatever the corpus."""
    rows = labelled_sample(docs, labels.where(F.col(label) == value), label, limit).select("sample_id", "text")

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            cut = pa.array([training_text(t) for t in texts_of(piece)], pa.binary())
            return pa.RecordBatch.from_arrays([piece.column("sample_id"), cut], ["sample_id", "cut"])

        return work

    found = map_chunks(rows, make, extend(rows.select("sample_id").schema, "cut binary"))
    return [bytes(r["cut"]) for r in sorted(found.toLocalIterator(), key=lambda r: (r["sample_id"], bytes(r["cut"])))]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    toxic = _sample(docs, labels, label, 1, MAX_TOXIC)
    ordinary = _sample(docs, labels, label, 0, MAX_ORDINARY)
    if min(len(toxic), len(ordinary)) < 4:
        total = len(toxic) + len(ordinary)
        return ToxicityModel(None, None, len(toxic) / total if total else 0.5)
    x, y = [], []
    for half in (0, 1):
        other = train_compressors(toxic[1 - half :: 2], ordinary[1 - half :: 2])
        for texts, value in ((toxic[half::2], 1.0), (ordinary[half::2], 0.0)):
            x += [other.features(t) for t in texts]
            y += [value] * len(texts)
    weights = fit_logistic(np.array(x, dtype=np.float64), np.array(y))
    return ToxicityModel(train_compressors(toxic, ordinary), weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and toxicity_score."""

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            score = model.score(texts_of(piece))
            return pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in keep), pa.array(score, pa.float64())], [*keep, "toxicity_score"]
            )

        return work

    schema = extend(docs.select(*keep).schema, "toxicity_score double")
    return map_chunks(docs.select(*dict.fromkeys((*keep, "text"))), make, schema)


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"),
    )
