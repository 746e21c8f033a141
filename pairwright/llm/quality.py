"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (lengths, character
classes, repetition, compressibility). For each class a mean and a shrinkage
covariance are fitted on a bounded labelled sample; a text's score compares its
two Gaussian log densities, whose Mahalanobis terms use Cholesky factors
computed once. A one-variable logistic map fitted on the same sample turns the
difference into a probability.

Edge cases: null and empty texts have the statistics of the empty text and get
a score like any other; long texts are read whole; repeated rows score alike;
with labels of one class only every score is that class's share, and with none
it is 0.5; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, labelled_sample, map_chunks, remainder, texts_of

MAX_TRAIN = 6000
THRESHOLD = 0.3
SHRINKAGE = 0.05
FEATURES = (
    "chars", "words", "word_length", "word_length_spread", "upper", "digit", "punctuation", "symbol", "other",
    "distinct", "top_word", "line_words", "repeated_lines", "end_marks", "short_words", "adjacent_repeats", "zipped",
)
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[ord(c) for c in ".,;:'\"!?()-"]] = 3
_CLASS[[ord(c) for c in "#$%&*+/<=>@[]\\^_`{|}~"]] = 4
_CLASS[0x80:0xC0] = 5  # UTF-8 continuation bytes
_CLASS[[0x20, *range(0x09, 0x0E)]] = 6


def _logit(share: float, n: float) -> float:
    """Log odds of a share of n, smoothed so that 0 and 1 stay finite."""
    return float(np.log((share * n + 0.5) / (n - share * n + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The values named in ``FEATURES``."""
    raw = np.frombuffer(text, dtype=np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=7) if len(raw) else np.zeros(7, dtype=np.int64)
    chars = len(text) - int(kinds[5])
    letters = max(chars - int(kinds[6]), 0)
    found = text.split()
    n = len(found)
    lengths = np.fromiter(map(len, found), dtype=np.float64, count=n) if n else np.zeros(1)
    counts = Counter(found)
    top = max(counts.values(), default=0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = sum(1 for w in counts.elements() if not (w[-1:].isalnum() or w[-1] >= 0x80 or w[-1:] in b".,;:?"))
    again = sum(map(bytes.__eq__, found, found[1:]))
    # lengths come in through logs and near-independent shares, so a long clean text looks like a short one
    return [
        np.log1p(chars),
        np.log1p(n),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        _logit(kinds[1] / max(letters, 1), letters),
        _logit(kinds[2] / max(letters, 1), letters),
        _logit(kinds[3] / max(letters, 1), letters),
        _logit(kinds[4] / max(letters, 1), letters),
        _logit(min(1.0, kinds[5] / max(letters, 1)), letters),
        np.log1p(len(counts)) / max(np.log1p(n), 0.1),
        _logit(top / max(n, 1), n),
        np.log1p(n / max(len(lines), 1)),
        _logit(1 - len(set(lines)) / max(len(lines), 1), len(lines)),
        _logit(marks / max(n, 1), n),
        _logit(float((lengths <= 3).sum()) / max(n, 1), max(n, 1)),
        _logit(again / max(n, 1), n),
        np.log((len(zlib.compress(text, 1)) + 1) / (len(text) + 12)),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log terms of both classes, and the logistic map."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    terms: list[float]
    slope: float
    offset: float
    share: float | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
        if len(set(y.tolist())) < 2 or min((y == 0).sum(), (y == 1).sum()) < 2:
            share = float(y.mean()) if len(y) else 0.5
            return cls(np.zeros(0), np.ones(0), [], [], [], 0.0, 0.0, share)
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - centre) / scale
        means, factors, terms = [], [], []
        for k in (0, 1):
            own = z[y == k]
            mean = own.mean(axis=0)
            cov = (own - mean).T @ (own - mean) / len(own)
            width = z.shape[1]
            cov = (1 - shrinkage) * cov + shrinkage * (0.5 * np.trace(cov) / width + 0.5) * np.eye(width)
            factor = np.linalg.cholesky(cov)
            means.append(mean)
            factors.append(np.linalg.inv(factor))
            terms.append(-float(np.log(np.diag(factor)).sum()) + float(np.log(len(own) / len(z))))
        model = cls(centre, scale, means, factors, terms, 1.0, 0.0)
        model.slope, model.offset = logistic_map(model.difference(x), y)
        return model

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, squashed so that far tails keep their order."""
        z = (x - self.centre) / self.scale
        value = [
            term - 0.5 * (((z - mean) @ factor.T) ** 2).sum(axis=1)
            for mean, factor, term in zip(self.means, self.factors, self.terms)
        ]
        return np.arcsinh(value[1] - value[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -40, 40)))


def logistic_map(value: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton's method."""
    a = np.stack([value, np.ones_like(value)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, label: str = "quality") -> Discriminant:
    """Fit on at most ``max_train`` labelled texts that aren't held out."""

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            values = [statistics(t) for t in texts_of(piece)]
            return pa.RecordBatch.from_arrays(
                [piece.column("sample_id"), piece.column("label"), pa.array(values, pa.list_(pa.float64()))],
                ["sample_id", "label", "x"],
            )

        return work

    sample = labelled_sample(docs, labels, label, max_train)
    rows = map_chunks(sample, make, extend(sample.select("sample_id", "label").schema, "x array<double>")).toPandas()
    rows = rows.sort_values("sample_id", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return Discriminant.fit(x, rows["label"].to_numpy(dtype=np.int64))


def score_quality(docs: DataFrame, model: Discriminant, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and quality_score."""
    fields = [docs.schema[c] for c in keep]
    schema = extend(docs.select(*keep).schema, "quality_score double")

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t) for t in texts_of(piece)], dtype=np.float64).reshape(-1, len(FEATURES))
            columns = [piece.column(f.name) for f in fields]
            return pa.RecordBatch.from_arrays([*columns, pa.array(model.score(x))], [*keep, "quality_score"])

        return work

    return map_chunks(docs.select(*dict.fromkeys((*keep, "text"))), make, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit_quality(docs, labels, max_train)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents whose score reaches the threshold, with their own columns."""
    model = fit_quality(docs, labels)
    schema = docs.schema
    names = [f.name for f in schema.fields]

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch | None:
            x = np.array([statistics(t) for t in texts_of(piece)], dtype=np.float64).reshape(-1, len(FEATURES))
            kept = piece.filter(pa.array(model.score(x) >= threshold))
            return kept.select(names) if kept.num_rows else None

        return work

    return map_chunks(docs, make, schema)
