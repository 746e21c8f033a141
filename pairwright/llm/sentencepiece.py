"""SentencePiece models on the tokenizers library.

The model protobuf is parsed here (no generated classes): pieces with scores and
kinds, the trainer's model type and byte fallback, the normaliser's flags and
its compiled character map. From these the tokenizer is rebuilt: normaliser,
metaspace marker, unigram scores or, for a BPE model, merges ordered by the
scores of what they make, and byte fallback. Batches are encoded with the
library's threads. Parity is verified against the sentencepiece library.

Between words nothing can merge if no piece holds the marker after another
character; then texts are cut before each run of markers and a word's ids are
computed once per worker process and reused. A cache of words is emptied when it reaches
``CACHE_WORDS`` entries, so memory stays bounded.

Edge cases: null and empty texts have no ids and decode to the empty string;
ids and text of any length are whole; unpaired or unknown characters fall back
to bytes; repeated rows give equal results; extra columns are kept aside.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extend, map_chunks, texts_of

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
CACHE_WORDS = 150_000
JOINED = 500
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(field number, value) of a protobuf message; values are ints or bytes."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if not byte & 0x80:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            yield key >> 3, data[i : i + size]
            i += size


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes = b""

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, dtype="<f4")[0])
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        model.kind = v
                    elif n == 35:
                        model.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        model.charsmap = v
                    elif n == 3:
                        model.add_dummy_prefix = bool(v)
                    elif n == 4:
                        model.remove_extra_whitespaces = bool(v)
                    elif n == 5:
                        model.escape_whitespaces = bool(v)
        return model

    @property
    def words_are_apart(self) -> bool:
        """True if no piece has the marker after another character."""
        return not any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED))


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best result first."""
    ids = {p: i for i, (p, _, k) in enumerate(model.pieces) if k in (NORMAL, USER_DEFINED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL and len(piece) > 1:
            pairs = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in ids and piece[i:] in ids]
            found += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in pairs]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model):
    """A tokenizers.Tokenizer equal to the model on normalised, marked text."""
    from tokenizers import Tokenizer, models, normalizers

    unknown = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), None)
    if model.kind == BPE:
        core = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(model.pieces)},
            merges=merges_of(model),
            unk_token=None if unknown is None else model.pieces[unknown][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        from tokenizers import Regex

        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    return tokenizer


class Codec:
    """Encode and decode whole texts; one for each task."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = Model.parse(data)
        self.tokenizer = build(self.model)
        self.apart = self.model.words_are_apart
        self.cache: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.cut = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
        kinds = [k for _, _, k in self.model.pieces]
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else -1
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() for p, _, k in self.model.pieces]
        self.text_of = [str(i).encode() for i in range(len(raw))]
        self.width = np.array([len(x) for x in raw], dtype=np.int64)
        space = (MARKER.encode(), b" ") if self.model.escape_whitespaces else (b"", b"")
        self.plain = [
            b"" if k == CONTROL else " \u2047 ".encode() if k == UNKNOWN else x if k == BYTE else x.replace(*space)
            for x, k in zip(raw, kinds)
        ]

    def marked(self, text: str) -> str:
        """The normalised text with markers for spaces."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if text and self.model.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", MARKER) if self.model.escape_whitespaces else text

    def _raw(self, texts: list[str]) -> list[list[int]]:
        normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, None
        try:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        finally:
            if normalizer is not None:
                self.tokenizer.normalizer = normalizer

    def _fresh(self, words: list[str]) -> None:
        """Ids of unseen words. Words are encoded many at a time, joined, and told apart by their bytes' ends."""
        joined = [w for w in words if w[0] == MARKER and w[-1] != MARKER]
        groups = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        alone = [w for w in words if w[0] != MARKER or w[-1] == MARKER]
        for group, ids in zip(groups, self._raw(["".join(g) for g in groups])):
            row = np.array(ids, dtype=np.int64)
            if self.unknown in ids:
                alone += group
                continue
            ends = np.cumsum([len(w.encode()) for w in group])
            at = [0, *np.searchsorted(np.cumsum(self.width[row]), ends, side="right").tolist()]
            data = row.astype(np.int32).tobytes()
            for word, i, j in zip(group, at, at[1:]):
                self.cache[word] = data[4 * i : 4 * j]
        for word, ids in zip(alone, self._raw(alone)):
            self.cache[word] = np.array(ids, dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [self.marked(t) for t in texts]
        if not self.apart:
            return [np.array(x, dtype=np.int32) for x in self._raw(marked)]
        split = [self.cut.findall(t) for t in marked]
        seen = set().union(*split) if split else set()
        if len(self.cache) + len(fresh := seen - self.cache.keys()) > CACHE_WORDS:
            self.cache, fresh = {}, seen
        if fresh:
            self._fresh(list(fresh))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), dtype=np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the sentencepiece library gives it."""
        text = b"".join(map(self.plain.__getitem__, ids.tolist())).decode("utf-8", errors="replace")
        return text[1:] if self.model.add_dummy_prefix and text[:1] == " " else text


_CODECS: dict[bytes, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """One codec for all tasks of a worker process, so that words seen before stay known."""
    key = hashlib.sha256(data).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def verify_parity(data: bytes, texts: list[str]) -> list[int]:
    """Positions of texts whose ids or decoded text differ from the sentencepiece library's."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    ours = Codec(data)
    wrong = []
    for i, (text, ids) in enumerate(zip(texts, ours.encode(texts))):
        want = theirs.encode(text)
        if want != ids.tolist() or theirs.decode(want) != ours.decode(ids):
            wrong.append(i)
    return wrong


def read_model(path: str = MODEL_PATH) -> bytes:
    """The model file, read on the driver; its bytes (under ``MAX_MODEL``) go to tasks with the code."""
    with open(path, "rb") as file:
        data = file.read(MAX_MODEL + 1)
    if len(data) > MAX_MODEL:
        raise ValueError(f"{path} is larger than {MAX_MODEL} bytes")
    return data


MAX_MODEL = 64 << 20


def encode_decode(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns ``keep`` with token_ids (array<int>), decoded (string) and round_trip.

    round_trip: the ids decode to the text itself. ``prefix`` goes before the
    three names where they would clash.
    """
    names = [f"{prefix}{n}" for n in ("token_ids", "decoded", "round_trip")]
    schema = extend(docs.select(*keep).schema, f"{names[0]} array<int>, {names[1]} string, {names[2]} boolean")

    def make():
        codec = codec_of(model)

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t.decode("utf-8", errors="replace") for t in texts_of(piece)]
            ids = codec.encode(texts)
            decoded = [codec.decode(x) for x in ids]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    *(piece.column(c) for c in keep),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array(decoded, pa.string()),
                    pa.array([a == b for a, b in zip(texts, decoded)], pa.bool_()),
                ],
                [*keep, *names],
            )

        return work

    return map_chunks(docs.select(*dict.fromkeys((*keep, "text"))), make, schema)


def digest(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids joined by commas), decoded_sha256, round_trip; one row a document."""
    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    schema = extend(docs.select("doc_id").schema, added)

    def make():
        codec = codec_of(model)

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            raw = texts_of(piece)
            ids = codec.encode([t.decode("utf-8", errors="replace") for t in raw])
            decoded = [codec.decode(x).encode() for x in ids]
            return pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(b",".join(map(codec.text_of.__getitem__, x.tolist()))).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    pa.array([a == b for a, b in zip(raw, decoded)], pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

        return work

    return map_chunks(docs.select("doc_id", "text"), make, schema)


__all__ = ["Codec", "Model", "digest", "encode_decode", "read_model", "verify_parity"]
