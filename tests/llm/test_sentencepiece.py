import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.llm import sentencepiece as sp

from .messy import documents, empty_documents, texts

DATA = sp.read_model()
EXTRA = ["", " ", "  a  b ", "▁", "a▁b▁▁c", "\n\n x\ty", "😀 𝔘", "\x00x", "<s> </s> <unk> <0x41>", "é é", "a" * 3000, " \n " * 50, "世界 こんにちは"]


def test_parity_on_awkward_texts():
    assert sp.verify_parity(DATA, [t or "" for _, t in texts()] + EXTRA) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_parity_on_any_text(text):
    assert sp.verify_parity(DATA, [text.encode("utf-8", "ignore").decode()]) == []


def test_small_cache_changes_nothing(monkeypatch):
    whole = [x.tolist() for x in sp.Codec(DATA).encode(EXTRA)]
    monkeypatch.setattr(sp, "CACHE_WORDS", 4)
    codec = sp.Codec(DATA)
    assert [codec.encode([t])[0].tolist() for t in EXTRA] == whole


def test_contract(spark):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    got = sp.digest(documents(spark), DATA).collect()
    want = {}
    for i, t in texts():
        ids = theirs.encode(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True)
    assert len(got) == len(texts())
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.round_trip) == want[r.doc_id]


def test_columns_stay(spark):
    docs = documents(spark)
    out = sp.encode_decode(docs, DATA, keep=tuple(docs.columns))
    assert out.columns == [*docs.columns, "token_ids", "decoded", "round_trip"]
    assert all(r.decoded == (r.text or "") for r in out.collect())
    assert sp.encode_decode(empty_documents(spark), DATA).count() == 0


def unigram_model(tmp_path):
    """A unigram model file written by hand: pieces with scores, byte fallback, nothing trained."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("▁the", -3.0, 1), ("▁cat", -5.0, 1), ("c", -6.5, 1), ("a", -6.0, 1), ("t", -6.2, 1), ("s", -5.5, 1), ("▁c", -5.6, 1), ("at", -4.8, 1), ("the", -7.0, 1)]
    data = b""
    for piece, score, kind in pieces:
        body = message(1, piece.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind)
        data += message(1, body)
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
    normalizer = message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1) + varint(5 << 3) + varint(1)
    return data + message(2, trainer) + message(3, normalizer)


def test_unigram_models_are_rebuilt(tmp_path):
    data = unigram_model(tmp_path)
    model = sp.Model.parse(data)
    assert model.kind == sp.UNIGRAM and model.byte_fallback and model.remove_extra_whitespaces
    assert sp.verify_parity(data, ["the cat", "  the   cats ", "ca at s", "the é", "", "cat\ncat"]) == []


def test_unknown_kinds_are_refused():
    with pytest.raises(ValueError, match="neither"):
        sp.build(sp.Model(pieces=[("a", 0.0, 1)], kind=3))
