import math
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairwright.llm import ppm

from .messy import documents, empty_documents, prose, texts

K = ppm.ORDER


def slow(rows, training):
    counts = [defaultdict(Counter) for _ in range(K + 1)]
    for t in training:
        x = b"\xfe" * K + t + b"\xff"
        for k in range(K, len(x)):
            for o in range(K + 1):
                counts[o][x[k - o : k]][x[k]] += 1

    def symbol(context, s):
        out, value = set(), 0.0
        for o in range(K, -1, -1):
            seen = {b: n for b, n in counts[o].get(context[K - o :], {}).items() if b not in out}
            if not seen:
                continue
            bottom = sum(seen.values()) + len(seen)
            if s in seen:
                return value + math.log10(seen[s] / bottom)
            value += math.log10(len(seen) / bottom)
            out |= set(seen)
        return value - math.log10(256 - len(out))

    scores = []
    for t in rows:
        x = b"\xfe" * K + t + b"\xff"
        scores.append(sum(symbol(x[k - K : k], x[k]) for k in range(K, len(x))))
    return scores


def split(rows):
    coded = [(i, (t or "").encode()) for i, t in rows]
    return coded, [t for i, t in coded if zlib.crc32(b"" if i is None else str(i).encode()) % 10]


def test_contract(spark):
    rows = texts() + [(i, prose(i, 25)) for i in range(40, 60)]
    coded, training = split(rows)
    counts = Counter(w for t in training for w in [*t.lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, t), score in zip(coded, slow([t for _, t in coded], training)):
        w = [*t.lower().split(), None]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        held = zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
        want.append((-1 if i is None else i, held, len(w), sum(counts[x] > 0 for x in w), n, pytest.approx(base), pytest.approx(score, rel=1e-9)))
    got = ppm.score_documents(documents(spark, rows)).fillna(-1, ["doc_id"]).collect()
    for g, w in zip(sorted(map(tuple, got)), sorted(want, key=lambda x: x[:5])):
        assert g == w


def test_tail_words_are_joined(spark, monkeypatch):
    rows = [(i, prose(i, 30)) for i in range(1, 30)]
    whole = {r.doc_id: (r.n_known, r.base_score) for r in ppm.score_documents(documents(spark, rows)).collect()}
    monkeypatch.setattr(ppm, "HEAD_WORDS", 3)
    for r in ppm.score_documents(documents(spark, rows)).collect():
        assert (r.n_known, pytest.approx(r.base_score)) == whole[r.doc_id]


def test_probabilities_add_up(spark):
    rows = [(i, prose(i, 30)) for i in range(1, 30)]
    symbols = np.concatenate([ppm.grams(ppm.stream([t.encode()])[0]) for _, t in rows])
    gram, n = np.unique(symbols, return_counts=True)
    pair, m = np.unique(gram & 0xFFFFFF, return_inverse=True)
    base = ppm.base_levels(pair, np.bincount(m, weights=n).astype(int))
    for context in (b"alpha", b"zzzzz", b"ga de"):
        asked = np.array([(int.from_bytes(context, "big") << 8) | b for b in range(256)])
        total = sum(10**s for s in ppm.gram_scores(asked, gram, n, base))
        assert 0.98 < total <= 1.0 + 1e-6


def test_rare_grams_are_joined(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(string.printable[:70], k=200))) for i in range(60)]
    rows += [(i, rows[i % 7][1][:90] + "#" + rows[i % 11][1][50:]) for i in range(60, 80)] + texts()[:9]
    coded, training = split(rows)
    want = dict(zip([i for i, _ in coded], slow([t for _, t in coded], training)))
    for grams, part in ((1 << 20, 1 << 16), (40, 50), (0, 5)):
        monkeypatch.setattr(ppm, "HEAD_GRAMS", grams)
        monkeypatch.setattr(ppm, "PART_GRAMS", part)
        got = ppm.score_documents(documents(spark, rows)).collect()
        assert len(got) == len(rows)
        assert all(r.score == pytest.approx(want[r.doc_id], rel=1e-9) for r in got if rows.count((r.doc_id, None)) == 0 and r.doc_id >= 12)


def test_training_on_another_table(spark):
    rows, other = [(i, prose(i, 20)) for i in range(8)], [prose(70 + i, 40) for i in range(9)]
    got = ppm.score_texts(documents(spark, rows), spark.createDataFrame([(t,) for t in other], "text string")).collect()
    want = dict(zip(range(8), slow([t.encode() for _, t in rows], [t.encode() for t in other])))
    assert {r.doc_id: r.score for r in got} == {i: pytest.approx(v) for i, v in want.items()}


def test_long_words_have_keys_of_their_own(spark):
    a, b = "x" * 500, "x" * 499 + "y"
    rows = [(i, f"{a} {a} {b}") for i in range(1, 8)] + [(9, a + "z")]
    learnt = sum(zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows)
    got = {r.doc_id: r for r in ppm.score_documents(documents(spark, rows)).collect()}
    assert got[1].n_known == 4 and learnt > 1


def test_empty(spark):
    assert ppm.score_documents(empty_documents(spark)).count() == 0
    alone = ppm.score_texts(spark.createDataFrame([(1, "ab")], "doc_id bigint, text string"), documents(spark, [])).first()
    assert alone.score == pytest.approx(-3 * math.log10(256)) and alone.train_tokens == 0 and alone.n_known == 0
