import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.llm import simhash
from pairwright.llm.components import components

from .messy import documents, empty_documents, texts


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def slow_roots(fps, distance=4):
    roots = {f: f for f in fps}

    def top(f):
        while roots[f] != f:
            f = roots[f]
        return f

    fps = list(roots)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= distance:
                roots[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in fps}


def test_contract(spark):
    rows = texts()
    got = simhash.simhash_components(documents(spark)).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{slow_fingerprint(t):016x}") for i, t in rows)
    roots = slow_roots({slow_fingerprint(t) for _, t in rows})
    least = {}
    for i, t in rows:
        if i is not None:
            root = roots[slow_fingerprint(t)]
            least[root] = min(least.get(root, i), i)
    assert all(r.component_id == least.get(roots[int(r.fingerprint, 16)]) for r in got)


def test_empty(spark):
    assert simhash.simhash_components(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("bucket", [8, 4096])
def test_links_keep_components(spark, bucket):
    rng = np.random.default_rng(bucket)
    centres = rng.integers(0, 2**63, 12)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 8), replace=False)
            fps.add(int(np.uint64(c) ^ np.uint64(sum(1 << int(b) for b in flips))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = {r.node % 2**64: r.root % 2**64 for r in components(simhash.links(nodes, bucket=bucket)).collect()}
    want = slow_roots(fps)

    def groups(roots):
        out = {}
        for f in fps:
            out.setdefault(roots.get(f, f), set()).add(f)
        return sorted(map(sorted, out.values()))

    assert groups(found) == groups(want)


@settings(max_examples=200)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_linked_fingerprints_share_a_variant(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    x = np.array([fp ^ other], dtype=np.uint64)
    assert simhash._first_key(x)[0] >= 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_dropping_keeps_one_of_each_group(spark):
    docs = documents(spark)
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 2 not in ids and None in ids and ids.count(12) == 1


def test_dropping_goes_by_row_where_ids_repeat(spark):
    a, b = "the first text " + "of many words " * 9, "quite another thing " + "said in other terms " * 9
    docs = documents(spark, [(1, a), (5, a), (5, b), (None, a)])
    got = sorted(((r.doc_id or 0), r.text) for r in simhash.drop_near_copies(docs).collect())
    assert got == sorted([(0, a), (1, a), (5, b)])


def test_dropping_against_brute_force(spark):
    rows = [*texts(), (12, "same id, another text " + "with words of its own " * 5), (1, None)]
    kept = simhash.drop_near_copies(documents(spark, rows)).collect()
    roots = slow_roots({slow_fingerprint(t) for i, t in rows if i is not None})
    of = lambda t: roots[slow_fingerprint(t)]
    least = {}
    for i, t in rows:
        if i is not None:
            least[of(t)] = min(least.get(of(t), i), i)
    named = [r for r in kept if r.doc_id is not None]
    assert sorted((of(r.text), r.doc_id) for r in named) == sorted(least.items())
    assert len(kept) - len(named) == sum(i is None for i, _ in rows)
