import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import repeats

from .messy import documents, empty_documents, prose, texts


def slow(rows, window):
    """(n_words, n_removed, kept) of each row in order of id, null first."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        found, gone = (text or "").encode().split(), set()
        for i in range(len(found) - window + 1):
            phrase = tuple(found[i : i + window])
            if phrase in seen:
                gone |= set(range(i, i + window))
            seen.add(phrase)
        kept = [w for i, w in enumerate(found) if i not in gone]
        out.append((doc, len(found), len(gone), b" ".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


ROWS = [
    *texts(),
    *[(100 + i, prose(1, 40)) for i in range(30)],
    *[(200 + i, prose(500 + i, 25) + "\n" + prose(900, 22) + " " + prose(600 + i, i)) for i in range(25)],
    (300, " ".join(["same"] * 75)),
    (301, prose(7, 19)),
    (302, prose(7, 19)),
    (303, prose(8, 20)),
    (304, prose(8, 20) + " tail"),
    (305, prose(9, 30) + " mid " + prose(9, 30)),
]


@pytest.mark.parametrize("window", [20, 5, 1, 64])
def test_against_brute_force(spark, window):
    rows = ROWS
    got = repeats.repeat_report(documents(spark, rows).repartition(5), window).collect()
    want = [(d, n, gone, hashlib.sha256(kept).hexdigest()) for d, n, gone, kept in slow(rows, window)]
    assert ordered(map(tuple, got)) == ordered(want)


def test_whole_numbers_and_other_ids(spark):
    rows = [(d, t) for d, t in ROWS if d is not None and d != 12]
    docs = documents(spark, rows)
    want = [(n, gone, hashlib.sha256(kept).hexdigest()) for _, n, gone, kept in slow(rows, 20)]
    for ids in (docs, docs.withColumn("doc_id", F.format_string("%05d", "doc_id"))):
        assert ordered((r[1], r[2], r[3]) for r in repeats.repeat_report(ids).collect()) == ordered(want)


def test_texts_lose_the_intervals_and_columns_stay(spark):
    docs = documents(spark, ROWS)
    got = repeats.drop_repeats(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    held = {(r.doc_id, r.text) for r in got.collect()}
    for (doc, _, gone, kept), (_, text) in zip(slow(ROWS, 20), sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))):
        assert (doc, kept.decode() if gone else text) in held
    changed = got.where("doc_id = 101").first()
    assert changed.text == "" and changed.n_chars == 0


def test_intervals_are_maximal(spark):
    docs = spark.createDataFrame([(1, prose(1, 90)), (2, "a b " + prose(1, 90) + " c " + prose(1, 25))], "seq bigint, text string")
    rows = repeats.repeated_passages(docs).collect()
    assert [(r.seq, [tuple(x) for x in r.runs]) for r in rows] == [(2, [(2, 92), (93, 118)])]


def test_empty_table(spark):
    assert repeats.repeat_report(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 7, 20, 33])
def test_rolling_is_the_polynomial(window):
    ids = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x123456789ABCDEF1)
    got = repeats.rolling(ids, window, repeats.BASES[0])
    assert len(got) == 60 - window

    def plain(part):
        total = 0
        for x in part.tolist():
            total = (total * repeats.BASES[0] + x) % (1 << 64)
        total = (total ^ total >> 31) * repeats.MIX % (1 << 64)
        return total ^ total >> 29

    assert got.tolist() == [plain(ids[i : i + window]) for i in range(len(got))]


def test_a_shared_first_hash_is_not_enough():
    """Windows count as equal on both hashes."""
    seqs = np.array([1, 2, 3])
    doc, place, h = np.array([0, 1, 2]), np.array([4, 5, 6]), np.array([9, 9, 9], "<u8")
    row = dict(zip("n_docs n docs docs_size places places_size".split(), repeats._rows(doc, place, (h, np.array([1, 2, 1], "<u2")), seqs)))
    batch = repeats.pa.RecordBatch.from_pylist([{"bucket": 0, "local": False, **row}])
    found = [r for b in repeats._repeats([batch]) for r in b.to_pylist()]
    assert found == [{"seq": 3, "places": [6]}]
