import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pairwright.llm import ranked
from pairwright.llm.common import ordered, rows_a_batch

from .messy import documents, empty_documents, prose, texts

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def slow(docs, items, k=10):
    found = [(d, cut(t)) for d, t in docs]
    held = [x for x in found if x[1]]
    n, total = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        scores = []
        for doc, own in held:
            m, score = 10 + (90 * len(own) * n) // total, 0
            for t in set(cut(text)):
                df, tf = sum(t in w for _, w in held), own.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, r + 1, d if held else None, -s) for r, (s, held, d) in enumerate(sorted(scores)[:k])]
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("x"))


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


DOCS = [*texts(), *[(100 + i, prose(1, 40)) for i in range(40)], *[(300 + i, prose(700 + i, 5 + i * i % 90)) for i in range(60)]]
ITEMS = [(1, prose(1, 12)), (2, prose(2, 35)), (3, None), (4, ""), (5, "nowhere"), (6, "Two WORDS, one: ünï"), (7, prose(1, 12)), (7, prose(9, 5)), (None, prose(3, 4))]


@pytest.mark.parametrize("limit", [512, 2])
def test_against_brute_force(spark, limit):
    got = ranked.rank_documents(documents(spark, DOCS).repartition(4), bench(spark, ITEMS), max_items=limit)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    same(got.collect(), slow(DOCS, ITEMS))


def test_other_ids_and_numbers_of_results(spark):
    rows = [(d, t) for d, t in DOCS if d is not None and d != 12]
    for k in (1, 25):
        same(ranked.rank_documents(documents(spark, rows), bench(spark, ITEMS), k=k).collect(), slow(rows, ITEMS, k))
    named = documents(spark, rows).withColumn("doc_id", F.format_string("%05d", "doc_id"))
    same(ranked.rank_documents(named, bench(spark, ITEMS)).collect(), [(i, r, f"{d:05d}", s) for i, r, d, s in slow(rows, ITEMS)])


def test_bounds_hold_and_cut(spark):
    """Upper and lower bounds enclose every score, and few documents are rescored."""
    docs = documents(spark, [(i, prose(i, 30 + i % 50)) for i in range(400)])
    index = ranked.build_index(ordered(docs.select("doc_id", "text")))
    items = [list({int(x) for x in ranked.Hashes().of(list(set(cut(prose(3000 + i, 8))))).view(np.int64)}) for i in range(5)]
    blocks = index.blocks.toArrow().combine_chunks().to_batches()
    held = {}
    for batch in blocks:
        for k in range(batch.num_rows):
            for t, n in zip(ranked._list(batch, "terms", k).tolist(), ranked._list(batch, "counts", k).tolist()):
                held[t] = held.get(t, 0) + n
    own = ranked.Queries(items, {t: held[t] for x in items for t in x if t in held}, index.n_docs)
    rescored, seen = 0, 0
    for batch in blocks:
        for k in range(batch.num_rows):
            high, low, cuts, places = own.bounds(batch, k, True)
            m = ranked.dampings(ranked._list(batch, "lengths", k), index.n_docs, index.n_terms)
            for item in range(len(items)):
                score = own.exact(item, np.arange(len(m)), m, ranked._list(batch, "docs", k), ranked._list(batch, "tfs", k), cuts, places)
                assert (score <= high[item] * ranked.STEP).all() and (score >= low[item] * ranked.STEP).all()
                seen += len(m)
                rescored += int((high[item] >= np.sort(low[item])[-10]).sum()) if len(m) >= 10 else len(m)
    assert seen == 2000 and rescored < seen / 5


def test_no_documents_and_no_items(spark):
    assert ranked.rank_documents(empty_documents(spark), bench(spark, ITEMS)).count() == 0
    assert ranked.rank_documents(documents(spark), bench(spark, [])).count() == 0


def test_blocks_are_held_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ranked, "CHUNK", 1)  # a block a document
    index = ranked.build_index(ordered(documents(spark, DOCS)).coalesce(1))
    files = list(Path(index.blocks.written_path.removeprefix("file:")).glob("*.parquet"))
    held = [m.row_group(g).num_rows for m in map(pq.read_metadata, files) for g in range(m.num_row_groups)]
    assert sum(held) > 50 and max(held) <= ranked.GROUP_ROWS

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    with rows_a_batch(spark, ranked.GROUP_ROWS):
        assert max(r.n for r in index.blocks.mapInArrow(sizes, "n bigint").collect()) <= ranked.GROUP_ROWS
