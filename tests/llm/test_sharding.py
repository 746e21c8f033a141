import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import sharding

from .messy import documents, empty_documents, texts


def place(df, **options):
    return sharding.hypergeometric_shuffle(df, **options).collect()


def slow(rows, shards):
    """What any shuffle into these shards must give, whatever its order: sizes, checksums, full shards and slots."""
    sums = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = sorted(len(rows) // shards + (k < len(rows) % shards) for k in range(shards))
    return sums, [sorted(range(n)) for n in sizes]


@pytest.mark.parametrize("shards", [1, 4, 16, 40])
def test_contract(spark, shards):
    got = place(documents(spark), shards=shards)
    slots = {k: [] for k in range(shards)}
    for r in got:
        slots[r.shard].append(r.slot)
    rows = sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got)
    assert (rows, sorted(map(sorted, slots.values()), key=len)) == slow(texts(), shards)


def test_exact_sizes_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 50)
    rows = spark.range(5003).selectExpr("id as doc_id", "concat('text ', id % 7) as text")
    got = place(rows)
    counts = np.bincount([r.shard for r in got], minlength=16)
    assert counts.sum() == 5003 and counts.max() - counts.min() == 1
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    again = place(rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    ids = np.array([r.doc_id for r in got])
    shard = np.array([r.shard for r in got])
    assert abs(np.corrcoef(ids, shard)[0, 1]) < 0.06


def test_one_row_repeated_many_times_is_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 50)
    got = place(spark.range(2000).selectExpr("7L as doc_id", "'same' as text"))
    counts = np.bincount([r.shard for r in got], minlength=16)
    assert (counts == 125).all() and len({(r.shard, r.slot) for r in got}) == 2000


def test_matrix_margins_and_law():
    columns = sharding.shard_sizes(103, 5)
    total = np.zeros((3, 5))
    for seed in range(400):
        m = sharding.communication_matrix([50, 3, 50], columns, seed)
        assert (m.sum(axis=0) == columns).all() and m.sum(axis=1).tolist() == [50, 3, 50] and (m >= 0).all()
        total += m
    assert np.allclose(total / 400, np.outer([50, 3, 50], columns) / 103, atol=0.5)
    huge = sharding.communication_matrix([3 * 10**9, 10**9], sharding.shard_sizes(4 * 10**9, 4), 1)
    assert huge.sum() == 4 * 10**9 and (huge.sum(axis=0) == 10**9).all()


@pytest.mark.parametrize("urn", [(6, 5, 4), (40, 2, 30), (3, 90, 60), (1000, 3000, 700), (5, 0, 3), (0, 5, 3), (7, 7, 14)])
def test_draws_by_inversion_follow_the_law(urn):
    import math

    good, bad, drawn = urn
    n, generator = 20_000, np.random.default_rng(2)
    got = np.bincount([sharding._by_inversion(generator, good, bad, drawn) for _ in range(n)], minlength=good + 1)
    want = np.array([math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) if 0 <= drawn - k <= bad else 0.0 for k in range(good + 1)])
    assert got[want == 0].sum() == 0
    assert (np.abs(got / n - want) < 5 * np.sqrt(want * (1 - want) / n) + 1e-4).all()


def test_draws_from_a_huge_urn():
    generator = np.random.default_rng(3)
    good, bad, drawn = 10**11, 15 * 10**11, 10**6
    got = np.array([sharding.draw(generator, good, bad, drawn) for _ in range(400)])
    assert abs(got.mean() - 62_500) < 60 and 200 < got.std() < 290


def test_write(spark, tmp_path):
    docs = documents(spark).withColumn("shard", F.lit("theirs")).withColumn("copy", F.lit(1)).withColumn("row", F.lit(2)).withColumn("id", F.lit(3))
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    order = lambda r: (r[0] or -1, r[1] or "", r[1] is None)
    assert sorted([(r.doc_id, r.text) for r in back], key=order) == sorted(texts(), key=order)
    assert sorted({r.shard for r in back}) == [0, 1, 2] and {(r.shard_in, r.copy, r.row, r.id) for r in back} == {("theirs", 1, 2, 3)}


def test_empty(spark):
    assert place(empty_documents(spark)) == []


@pytest.mark.parametrize("n", [1, 2, 17])
def test_fewer_rows_than_shards(spark, n):
    got = place(spark.range(n).selectExpr("id as doc_id", "'x' as text"))
    assert len(got) == n
