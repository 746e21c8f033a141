"""Toxicity and quality: held-out accuracy, no use of forbidden columns, defined results for odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import quality, toxicity

from .messy import documents, empty_documents

DATA = "/root/testdata/sf0.1"


def auc(score, y):
    good, bad = score[y == 1], np.sort(score[y == 0])
    return (np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")).sum() / 2 / len(good) / len(bad)


def held_out(spark, classify, label):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    return auc(rows["score"].to_numpy(), rows[label].to_numpy()), rows


def test_quality_held_out(spark):
    value, rows = held_out(spark, quality.classify_quality, "quality")
    assert value > 0.99
    assert rows.loc[rows["quality"] == 1, "predicted"].mean() > 0.98
    assert rows.loc[rows["quality"] == 0, "predicted"].mean() < 0.1


def test_toxicity_held_out(spark):
    value, rows = held_out(spark, toxicity.classify_toxicity, "toxic")
    assert value > 0.9
    assert rows.loc[rows["toxic"] == 0, "predicted"].mean() < 0.03


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("classify", [quality.classify_quality, toxicity.classify_toxicity])
def test_odd_rows_and_labels(spark, classify):
    docs = documents(spark)
    given = [(1, 1, 0), (2, 1, 1), (3, 0, None), (5, 0, 1), (8, 0, 0), (9, 1, 0), (11, 1, 1), (99, 1, 1), (None, 1, 1), (1, 1, 0)]
    for rows in (given, [(1, 1, 1), (3, 1, 1)], []):
        out = classify(docs, labels(spark, rows)).collect()
        assert len(out) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
        assert len({r.score for r in out if r.doc_id in (4, 5)}) == 1  # null scores as empty
    assert classify(empty_documents(spark), labels(spark, given)).count() == 0


@pytest.mark.parametrize("classify", [quality.classify_quality, toxicity.classify_toxicity])
def test_only_the_text_counts(spark, classify):
    given = labels(spark, [(i, i % 2, (i + 1) % 2) for i in range(1, 13)])
    docs = documents(spark)
    moved = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("other")).withColumn("n_chars", F.lit(0))
    a, b = (sorted((r.doc_id or -1, r.score) for r in classify(x, given).collect()) for x in (docs, moved))
    assert a == b


def test_discriminant_is_the_gaussian_rule():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], 300)
    model = quality.Discriminant.fit(x, y, shrinkage=0.0)
    z = (x - model.centre) / model.scale
    want = []
    for k in (0, 1):
        own = z[y == k]
        cov = np.cov(own.T, bias=True)
        gap = z - own.mean(axis=0)
        want.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.log(np.linalg.det(cov)))
    assert np.allclose(np.sinh(model.difference(x)), want[1] - want[0])


def test_keep_good_keeps_columns(spark):
    docs = documents(spark)
    out = quality.keep_good(docs, labels(spark, [(i, 1, 0) for i in range(1, 10)]))
    assert out.columns == docs.columns and out.count() == docs.count()


@pytest.mark.parametrize("classify", [quality.classify_quality, toxicity.classify_toxicity])
def test_string_ids(spark, classify):
    """An id of another type changes neither the sample's kind of rows nor the result's columns."""
    docs = documents(spark).where("doc_id IS NOT NULL").withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    marks = spark.createDataFrame([(f"d{i:03d}", i % 2, i % 2) for i in range(1, 13)], "doc_id string, quality int, toxic int")
    got = classify(docs, marks)
    assert got.dtypes[0] == ("doc_id", "string") and got.count() == docs.count()
    assert quality.keep_good(docs, marks, 0.0).count() == docs.count()
