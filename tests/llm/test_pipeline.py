import importlib

import corpus_pipeline
from pairwright.llm import decontamination, linededup, quality, sentencepiece, simhash
from pairwright.llm.common import written
from pairwright.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import assert_same

DATA = "/root/testdata/sf0.001"


def test_stages_feed_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = written(quality.keep_good(docs, labels))
    assert want.columns == docs.columns
    want = written(linededup.drop_lines(want))
    want = written(simhash.drop_near_copies(want))
    groups = simhash.simhash_components(want)
    assert groups.where("doc_id <> component_id").count() == 0
    want = written(decontamination.drop_contaminated(want, bench))
    assert decontamination.contamination(want, bench).where("contaminated").count() == 0
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((r.doc_id, r.text) for r in want.collect())
    codec = sentencepiece.Codec(sentencepiece.read_model())
    assert all(codec.decode(__import__("numpy").array(r.token_ids)) == r.text and r.round_trip for r in got.collect())


def test_registered(spark):
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    for name, sql in ORACLE_SQL.items():
        assert_same(QUERIES[name](spark, DATA), sql, DATA)


def test_stages_against_brute_force_on_planted_rows(spark):
    """Each stage on what the one before kept, held against plain Python over the same rows."""
    from . import test_decontamination, test_linededup, test_simhash
    from .messy import documents, prose, texts

    docs = documents(spark, [*texts(), *[(50 + i, prose(60 + i % 9, 45)) for i in range(18)], (80, prose(1, 40) + " with an end")])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, prose(64, 12)), (2, prose(2, 35))]
    bench = test_decontamination.bench(spark, items)

    kept = written(linededup.drop_lines(docs))
    gone = {}
    for (i, j), _ in test_linededup.brute(rows).items():
        gone.setdefault(i, set()).add(j)
    want = [(d, t if i not in gone else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i])) for i, (d, t) in enumerate(rows)]
    order = lambda r: (r[0] or -1, r[1] or "")
    now = sorted([(r.doc_id, r.text) for r in kept.collect()], key=order)
    assert now == sorted(want, key=order)

    kept = written(simhash.drop_near_copies(kept))
    roots = test_simhash.slow_roots({test_simhash.slow_fingerprint(t) for d, t in now if d is not None})
    least = {}
    for d, t in now:
        if d is not None:
            root = roots[test_simhash.slow_fingerprint(t)]
            least[root] = min(least.get(root, d), d)
    now = sorted([(r.doc_id, r.text) for r in kept.collect()], key=order)
    assert sorted(d for d, _ in now if d is not None) == sorted(least.values())

    clean = written(decontamination.drop_contaminated(kept, bench))
    want = [(d, t) for d, t in now if not test_decontamination.slow(t, items)[4]]
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=order) == sorted(want, key=order)
    assert clean.columns == docs.columns


def test_tokenize_with_clashing_names(spark):
    from .messy import documents

    docs = documents(spark).selectExpr("*", "doc_id AS token_ids", "lang AS Decoded", "1 AS new_round_trip")
    got = corpus_pipeline.tokenize(spark, docs, DATA)
    assert got.columns == [*docs.columns, "new_new_token_ids", "new_new_round_trip"]
    rows = got.select("doc_id", "token_ids", "Decoded", "new_round_trip").collect()
    assert all(r.doc_id == r.token_ids and r.Decoded == "en" and r.new_round_trip == 1 for r in rows)
