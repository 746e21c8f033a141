import math
import re

import pytest
from pyspark.sql import functions as F

from pairwright.llm import linededup

from .messy import documents, empty_documents, prose, texts


def brute(rows):
    """(doc place, line) -> 'exact' or 'near', by comparing every line with all earlier ones."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    gone, first, sets = {}, set(), []
    for i in order:
        for j, line in enumerate((rows[i][1] or "").split("\n")):
            words = frozenset(w for w in re.split("[\t-\r ]+", line) if w)
            if not words:
                continue
            if words in first:
                gone[i, j] = "exact"
                continue
            if any(len(words & s) * 9 >= 4 * (len(words) + len(s)) for s in sets):
                gone[i, j] = "near"
            first.add(words)
            sets.append(words)
    return gone


def lines_by_id(rows, gone):
    out = {}
    for (i, j), kind in gone.items():
        out.setdefault(rows[i][0], []).append((j, kind == "exact"))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("hot", [1, 16])
def test_against_brute_force(spark, hot):
    rows = texts()
    for v in range(30):  # near copies that share rare words
        words = prose(50, 24).split()
        words[v % 24] = f"variant{v}"
        rows.append((100 + v, prose(v + 300, 10) + "\n" + " ".join(words) + "\nshared line of words"))
    got = {}
    for r in linededup.removed_lines(documents(spark, rows), hot=hot).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.exact))
    assert {k: sorted(v) for k, v in got.items()} == lines_by_id(rows, brute(rows))


def test_report_counts_add_up(spark):
    for r in linededup.line_report(documents(spark)).collect():
        assert r.n_lines == r.n_exact + r.n_near + r.n_kept


def test_dropping_keeps_documents_and_columns(spark):
    docs = documents(spark)
    out = linededup.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[2].text == "" and by_id[1].text == texts()[0][1] and by_id[4].text is None
    assert by_id[11].text.count("\n") == 1 and by_id[11].n_chars == len(by_id[11].text)


def test_empty(spark):
    assert linededup.line_report(empty_documents(spark)).count() == 0
    assert linededup.drop_lines(empty_documents(spark)).count() == 0


def test_ids_too_large_for_one_number(spark):
    rows = [(2**61, "a b c d e f g"), (2**61 + 1, "x\na b c d e f g"), (-(2**61), "q r s t u")]
    got = {(r.doc_id, r.line_no, r.exact) for r in linededup.removed_lines(documents(spark, rows)).collect()}
    assert got == {(2**61 + 1, 1, True)}


def test_shared_ids_lose_no_line(spark):
    rows = [(1, "a b c d e"), (2, "x1 x2 x3 x4 x5"), (2, "a b c d e"), (None, "k1 k2 k3 k4 k5"), (None, "a b c d e")]
    got = sorted(((r.doc_id or 0), r.text) for r in linededup.drop_lines(documents(spark, rows)).collect())
    # a null id comes first, so its copy of the shared line is the one that stays
    assert got == [(0, "a b c d e"), (0, "k1 k2 k3 k4 k5"), (1, ""), (2, ""), (2, "x1 x2 x3 x4 x5")]


def test_ids_as_text_and_clashing_columns(spark):
    docs = documents(spark).select(
        F.col("doc_id").cast("string").alias("doc_id"), "text",
        *[F.lit(k).alias(c) for k, c in enumerate("_gone _gone_id _row row doc in numbers gone id word a b".split())],
    )
    out = linededup.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == len(texts())
    rows = [(None if i is None else str(i), t) for i, t in texts()]
    by_text = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or ""))
    want = {}
    for (k, j), kind in brute([(n, rows[k][1]) for n, k in enumerate(by_text)]).items():
        want.setdefault(rows[by_text[k]][0], []).append((j, kind == "exact"))
    got = {}
    for r in linededup.removed_lines(docs).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.exact))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_no_python_in_the_plan(spark):
    plan = linededup.line_report(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_bitmap_holds_the_first_and_last_bit(spark):
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << linededup.BITMAP_BITS))
    for value in (0, 1, (1 << linededup.BITMAP_BITS) - 1):
        ids = spark.createDataFrame(spark.range(1 << 27).where(bit == value).limit(1).collect())
        bitmap = linededup._bitmap(ids)
        assert len(bitmap) == (1 << linededup.BITMAP_BITS) // 8 and sum(b.bit_count() for b in bitmap) == 1
        assert ids.where(linededup._may_hold(linededup._constant(ids, bitmap, "binary"), "id")).count() == 1


def test_rows_of_the_same_id_are_told_apart(spark):
    null = [(None, "x1 x2 x3\ny1 y2 y3"), (None, "y1 y2 y3\nz1 z2 z3")]
    rows = [*texts(), *null, (2**61, "far a b c"), (2**61, "far a b c\nfar d e")]
    docs = documents(spark, rows)
    got = {}
    for r in linededup.removed_lines(docs).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.exact))
    # rows stay in the order of the list here
    assert {k: sorted(v) for k, v in got.items()} == lines_by_id(rows, brute(rows))
    kept = [(r.doc_id, line) for r in linededup.drop_lines(docs).collect() for line in (r.text or "").split("\n")]
    for line in ((12, rows[12][1]), (None, "x1 x2 x3"), (None, "y1 y2 y3"), (None, "z1 z2 z3"), (2**61, "far a b c"), (2**61, "far d e")):
        assert kept.count(line) == 1
    report = [r for r in linededup.line_report(docs).collect() if r.doc_id == 12]
    assert sorted((r.n_exact, r.n_kept) for r in report) == [(0, 1), (1, 0)]


def test_the_report_reads_texts_no_more_and_keeps_no_hashes(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    report = linededup.line_report(spark.read.parquet(f"{tmp_path}/documents"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and not re.search(r"ReadSchema: .*\btext:", plan)
    got = sorted((str(r.doc_id), r.n_lines) for r in report.collect())
    assert got == sorted((str(i), (t or "").count("\n") + 1) for i, t in texts())
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_rarity_counts_every_word(spark):
    shift = 64 - linededup.BUCKET_BITS
    # word of bucket b, in as many lines as named
    many = {0: 1, 1: 5, 2: 64, 3: 2, 4: 9, (1 << linededup.BUCKET_BITS) - 1: 16, (1 << linededup.BUCKET_BITS) - 2: 3}
    words = {b: (b << shift) - (1 << 64 if b >= 1 << (linededup.BUCKET_BITS - 1) else 0) for b in many}
    rows = [([words[b] for b in many if many[b] > k],) for k in range(max(many.values()))]
    hashed = spark.createDataFrame(rows, "hashes array<bigint>")
    codes = spark.createDataFrame([(list(words.values()),)], "hashes array<bigint>").select(
        "hashes", linededup._rarity_table(hashed).alias("ranks")
    )
    got = codes.select(linededup._codes(F.col("hashes"), F.col("ranks")).alias("codes")).first().codes
    assert [c >> 56 for c in got] == sorted(int(4 * math.log2(n)) for n in many.values())


def test_sets_are_grouped_before_they_are_written(spark, monkeypatch):
    made, write = [], linededup.written
    monkeypatch.setattr(linededup, "written", lambda df: made.append(df.columns) or write(df))
    rows = texts()
    got = {}
    for r in linededup.removed_lines(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.exact))
    assert {k: sorted(v) for k, v in got.items()} == lines_by_id(rows, brute(rows))
    assert [c for c in made if "line_no" in c] == [["doc", "row", "line_no", "n"]]


def test_words_of_low_classes_are_not_hot(spark):
    low, high = int(4 * math.log2(256)) - 1 << 56, int(4 * math.log2(256)) << 56
    nodes = spark.range(2000).select("id", F.array(F.lit(low).cast("long"), F.lit(high).cast("long")).alias("prefix"))
    want = spark.range(1).select(F.hash(F.lit(high).cast("long")).alias("word")).collect()
    assert linededup._hot_words(nodes, 256).collect() == want
