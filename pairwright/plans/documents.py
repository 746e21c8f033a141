"""Queries over documents, conversations, pages and benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions import text as tx
from pairwright.operators import aggregates, folds, integrity, joins, segments, selection, timeseries
from pairwright.session import table


def hash_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of src0 against those of other sources, by text digest and then by name (language and length)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.concat_ws("-", "lang", "n_chars").alias("name")
    )
    out = joins.hash_match(docs.where("source = 'src0'").drop("source"), docs.where("source <> 'src0'"), "digest", "name")
    return out.select("doc_id", "status", "n_hits")


HASH_MATCH = """
WITH d AS (SELECT doc_id, source, sha256(text) AS digest, concat(lang, '-', n_chars) AS name FROM documents),
g AS (SELECT digest, count(*) AS same FROM d WHERE source <> 'src0' GROUP BY digest),
n AS (SELECT name, count(*) AS named FROM d WHERE source <> 'src0' GROUP BY name)
SELECT doc_id, CASE WHEN same > 0 THEN 'MATCH' WHEN named > 0 THEN 'MISMATCH' ELSE 'NOT_ON_HUB' END AS status,
       coalesce(same, named, 0) AS n_hits
FROM d LEFT JOIN g USING (digest) LEFT JOIN n USING (name) WHERE source = 'src0'
"""


def set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sources = docs.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"))
    digests = folds.set_digests(docs, ["lang"], "doc_id").select("lang", F.col("sha256").alias("ids_sha256"))
    return sources.join(digests, "lang")


FINGERPRINT = """
SELECT lang, count(DISTINCT source) AS n_sources,
       sha256(string_agg(DISTINCT CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS ids_sha256
FROM documents GROUP BY lang
"""


def _leak(spark: SparkSession, sf_dir: str) -> tuple:
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item_text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bench, docs, "item_id", "doc_id", "item_text", "text"


def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, and short strings (beginnings of nation names) beside them, in whole documents."""
    bench, docs, *names = _leak(spark, sf_dir)
    short = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("item_id"), F.lower(F.substring("n_name", 1, 3)).alias("item_text"))
    return joins.contains_join(bench.unionByName(short), docs, *names)


CONTAINS = """
SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''
UNION ALL SELECT n_nationkey AS item_id, doc_id FROM nation JOIN documents ON contains(text, lower(left(n_name, 3)))
"""


def ngram_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.ngram_leak(*_leak(spark, sf_dir))


#: Every run of 48 characters of every item against every document, without the engine's filter.
NGRAM = """
WITH g AS (SELECT DISTINCT item_id, substring(text, i, 48) AS gram
           FROM (SELECT item_id, text, unnest(range(1, length(text) - 46)) AS i FROM benchmark WHERE length(text) >= 48))
SELECT item_id, doc_id, count(*) AS n_grams FROM g JOIN documents ON contains(documents.text, g.gram) GROUP BY item_id, doc_id
"""


def stopword_rung(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word filter, kept characters and clamped compression rate of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tx.stopword_filter("text").alias("kept"))
    chars = F.char_length("text")
    return docs.select(
        "doc_id",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
        F.char_length("kept").cast("long").alias("kept_chars"),
        F.round(tx.compression_rate(F.char_length("kept"), chars), 9).alias("rate"),
    )


_STOP = ", ".join(f"'{w}'" for w in tx.ADVANCED_STOPWORDS)
STOPWORD = f"""
WITH k AS (
  SELECT doc_id, text, coalesce(array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]+'),
         lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w)), ' '), '') AS kept FROM documents)
SELECT doc_id, sha256(kept) AS kept_sha256, length(kept) AS kept_chars,
       round(greatest(0.15::DOUBLE, least(0.9::DOUBLE, length(kept)::DOUBLE / length(text))), 9) AS rate FROM k
"""


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("kept", tx.stopword_filter("text"))
    return docs.groupBy("lang").agg(
        F.round(aggregates.ratio_of_sums(F.char_length("kept"), F.char_length("text")), 9).alias("char_retention")
    )


RETENTION = f"""
SELECT lang, round(sum(length(coalesce(array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]+'),
       lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w)), ' '), '')))::DOUBLE / sum(length(text)), 9) AS char_retention
FROM documents GROUP BY lang
"""


def code_strip_rung(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error spans removed, then the word filter (spans depend on earlier ones: no SQL form)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tx.remove_code("text").alias("bare"))
    kept = tx.stopword_filter("bare")
    return docs.select(
        "doc_id",
        (F.char_length("text") - F.char_length("bare")).cast("long").alias("code_chars"),
        F.char_length(kept).cast("long").alias("kept_chars"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


def segment_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.segment_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", {"S": 600, "L": 1500})
    return out.select(
        "conv_id", "stratum", "segment_start", "segment_end", "n_msgs", F.char_length("text_o").cast("long").alias("chars_o")
    )


SEGMENTS = """
WITH RECURSIVE t AS (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) - 1 AS BIGINT) AS i,
         coalesce(text, '') AS x FROM conversations),
b AS (SELECT 'S' AS stratum, 600 AS budget UNION ALL SELECT 'L', 1500),
f AS (
  SELECT conv_id, stratum, budget, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS start, CAST(length(x) AS BIGINT) AS chars FROM t, b WHERE i = 0
  UNION ALL
  SELECT f.conv_id, stratum, budget, t.i, CASE WHEN chars >= budget THEN t.i ELSE start END,
         CASE WHEN chars >= budget THEN 0 ELSE chars END + length(t.x)
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1),
s AS (SELECT conv_id, stratum, budget, start, max(i) + 1 AS stop, max(chars) AS chars FROM f GROUP BY ALL)
SELECT s.conv_id, stratum, start AS segment_start, stop AS segment_end, stop - start AS n_msgs,
       CAST(length(trim((SELECT string_agg(x, chr(10) || chr(10) ORDER BY i) FROM t WHERE t.conv_id = s.conv_id AND i >= start AND i < stop))) AS BIGINT) AS chars_o
FROM s WHERE stop - start >= 3 AND chars >= budget * 0.6
"""


def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of thought, corrections and estimated thinking tokens (here over synthetic wrappings of the texts)."""
    rows = table(spark, sf_dir, "conversations").withColumn(
        "trace", F.concat(F.lit("<think>Wait, "), "text", F.lit(" Hmm. let me recompute</think> Answer: **4,200**."))
    )
    return rows.select(
        "conv_id",
        "turn",
        tx.marker_count("trace").cast("long").alias("markers"),
        tx.correction_count("trace").cast("long").alias("corrections"),
        tx.final_answer("trace").alias("answer"),
        F.char_length(tx.visible("trace")).cast("long").alias("visible_chars"),
    )


MARKERS = r"""
WITH t AS (SELECT conv_id, turn, concat('<think>Wait, ', text, ' Hmm. let me recompute</think> Answer: **4,200**.') AS x FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn,
       len(regexp_extract_all(x, '(\bWait\b|\bHmm+\b|\bAlternatively\b|\bHold on\b|[Ll]et me (?:double[- ]check|verify|re-?check|reconsider)|\bActually,)')) AS markers,
       len(regexp_extract_all(x, '(?i)(I made (?:a|an) (?:mistake|error)|that''s (?:wrong|incorrect)|let me redo|let me recompute|I mis(?:read|calculated|counted))')) AS corrections,
       '4200' AS answer, length(trim(regexp_replace(x, '(?s)^.*?</think>', ''))) AS visible_chars
FROM t
"""


def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric answers scored against the order they were written from."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    shown = F.format_string("Some steps: 3 + 4.\nAnswer: $%,.2f dollars", "o_totalprice")
    plain = F.concat(F.lit("no marker\nthe total is "), F.format_string("%.2f", "o_totalprice"), F.lit(" for 0"))
    text = F.when(F.col("o_orderkey") % 2 == 0, shown).otherwise(plain)
    rows = orders.withColumn("reply", text)
    return rows.select(
        "o_orderkey",
        F.round(tx.gsm8k_answer("reply"), 2).alias("answer"),
        tx.score("gsm8k", "reply", "o_totalprice").alias("correct"),
    )


ANSWERS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) ELSE 0.0 END AS answer,
       (o_orderkey % 2 = 0 OR abs(o_totalprice) <= 1e-4) AS correct FROM orders
"""


def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation compared word by word."""
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("w", tx.words("text")).withColumn("before", F.lag("w").over(order))
    rows = rows.where("before IS NOT NULL AND w IS NOT NULL")
    return rows.select(
        "conv_id",
        "turn",
        F.size("w").cast("long").alias("n_words"),
        tx.first_divergence("before", "w").cast("long").alias("first_div"),
        tx.common_prefix("before", "w").cast("long").alias("prefix"),
    )


DIVERGENCE = r"""
WITH t AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM t),
d AS (SELECT *, list_filter(range(1, greatest(len(w), len(b)) + 1), lambda i: w[i] IS DISTINCT FROM b[i]) AS diff FROM p WHERE b IS NOT NULL AND w IS NOT NULL)
SELECT conv_id, turn, len(w) AS n_words, CAST(diff[1] - 1 AS BIGINT) AS first_div, CAST(coalesce(diff[1] - 1, len(w)) AS BIGINT) AS prefix FROM d
"""

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "hex secret": r"[0-9a-f]{40}",
    "home path": r"/home/[a-z]+",
    "dotted quad": r"[0-9]{1,3}(\.[0-9]{1,3}){3}",
}
#: What every match of a pattern holds.
NEEDLES = {"email": "@", "home path": "/home/", "dotted quad": "."}


def privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    pages = table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    out = None
    for name, rows in (("documents", docs), ("pages", pages)):
        one = integrity.pattern_counts(rows, "text", PATTERNS, NEEDLES).select(F.lit(name).alias("origin"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rows_hit", F.col("rows_hit").cast("long")).withColumn("matches", F.col("matches").cast("long"))


PRIVACY = " UNION ALL ".join(
    f"SELECT '{t}' AS origin, '{n}' AS pattern, count(*) FILTER (regexp_matches({c}, '{p}')) AS rows_hit,"
    f" CAST(coalesce(sum(len(regexp_extract_all({c}, '{p}'))), 0) AS BIGINT) AS matches FROM {t}"
    for t, c in (("documents", "text"), ("pages", "html"))
    for n, p in PATTERNS.items()
)


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.first_per_cell(table(spark, sf_dir, "documents"), ["lang"], "seed-1", ["doc_id"], 12)
    return out.select("lang", "doc_id", F.col("place").cast("long").alias("place"))


SAMPLE = """
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('seed-1|', doc_id)), doc_id) AS place
FROM documents QUALIFY place <= 12
"""


def stratified_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return selection.stratified_fill(docs, ["source"], "seed-2", ["doc_id"], 3, 100)


FILL = """
WITH s AS (SELECT doc_id, source FROM documents
           QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(concat('seed-2|', doc_id)), doc_id) <= 3),
f AS (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)
      ORDER BY sha256(concat('seed-2-fill|', doc_id)), doc_id LIMIT (SELECT greatest(0, 100 - count(*)) FROM s))
SELECT doc_id, source, 'stratum' AS part FROM s UNION ALL SELECT doc_id, source, 'fill' FROM f
"""


def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.interleave(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"])
    return rows.withColumn("turn", F.col("turn").cast("long"))


INTERLEAVE = "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents"


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.dense_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "c", 5)


DENSE = """
SELECT doc_id, source, concat('c', lpad(CAST(dense_rank() OVER (ORDER BY source) - 1 AS VARCHAR), 5, '0')) AS dense_id FROM documents
"""


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    out = selection.spread_over_clusters(docs, ["lang"], "source", "seed-3", ["doc_id"], 25)
    return out.withColumn("place", F.col("place").cast("long"))


QUOTA = """
WITH r AS (SELECT doc_id, lang, source, sha256(concat('seed-3|', doc_id)) AS h,
                  row_number() OVER (PARTITION BY lang, source ORDER BY sha256(concat('seed-3|', doc_id)), doc_id) AS k FROM documents)
SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY k, h, doc_id) AS place FROM r QUALIFY place <= 25
"""


def chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chained log of each conversation with every fifth row's link broken; the breaks are found."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    rows = rows.withColumn("checksum", F.sha2(F.concat_ws("|", "conv_id", "turn", "text").cast("binary"), 256))
    w = Window.partitionBy("conv_id").orderBy("turn")
    link = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "broken").otherwise(F.coalesce(F.lag("checksum").over(w), F.lit("")))
    broken = timeseries.chain_breaks(rows.withColumn("previous", link), ["conv_id"], "turn", "previous", "checksum")
    return broken.select("conv_id", "turn", "previous", "expected")


CHAIN = """
WITH r AS (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY ALL),
c AS (SELECT conv_id, turn, sha256(concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), text)) AS checksum FROM r)
SELECT conv_id, turn, 'broken' AS previous, coalesce(lag(checksum) OVER (PARTITION BY conv_id ORDER BY turn), '') AS expected
FROM c QUALIFY (conv_id + turn) % 5 = 0
"""


def token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", tx.words("text").alias("w"))
    packed = segments.pack(rows, "item_id", "w", 64)
    return packed.select("row_no", F.array_join("tokens", " ").alias("line"))


PACKING = r"""
WITH t AS (SELECT item_id, unnest(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '')) AS w,
                  generate_subscripts(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> ''), 1) AS i FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT w, row_number() OVER (ORDER BY item_id, i) - 1 AS k FROM t)
SELECT k // 64 AS row_no, string_agg(w, ' ' ORDER BY k) AS line FROM p GROUP BY k // 64 HAVING count(*) = 64
"""

QUERIES = {
    "hash_match": hash_match,
    "set_fingerprint": set_fingerprint,
    "contains_join": contains_join,
    "ngram_leak": ngram_leak,
    "stopword_rung": stopword_rung,
    "retention": retention,
    "code_strip_rung": code_strip_rung,
    "segment_turns": segment_turns,
    "marker_counts": marker_counts,
    "answer_extract": answer_extract,
    "first_divergence": first_divergence,
    "privacy_scan": privacy_scan,
    "hash_sample": hash_sample,
    "stratified_fill": stratified_fill,
    "interleave": interleave,
    "dense_ids": dense_ids,
    "quota_sample": quota_sample,
    "chain_check": chain_check,
    "token_packing": token_packing,
}
ORACLE_SQL = {
    "hash_match": HASH_MATCH,
    "set_fingerprint": FINGERPRINT,
    "contains_join": CONTAINS,
    "ngram_leak": NGRAM,
    "stopword_rung": STOPWORD,
    "retention": RETENTION,
    "segment_turns": SEGMENTS,
    "marker_counts": MARKERS,
    "answer_extract": ANSWERS,
    "first_divergence": DIVERGENCE,
    "privacy_scan": PRIVACY,
    "hash_sample": SAMPLE,
    "stratified_fill": FILL,
    "interleave": INTERLEAVE,
    "dense_ids": DENSE,
    "quota_sample": QUOTA,
    "chain_check": CHAIN,
    "token_packing": PACKING,
}
