"""Queries of ordered and greedy mechanisms: nearest events, early exits, quotas, containment after normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.folding import survival_form
from pairwright.operators import folds, joins, selection
from pairwright.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


@_query("""
WITH m AS (SELECT DISTINCT user_id, epoch_us(ts) AS bought FROM events WHERE event_type = 'purchase'),
t AS (SELECT user_id, epoch_us(ts) AS clicked, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT user_id, bought, clicked, event_id FROM m JOIN t USING (user_id)
QUALIFY row_number() OVER (PARTITION BY user_id, bought ORDER BY abs(bought - clicked), clicked) = 1
""")
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the click of the same user nearest in time."""
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    marks = events.where("event_type = 'purchase'").select("user_id", F.col("us").alias("bought"))
    clicks = events.where("event_type = 'click'").select("user_id", F.col("us").alias("clicked"), "event_id")
    return joins.nearest_position(marks, clicks, "user_id", "bought", "clicked", "event_id")


RULE = folds.ExitRule(budget=220, threshold=0.45, least=20, gap=30, probe_tokens=7, force_share=0.8, rule="consistent", high=0.85)


@_query("""
WITH RECURSIVE seg AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, len(regexp_extract_all(x, '[^ \\n]+')) AS tokens,
         contains(x, ',') AS marker, length(x) % 11 = 0 AS closes, (length(x) % 100) / 100.0 AS p, left(x, 1) AS trial
  FROM (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS probes, CAST(0 AS BIGINT) AS segments,
         CAST(-1000000 AS BIGINT) AS probed, CAST(NULL AS VARCHAR) AS last, true AS thinking, CAST(NULL AS VARCHAR) AS fate
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, n.used + CASE WHEN what IN ('force', 'probe') THEN 7 ELSE 0 END, probes + CASE WHEN what IN ('force', 'probe') THEN 1 ELSE 0 END,
         segments + 1, CASE WHEN what = 'probe' THEN n.used ELSE probed END, CASE WHEN what = 'probe' THEN trial ELSE last END, n.thinking,
         CASE WHEN what = 'force' THEN 'forced_exit' WHEN what = 'cut' THEN 'budget'
              WHEN what = 'probe' AND (p >= 0.85 OR (p >= 0.45 AND trial = coalesce(last, ''))) THEN 'early_exit' END
  FROM (
    SELECT b.*, CASE WHEN b.thinking AND b.used >= 176 THEN 'force'
                     WHEN fits AND marker AND b.thinking AND b.used >= 20 AND b.used >= probed + 30 THEN 'probe'
                     WHEN NOT fits THEN 'cut' ELSE 'go' END AS what
    FROM (
      SELECT w.conv_id, s.i, w.used + least(s.tokens, room) AS used, w.probes, w.segments, w.probed, w.last, s.p, s.trial, s.marker,
             s.tokens <= room AS fits, w.thinking AND NOT (s.tokens <= room AND s.closes) AS thinking
      FROM (SELECT *, CASE WHEN thinking AND used < 176 THEN least(220 - used, 176 - used) ELSE 220 - used END AS room FROM walk) w
      JOIN seg s ON s.conv_id = w.conv_id AND s.i = w.i + 1 WHERE w.fate IS NULL AND w.used < 220) b) n),
final AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
SELECT conv_id, CASE WHEN fate IN ('forced_exit', 'early_exit') THEN fate WHEN NOT thinking THEN 'natural'
                     WHEN fate = 'budget' OR used >= 220 THEN 'budget' ELSE 'eos' END AS exit,
       used, probes AS n_probes, segments AS n_segments FROM final
""")
def early_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations replayed as traces of thought: words are tokens, a comma is a marker, lengths stand for probabilities."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.regexp_count(text, F.lit(r"[^ \n]+")).cast("bigint").alias("tokens"),
        F.contains(text, F.lit(",")).alias("marker"),
        (F.char_length(text) % 11 == 0).alias("closes"),
        ((F.char_length(text) % 100) / 100.0).alias("p"),
        F.substring(text, 1, 1).alias("trial"),
    )
    return folds.early_exits(rows, ["conv_id"], ["turn"], RULE)


_STRATA = ("de", "en", "es", "fr")


@_query(f"""
WITH RECURSIVE cand AS (
  SELECT doc_id, lang, doc_id // 2 AS w, doc_id // 14 AS c, sha256(concat('quota|', doc_id)) AS h FROM documents),
lists AS (SELECT lang, list(struct_pack(d := doc_id, w := w, c := c) ORDER BY h, doc_id) AS l FROM cand GROUP BY lang),
turns AS (
  SELECT CAST(k AS BIGINT) AS k, {list(_STRATA)}[CAST(CASE WHEN k < 48 THEN k % 4 ELSE (k - 48) // 12 END AS BIGINT) + 1] AS lang, k >= 48 AS fill
  FROM range(96) r(k)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(d BIGINT, w BIGINT, c BIGINT, s VARCHAR, p VARCHAR)[]) AS got
  UNION ALL
  SELECT k + 1, CASE WHEN x IS NULL OR len(list_filter(got, lambda g: g.s = lang)) >= 12 THEN got
                     ELSE list_append(got, struct_pack(d := x.d, w := x.w, c := x.c, s := lang, p := CASE WHEN fill THEN 'fill' ELSE 'distinct' END)) END
  FROM (SELECT w.k, w.got, t.lang, t.fill, list_filter(l.l, lambda x: NOT list_contains(list_transform(w.got, lambda g: g.w), x.w)
                 AND (t.fill OR NOT list_contains(list_transform(w.got, lambda g: g.c), x.c)))[1] AS x
        FROM walk w JOIN turns t ON t.k = w.k JOIN lists l ON l.lang = t.lang))
SELECT g.d AS doc_id, g.s AS lang, CAST(i AS INTEGER) AS place, g.p AS phase
FROM (SELECT unnest(got) AS g, unnest(range(1, len(got) + 1)) AS i FROM (SELECT got FROM walk ORDER BY k DESC LIMIT 1))
""")
def greedy_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve documents a language, from windows of two documents and clusters of fourteen, greedily from different clusters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs = docs.withColumn("window", F.floor(F.col("doc_id") / 2)).withColumn("cluster", F.floor(F.col("doc_id") / 14))
    out = selection.distinct_cluster_quota(docs, "lang", "window", "cluster", "quota", ["doc_id"], dict.fromkeys(_STRATA, 12), strict=False)
    return out.select("doc_id", "lang", "place", "phase")


_UPPER = "translate({0}, 'abcdefghijklmnopqrstuvwxyz ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9))"
_NORMAL = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[\s\x0B]+', ' ', 'g'))"


@_query(f"""
WITH i AS (
  SELECT item_id, trim({_NORMAL.format("'(' || " + _UPPER.format("left(text, CAST(1 + item_id % 60 AS BIGINT))") + " || '!?) '")}, '"''`.,:;!?()[]{{}}') AS x FROM benchmark),
d AS (SELECT doc_id, trim({_NORMAL.format("text")}, '"''`.,:;!?()[]{{}}') AS y FROM documents)
SELECT item_id, doc_id FROM i JOIN d ON x <> '' AND contains(y, x)
""")
def normalized_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of benchmark items, of 1 to 60 characters, shouted and in brackets, in documents after normalisation."""
    start = F.substring("text", F.lit(1), (F.col("item_id") % 60 + 1).cast("int"))
    loud = F.concat(F.lit("("), F.translate(start, "abcdefghijklmnopqrstuvwxyz ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t"), F.lit("!?) "))
    items = table(spark, sf_dir, "benchmark").select("item_id", loud.alias("item_text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.contains_join(items, docs, "item_id", "doc_id", "item_text", "text", form=survival_form)


@_query(f"""
WITH i AS (
  SELECT item_id, {_NORMAL.format(_UPPER.format("substr(text, 3, CAST(8 + (item_id * 7) % 90 AS BIGINT))"))} AS x FROM benchmark),
d AS (SELECT doc_id, {_NORMAL.format("text")} AS y FROM documents),
g AS (SELECT DISTINCT item_id, substr(x, s, 48) AS gram FROM (SELECT item_id, x, unnest(range(1, length(x) - 46)) AS s FROM i WHERE length(x) >= 48))
SELECT item_id, doc_id, 'whole' AS kind FROM i JOIN d ON contains(y, x)
WHERE length(x) < 48 AND (length(x) >= 20 OR (length(x) >= 12 AND (regexp_matches(x, '[0-9]') OR len(string_split(x, ' ')) >= 3)))
UNION ALL SELECT DISTINCT item_id, doc_id, 'grams' FROM g JOIN d ON contains(y, gram)
""")
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of benchmark items, of 8 to 97 characters in capitals, that show up in documents: short ones whole, long ones by any 48 characters."""
    piece = F.substring("text", F.lit(3), (F.col("item_id") * 7 % 90 + 8).cast("int"))
    loud = F.translate(piece, "abcdefghijklmnopqrstuvwxyz ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t")
    items = table(spark, sf_dir, "benchmark").select("item_id", loud.alias("item_text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.leak_audit(items, docs, "item_id", "doc_id", "item_text", "text")
