"""Queries of record audits, machine snapshots, Parquet batches, optional fields and orders of conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import text as tx
from pairwright.operators import integrity, records, selection
from pairwright.session import scratch, table
from pairwright.sources import readers, slices, snapshots

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PER_FILE = 100_000


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


@_query(r"""
WITH d AS (SELECT doc_id, n_chars, coalesce(text, '') || chr(10) || 'Answer: ' || (n_chars + doc_id % 2) AS whole,
                  CASE WHEN doc_id % 3 = 0 THEN strpos(coalesce(text, ''), '. ') ELSE 0 END AS cut FROM documents),
r AS (SELECT doc_id, n_chars, regexp_replace(whole, '^\s+|\s+$', '', 'g') AS plain,
             CASE WHEN cut > 0 THEN regexp_replace(substr(whole, cut + 2), '^\s+|\s+$', '', 'g') ELSE regexp_replace(whole, '^\s+|\s+$', '', 'g') END AS scored,
             len(regexp_extract_all(CASE WHEN cut > 0 THEN left(whole, cut - 1) ELSE '' END, '\S+')) AS head,
             n_chars + doc_id % 2 AS answer FROM d),
f AS (
  SELECT doc_id, CASE
    WHEN doc_id % 10 = 7 THEN concat_ws(',', CASE WHEN doc_id % 4 = 1 THEN 'error' END, CASE WHEN n_chars % 2 = 0 THEN 'content' END)
    ELSE concat_ws(',', CASE WHEN doc_id % 12 = 5 THEN 'raw'
      ELSE nullif(concat_ws(',', CASE WHEN scored <> plain THEN 'content' END, CASE WHEN doc_id % 5 = 0 THEN 'answer' END,
                  CASE WHEN n_chars > 2000 AND n_chars <= 3000 THEN 'truncated' END, CASE WHEN n_chars % 11 = 3 THEN 'tokens' END,
                  CASE WHEN floor(head * 1.3) <> head + head // 4 THEN 'thinking' END,
                  CASE WHEN (answer = n_chars OR (n_chars <> 0 AND abs(answer - n_chars) / n_chars <= 1e-4)) <> (doc_id % 2 = 0) THEN 'correct' END), '') END)
    END AS findings FROM r)
SELECT doc_id, findings FROM f WHERE findings <> ''
""")
def record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as replies with an answer at their end: stored fields, made in other ways, against those recomputed from the raw replies."""
    n, i, text = F.col("n_chars"), F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").withColumn("whole", F.concat(text, F.lit("\nAnswer: "), (n + i % 2).cast("string")))
    at = F.when(i % 3 == 0, F.locate(". ", text)).otherwise(0)
    head = F.when(at > 0, F.substring("whole", F.lit(1), at - 1)).otherwise("")
    content = F.when(at > 0, F.concat(head, F.lit(records.END), F.substring("whole", at + 2, F.length("whole")))).otherwise(F.col("whole"))
    words = F.regexp_count(head, F.lit(r"\S+")).cast("bigint")
    tokens = F.length("whole").cast("bigint")
    reply = F.struct(
        F.when(i % 12 == 5, "other").otherwise("m").alias("model"),
        F.array(F.struct(F.struct(content.alias("content")).alias("message"), F.when(n > 2000, "length").otherwise("stop").alias("finish_reason"))).alias("choices"),
        F.struct(tokens.alias("completion_tokens")).alias("usage"),
    )
    lost = i % 10 == 7
    error = F.when(i % 4 == 1, '{"kind":"http","status":200,"attempts":1}').otherwise('{"kind":"http","status":503,"attempts":2}')
    rows = docs.select(
        "doc_id",
        F.concat(F.lit("item_"), i.cast("string")).alias("id"),
        n.cast("double").alias("gold"),
        (i + 4_200_000).alias("sampler_seed"),
        F.when(lost, error).alias("api_error"),
        F.lit(None).cast("string").alias("retry_error"),
        F.lit(False).alias("retried"),
        F.when(~lost, F.to_json(reply)).alias("raw_response"),
        F.when(lost, F.when(n % 2 == 0, "x").otherwise("")).otherwise(F.btrim("whole", F.lit(" \t\n\r\f"))).alias("scoring_content"),
        F.when(~lost & (i % 5 != 0), (n + i % 2).cast("double")).alias("parsed_answer"),
        (n > 3000).alias("truncated"),
        F.when(n % 11 != 3, tokens).alias("completion_tokens"),
        (words + F.floor(words / 4)).alias("thinking_tokens"),
        (~lost & (i % 2 == 0)).alias("correct"),
    )
    found = records.record_findings(rows, "m", 4_200_000, key="doc_id")
    return found.where(F.size("findings") > 0).select("doc_id", F.array_join("findings", ",").alias("findings"))


@_query(f"""
WITH e AS (SELECT event_id // {PER_FILE} AS part, event_id, user_id, event_type, value FROM events),
p AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'fields' WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'number' WHEN value > 100 THEN 'range' END AS problem FROM e)
SELECT part, problem, count(*) AS n, round(sum(CASE WHEN problem IS NULL THEN value END), 4) AS utilization,
       CAST(max(CASE WHEN problem IS NULL THEN user_id END) AS BIGINT) AS last_index FROM p GROUP BY part, problem
""")
def processor_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a processor log, some short, some with words for numbers, some with shares above 100, read back and sorted out."""
    i, kind = F.col("user_id").cast("string"), F.col("event_type")
    watts = F.when((kind == "error") & (F.col("user_id") % 2 == 0), "[N/A]").otherwise("81.25")
    row = F.concat_ws(", ", i, F.lit("card"), F.concat(F.lit("id-"), i), F.lit("61"), watts, F.lit("512"), F.lit("12288"), F.col("value").cast("string"), F.lit("1.8e3"))
    line = F.when(kind == "signup", F.substring_index(row, ", ", 8)).otherwise(row)
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / PER_FILE).alias("part"), line.alias("value"))
    place = f"{scratch(spark, 'processors')}/rows"
    rows.write.partitionBy("part").text(place)
    found = snapshots.processor_rows(readers.read_lines(spark, f"{place}/*"), strict=False)
    part = F.regexp_extract("file", r"part=(\d+)/", 1).cast("bigint").alias("part")
    return found.groupBy(part, "problem").agg(
        F.count("*").alias("n"), F.round(F.sum("utilization_percent"), 4).alias("utilization"), F.max("index").alias("last_index")
    )


@_query("""
WITH e AS (SELECT event_id // 100 AS snapshot, event_id, event_type, CAST(round(value * 1000) AS BIGINT) * 1024 AS bytes FROM events)
SELECT snapshot, arg_max(bytes, event_id) FILTER (event_type = 'view') AS total, arg_max(bytes, event_id) FILTER (event_type = 'click') AS free,
       arg_max(bytes, event_id) FILTER (event_type = 'purchase') AS available, arg_max(bytes, event_id) FILTER (event_type = 'signup') AS cached,
       CAST(NULL AS BIGINT) AS buffers, CAST(NULL AS BIGINT) AS swap_free FROM e GROUP BY snapshot
""")
def memory_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred events each as a memory table with repeated, unknown and missing keys."""
    name = {"view": "MemTotal", "click": "MemFree", "purchase": "MemAvailable", "signup": "Cached", "error": "Slab"}
    key = F.element_at(F.create_map(*[F.lit(x) for pair in name.items() for x in pair]), F.col("event_type"))
    line = F.concat(key, F.lit(":     "), F.round(F.col("value") * 1000).cast("bigint").cast("string"), F.lit(" kB"))
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("snapshot"), "event_id", line.alias("line"))
    return snapshots.memory_rows(rows, ["snapshot"], "event_id")


@_query(f"""
WITH e AS (SELECT event_id // {PER_FILE} AS part, event_id, value, row_number() OVER (PARTITION BY event_id // {PER_FILE} ORDER BY event_id) - 1 AS pos FROM events)
SELECT CAST(part AS BIGINT) AS part, pos // 256 AS batch_no, count(*) AS n, min(pos) AS first, min(event_id) AS low, max(event_id) AS high, round(sum(value), 4) AS total
FROM e WHERE pos < 900 GROUP BY ALL
""")
def first_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 900 rows of each file of events in batches of 256, from the row groups that hold them."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / PER_FILE).alias("part"), "event_id", "value", "props")
    place = f"{scratch(spark, 'batches')}/rows"
    rows.repartition("part").sortWithinPartitions("part", "event_id").write.option("parquet.block.size", 4096).partitionBy("part").parquet(place)
    found = slices.read_batches(spark, f"{place}/*", ["event_id", "value"], 900)
    part = F.regexp_extract("file", r"part=(\d+)/", 1).cast("bigint").alias("part")
    return found.groupBy(part, "batch_no").agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.round(F.sum("value"), 4).alias("total")
    )


@_query("""
SELECT doc_id, coalesce(text, '') <> '' AS has_text, n_chars % 3 <> 0 AS has_number, quality IS NOT NULL AND quality = 1 AS has_label,
       coalesce(len(list_filter(string_split(text, ' '), lambda w: length(w) > 12)), 0) > 0 AS has_words, false AS has_partial
FROM documents LEFT JOIN labels USING (doc_id)
""")
def optional_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a document's optional fields hold something: a text, a number, a flag of a left join, a list, and a column that isn't there."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    long_words = F.filter(F.split("text", " "), lambda w: F.char_length(w) > 12)
    rows = docs.select("doc_id", "text", (F.col("n_chars") % 3).alias("number"), (F.col("quality") == 1).alias("label"), long_words.alias("words"))
    return rows.select("doc_id", *[integrity.truthy(rows, c).alias(f"has_{c}") for c in ("text", "number", "label", "words", "partial")])


_CONDITIONS = ("O", "A", "B", "C", "E")


@_query(f"""
SELECT item_id, array_to_string(list_transform(list_sort(list_transform({list(_CONDITIONS)}, lambda c: struct_pack(h := sha256('r1|' || item_id || '|' || c), c := c))), lambda s: s.c), '') AS conditions
FROM benchmark
""")
def condition_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions in an order of each benchmark item's own."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    return selection.condition_orders(items, ["item_id"], list(_CONDITIONS), "r1").select("item_id", F.array_join("order", "").alias("conditions"))


@_query(r"""
WITH d AS (SELECT doc_id, n_chars, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') || chr(10) || '  import os' WHEN 1 THEN 'class Words: ' || coalesce(text, '')
                  WHEN 2 THEN coalesce(text, '') || ' import os' ELSE coalesce(text, '') END AS x FROM documents),
l AS (SELECT doc_id, n_chars > 4000 AS big, unnest(string_split(x, chr(10))) AS line FROM d)
SELECT stratum, count(*) AS n FROM (
  SELECT doc_id, CASE WHEN any_value(big) THEN 'L' ELSE 'S' END || '-' ||
         CASE WHEN bool_or(contains(line, '```') OR regexp_matches(line, '^[ \t\r\f\v]*((def|class)[ \t]+|(import|from)[ \t]+)[A-Za-z0-9_]')) THEN 'code' ELSE 'nocode' END AS stratum
  FROM l GROUP BY doc_id) GROUP BY stratum
""")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some with a line of code, by length and by whether they hold code."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    x = F.when(k == 0, F.concat(text, F.lit("\n  import os"))).when(k == 1, F.concat(F.lit("class Words: "), text)).when(k == 2, F.concat(text, F.lit(" import os"))).otherwise(text)
    rows = table(spark, sf_dir, "documents").select(tx.stratum_key(F.col("n_chars") > 4000, x).alias("stratum"))
    return rows.groupBy("stratum").agg(F.count("*").alias("n"))
