"""Streaming queries: gates with time-outs, a journal that survives a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.session import scratch, table
from pairwright.streaming import gates, journal, telemetry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

NEED, SILENCE_MS, LATE = 2, 36_000_500, "1 hour"


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def in_time_order(spark: SparkSession, events: DataFrame, ts: str, parts: int, folder: str):
    """Writes rows by stretches of time, one after the other, and yields after each: batches of a stream that come in order."""
    low, high = events.agg(F.min(ts), F.max(ts)).first()
    for k in range(parts):
        start, stop = low + (high - low) * k / parts, low + (high - low) * (k + 1) / parts
        rows = events.where((F.col(ts) >= F.lit(start)) & ((F.col(ts) < F.lit(stop)) if k + 1 < parts else F.lit(True)))
        rows.write.mode("append").parquet(folder)
        yield k


@_query(f"""
WITH e AS (
  SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, coalesce(value > 40, false) AS over,
         lag(epoch_us(ts) // 1000) OVER w AS before, lead(epoch_us(ts) // 1000) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN NOT over OR ms - before > {SILENCE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS island FROM e),
s AS (SELECT *, sum(CASE WHEN over THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ms, event_id) AS streak FROM g)
SELECT user_id AS key, ms AS at, 'open' AS event, CAST(streak AS INTEGER) AS streak FROM s WHERE over AND streak = {NEED}
UNION ALL
SELECT user_id, ms + {SILENCE_MS}, 'silent', CAST(streak AS INTEGER) FROM s
WHERE over AND (after - ms > {SILENCE_MS} OR (after IS NULL AND ms + {SILENCE_MS} < (SELECT epoch_us(max(ts)) // 1000 FROM events) - 3600000))
""")
def gate_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks of values over 40 a user, open at the second, cut by ten hours of silence; three runs over one checkpoint."""
    place = scratch(spark, "gate")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    for _ in in_time_order(spark, events, "ts", 3, f"{place}/in"):
        stream = telemetry.stream_table(spark, f"{place}/in", events.schema, files_per_batch=1 << 20)
        found = gates.gate_events(stream, "user_id", "ts", "event_id", F.col("value") > 40, NEED, SILENCE_MS, LATE)
        with gates.timers_allowed(spark):
            telemetry.run_to_parquet(found, f"{place}/out", f"{place}/checkpoint")
    return spark.read.schema("key bigint, at bigint, event string, streak int").parquet(f"{place}/out")


@_query("""
SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, 'journal' AS part FROM events GROUP BY ALL
UNION ALL
SELECT 'signup', count(*), CAST(sum(user_id) AS BIGINT), 'quarantine' FROM (
  SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'purchase') = 0)
""")
def journal_after_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a journal whose writer dies twice between rows and receipt: nothing is lost or doubled. Users who signed up
    and never bought stand for intents without a terminal."""
    place = scratch(spark, "journal")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    book = journal.Journal(spark, f"{place}/journal", events.schema)
    dying = {0, 2}

    def crash(batch: int) -> None:
        if batch in dying:
            dying.discard(batch)
            raise RuntimeError("the writer dies here")

    for _ in in_time_order(spark, events, "ts", 3, f"{place}/in"):
        while True:
            stream = telemetry.stream_table(spark, f"{place}/in", events.schema, files_per_batch=1 << 20)
            try:
                journal.stream_into(stream, book, f"{place}/checkpoint", crash)
                break
            except Exception as error:
                if "the writer dies here" not in str(error):
                    raise
    rows = book.read()
    sums = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).withColumn("part", F.lit("journal"))
    open_keys = journal.quarantine(rows, ["user_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase")
    held = open_keys.agg(F.count("*").alias("n"), F.sum("user_id").cast("bigint").alias("ids"))
    return sums.unionByName(held.select(F.lit("signup").alias("event_type"), "n", "ids", F.lit("quarantine").alias("part")))
