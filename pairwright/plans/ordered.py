"""Queries over events and orders: latest rows, key sets, ledgers, energy, windows, quantiles, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators import aggregates, integrity, joins, pairing, selection, timeseries
from pairwright.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", timeseries.seconds("ts"))


def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


LATEST = """
SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
"""


def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, day) keys that have all five event types."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return pairing.common_keys(events, ["user_id", "day"], "event_type", 5)


INTERSECTION = """
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events
GROUP BY ALL HAVING count(DISTINCT event_type) = 5
"""


def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left = joins.remainder(orders, lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return left.select("o_orderkey", "o_custkey", "o_orderstatus")


ANTI = """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
"""


def sym_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    a = events.where("event_type = 'click'").select("user_id", "day")
    b = events.where("event_type = 'purchase'").select("user_id", "day")
    return pairing.unmatched(a, b, ["user_id", "day"])


SYM_DIFF = """
WITH a AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE event_type = 'click'),
b AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE event_type = 'purchase')
SELECT user_id, day, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT user_id, day, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
"""


def ledger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn(
        "request", F.concat_ws(":", "user_id", F.to_date("ts").cast("string"))
    )
    return joins.ledger_audit(
        events.where("event_type = 'signup'"), events.where("event_type = 'purchase'"), "request"
    )


LEDGER = """
WITH e AS (SELECT concat(user_id, ':', CAST(CAST(ts AS DATE) AS VARCHAR)) AS request, event_type FROM events),
c AS (SELECT request, count(*) FILTER (event_type = 'signup') AS n_intents,
             count(*) FILTER (event_type = 'purchase') AS n_terminals FROM e GROUP BY request)
SELECT request, n_intents, n_terminals,
       CASE WHEN n_terminals = 0 THEN 'open' WHEN n_intents = 0 THEN 'orphan'
            WHEN n_intents > 1 OR n_terminals > 1 THEN 'repeated' ELSE 'closed' END AS finding
FROM c WHERE n_intents + n_terminals > 0
"""


def energy_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.energy(_events(spark, sf_dir), "t", "value", ["user_id"])
    return out.select(
        "user_id", "n_samples", F.round("energy", 2).alias("energy"), F.round("span", 3).alias("span"),
        F.round("mean_power", 6).alias("mean_power"),
    )


ENERGY = """
WITH s AS (
  SELECT user_id, epoch_us(ts) / 1000000.0 AS t, value,
         lead(epoch_us(ts) / 1000000.0) OVER w AS t2, lead(value) OVER w AS v2
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value))
SELECT user_id, count(*) AS n_samples, round(coalesce(sum((t2 - t) * (value + v2) / 2), 0), 2) AS energy,
       round(max(t) - min(t), 3) AS span,
       round(coalesce(sum((t2 - t) * (value + v2) / 2), 0) / nullif(max(t) - min(t), 0), 6) AS mean_power
FROM s GROUP BY user_id
"""


def range_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples inside the two hours after each of a user's purchases, by a binned range join."""
    events = _events(spark, sf_dir)
    spans = events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("request"), F.col("t").alias("t0"), (F.col("t") + 7200).alias("t1")
    )
    points = events.select("user_id", "t", "value")
    met = timeseries.range_join(points, spans, "t", "t0", "t1", 7200, ["user_id"])
    return met.groupBy("user_id", "request").agg(
        F.count("*").alias("n_samples"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("peak")
    )


RANGE = """
WITH e AS (SELECT *, epoch_us(ts) / 1000000.0 AS t FROM events)
SELECT p.user_id, p.event_id AS request, count(*) AS n_samples, round(sum(s.value), 4) AS total, round(max(s.value), 4) AS peak
FROM e p JOIN e s ON p.user_id = s.user_id AND s.t >= p.t AND s.t <= p.t + 7200
WHERE p.event_type = 'purchase' GROUP BY p.user_id, p.event_id
"""


def tumbling_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute windows from each event type's own start."""
    rows = timeseries.tumbling(_events(spark, sf_dir), "t", 300, ["event_type"])
    return rows.groupBy("event_type", "window_no").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


TUMBLING = """
WITH e AS (SELECT event_type, value, epoch_us(ts) / 1000000.0 AS t FROM events),
o AS (SELECT *, min(t) OVER (PARTITION BY event_type) AS t0 FROM e)
SELECT event_type, CAST(floor((t - t0) / 300) AS BIGINT) AS window_no, count(*) AS n, round(avg(value), 6) AS mean_value
FROM o GROUP BY ALL
"""


def consecutive_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeseries.consecutive(_events(spark, sf_dir), F.col("value") < 100, ["ts", "event_id"], ["user_id"], 3)
    return rows.select("event_id", "user_id", F.col("streak").cast("long").alias("streak"), "gate_open")


GATE = """
WITH e AS (SELECT event_id, user_id, ts, value < 100 AS ok FROM events),
i AS (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
s AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM i)
SELECT event_id, user_id, CAST(CASE WHEN ok THEN run ELSE 0 END AS BIGINT) AS streak, (ok AND run >= 3) AS gate_open FROM s
"""


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles from value counts, beside median and mean."""
    orders = table(spark, sf_dir, "orders")
    ranks = aggregates.nearest_rank_counts(orders, "o_totalprice", ["o_orderstatus"], [0.5, 0.9, 0.99])
    middle = orders.groupBy("o_orderstatus").agg(
        F.round(F.median("o_totalprice"), 6).alias("median"), F.round(F.avg("o_totalprice"), 4).alias("mean")
    )
    return ranks.join(middle, "o_orderstatus")


QUANTILES = """
WITH l AS (SELECT o_orderstatus, list_sort(list(o_totalprice)) AS v, median(o_totalprice) AS m, avg(o_totalprice) AS a
           FROM orders GROUP BY o_orderstatus)
SELECT o_orderstatus, CAST(len(v) AS BIGINT) AS n, v[least(len(v) - 1, CAST(floor(0.5 * len(v)) AS INT)) + 1] AS q50,
       v[least(len(v) - 1, CAST(floor(0.9 * len(v)) AS INT)) + 1] AS q90,
       v[least(len(v) - 1, CAST(floor(0.99 * len(v)) AS INT)) + 1] AS q99, round(m, 6) AS median, round(a, 4) AS mean FROM l
"""


def terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.terciles(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], ["o_orderpriority"])
    return rows.groupBy("o_orderpriority", "tercile").agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("largest"), F.round(F.avg("o_totalprice"), 4).alias("mean")
    )


TERCILES = """
WITH r AS (SELECT o_orderpriority, o_totalprice, count(*) OVER (PARTITION BY o_orderpriority) AS n,
                  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS k FROM orders)
SELECT o_orderpriority, CASE WHEN k < n // 3 THEN 0 WHEN k < 2 * (n // 3) THEN 1 ELSE 2 END AS tercile,
       count(*) AS n, max(o_totalprice) AS largest, round(avg(o_totalprice), 4) AS mean
FROM r GROUP BY ALL
"""


def delta_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of quantity between neighbouring lines of an order, in buckets."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    rows = timeseries.neighbour_delta(rows, "q", "l_linenumber", ["l_orderkey"]).where("delta IS NOT NULL")
    return rows.groupBy(aggregates.delta_bucket(F.col("delta")).alias("bucket")).agg(F.count("*").alias("n"))


DELTAS = """
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
d AS (SELECT abs(b.q - a.q) AS d FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT CASE WHEN d = 0 THEN '0' WHEN d <= 5 THEN '1-5' WHEN d <= 50 THEN '6-50' ELSE '>50' END AS bucket, count(*) AS n
FROM d GROUP BY ALL
"""


def wls_two_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.weighted_least_squares(
        table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_extendedprice"), ["l_returnflag"]
    )
    return out.select("l_returnflag", F.round("c0", 4).alias("c0"), F.round("c1", 4).alias("c1"))


WLS = """
WITH s AS (
  SELECT l_returnflag, sum(x * x * w) AS a, sum(x * z * w) AS b, sum(z * z * w) AS c, sum(x * y * w) AS d, sum(z * y * w) AS e
  FROM (SELECT l_returnflag, l_quantity AS x, l_tax * 100 AS z, l_extendedprice AS y, 1 / (l_extendedprice * l_extendedprice) AS w FROM lineitem)
  GROUP BY l_returnflag)
SELECT l_returnflag, round((c * d - b * e) / (a * c - b * b), 4) AS c0, round((a * e - b * d) / (a * c - b * b), 4) AS c1 FROM s
"""


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed properties under an explicit schema, with their constraints as a table of checks."""
    events = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k BIGINT"))
    return integrity.check_rows(
        events,
        {
            "k is a number": F.col("p.k").isNotNull(),
            "k under 50": F.col("p.k") < 50,
            "value is finite": ~F.isnan("value") & (F.col("value") >= 0),
            "type is known": F.col("event_type").isin("signup", "error", "click", "view", "purchase"),
        },
    )


JSON_PROPS = """
WITH e AS (SELECT *, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT 'k is a number' AS name, k IS NOT NULL AS ok FROM e UNION ALL SELECT 'k under 50', coalesce(k < 50, false) FROM e
      UNION ALL SELECT 'value is finite', coalesce(NOT isnan(value) AND value >= 0, false) FROM e
      UNION ALL SELECT 'type is known', coalesce(event_type IN ('signup', 'error', 'click', 'view', 'purchase'), false) FROM e)
SELECT name, bool_and(ok) AS ok, count(*) AS n_rows, count(*) FILTER (NOT ok) AS n_bad FROM c GROUP BY name
"""


def bucket_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value by coarse type, with shares of the whole (ordered substring rules)."""
    from pairwright.functions.text import first_bucket

    kind = first_bucket("event_type", [("entry", ["sign"]), ("money", ["purch"]), ("look", ["view", "click"])])
    out = aggregates.shares(table(spark, sf_dir, "events").withColumn("kind", kind), ["kind"], F.col("value"))
    return out.select("kind", F.round("total", 4).alias("total"), F.round("share", 8).alias("share"))


BUCKETS = """
WITH k AS (SELECT CASE WHEN event_type LIKE '%sign%' THEN 'entry' WHEN event_type LIKE '%purch%' THEN 'money'
                       WHEN event_type LIKE '%view%' OR event_type LIKE '%click%' THEN 'look' ELSE 'other' END AS kind, value FROM events)
SELECT kind, round(sum(value), 4) AS total, round(sum(value) / (SELECT sum(value) FROM k), 8) AS share FROM k GROUP BY kind
"""


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return aggregates.envelope(orders, "o_totalprice", ["o_orderpriority"], ["o_orderstatus"]).withColumn(
        "largest_spread", F.round("largest_spread", 6)
    )


ENVELOPES = """
SELECT o_orderstatus, min(lo) AS low, max(hi) AS high, round(max(hi - lo), 6) AS largest_spread
FROM (SELECT o_orderstatus, o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL) GROUP BY ALL
"""


def running_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive prefix sums and trailing means of 20 rows, per user in time order."""
    events = table(spark, sf_dir, "events")
    rows = timeseries.running_before(events, "value", ["ts", "event_id"], ["user_id"])
    rows = timeseries.trailing_mean(rows, "value", ["ts", "event_id"], ["user_id"], 20)
    return rows.select("event_id", F.round("before", 4).alias("before"), F.round("trailing_mean", 6).alias("trailing_mean"))


RUNNING = """
SELECT event_id,
       round(coalesce(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS before,
       round(avg(value) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS trailing_mean
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""

QUERIES = {
    "latest_row": latest_row,
    "key_intersection": key_intersection,
    "anti_resume": anti_resume,
    "sym_diff": sym_diff,
    "ledger_audit": ledger_audit,
    "energy_trapezoid": energy_trapezoid,
    "range_energy": range_energy,
    "tumbling_5min": tumbling_5min,
    "consecutive_gate": consecutive_gate,
    "quantiles": quantiles,
    "terciles": terciles,
    "delta_buckets": delta_buckets,
    "wls_two_param": wls_two_param,
    "json_props": json_props,
    "bucket_shares": bucket_shares,
    "envelopes": envelopes,
    "running_windows": running_windows,
}
ORACLE_SQL = {
    "latest_row": LATEST,
    "key_intersection": INTERSECTION,
    "anti_resume": ANTI,
    "sym_diff": SYM_DIFF,
    "ledger_audit": LEDGER,
    "energy_trapezoid": ENERGY,
    "range_energy": RANGE,
    "tumbling_5min": TUMBLING,
    "consecutive_gate": GATE,
    "quantiles": QUANTILES,
    "terciles": TERCILES,
    "delta_buckets": DELTAS,
    "wls_two_param": WLS,
    "json_props": JSON_PROPS,
    "bucket_shares": BUCKETS,
    "envelopes": ENVELOPES,
    "running_windows": RUNNING,
}


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows of one hour over the events as a stream, in update mode until the input ends."""
    import uuid

    from pairwright.session import shared_folder
    from pairwright.streaming import telemetry

    events = table(spark, sf_dir, "events")
    stream = telemetry.stream_table(spark, f"{sf_dir}/events.parquet*", events.schema)  # one file or a folder of them
    counts = telemetry.tumbling_counts(stream, "ts", ["event_type"], "1 hour", "2 hours")
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = telemetry.run_updates(counts, ["start", "event_type"], f"{place}/rows", f"{place}/checkpoint")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


QUERIES["stream_tumbling"] = stream_tumbling
ORACLE_SQL["stream_tumbling"] = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value
FROM events GROUP BY ALL
"""
