"""Queries that recompute and reconcile figures: summaries, records, survival, roll-ups, digests, ledgers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions import arrays
from pairwright.functions import text as tx
from pairwright.functions.canonical import canonical_row
from pairwright.operators import aggregates, claims, folds, integrity, joins, selection, timeseries
from pairwright.plans.paired import _P
from pairwright.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").join(docs, "doc_id")


_LABELLED = "l AS (SELECT * FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


@_query("""
WITH lines AS (SELECT l_orderkey, count(*) AS rows_n, count(*) FILTER (l_quantity > 25) AS rows_k FROM lineitem GROUP BY ALL),
s AS (SELECT o_orderkey AS l_orderkey, CAST(o_orderkey % 5 + 1 AS BIGINT) AS n, CAST(o_custkey % (o_orderkey % 5 + 2) AS BIGINT) AS summary_k FROM orders)
SELECT l_orderkey, n, summary_k, coalesce(rows_n, 0) AS rows_n, coalesce(rows_k, 0) AS rows_k,
       CASE WHEN rows_n IS NULL THEN 'no_rows' WHEN rows_n < n AND rows_k <= summary_k THEN 'partial'
            WHEN rows_n = n AND rows_k = summary_k THEN 'complete' ELSE 'contradiction' END AS status
FROM s LEFT JOIN lines USING (l_orderkey)
""")
def reconcile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed counts per order (made from its keys, as rates) against its lines."""
    n = (F.col("o_orderkey") % 5 + 1).cast("bigint")
    told = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), n.alias("n"), F.try_divide((F.col("o_custkey") % (n + 1)).cast("double"), n).alias("accuracy")
    )
    return claims.reconcile(told, table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity") > 25)


@_query(f"""
WITH {_LABELLED},
o AS (SELECT 'quality' AS config, doc_id AS item, quality = 1 AS ok FROM l UNION ALL SELECT 'toxic', doc_id, toxic = 1 FROM l
      UNION ALL SELECT 'english', doc_id, quality = 1 FROM l WHERE lang = 'en'),
spec AS (SELECT * FROM (VALUES ('paired', 'quality', 'toxic'), ('part', 'quality', 'english'), ('absent', 'quality', 'none')) AS v(name, config_a, config_b)),
c AS (SELECT config, count(*) AS n, count(*) FILTER (ok) AS k FROM o GROUP BY config),
w AS (SELECT name, config_a, config_b, a.n AS n_a, a.k AS k_a, b.n AS n_b, b.k AS k_b
      FROM spec LEFT JOIN c a ON a.config = config_a LEFT JOIN c b ON b.config = config_b),
p AS (SELECT name, count(*) AS n_common, count(*) FILTER (x.ok AND NOT y.ok) AS a_only, count(*) FILTER (NOT x.ok AND y.ok) AS b_only
      FROM spec JOIN o x ON x.config = config_a JOIN o y ON y.config = config_b AND x.item = y.item GROUP BY name),
j AS (SELECT *, CASE WHEN n_a IS NULL OR n_b IS NULL THEN 'no rows' WHEN coalesce(n_common, 0) <> greatest(n_a, n_b) THEN 'items differ' END AS unavailable
      FROM w LEFT JOIN p USING (name)),
f AS (SELECT name, unnest(range(greatest(0, k_a + k_b - n_b), least(n_a, k_a + k_b) + 1)) AS i, n_a, k_a, n_b, k_b FROM j WHERE n_b IS NOT NULL),
g AS (SELECT *, lgamma(n_a + 1) - lgamma(i + 1) - lgamma(n_a - i + 1) + lgamma(n_b + 1) - lgamma(k_a + k_b - i + 1) - lgamma(n_b - k_a - k_b + i + 1)
             - lgamma(n_a + n_b + 1) + lgamma(k_a + k_b + 1) + lgamma(n_a + n_b - k_a - k_b + 1) AS lp FROM f),
h AS (SELECT name, sum(exp(g.lp)) FILTER (g.lp <= t.lp + 1e-9) AS fisher_p FROM g JOIN (SELECT name, lp FROM g WHERE i = k_a) t USING (name) GROUP BY name)
SELECT name, config_a, config_b, n_a, k_a, n_b, k_b, round(fisher_p, 8) AS fisher_p,
       CASE WHEN unavailable IS NULL THEN a_only END AS a_only, CASE WHEN unavailable IS NULL THEN b_only END AS b_only,
       CASE WHEN unavailable IS NULL THEN round({_P}, 8) END AS mcnemar_p, unavailable
FROM j LEFT JOIN h USING (name)
""")
def comparison_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons given as a table of specs: whole items, a part of them, and a configuration without rows."""
    rows = _labelled(spark, sf_dir)
    parts = (("quality", "quality", F.lit(True)), ("toxic", "toxic", F.lit(True)), ("english", "quality", F.col("lang") == "en"))
    outcomes = None
    for name, column, where in parts:
        one = rows.where(where).select(F.lit(name).alias("config"), "doc_id", (F.col(column) == 1).alias("ok"))
        outcomes = one if outcomes is None else outcomes.unionByName(one)
    specs = spark.createDataFrame(
        [("paired", "quality", "toxic"), ("part", "quality", "english"), ("absent", "quality", "none")], "name string, config_a string, config_b string"
    )
    out = claims.comparison_records(specs, outcomes, "config", "doc_id", F.col("ok"))
    return out.withColumns({c: F.round(c, 8) for c in ("fisher_p", "mcnemar_p")})


@_query(f"""
WITH {_LABELLED},
t AS (SELECT source, lang, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS b, count(*) FILTER (quality = 1 AND toxic <> 1) AS x,
             count(*) FILTER (quality <> 1 AND toxic = 1) AS y, count(*) FILTER (quality <> 1 AND toxic <> 1) AS z FROM l GROUP BY source, lang),
s AS (SELECT source, sum(n)::BIGINT AS n, sum(b)::BIGINT AS "both", sum(x)::BIGINT AS a_only, sum(y)::BIGINT AS b_only, sum(z)::BIGINT AS neither FROM t GROUP BY source)
SELECT *, round({_P}, 8) AS p FROM s
""")
def pooled_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of each language pooled per source, then the exact test."""
    from pairwright.operators.pairing import paired_counts

    tables = paired_counts(_labelled(spark, sf_dir), F.col("quality") == 1, F.col("toxic") == 1, ["source", "lang"])
    return claims.pooled(tables, ["source"]).withColumn("p", F.round("p", 8))


@_query("""
WITH t AS (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY ALL),
p AS (SELECT a.conv_id, sha256(a.text) AS sa, sha256(b.text) AS sb, length(a.text) // 20 AS ta, length(b.text) // 20 AS tb
      FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2)
SELECT conv_id % 7 AS fold, count(*) AS n_pairs, count(*) FILTER (sa IS NOT NULL AND sb IS NOT NULL) AS n_hashed,
       count(*) FILTER (sa = sb) AS identical,
       round(count(*) FILTER (sa = sb) / nullif(count(*) FILTER (sa IS NOT NULL AND sb IS NOT NULL), 0)::DOUBLE, 9) AS identity_hashed,
       round(count(*) FILTER (sa = sb) / count(*)::DOUBLE, 9) AS identity_all,
       count(*) FILTER (ta = tb AND ta > 0) AS same_tokens_positive, count(*) FILTER (ta = tb) AS same_tokens FROM p GROUP BY ALL
""")
def identity_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn against the one after next: equal texts and equal lengths by both denominators."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    size = F.floor(F.char_length("text") / 20)
    one = rows.select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("sa"), size.alias("ta"))
    two = rows.select("conv_id", (F.col("turn") - 2).alias("turn"), F.sha2(F.col("text").cast("binary"), 256).alias("sb"), size.alias("tb"))
    pairs = one.join(two, ["conv_id", "turn"]).withColumn("fold", F.col("conv_id") % 7)
    out = claims.identity_rates(pairs, ["fold"], "sa", "sb", "ta", "tb")
    return out.withColumns({c: F.round(c, 9) for c in ("identity_hashed", "identity_all")})


@_query("""
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT o_orderpriority, count(*) AS n_pairs, count(*) FILTER (b.q > 1.2 * a.q) AS longer, count(*) FILTER (b.q < 0.8 * a.q) AS shorter
FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN orders ON o_orderkey = a.l_orderkey GROUP BY ALL
""")
def length_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of an order that are more than a fifth longer or shorter."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("a"))
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("a").alias("b"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return claims.length_changes(rows.join(after, ["l_orderkey", "l_linenumber"]).join(orders, "l_orderkey"), ["o_orderpriority"], "a", "b")


@_query(f"""
WITH {_LABELLED}, s AS (SELECT lang, quality = 1 AS ok, contains(text, 'a a') OR length(text) > 800 AS alive FROM l)
SELECT lang, count(*) AS n, count(*) FILTER (alive) AS n_survive, count(*) FILTER (alive AND ok) AS k_survive,
       count(*) FILTER (NOT alive) AS n_destroyed, count(*) FILTER (NOT alive AND ok) AS k_destroyed,
       round(count(*) FILTER (alive AND ok) / nullif(count(*) FILTER (alive), 0)::DOUBLE, 9) AS acc_survive,
       round(count(*) FILTER (NOT alive AND ok) / nullif(count(*) FILTER (NOT alive), 0)::DOUBLE, 9) AS acc_destroyed
FROM s GROUP BY lang
""")
def survival_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _labelled(spark, sf_dir).join(texts, "doc_id").where("text IS NOT NULL")
    alive = F.contains("text", F.lit("a a")) | (F.char_length("text") > 800)
    out = claims.survival(rows, ["lang"], alive, F.col("quality") == 1)
    return out.withColumns({c: F.round(c, 9) for c in ("acc_survive", "acc_destroyed")})


@_query("""
WITH a AS (SELECT user_id % 10 AS grp, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN props END AS err FROM events),
k AS (SELECT grp, err, count(*) AS n FROM a WHERE err IS NOT NULL GROUP BY ALL),
t AS (SELECT grp, err FROM k QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, err) = 1),
s AS (SELECT grp, count(*) AS attempts, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected, count(DISTINCT err) AS error_kinds FROM a GROUP BY grp)
SELECT s.*, err AS top_error FROM s LEFT JOIN t USING (grp)
""")
def attempt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("grp"), (~bad).alias("ok"), F.when(bad, F.col("props")).alias("err"))
    return claims.attempt_summary(rows, ["grp"], F.col("ok"), "err")


@_query(r"""
WITH t AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM t),
d AS (SELECT conv_id % 5 AS fold, list_filter(range(1, greatest(len(w), len(b)) + 1), lambda i: w[i] IS DISTINCT FROM b[i])[1] - 1 AS place,
             abs(len(w) - len(b)) AS gap FROM p WHERE b IS NOT NULL AND w IS NOT NULL)
SELECT fold, count(*) AS n, count(place) AS diverged, median(place)::DOUBLE AS median_place,
       round(count(*) FILTER (place IS NOT NULL AND gap < 4) / nullif(count(place), 0)::DOUBLE, 9) AS near_tie_share FROM d GROUP BY fold
""")
def divergence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("w", tx.words("text")).withColumn("b", F.lag("w").over(order))
    rows = rows.where("b IS NOT NULL AND w IS NOT NULL").select(
        (F.col("conv_id") % 5).alias("fold"), tx.first_divergence("b", "w").alias("place"), F.abs(F.size("w") - F.size("b")).alias("gap")
    )
    out = claims.divergence_summary(rows, ["fold"], "place", "gap", 4)
    return out.withColumn("median_place", F.col("median_place").cast("double")).withColumn("near_tie_share", F.round("near_tie_share", 9))


@_query("""
WITH a AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
b AS (SELECT l_suppkey, l_returnflag, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
g AS (SELECT l_suppkey, l_returnflag, abs(a.v - b.v) AS gap FROM a JOIN b USING (l_suppkey, l_returnflag))
SELECT (SELECT count(*) FROM g) AS n, round(gap, 4) AS largest_gap, l_suppkey, l_returnflag FROM g
ORDER BY gap DESC, l_suppkey DESC, l_returnflag DESC LIMIT 1
""")
def largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain against weighted mean price: where the two modes differ most."""
    keys = ["l_suppkey", "l_returnflag"]
    rows = table(spark, sf_dir, "lineitem").groupBy(*keys)
    a = rows.agg(F.avg("l_extendedprice").alias("v"))
    b = rows.agg(F.try_divide(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), F.sum("l_quantity")).alias("v"))
    return claims.largest_gap(a, b, keys, "v").withColumn("largest_gap", F.round("largest_gap", 4))


@_query("""
SELECT l_suppkey, count(*) AS n_shards, CAST(sum(l_extendedprice::BIGINT) AS BIGINT) AS bytes, CAST(sum(l_quantity::BIGINT * 1000) AS BIGINT) AS params,
       CAST(sum(l_linenumber) AS BIGINT) AS tensors, round(8.0 * sum(l_extendedprice::BIGINT) / sum(l_quantity::BIGINT * 1000), 9) AS bits_per_weight,
       arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS l_returnflag,
       count(*) = arg_min(l_partkey % 700, l_orderkey * 10 + l_linenumber) AS all_shards
FROM (SELECT * REPLACE (floor(l_extendedprice) AS l_extendedprice, floor(l_quantity) AS l_quantity) FROM lineitem) GROUP BY l_suppkey
""")
def shard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as shards of a supplier's model: sums, bits per weight, the first shard's metadata, the declared number."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
        F.floor("l_extendedprice").cast("bigint").alias("bytes"), (F.floor("l_quantity").cast("bigint") * 1000).alias("params"),
        F.col("l_linenumber").cast("bigint").alias("tensors"), (F.col("l_partkey") % 700).alias("declared"),
    )
    out = claims.shard_rollup(rows, "l_suppkey", "place", ["l_returnflag"], "declared")
    return out.withColumn("bits_per_weight", F.round("bits_per_weight", 9))


@_query("""
SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS k, round(avg(o_totalprice), 4) AS mean_wall,
       count(*) = 1500 AS complete FROM orders GROUP BY ALL
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = claims.run_summary(
        table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], F.col("o_totalprice") > 150000, F.col("o_totalprice"), 1500
    )
    return out.withColumn("mean_wall", F.round("mean_wall", 4))


@_query("""
WITH t AS (SELECT o_orderpriority, l_linenumber - 1 AS turn, l_discount AS first_token, l_quantity AS tokens, l_extendedprice AS wall, l_tax
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderpriority, count(*) FILTER (turn = 0) AS cold_turns, round(avg(first_token) FILTER (turn = 0), 9) AS cold_first_token,
       round(avg(first_token) FILTER (turn <> 0), 9) AS later_first_token, round(sum(tokens) / sum(wall), 9) AS tokens_per_second,
       round(avg(l_tax) FILTER (l_tax > 0.03), 9) AS mean_load
FROM t GROUP BY o_orderpriority
""")
def turn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as turns of a session: cold first turns against later ones, throughput, load over an idle floor."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    rows = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").withColumn("turn", F.col("l_linenumber") - 1)
    out = claims.turn_summary(rows, ["o_orderpriority"], "turn", "l_discount", "l_quantity", "l_extendedprice")
    load = rows.groupBy("o_orderpriority").agg(claims.mean_above(F.col("l_tax"), 0.03).alias("mean_load"))
    doubles = ("cold_first_token", "later_first_token", "tokens_per_second", "mean_load")
    return out.join(load, "o_orderpriority").withColumns({c: F.round(c, 9) for c in doubles})


@_query("""
WITH e AS (SELECT *, epoch_us(ts) / 1000000.0 AS t FROM events),
r AS (SELECT user_id, min(t) AS t0 FROM e WHERE event_type = 'purchase' GROUP BY user_id),
i AS (SELECT user_id, count(*) AS idle_samples, avg(value) AS idle_power FROM e JOIN r USING (user_id) WHERE t >= t0 - 86400 AND t < t0 GROUP BY user_id),
s AS (SELECT user_id, t, value, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, value)),
g AS (SELECT user_id, count(*) AS tokens, coalesce(sum((t2 - t) * (value + v2) / 2), 0) AS energy, max(t) - min(t) AS span FROM s GROUP BY user_id),
j AS (SELECT *, coalesce(idle_power, 0) * 0.5 AS idle FROM g LEFT JOIN i USING (user_id))
SELECT user_id, coalesce(idle_samples, 0) AS idle_samples, round(idle, 6) AS idle_power, round(1e6 * tokens / nullif(energy, 0), 6) AS tokens_per_megajoule,
       round(1e6 * tokens / nullif(CASE WHEN energy - idle * span > 0 THEN energy - idle * span END, 0), 6) AS net_tokens_per_megajoule,
       round(1e3 * tokens / nullif(energy, 0), 9) AS tokens_per_kilojoule FROM j
""")
def energy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per joule of each user's load, gross and net of half the mean load in the day before the first purchase."""
    events = table(spark, sf_dir, "events").withColumn("t", timeseries.seconds("ts"))
    runs = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("t").alias("t0"))
    idle = claims.idle_power(events, runs, ["user_id"], "t", "value", "t0", 86400).drop("t0")
    whole = timeseries.energy(events, "t", "value", ["user_id"]).join(idle, "user_id", "left")
    whole = whole.withColumn("idle", F.coalesce("idle_power", F.lit(0.0)) * 0.5).withColumn("tokens", F.col("n_samples"))
    out = claims.energy_rates(whole, "tokens", "energy", "span", "idle")
    return out.select(
        "user_id", F.coalesce("idle_samples", F.lit(0).cast("bigint")).alias("idle_samples"), F.round("idle", 6).alias("idle_power"),
        F.round(F.col("tokens_per_joule") * 1e6, 6).alias("tokens_per_megajoule"),
        F.round(F.col("net_tokens_per_joule") * 1e6, 6).alias("net_tokens_per_megajoule"),
        F.round("tokens_per_kilojoule", 9).alias("tokens_per_kilojoule"),
    )


@_query("""
WITH r AS (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS rate FROM lineitem GROUP BY ALL)
SELECT a.l_returnflag, a.l_linenumber, a.rate, round(a.rate / b.rate, 9) AS scale, round(a.rate / a.l_linenumber, 6) AS per_stream
FROM r a LEFT JOIN r b ON a.l_returnflag = b.l_returnflag AND b.l_linenumber = 1
""")
def scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as client counts: throughput against one client, and per stream."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.sum("l_quantity").alias("rate"))
    out = claims.scaling(rows, ["l_returnflag"], "l_linenumber", "rate")
    return out.withColumn("scale", F.round("scale", 9)).withColumn("per_stream", F.round("per_stream", 6))


@_query("""
WITH want AS (SELECT * FROM (VALUES ('en', 250), ('de', 250), ('xx', 3)) AS v(lang, expected)), have AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, coalesce(n, 0) AS n, CAST(expected AS BIGINT) AS expected, n IS NOT DISTINCT FROM expected AS ok FROM have FULL JOIN want USING (lang)
""")
def frame_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.frame_pins(table(spark, sf_dir, "documents"), "lang", {"en": 250, "de": 250, "xx": 3})


@_query("""
WITH m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS was, row_number() OVER (ORDER BY doc_id // 10, -(doc_id % 10 // 5), doc_id) - 1 AS i FROM documents)
SELECT count(*) AS n_common, CAST(count(*) FILTER (was < before) AS BIGINT) AS out_of_order FROM (SELECT *, lag(was) OVER (ORDER BY i) AS before FROM m)
""")
def order_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame whose tens have swapped halves: how many rows come out of their former order."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    key = F.col("doc_id")
    ten, half = F.floor(key / 10), F.floor(key % 10 / 5)
    # positions by arithmetic would need dense ids, so both come from global ranks of the (unique) ids
    before = selection.with_positions(ids, ["doc_id"])
    after = selection.with_positions(ids, [ten, -half, key])
    return claims.order_kept(before, after, "doc_id", "pos")


@_query("""
SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars > 5000) AS truncated, count(*) FILTER (text IS NULL OR text = '') AS errored,
       round(count(*) FILTER (n_chars > 5000) / count(*)::DOUBLE, 9) AS truncated_share FROM documents GROUP BY ALL
""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = claims.inventory(
        table(spark, sf_dir, "documents"), ["lang", "source"], F.col("n_chars") > 5000, F.col("text").isNull() | (F.col("text") == "")
    )
    return out.withColumn("truncated_share", F.round("truncated_share", 9))


@_query("""
WITH l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, count(*) AS n_lines, bool_and(contains(line, ' ')) AS all_hold, bool_or(contains(line, '?')) AS some_hold FROM l GROUP BY conv_id
""")
def file_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files: lines, whether all hold a space, whether any asks something."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.split("text", "\n")).alias("line"))
    return claims.file_predicates(lines, "conv_id", "line", " ", "?")


@_query("""
WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 4 = 0 THEN 'oops'
             WHEN event_id % 4 = 1 THEN concat('{"kind":"http","status":', 100 * (user_id % 7), ',"attempts":1}')
             WHEN event_id % 4 = 2 THEN '{"kind":"exception","exception":"Timeout","attempts":2}' ELSE '{"kind":"exception","attempts":2}' END AS x, user_id FROM events)
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN x IS NULL THEN NULL WHEN event_id % 4 = 0 THEN 'not a record' WHEN event_id % 4 = 1 AND user_id % 7 NOT IN (4, 5) THEN 'status out of range'
              WHEN event_id % 4 = 3 THEN 'exception without a name' END AS reason FROM e) GROUP BY reason
""")
def error_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error records of several shapes, sound and not, by what is wrong with them."""
    k = F.col("event_id") % 4
    http = F.concat(F.lit('{"kind":"http","status":'), (F.col("user_id") % 7 * 100).cast("string"), F.lit(',"attempts":1}'))
    record = (
        F.when(F.col("event_type") != "error", None).when(k == 0, "oops").when(k == 1, http)
        .when(k == 2, '{"kind":"exception","exception":"Timeout","attempts":2}').otherwise('{"kind":"exception","attempts":2}')
    )
    rows = table(spark, sf_dir, "events").select(claims.error_contract(record).alias("c"))
    return rows.groupBy(F.col("c.reason").alias("reason")).agg(F.count("*").alias("n"))


@_query("""
WITH h AS (SELECT concat('c_', c_custkey) AS id, c_custkey AS pos FROM customer UNION ALL SELECT 'odd id', 0 UNION ALL SELECT 'c_5', 9),
w AS (SELECT concat('c_', c_custkey) AS id, c_custkey + CAST(c_custkey % 50 = 0 AS INT) AS pos FROM customer WHERE c_custkey % 97 <> 0 UNION ALL SELECT 'c_0', 0),
g AS (SELECT id, count(*) AS n, min(pos) AS pos FROM h GROUP BY id), f AS (SELECT g.id, g.n, g.pos, w.id AS want, w.pos AS wpos FROM g FULL JOIN w USING (id))
SELECT count(*) FILTER (id IS NOT NULL AND NOT regexp_matches(id, '^[a-z]+_[0-9]+$')) AS odd_ids, count(*) FILTER (n > 1) AS repeated,
       count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (want IS NULL) AS unexpected, count(*) FILTER (pos <> wpos) AS misplaced FROM f
""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a data set with an odd and a repeated id, against a sample that misses and misplaces some."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(key)
    label = F.concat(F.lit("c_"), key.cast("string")).alias("id")
    extra = spark.createDataFrame([("odd id", 0), ("c_5", 9)], "id string, pos bigint")
    rows = customers.select(label, key.cast("bigint").alias("pos")).unionAll(extra)
    sample = customers.where(key % 97 != 0).select(label, (key + (key % 50 == 0).cast("int")).cast("bigint").alias("pos"))
    return claims.provenance(rows, sample.unionAll(spark.createDataFrame([("c_0", 0)], "id string, pos bigint")), "id", "pos", r"^[a-z]+_[0-9]+$")


@_query("""
SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 60000 THEN 'middle' END AS verdict FROM orders
""")
def banded_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from a table of registered bands; a gap between bands gives null."""
    bands = spark.createDataFrame([(None, 50000.0, "low"), (60000.0, 200000.0, "middle"), (200000.0, None, "high")], "low double, high double, verdict string")
    return claims.banded(table(spark, sf_dir, "orders"), "o_totalprice", bands).select("o_orderkey", "verdict")


@_query("""
WITH m AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
w AS (SELECT o_orderpriority, max(v) FILTER (o_orderstatus = 'P') AS P, max(v) FILTER (o_orderstatus = 'F') AS F, max(v) FILTER (o_orderstatus = 'O') AS O FROM m GROUP BY ALL)
SELECT o_orderpriority, round(P, 4) AS "P", round(F, 4) AS "F", round(O, 4) AS "O", P > F AND F > O AS falls FROM w
""")
def ordered_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    out = claims.ordered_values(rows, ["o_orderpriority"], "o_orderstatus", "v", ["P", "F", "O"])
    return out.withColumns({c: F.round(c, 4) for c in ("P", "F", "O")})


@_query("""
WITH e AS (SELECT user_id % 4 AS grp, value, event_type FROM events),
l AS (SELECT grp, list_sort(list(value)) AS v, count(*) AS n, max(value) AS m, count(*) FILTER (event_type = 'view') AS c, count(*) FILTER (event_type = 'signup') AS d FROM e GROUP BY grp)
SELECT grp, n, m AS largest, round(c / n::DOUBLE, 9) AS cached_share, round(d / n::DOUBLE, 9) AS cold_share,
       v[least(n - 1, CAST(floor(0.5 * n) AS INT)) + 1] AS q50, v[least(n - 1, CAST(floor(0.9 * n) AS INT)) + 1] AS q90 FROM l
""")
def traffic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 4)
    out = claims.traffic_summary(rows, ["grp"], "value", F.col("event_type") == "view", F.col("event_type") == "signup")
    return out.withColumns({c: F.round(c, 9) for c in ("cached_share", "cold_share")})


@_query("""
SELECT l_returnflag, least(floor((l_linenumber - 1) * 3 / 7.0), 2)::INT AS band, count(*) AS n, round(median(l_extendedprice), 4) AS median, max(l_extendedprice) AS largest
FROM lineitem GROUP BY ALL
""")
def component_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("depth", F.col("l_linenumber") - 1)
    return claims.component_summary(rows, ["l_returnflag"], "l_extendedprice", "depth", 3, 7).withColumn("median", F.round("median", 4))


@_query("""
WITH v AS (SELECT grp, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS place FROM (SELECT vec_id % 3 AS grp, embedding AS e FROM embeddings))
SELECT grp, CAST(place AS INT) AS place, count(x) AS n, round(avg(x), 6) AS mean FROM v GROUP BY ALL
""")
def position_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("grp"), "embedding")
    return claims.position_means(rows, ["grp"], "embedding").withColumn("mean", F.round("mean", 6))


@_query("""
WITH f AS (SELECT conv_id, turn, concat(lpad(hex(octet_length(encode(coalesce(role, '')))), 16, '0'), hex(encode(coalesce(role, ''))),
                  lpad(hex(octet_length(encode(coalesce(text, '')))), 16, '0'), hex(encode(coalesce(text, '')))) AS frame, role, text FROM conversations)
SELECT conv_id, count(*) AS n, sha256(unhex(string_agg(frame, '' ORDER BY turn, unhex(frame)))) AS sha256 FROM f GROUP BY conv_id
""")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns in order, roles and texts behind their lengths."""
    return claims.ordered_digest(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role", "text"])


@_query("""
WITH e AS (SELECT concat(user_id, ':', CAST(CAST(ts AS DATE) AS VARCHAR)) AS request, event_type FROM events),
c AS (SELECT request, count(*) FILTER (event_type = 'signup') AS n_intents, count(*) FILTER (event_type = 'purchase') AS n_terminals,
             count(*) FILTER (event_type = 'view') AS n_responses FROM e GROUP BY request)
SELECT *, CASE WHEN n_intents <> 1 THEN 'intent' WHEN n_terminals <> 1 THEN 'terminal' WHEN n_responses <> 1 THEN 'response' ELSE 'closed' END AS finding
FROM c WHERE n_intents + n_terminals + n_responses > 0
""")
def response_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("request", F.concat_ws(":", "user_id", F.to_date("ts").cast("string")))
    return claims.response_audit(*[events.where(F.col("event_type") == t) for t in ("signup", "purchase", "view")], "request")


@_query("""
WITH p AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS y, o_totalprice BETWEEN 1000 AND 300000 AS valid FROM orders),
l AS (SELECT o_orderstatus, min(y) AS lo, max(y) AS hi FROM p WHERE valid GROUP BY o_orderstatus)
SELECT o_orderkey, valid, round(lo - 0.05 * (hi - lo), 4) AS axis_low, round(hi + 0.05 * (hi - lo), 4) AS axis_high FROM p LEFT JOIN l USING (o_orderstatus)
""")
def plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = claims.plot_points(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", "o_orderstatus", 1000, 300000)
    return out.select("o_orderkey", "valid", F.round("axis_low", 4).alias("axis_low"), F.round("axis_high", 4).alias("axis_high"))


@_query("""
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderstatus ELSE o_orderpriority END AS expected FROM orders
""")
def sentinel_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that stands for null falls back to the stored answer."""
    told = F.when(F.col("o_orderpriority").like("1%"), F.when(F.col("o_orderkey") % 2 == 0, "None")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.sentinel(told, "o_orderstatus").alias("expected"))


@_query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)
SELECT l_orderkey, l_linenumber, pos FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE pos < 500
""")
def dataset_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first 500 items in a data set's own order, which a table of positions gives."""
    orders = table(spark, sf_dir, "orders")
    first = orders.orderBy("o_orderdate", "o_orderkey").limit(500)
    order = first.select("o_orderkey", (F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")) - 1).cast("bigint").alias("pos"))
    return selection.head_in_order(table(spark, sf_dir, "lineitem").withColumn("o_orderkey", F.col("l_orderkey")), order, "o_orderkey", "pos", 500).select(
        "l_orderkey", "l_linenumber", "pos"
    )


@_query("""
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
""")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a finished order: membership only, so no row is multiplied."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.members(table(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_mktsegment")


@_query("""
SELECT s.o_orderkey, s.o_totalprice, p.o_orderkey AS other_key, s.o_totalprice = p.o_totalprice AS same
FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P') s
JOIN (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') p USING (k)
""")
def zipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row i of one list beside row i of another, by explicit positions."""

    def ranked(status: str, key: str, price: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
        rows = selection.with_positions(rows.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
        return rows.select("pos", F.col("o_orderkey").alias(key), F.col("o_totalprice").alias(price))

    out = joins.positional_zip(ranked("P", "key", "price"), ranked("F", "key", "price"), "pos").where("key_a IS NOT NULL AND key_b IS NOT NULL")
    return out.select(
        F.col("key_a").alias("o_orderkey"), F.col("price_a").alias("o_totalprice"), F.col("key_b").alias("other_key"), (F.col("price_a") == F.col("price_b")).alias("same")
    )


@_query("""
SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(concat('seed-4|', doc_id)), doc_id) = 1
""")
def min_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.min_by_hash(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "seed-4", ["doc_id"])


@_query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
""")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 dearest orders: a top-k per task and one merge, no full sort."""
    return selection.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 25)


@_query("""
SELECT l_suppkey, round(-ln(count(*) FILTER (l_tax < 0.05) / count(*)::DOUBLE) / median(l_quantity), 9) AS hazard,
       round(median(l_extendedprice / greatest(1, l_quantity)), 6) AS median_ratio FROM lineitem GROUP BY l_suppkey
""")
def hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-ln(identity) per median length, and the median of per-row ratios."""
    out = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_tax") < 0.05).alias("k"), F.median("l_quantity").alias("length"),
        F.round(arrays.median_of_ratios("l_quantity", "l_extendedprice"), 6).alias("median_ratio"),
    )
    value = aggregates.hazard(F.col("k"), F.col("n"), F.col("length"))
    return out.select("l_suppkey", F.round(value, 9).alias("hazard"), "median_ratio")


@_query("""
SELECT o_orderkey, CASE WHEN p >= 0.001 THEN format('{:.3f}', p) ELSE concat(split_part(format('{:.1e}', p), 'e', 1), '×10^', CAST(CAST(split_part(format('{:.1e}', p), 'e', 2) AS INT) AS VARCHAR)) END AS shown,
       concat(format('{:.1f}', 100 * p), '%') AS share, concat(format('{:.2f}', big / 1073741824.0), ' GiB') AS size
FROM (SELECT o_orderkey, power(10.0, -(o_orderkey % 9)) * 0.7 AS p, o_custkey * 7919000::BIGINT AS big FROM orders)
""")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of small p values, shares and sizes."""
    p = F.pow(F.lit(10.0), -(F.col("o_orderkey") % 9)) * 0.7
    big = F.col("o_custkey") * F.lit(7919000).cast("bigint")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", tx.scientific(p).alias("shown"), tx.percent(p).alias("share"), tx.gibibytes(big).alias("size")
    )


@_query("""
SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN 'L' ELSE 'S' END || '-nocode' AS stratum,
       CAST(floor(length(text) / 3.5) AS BIGINT) AS tokens, CAST(floor(floor(length(text) / 3.5) / 1.3) AS BIGINT) AS words,
       concat('Pick one option and end with ''Answer: <letter>''.', chr(10), chr(10), text) AS prompt,
       sha256(concat('{"conv_id":', conv_id, ',"turn":', turn, '}')) AS row_sha256
FROM conversations WHERE text IS NOT NULL AND NOT contains(text, '```') AND NOT regexp_matches(text, '(?m)^\\s*(def|class|import|from)\\s')
""".replace("\\\\", "\\"))
def prompts_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered prompt, stratum, token and word estimates and the digest of a row's canonical JSON."""
    rows = table(spark, sf_dir, "conversations").where(
        "text IS NOT NULL AND NOT contains(text, '```')"
    ).where(~F.col("text").rlike(r"(?m)^\s*(def|class|import|from)\s"))
    tokens = tx.tokens_from_chars(F.char_length("text"))
    row = F.struct("turn", "conv_id")
    return rows.select(
        "conv_id", "turn", tx.stratum_key(F.char_length("text") > 200, "text").alias("stratum"), tokens.alias("tokens"),
        tx.words_from_tokens(tokens).alias("words"), tx.prompt("mmlu_500", "text").alias("prompt"),
        F.sha2(tx.canonical_json(row, ["turn", "conv_id"]).cast("binary"), 256).alias("row_sha256"),
    )


@_query("""
SELECT o_orderkey, CAST(1 AS INT) AS n, concat('is it ', o_orderstatus, '?') AS question, o_orderpriority AS answer FROM orders
UNION ALL SELECT o_orderkey, 2, 'and the clerk?', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 <> 0
""")
def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered questions and answers parsed from a reply; a question without its answer is no pair."""
    key, line = F.col("o_orderkey"), F.lit("\n")
    reply = F.concat(
        F.lit("Sure.\nQ1: is it "), "o_orderstatus", F.lit("?\nA1: "), "o_orderpriority", line, F.lit("Q2:  and the clerk? \n"),
        F.when(key % 3 != 0, F.concat(F.lit("A2: "), F.col("o_custkey").cast("string"))).otherwise(F.lit("A7: none")), line,
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(tx.question_pairs(reply)))


@_query("""
SELECT p_name, p_type, p_size FROM part WHERE NOT regexp_matches(p_name, 'ar|ed') AND p_size > 10
""")
def recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitelisted columns of the entries whose names hold none of the excluded parts."""
    rows = table(spark, sf_dir, "part").where("p_size > 10")
    return integrity.whitelist(rows.where(~F.col("p_name").rlike("ar|ed")), ["p_name", "p_type", "p_size"])


@_query("""
WITH r AS (SELECT conv_id, turn, max(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL), n AS (SELECT conv_id, count(*) AS n FROM r GROUP BY ALL)
SELECT conv_id, turn AS at, 'digest' AS finding FROM r WHERE conv_id % 5 = 0 AND turn = 1
UNION ALL SELECT conv_id, turn, 'link' FROM r WHERE conv_id % 7 = 0 AND turn = 2 AND NOT (conv_id % 5 = 0 AND turn = 1)
UNION ALL SELECT conv_id, n, 'torn' FROM n WHERE conv_id % 3 = 0
UNION ALL SELECT conv_id, n, 'head' FROM n WHERE conv_id % 3 = 1
""")
def log_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as hash-chained logs with planted faults: a changed payload, a broken link, a torn tail, a wrong head receipt."""
    from pairwright.sources.readers import verify_log

    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    rows = rows.withColumn("body", canonical_row(rows, ["conv_id", "turn", "text"]))

    class Faulty(folds.Chain):
        """A log whose writer forgets a link in some and writes a wrong checksum in others."""

        def step(self, at: int, told: str):
            conv = json.loads(told)["conv_id"]
            link = "gone" if conv % 7 == 0 and at == 2 else self.last
            self.last = "none" if conv % 5 == 0 and at == 1 else self.seal(link, told)
            return [(at, link, self.last)]

    chained = folds.chained_log(rows, ["conv_id"], "turn", "body", Faulty).withColumnRenamed("at", "turn")
    chained = chained.join(rows.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    count = chained.groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by("sum", "turn").alias("checksum"))
    heads = count.select("conv_id", (F.col("n") + (F.col("conv_id") % 3 == 0).cast("int")).alias("n"), F.when(F.col("conv_id") % 3 == 1, "other").otherwise(F.col("checksum")).alias("checksum"))
    return verify_log(chained, "conv_id", "turn", "link", "sum", ["conv_id", "turn", "text"], heads)


@_query("""
WITH e AS (SELECT user_id, event_type, value, epoch_us(ts) / 1000000.0 AS t FROM events),
r AS (SELECT DISTINCT user_id, t AS t0 FROM e WHERE event_type = 'purchase')
SELECT user_id, round(t0, 6) AS t0, count(*) AS idle_samples, round(avg(value), 6) AS idle_power FROM e JOIN r USING (user_id) WHERE t >= t0 - 43200 AND t < t0 GROUP BY user_id, r.t0
""")
def idle_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value in the half day before every purchase; stretches of one user overlap, and each keeps its own."""
    events = table(spark, sf_dir, "events").withColumn("t", timeseries.seconds("ts"))
    runs = events.where("event_type = 'purchase'").select("user_id", F.col("t").alias("t0")).distinct()
    out = claims.idle_power(events.select("user_id", "t", "value"), runs, ["user_id"], "t", "value", "t0", 43200)
    return out.select("user_id", F.round("t0", 6).alias("t0"), "idle_samples", F.round("idle_power", 6).alias("idle_power"))


@_query("""
WITH c AS (SELECT concat(user_id, ':', CAST(CAST(ts AS DATE) AS VARCHAR)) AS session, event_type FROM events),
s AS (SELECT session, count(*) FILTER (event_type = 'signup') AS registered, count(*) FILTER (event_type = 'view') AS intents,
             count(*) FILTER (event_type = 'purchase') AS responses FROM c GROUP BY session)
SELECT *, CASE WHEN registered = 0 THEN 'unknown' WHEN registered > 1 THEN 'repeated' WHEN intents = 0 THEN 'unused' ELSE 'sound' END AS finding
FROM s WHERE registered + intents + responses > 0
""")
def session_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users as sessions: sign-ups register them, views are intents, purchases responses."""
    events = table(spark, sf_dir, "events").withColumn("session", F.concat_ws(":", "user_id", F.to_date("ts").cast("string")))
    return claims.session_audit(*[events.where(F.col("event_type") == t) for t in ("signup", "view", "purchase")], "session")


@_query(r"""
WITH c AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, text, CAST(1 AS INTEGER) AS n, 'what stands at ' || turn || ' of it?' AS question, w[1] || ' ' || w[2] AS answer FROM c WHERE len(w) >= 3
      UNION ALL SELECT conv_id, turn, text, 2, 'and what comes then?', CASE conv_id % 3 WHEN 0 THEN upper(w[3]) || 'X' WHEN 1 THEN w[3] ELSE w[3] || ' nowhere at all' END FROM c WHERE len(w) >= 3)
SELECT conv_id, turn, n, question, answer FROM p
WHERE length(question) BETWEEN 13 AND 500 AND length(answer) BETWEEN 2 AND 80 AND len(string_split(answer, ' ')) <= 8 AND contains(text, answer)
""")
def verified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers of a reply that stand in the text they are about: short enough, and word for word."""
    # the first three words and what follows them
    words = F.filter(F.split(F.ltrim("text", F.lit(" \n")), r"[ \n]+", 4), lambda x: x != "")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("w", words).where(F.size("w") >= 3)
    one, two, third = [F.get("w", F.lit(i)) for i in range(3)]
    k = F.col("conv_id") % 3
    second = F.when(k == 0, F.concat(F.upper(third), F.lit("X"))).when(k == 1, third).otherwise(F.concat(third, F.lit(" nowhere at all")))
    # without a turn there is no first question, but the second one stays
    first = F.coalesce(F.concat(F.lit("what stands at "), F.col("turn").cast("string"), F.lit(" of it?")), F.lit(""))
    reply = F.concat(F.lit("Here.\nQ1: "), first, F.lit("\nA1:  "), one, F.lit(" "), two, F.lit("\nQ2 : and what comes then? \nA2: "), second)
    # words end at spaces and line ends alone, and may be nothing but marks, as in the SQL; a named column of pairs would be
    # made again for the filters that the optimizer infers from it, before the one on the number of words
    return rows.select("conv_id", "turn", F.inline(tx.verified_pairs(reply, F.col("text"), space=" \n", marks="")))
