"""Queries over paired outcomes: intervals, exact tests, families, clustered differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.statistics import Z975, fisher_p, wilson
from pairwright.operators import aggregates, clustered, pairing
from pairwright.session import table

_Z = repr(Z975)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    out = aggregates.cell_summary(events, ["event_type"], F.col("value") > 50, F.col("value"))
    return _rounded(out, 6, "accuracy", "mean_wall", "total_wall", "correct_per_minute", "accuracy_per_minute")


CELL_SUMMARY = """
SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS k,
       round(avg(CAST(value > 50 AS INT)), 6) AS accuracy, round(avg(value), 6) AS mean_wall,
       round(sum(value), 6) AS total_wall, round(60.0 * count(*) FILTER (value > 50) / sum(value), 6) AS correct_per_minute,
       round(avg(CAST(value > 50 AS INT)) / (avg(value) / 60.0), 6) AS accuracy_per_minute
FROM events GROUP BY event_type
"""


def weighted_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    out = rows.groupBy("l_returnflag").agg(
        aggregates.ratio_of_sums(price, qty).alias("price_per_unit"),
        aggregates.ratio_of_sums(qty, qty / (1 + F.col("l_tax"))).alias("token_weighted_rate"),
        aggregates.relative_change(price, price * (1 - F.col("l_discount"))).alias("change"),
    )
    return _rounded(out, 6, "price_per_unit", "token_weighted_rate", "change")


WEIGHTED_RATE = """
SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) AS price_per_unit,
       round(sum(l_quantity) / sum(l_quantity / (1 + l_tax)), 6) AS token_weighted_rate,
       round(avg(l_extendedprice * (1 - l_discount)) / avg(l_extendedprice) - 1, 6) AS change
FROM lineitem GROUP BY l_returnflag
"""


def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _labelled(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k")
    )
    out = counts.withColumn("w", wilson("k", "n")).withColumn("u", wilson("k", "n", 1.96, clamp=False))
    return out.select(
        "lang",
        "n",
        "k",
        F.round("w.low", 9).alias("low"),
        F.round("w.high", 9).alias("high"),
        F.round("u.low", 9).alias("low_196"),
        F.round("u.high", 9).alias("high_196"),
    )


def _wilson_sql(k: str, n: str, z: str, sign: str) -> str:
    return (
        f"(({k}) / ({n})::DOUBLE + {z} * {z} / (2 * ({n})) {sign} {z} * sqrt(({k}) / ({n})::DOUBLE * (1 - ({k}) / ({n})::DOUBLE)"
        f" / ({n}) + {z} * {z} / (4.0 * ({n}) * ({n})))) / (1 + {z} * {z} / ({n}))"
    )


WILSON = f"""
SELECT lang, n, k, round(greatest({_wilson_sql("k", "n", _Z, "-")}, 0), 9) AS low,
       round(least({_wilson_sql("k", "n", _Z, "+")}, 1), 9) AS high,
       round({_wilson_sql("k", "n", "1.96", "-")}, 9) AS low_196, round({_wilson_sql("k", "n", "1.96", "+")}, 9) AS high_196
FROM (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS k
      FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY lang)
"""


def paired_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity as two outcomes of one item, aligned by a strict one-to-one join."""
    labels = table(spark, sf_dir, "labels")
    a = labels.select("doc_id", (F.col("quality") == 1).alias("correct"))
    b = labels.select("doc_id", (F.col("toxic") == 1).alias("correct"))
    joined = pairing.strict_paired(a, b, "doc_id")
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return pairing.paired_counts(joined.join(langs, "doc_id"), F.col("correct_a"), F.col("correct_b"), ["lang"])


_TABLE = """
SELECT {by}, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS "both",
       count(*) FILTER (quality = 1 AND toxic <> 1) AS a_only, count(*) FILTER (quality <> 1 AND toxic = 1) AS b_only,
       count(*) FILTER (quality <> 1 AND toxic <> 1) AS neither
FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY {by}
"""
PAIRED_TABLE = _TABLE.format(by="lang")
_P = """least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda i:
        exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2)))))"""


def _compared(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return pairing.compare(pairing.paired_counts(rows, F.col("quality") == 1, F.col("toxic") == 1, [by]))


def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairing.holm(_compared(spark, sf_dir, "lang"), "p", "lang")
    doubles = "acc_a a_low a_high acc_b b_low b_high diff diff_low diff_high phi p p_holm holm_threshold".split()
    return _rounded(out, 8, *doubles).withColumn("holm_rank", F.col("holm_rank").cast("long"))


def _compare_sql(by: str) -> str:
    k_a, k_b = "both_ + a_only", "both_ + b_only"
    return f"""
t AS (SELECT {by}, n, "both" AS both_, a_only, b_only, neither FROM ({_TABLE.format(by=by)})),
w AS (SELECT *, ({k_a}) / n::DOUBLE AS acc_a, ({k_b}) / n::DOUBLE AS acc_b,
        greatest({_wilson_sql(k_a, "n", _Z, "-")}, 0) AS a_low, least({_wilson_sql(k_a, "n", _Z, "+")}, 1) AS a_high,
        greatest({_wilson_sql(k_b, "n", _Z, "-")}, 0) AS b_low, least({_wilson_sql(k_b, "n", _Z, "+")}, 1) AS b_high,
        CASE WHEN (both_ + a_only) * (b_only + neither) * (both_ + b_only) * (a_only + neither) > 0
             THEN (both_ * neither - a_only * b_only)
                  / sqrt((both_ + a_only)::DOUBLE * (b_only + neither) * (both_ + b_only) * (a_only + neither)) ELSE 0.0 END AS phi,
        {_P} AS p FROM t),
c AS (SELECT *, acc_a - acc_b AS diff,
        acc_a - acc_b - sqrt(greatest((acc_a - a_low) ** 2 - 2 * phi * (acc_a - a_low) * (b_high - acc_b) + (b_high - acc_b) ** 2, 0)) AS diff_low,
        acc_a - acc_b + sqrt(greatest((a_high - acc_a) ** 2 - 2 * phi * (a_high - acc_a) * (acc_b - b_low) + (acc_b - b_low) ** 2, 0)) AS diff_high
      FROM w),
h AS (SELECT *, row_number() OVER (ORDER BY p, {by}) AS holm_rank, count(*) OVER () AS m FROM c)
"""


PAIRED_COMPARE = f"""
WITH {_compare_sql("lang")}
SELECT lang, n, both_ AS "both", a_only, b_only, neither, round(acc_a, 8) AS acc_a, round(a_low, 8) AS a_low, round(a_high, 8) AS a_high,
       round(acc_b, 8) AS acc_b, round(b_low, 8) AS b_low, round(b_high, 8) AS b_high, round(diff, 8) AS diff,
       round(diff_low, 8) AS diff_low, round(diff_high, 8) AS diff_high, round(phi, 8) AS phi, round(p, 8) AS p, holm_rank,
       round(0.05 / (m - holm_rank + 1), 8) AS holm_threshold,
       round(max(least(1.0, (m - holm_rank + 1) * p)) OVER (ORDER BY holm_rank), 8) AS p_holm,
       bool_and(p <= 0.05 / (m - holm_rank + 1)) OVER (ORDER BY holm_rank) AS holm_reject
FROM h
"""


def holm_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairing.holm(_compared(spark, sf_dir, "source").select("source", "a_only", "b_only", "p"), "p", "source")
    return out.select(
        "source",
        "a_only",
        "b_only",
        F.round("p", 8).alias("p"),
        F.round("p_holm", 8).alias("p_holm"),
        F.col("holm_reject"),
    )


HOLM_FAMILY = f"""
WITH {_compare_sql("source")}
SELECT source, a_only, b_only, round(p, 8) AS p,
       round(max(least(1.0, (m - holm_rank + 1) * p)) OVER (ORDER BY holm_rank), 8) AS p_holm,
       bool_and(p <= 0.05 / (m - holm_rank + 1)) OVER (ORDER BY holm_rank) AS holm_reject
FROM h
"""


def fisher_two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    en, toxic = F.col("lang") == "en", F.col("toxic") == 1
    counts = rows.groupBy("quality").agg(
        F.count_if(en & toxic).alias("a"), F.count_if(en & ~toxic).alias("b"),
        F.count_if(~en & toxic).alias("c"), F.count_if(~en & ~toxic).alias("d"),
    )
    return counts.withColumn("p", F.round(fisher_p("a", "b", "c", "d"), 8))


FISHER = """
WITH t AS (
  SELECT quality, count(*) FILTER (lang = 'en' AND toxic = 1) AS a, count(*) FILTER (lang = 'en' AND toxic <> 1) AS b,
         count(*) FILTER (lang <> 'en' AND toxic = 1) AS c, count(*) FILTER (lang <> 'en' AND toxic <> 1) AS d
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality),
x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM t),
w AS (SELECT *, lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1)
             - lgamma(c + d - (a + c - i) + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) AS l FROM x),
o AS (SELECT quality, l AS here FROM w WHERE i = a)
SELECT quality, a, b, c, d, round(sum(exp(l)) FILTER (l <= here + 1e-9), 8) AS p
FROM w JOIN o USING (quality) GROUP BY quality, a, b, c, d
"""


def _contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    z = clustered.interaction(
        F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_returnflag") == "R"
    )
    return rows.select("l_suppkey", "l_linestatus", z.alias("z"))


def did_cr2(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = clustered.cluster_sums(_contrast(spark, sf_dir), F.col("z"), "l_suppkey", ["l_linestatus"])
    return _rounded(clustered.cr2(sums, ["l_linestatus"]), 9, "estimate", "variance", "df")


DID_CR2 = """
WITH z AS (
  SELECT l_linestatus, l_suppkey, CAST(l_quantity > 25 AS INT) - CAST(l_discount > 0.05 AS INT)
         - (CAST(l_tax > 0.04 AS INT) - CAST(l_returnflag = 'R' AS INT)) AS z FROM lineitem),
g AS (SELECT l_linestatus, l_suppkey, count(*) AS n_g, sum(z) AS s_g FROM z GROUP BY ALL),
t AS (SELECT *, sum(n_g) OVER (PARTITION BY l_linestatus) AS n, sum(s_g) OVER (PARTITION BY l_linestatus) AS s FROM g),
u AS (SELECT *, n_g / n::DOUBLE AS h, s_g - n_g * s / n::DOUBLE AS gap FROM t)
SELECT l_linestatus, CAST(n AS BIGINT) AS n, count(*) AS clusters, round(s / n::DOUBLE, 9) AS estimate,
       round(sum(gap * gap / (1 - h)) / (n::DOUBLE * n), 9) AS variance,
       round(1 / (sum(h * h) + sum(h * h / (1 - h)) ** 2 - sum((h * h / (1 - h)) ** 2)), 9) AS df
FROM u GROUP BY l_linestatus, n, s
"""


def did_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = clustered.cluster_sums(_contrast(spark, sf_dir), F.col("z"), "l_suppkey", ["l_linestatus"])
    fitted = clustered.inference(clustered.cr2(sums, ["l_linestatus"]))
    return fitted.join(clustered.sign_flip(sums, ["l_linestatus"]), "l_linestatus")


def did_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard error, t and its two-sided p of the contrast, by months of shipping, where some are far from certain."""
    rows = table(spark, sf_dir, "lineitem").withColumn("month", F.month("l_shipdate"))
    z = clustered.interaction(F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_quantity") > 26, F.col("l_discount") > 0.04)
    sums = clustered.cluster_sums(rows.withColumn("z", z), F.col("z"), "l_suppkey", ["month"])
    out = clustered.inference(clustered.cr2(sums, ["month"]))
    return _rounded(out.select("month", "se", "t", F.col("p_cr2").alias("p")), 7, "se", "t", "p")


#: The tail of Student's t by Simpson's rule over the angle whose tangent is t / sqrt(df).
DID_ERRORS = """
WITH z AS (
  SELECT month(l_shipdate) AS month, l_suppkey, CAST(l_quantity > 25 AS INT) - CAST(l_discount > 0.05 AS INT)
         - (CAST(l_quantity > 26 AS INT) - CAST(l_discount > 0.04 AS INT)) AS z FROM lineitem),
g AS (SELECT month, l_suppkey, count(*) AS n_g, sum(z) AS s_g FROM z GROUP BY ALL),
t AS (SELECT *, sum(n_g) OVER (PARTITION BY month) AS n, sum(s_g) OVER (PARTITION BY month) AS s FROM g),
u AS (SELECT *, n_g / n::DOUBLE AS h, s_g - n_g * s / n::DOUBLE AS gap FROM t),
f AS (SELECT month, s / n::DOUBLE AS estimate, sqrt(sum(gap * gap / (1 - h)) / (n::DOUBLE * n)) AS se,
             1 / (sum(h * h) + sum(h * h / (1 - h)) ** 2 - sum((h * h / (1 - h)) ** 2)) AS df FROM u GROUP BY month, n, s),
a AS (SELECT *, estimate / se AS t, atan(abs(estimate / se) / sqrt(df)) AS low, (pi() / 2 - atan(abs(estimate / se) / sqrt(df))) / 2000 AS step FROM f),
i AS (SELECT month, sum(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * greatest(cos(low + k * step), 0) ** (df - 1)) AS total
      FROM a, range(2001) r(k) GROUP BY month)
SELECT month, round(se, 7) AS se, round(t, 7) AS t,
       round(2 * total * step / 3 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()), 7) AS p FROM a JOIN i USING (month)
"""


def histogram_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = clustered.cluster_sums(_contrast(spark, sf_dir), F.col("z"), "l_suppkey")
    counted = clustered.histogram(sums)
    rebuilt = clustered.cr2(clustered.from_histogram(counted))
    cells = counted.agg(F.count("*").alias("cells"), F.max("multiplicity").alias("most"))
    out = rebuilt.withColumn("_k", F.lit(0)).join(cells.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return _rounded(out, 9, "estimate", "variance", "df")


HISTOGRAM = """
WITH z AS (
  SELECT l_suppkey, CAST(l_quantity > 25 AS INT) - CAST(l_discount > 0.05 AS INT)
         - (CAST(l_tax > 0.04 AS INT) - CAST(l_returnflag = 'R' AS INT)) AS z FROM lineitem),
g AS (SELECT l_suppkey, count(*) AS n_g, sum(z) AS s_g FROM z GROUP BY ALL),
t AS (SELECT *, sum(n_g) OVER () AS n, sum(s_g) OVER () AS s FROM g),
u AS (SELECT *, n_g / n::DOUBLE AS h, s_g - n_g * s / n::DOUBLE AS gap FROM t),
m AS (SELECT count(*) AS c FROM g GROUP BY n_g, s_g)
SELECT CAST(n AS BIGINT) AS n, count(*) AS clusters, round(s / n::DOUBLE, 9) AS estimate,
       round(sum(gap * gap / (1 - h)) / (n::DOUBLE * n), 9) AS variance,
       round(1 / (sum(h * h) + sum(h * h / (1 - h)) ** 2 - sum((h * h / (1 - h)) ** 2)), 9) AS df,
       (SELECT count(*) FROM m) AS cells, (SELECT max(c) FROM m) AS most
FROM u GROUP BY n, s
"""

QUERIES = {
    "cell_summary": cell_summary,
    "weighted_rate": weighted_rate,
    "wilson_by_group": wilson_by_group,
    "paired_table": paired_table,
    "paired_compare": paired_compare,
    "holm_family": holm_family,
    "fisher_two_groups": fisher_two_groups,
    "did_errors": did_errors,
    "did_cr2": did_cr2,
    "did_inference": did_inference,
    "histogram_roundtrip": histogram_roundtrip,
}
ORACLE_SQL = {
    "cell_summary": CELL_SUMMARY,
    "weighted_rate": WEIGHTED_RATE,
    "wilson_by_group": WILSON,
    "paired_table": PAIRED_TABLE,
    "paired_compare": PAIRED_COMPARE,
    "holm_family": HOLM_FAMILY,
    "fisher_two_groups": FISHER,
    "did_errors": DID_ERRORS,
    "did_cr2": DID_CR2,
    "histogram_roundtrip": HISTOGRAM,
}
