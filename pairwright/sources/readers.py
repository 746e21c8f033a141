"""Readers: outcome rows, strict JSON Lines, path labels, logs, manifests, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import checked_rows, line_numbers, matches, numbered

#: DDL of the rows that evaluation runs write.
OUTCOME = (
    "id STRING, correct BOOLEAN, errored BOOLEAN, truncated BOOLEAN, completion_tokens BIGINT, "
    "thinking_tokens_estimate BIGINT, wall_s DOUBLE"
)
OUTCOME_HASHED = OUTCOME + (", content_sha256 STRING, final_answer_sha256 STRING")
SUMMARY = (
    "label STRING, suite STRING, n BIGINT, accuracy DOUBLE, mean_wall_s DOUBLE, total_wall_s DOUBLE, "
    "mean_completion_tokens DOUBLE, accuracy_per_minute DOUBLE, reasoning_effort STRING, partial BOOLEAN, ts STRING"
)
GRID_CELLS = (
    "corpus STRING, deployment STRING, condition STRING, n INT, correct_exact INT, accuracy DOUBLE, wilson_low DOUBLE, "
    "wilson_high DOUBLE, paired_cost_vs_original DOUBLE, paired_cost_low DOUBLE, paired_cost_high DOUBLE, "
    "mcnemar_p DOUBLE, mean_request_s DOUBLE, correct_per_minute DOUBLE"
)
TELEMETRY = (
    "t DOUBLE, power_w DOUBLE, sm_mhz BIGINT, mem_mhz BIGINT, gpu_c BIGINT, util BIGINT, mem_mib BIGINT, throttle STRING, cpu_c DOUBLE"
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON Lines under an explicit schema; blank lines are skipped, a bad line fails the query if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def bad_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Lines that don't parse, or aren't objects, with their file and position in it (from 1)."""
    return checked_rows(read_lines(spark, path), schema, fail=False).where("bad").select("file", "line_no", "line")


def read_objects(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """file, line_no and the columns of each line's object; the first line that isn't one fails the query, with its file and number."""
    rows = checked_rows(read_lines(spark, path), schema, fail=True)
    return rows.where(~F.col("bad")).select("file", "line_no", "row.*")


def read_lines(spark: SparkSession, path: str | list[str], keep_blank: bool = False) -> DataFrame:
    """file, line_no (from 1), line. Positions are those in the file, however it is split."""
    return line_numbers(spark, path, keep_blank)


def read_slice(spark: SparkSession, path: str | list[str], schema: str, low: int, high: int) -> DataFrame:
    """Objects ``low`` to ``high`` (from 0, end exclusive, blank lines not counted) of each JSON Lines file, with file and pos."""
    rows = numbered(spark, path, "pos", keep_blank=False).withColumn("pos", F.col("pos") - 1)
    rows = rows.where((F.col("pos") >= low) & (F.col("pos") < high))
    return rows.select("file", "pos", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("_row")).select("file", "pos", "_row.*")


def path_part(path: Column, from_end: int) -> Column:
    """A part of a path counted from its end: 1 is the file name, 2 its folder."""
    return F.element_at(F.split(path, "/"), -from_end)


def of_suite(rows: DataFrame, suite: str) -> DataFrame:
    """Rows of one suite where rows name theirs; all rows of a table that has no such column."""
    return rows.where(F.col("suite") == suite) if "suite" in rows.columns else rows


def read_outcomes(spark: SparkSession, path: str | list[str], schema: str = OUTCOME) -> DataFrame:
    """Outcome rows of ``<label>/<suite>.jsonl`` files, with label, suite and pos (row order within the file)."""
    rows = numbered(spark, path, "_no", keep_blank=False).withColumn("_row", F.from_json("line", schema, {"mode": "FAILFAST"}))
    return rows.select(
        path_part(F.col("file"), 2).alias("label"),
        F.regexp_replace(path_part(F.col("file"), 1), r"\.jsonl$", "").alias("suite"),
        (F.col("_no") - 1).alias("pos"),
        "_row.*",
    )


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A whole JSON document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def manifest_items(document: DataFrame, array: str) -> DataFrame:
    """The structs of an array as rows."""
    return document.select(F.inline(array))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under an explicit schema; blank fields are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_first_rows(spark: SparkSession, path: str, columns: list[str], n: int) -> DataFrame:
    """Pruned columns of each Parquet file's first ``n`` rows, by position rather than by whichever come first."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.row_index").alias("pos")).where(F.col("pos") < n)


def generation_rates(spark: SparkSession, path: str) -> DataFrame:
    """tokens, seconds and rate of each generation in engine logs; line breaks inside a message count as spaces."""
    long_form = r"([0-9]+) tokens generated in ([0-9.]+) seconds \(Generate: ([0-9.]+) T/s"
    short_form = r"eval time = *([0-9.]+) ms / *([0-9]+) (?:tokens|runs)"
    long_rows = matches(spark, path, long_form, 9).select(
        "file", "pos",
        F.regexp_extract("m", long_form, 1).cast("long").alias("tokens"),
        F.regexp_extract("m", long_form, 2).cast("double").alias("seconds"),
        F.regexp_extract("m", long_form, 3).cast("double").alias("rate"),
    )
    short_rows = matches(spark, path, short_form, 8, unless_after="prompt").select(
        "file", "pos",
        F.regexp_extract("m", short_form, 2).cast("long").alias("tokens"),
        (F.regexp_extract("m", short_form, 1).cast("double") / 1000).alias("seconds"),
    )
    return long_rows.unionByName(short_rows.withColumn("rate", F.try_divide("tokens", "seconds")))


def metrics_lines(lines: DataFrame, patterns: dict[str, str], line: str = "line") -> DataFrame:
    """One double column per named pattern (its first group, thousands commas dropped); null where it doesn't occur."""
    found = {
        name: F.regexp_replace(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")), ",", "").try_cast("double")
        for name, pattern in patterns.items()
    }
    return lines.withColumns(found)


def last_per_key(lines: DataFrame, pattern: str, key_group: int, value_group: int, line: str = "line") -> DataFrame:
    """key -> last value (by file order) of lines that match a pattern."""
    hits = lines.where(F.col(line).rlike(pattern)).select(
        "file", "line_no", F.regexp_extract(line, pattern, key_group).alias("key"), F.regexp_extract(line, pattern, value_group).alias("value")
    )
    return hits.groupBy("file", "key").agg(F.max_by("value", "line_no").alias("value"))


def first_match(lines: DataFrame, pattern: str, value_group: int = 1, line: str = "line") -> DataFrame:
    """Per file the value of the first line (by file order) that matches a pattern."""
    hits = lines.where(F.col(line).rlike(pattern)).select("file", "line_no", F.regexp_extract(line, pattern, value_group).alias("value"))
    return hits.groupBy("file").agg(F.min_by("value", "line_no").alias("value"))


def verify_log(rows: DataFrame, log: str, order: str, previous: str, checksum: str, payload: list[str], heads: DataFrame) -> DataFrame:
    """Findings of hash-chained logs: ``digest`` (the checksum isn't that of the previous one and the payload), ``link`` (previous
    isn't the row before's checksum), and per log ``torn`` (fewer rows than its head receipt, columns log, n, checksum, says) or
    ``head`` (the last checksum isn't the receipt's). Sound logs give no row."""
    from pairwright.functions.canonical import canonical_row

    body = F.concat(F.col(previous), F.lit("\n"), canonical_row(rows, payload))
    w = Window.partitionBy(log).orderBy(order)
    marked = rows.withColumn("_digest", F.sha2(body.cast("binary"), 256)).withColumn("_before", F.coalesce(F.lag(checksum).over(w), F.lit("")))
    # a wiped checksum or link is a finding, too
    finding = F.when(~F.col(checksum).eqNullSafe(F.col("_digest")), "digest").when(~F.col(previous).eqNullSafe(F.col("_before")), "link")
    bad = marked.select(log, F.col(order).cast("long").alias("at"), finding.alias("finding")).where("finding IS NOT NULL")
    ends = rows.groupBy(log).agg(F.count("*").alias("_n"), F.max_by(checksum, order).alias("_last"))
    told = heads.select(F.col(log), F.col("n").alias("_told"), F.col("checksum").alias("_head"))
    held = F.coalesce("_n", F.lit(0).cast("long"))
    state = F.when(held < F.col("_told"), "torn").when(~F.col("_last").eqNullSafe(F.col("_head")), "head")
    tails = ends.join(told, log, "full_outer").select(log, held.alias("at"), state.alias("finding")).where("finding IS NOT NULL")
    return bad.unionByName(tails)


def sole_value(lines: DataFrame, pattern: str, line: str = "line") -> DataFrame:
    """Per file the one distinct value of a pattern's first group, null if there are none or several."""
    hits = lines.where(F.col(line).rlike(pattern)).select("file", F.regexp_extract(line, pattern, 1).alias("value"))
    sums = hits.groupBy("file").agg(F.count_distinct("value").alias("n_values"), F.min("value").alias("value"))
    return sums.select("file", "n_values", F.when(F.col("n_values") == 1, F.col("value")).alias("value"))


def file_digests(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """path (after ``root``), bytes and sha-256 of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    place = F.regexp_replace("path", "^file:/+", "/")
    place = F.substring_index(place, root, -1) if root else place
    return files.select(place.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def by_kind(events: DataFrame, discriminator: str) -> dict[str, DataFrame]:
    """One view per value of a discriminator column, each with just the columns that it fills."""
    from pairwright.operators.integrity import filled_columns

    kinds = [r[0] for r in events.select(discriminator).where(F.col(discriminator).isNotNull()).distinct().collect()]
    return {kind: filled_columns(events.where(F.col(discriminator) == kind)) for kind in sorted(kinds)}
