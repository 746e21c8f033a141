"""Lines of text files with their positions, where files are split among tasks.

Spark cuts a file into splits and hands each line to the split in which it begins. Within a split
lines keep their order, so a line's number is its place in the split and the number of lines in
the splits before. The second comes from prefix sums over splits, one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits (one row of three numbers and a path each) up to which their table travels to all tasks.
MOST_SPLITS = 1 << 17
#: Lines whose text is searched together for records that run over line ends.
CHUNK_LINES = 2000


def _scan(spark: SparkSession, path: str | list[str], keep_blank: bool) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    line = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), line.alias("line"))
    return rows if keep_blank else rows.where(F.trim("line") != "")


def numbered(spark: SparkSession, path: str | list[str], number: str = "line_no", keep_blank: bool = True) -> DataFrame:
    """file, ``number`` (from 1) and line; only lines that aren't blank count and come unless ``keep_blank``.

    Both readings of the files are parts of one plan, so they see the same splits in the same tasks.
    """
    rows = _scan(spark, path, keep_blank).withColumn("_id", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    splits = splits.select("file", "_start", shift.alias("_shift"))
    few = len(rows.inputFiles()) + rows.rdd.getNumPartitions() <= MOST_SPLITS
    met = rows.join(F.broadcast(splits) if few else splits, ["file", "_start"])
    return met.select("file", (F.col("_id") + F.col("_shift")).alias(number), "line")


def line_numbers(spark: SparkSession, path: str | list[str], keep_blank: bool = False) -> DataFrame:
    """file, line_no (from 1, blank lines count) and line."""
    rows = numbered(spark, path)
    return rows if keep_blank else rows.where(F.trim("line") != "")


def matches(spark: SparkSession, path: str | list[str], pattern: str, most_lines: int, unless_after: str | None = None) -> DataFrame:
    """file, pos (from 0) and m: matches of ``pattern`` in files whose white space, line ends among it, counts as single spaces.

    A match runs over ``most_lines`` lines that aren't blank at most, which a pattern of so many words bounds. It doesn't count where
    the word ``unless_after`` stands before it. Lines are put together in chunks with the lines behind them, so a
    file of any size is spread over tasks; a match belongs to the chunk in which it begins.
    """
    if most_lines >= CHUNK_LINES:
        raise ValueError(f"a match runs over fewer than {CHUNK_LINES} lines")
    rows = numbered(spark, path, "n", keep_blank=False).withColumn("n", F.col("n") - 1)
    chunk, place = F.floor(F.col("n") / CHUNK_LINES), F.col("n") % CHUNK_LINES
    own = F.array(F.struct(chunk.alias("chunk"), F.lit(0).alias("side")))
    tail = F.when((place < most_lines) & (chunk > 0), F.array(F.struct((chunk - 1).alias("chunk"), F.lit(1).alias("side"))))
    head = F.when(place == CHUNK_LINES - 1, F.array(F.struct((chunk + 1).alias("chunk"), F.lit(-1).alias("side"))))
    none = F.array_remove(own, own[0])
    rows = rows.select("file", "n", "line", F.explode(F.concat(own, F.coalesce(tail, none), F.coalesce(head, none))).alias("to"))

    def joined(side: int) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("to.side") == side, F.struct("n", "line"))))
        return F.trim(F.regexp_replace(F.array_join(F.transform(held, lambda x: x["line"]), " "), r"\s+", " "))

    parts = rows.groupBy("file", "to.chunk").agg(joined(0).alias("own"), joined(1).alias("tail"), joined(-1).alias("head")).where("own <> ''")
    search = F.lit(pattern if unless_after is None else f"(?<!{unless_after} ){pattern}")
    # what stands before a chunk matters only as the word after which nothing counts
    bare = F.lit("") if unless_after is None else F.when(F.col("head").rlike(f"{unless_after}$"), f"{unless_after} ").otherwise("")
    edge = F.lit("") if unless_after is None else F.when(F.col("own").rlike(f"{unless_after}$"), f"{unless_after} ").otherwise("")
    every = F.regexp_extract_all(F.concat(bare, F.col("own"), F.lit(" "), F.col("tail")), search, F.lit(0))
    behind = F.size(F.regexp_extract_all(F.concat(edge, F.col("tail")), search, F.lit(0)))
    parts = parts.select("file", "chunk", every.alias("m"), behind.alias("behind"))
    parts = parts.select("file", "chunk", F.slice("m", 1, F.greatest(F.size("m") - F.col("behind"), F.lit(0))).alias("m")).where("size(m) > 0")
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum(F.size("m")).over(before), F.lit(0)))
    return parts.select("file", "_base", F.posexplode("m").alias("_i", "m")).select("file", (F.col("_base") + F.col("_i")).alias("pos"), "m")


def checked_rows(lines: DataFrame, schema: str, fail: bool) -> DataFrame:
    """file, line_no, line, row (parsed by ``schema``) and bad; with ``fail`` a bad line ends the query with its file and number."""
    parsed = F.from_json("line", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("row", parsed)
    bad = F.coalesce(F.col("row._bad").isNotNull() | F.col("row").isNull() | ~F.startswith(F.ltrim("line"), F.lit("{")), F.lit(True))
    if fail:
        told = F.raise_error(F.concat(F.lit("malformed line "), F.col("file"), F.lit(":"), F.col("line_no").cast("string")))
        bad = F.when(bad, told.cast("boolean")).otherwise(False)
    return rows.select("file", "line_no", "line", F.col("row").dropFields("_bad").alias("row"), bad.alias("bad"))
