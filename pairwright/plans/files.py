"""Queries over files that are written from the tables and read back: lines with positions, tensor containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.canonical import canonical_row
from pairwright.session import scratch, table
from pairwright.sources import container, lines, readers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PER_FILE = 100_000


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


@_query(f"""
WITH d AS (SELECT doc_id, n_chars, doc_id // {PER_FILE} AS part FROM documents)
SELECT CAST(part AS BIGINT) AS part, doc_id % 37 = 5 AS bad, CASE WHEN doc_id % 37 <> 5 THEN doc_id END AS doc_id, CASE WHEN doc_id % 37 <> 5 THEN n_chars END AS n_chars,
       CAST(1 + coalesce(sum(CASE WHEN doc_id % 50 = 7 THEN 2 ELSE 1 END) OVER (PARTITION BY part ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no
FROM d
""")
def json_line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON Lines with cut and blank lines among them, read back with positions: what is bad, and where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    line = canonical_row(docs, ["doc_id", "n_chars", "text"])
    rows = docs.select(F.floor(F.col("doc_id") / PER_FILE).alias("part"), "doc_id", line.alias("line"))
    cut = F.when(F.col("doc_id") % 37 == 5, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    # a blank line follows some
    value = F.concat(cut, F.when(F.col("doc_id") % 50 == 7, "\n").otherwise(""))
    place = scratch(spark, "lines")
    rows = rows.select("part", "doc_id", value.alias("value")).repartition("part").sortWithinPartitions("part", "doc_id")
    rows.select("part", "value").write.partitionBy("part").text(f"{place}/rows")
    found = lines.checked_rows(readers.read_lines(spark, f"{place}/rows/*"), "doc_id BIGINT, n_chars BIGINT", fail=False)
    sound = ~F.col("bad")
    return found.select(
        F.regexp_extract("file", r"part=(\d+)/", 1).cast("bigint").alias("part"),
        "line_no",
        "bad",
        F.when(sound, F.col("row.doc_id")).alias("doc_id"),
        F.when(sound, F.col("row.n_chars")).cast("bigint").alias("n_chars"),
    )


@_query("""
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, CAST(4 * len(embedding) AS BIGINT) AS bytes, 'f32' AS type FROM embeddings
""")
def container_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tensors in container files; their headers, read without the data."""
    rows = table(spark, sf_dir, "embeddings")
    place = scratch(spark, "tensors")
    container.write_tensors(rows.select(F.concat(F.lit("v"), "vec_id").alias("name"), F.col("embedding").cast("array<float>").alias("values")), f"{place}/files")
    found = container.read_headers(spark, f"{place}/files").where("kind = 'tensor'")
    return found.select(F.substring("name", 2, 20).cast("bigint").alias("vec_id"), F.col("dims")[0].alias("dim"), "bytes", "type")
