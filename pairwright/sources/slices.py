"""The first rows of Parquet files in batches, by position, from just the row groups that hold them.

Footers are read in tasks and tell where each row group begins. A row group is one unit of work: it is read with the columns that
are asked for, in record batches, so a task holds one batch, however large the group. Row groups behind the last row
that is asked for aren't opened. Files are reached through Arrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .container import file_system

PLACES = "file string, pos bigint, batch_no bigint"
GROUPS = "file string, row_group int, first bigint, n bigint"


def row_groups(spark: SparkSession, path: str | list[str], most: int | None = None) -> DataFrame:
    """file, row_group, first (position of its first row in the file) and n; only groups that begin before row ``most``."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, place = file_system(name)
                with system.open_input_file(place) as stream:
                    told = pq.ParquetFile(stream).metadata
                    sizes = [told.row_group(i).num_rows for i in range(told.num_row_groups)]
                starts = [0, *accumulate(sizes)]
                rows = [(name, i, s, n) for i, (s, n) in enumerate(zip(starts, sizes)) if most is None or s < most]
                columns = [list(c) for c in zip(*rows)] or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["file", "row_group", "first", "n"]
                )

    return files.mapInArrow(work, GROUPS)


def read_batches(
    spark: SparkSession, path: str | list[str], columns: list[str], rows: int, size: int = 256, exact: bool = False, tasks: int | None = None
) -> DataFrame:
    """file, pos (from 0), batch_no (``size`` rows each) and ``columns`` of each file's first ``rows`` rows.

    ``exact`` fails if a file has fewer. Row groups are dealt out to ``tasks`` tasks, four a core where nothing is said.
    """
    kinds = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(*columns).schema
    schema = StructType([*StructType.fromDDL(PLACES).fields, *kinds.fields])
    if len({f.name.lower() for f in schema.fields}) < len(schema.fields):
        raise ValueError("columns are named apart from file, pos and batch_no, and once each")
    groups = row_groups(spark, path, rows)
    if exact:
        short = groups.groupBy("file").agg(F.sum("n").alias("n")).where(F.col("n") < rows).limit(1).collect()
        if short:
            raise ValueError(f"{rows} rows asked for; {short[0].file} has {short[0].n}")
    target = to_arrow_schema(kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.to_pylist():
                system, place = file_system(group["file"])
                with system.open_input_file(place) as stream:
                    yield from _pieces(pq.ParquetFile(stream), group, columns, target, rows, size)

    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    return groups.repartition(tasks, "file", "row_group").mapInArrow(work, schema)


def _pieces(file: pq.ParquetFile, group: dict, columns: list[str], target: pa.Schema, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of one row group with their positions, cut behind the last row that is asked for."""
    at = group["first"]
    for batch in file.iter_batches(batch_size=size, row_groups=[group["row_group"]], columns=columns):
        batch = batch.slice(0, max(0, rows - at))
        if not batch.num_rows:
            return
        pos = pa.array(range(at, at + batch.num_rows), pa.int64())
        number = pa.array([p // size for p in range(at, at + batch.num_rows)], pa.int64())
        held = pa.Table.from_batches([batch]).select(columns).cast(target).combine_chunks().to_batches()[0]
        name = pa.array([group["file"]] * batch.num_rows, pa.string())
        yield pa.RecordBatch.from_arrays([name, pos, number, *held.columns], ["file", "pos", "batch_no", *columns])
        at += batch.num_rows
