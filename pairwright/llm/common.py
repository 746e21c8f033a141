"""Helpers of the corpus operators: bounded Arrow chunks, checkpoints, label samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 20


def shared_folder(df: DataFrame) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where neither that setting nor a context-level folder exists is one set: a temporary
    folder in a local session; elsewhere that would be a folder of one machine, so it is an error.
    """
    context = df.sparkSession.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pairwright-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Let the context cleaner drop shuffle files of finished phases whose plans are out of scope.

    It does so when the driver collects garbage, which may be long after the
    disks of the executors are full.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``text``, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    group = (np.cumsum(lengths) - lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        if stop > start:
            yield batch.slice(start, stop - start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    return pc.fill_null(batch.column(text).cast(pa.binary()), b"").to_pylist()


def trim() -> None:
    """Give freed memory of this worker back to the system: it stays alive, idle, while other stages need the machine's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call outside glibc
        pass


def map_chunks(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: str | StructType,
    text: str = "text",
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """``mapInArrow`` in chunks of bounded text; ``make`` runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in slices(batch, text, limit):
                if (out := work(piece)) is not None:
                    yield out
        del work
        trim()

    return df.mapInArrow(run, schema)


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that run in here pass at most ``rows`` rows at once to Python: rows of megabytes would pile up otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def extend(schema: StructType, ddl: str) -> StructType:
    """``schema`` with the fields of a DDL string after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, modulus: int = 5, id_col: str = "doc_id"
) -> DataFrame:
    """At most ``limit`` labelled, not held-out ids with their texts: columns id, text, label.

    Ids are taken in hash order, so the sample is the same on every run. Only
    the ids are broadcast: ``limit`` rows of two numbers, a fixed bound.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, modulus) != 0))
        .groupBy(F.col(id_col).alias("sample_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("sample_id"), "sample_id")
        .limit(limit)
    )
    rows = docs.select(F.col(id_col).alias("sample_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "sample_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (the last one is the offset) by Newton's method; ``y`` may be shares."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))


def written(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back by the columns that are needed.

    ``group_rows`` is for rows of megabytes: writers and readers hold so many of them at once, not a whole file.
    What nobody discards, as a result still to be read needs it, goes when the driver's JVM ends.
    """
    path = f"{shared_folder(df)}/table-{uuid.uuid4().hex}"
    options = {} if group_rows is None else {"parquet.block.row.count.limit": group_rows, "parquet.page.size.row.check.min": 1}
    df.write.options(**options).parquet(path)
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(folder)
    table = df.sparkSession.read.parquet(path)
    table.written_path = path
    return table


def ordered(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``in`` (a struct of all columns of ``docs``), text, and seq: a long that differs for each row and follows the id's order.

    A null id comes first; rows of the same id follow one another in no particular order. Where ids are whole numbers and none
    is null or repeats, seq is the id; otherwise rows are written with a number, and the sorted ids give it its place.
    """
    rows = docs.select(F.struct("*").alias("in"), F.col(text).alias("text"))
    key = F.col(f"in.`{id_col}`")
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        odd = docs.groupBy(F.col(id_col).alias("key")).agg(F.count("*").alias("n")).where("n > 1 OR key IS NULL")
        if odd.isEmpty():
            return rows.withColumn("seq", key.cast("long"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    placed = rows.select(key.alias("key"), "row").orderBy(F.col("key").asc_nulls_first(), "row")
    # partitions of a sorted table are in order, and so are these numbers
    placed = written(placed.select(F.col("row").alias("placed"), F.monotonically_increasing_id().alias("seq")))
    return rows.join(placed, F.col("row") == F.col("placed")).select("in", "text", "seq")


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that no plan still to run reads."""
    for table in tables:
        if path := getattr(table, "written_path", None):
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
