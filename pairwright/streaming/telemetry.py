"""Structured Streaming forms of the telemetry operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_table(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tumbling_counts(events: DataFrame, ts: str, by: list[str], width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Count and mean value per event-time window; rows later than the watermark are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", width), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "mean_value")


def running_accuracy(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts and accuracy so far; for update or complete mode."""
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("correct").alias("k"), F.avg(F.col("correct").cast("int")).alias("accuracy")
    )


def hot_streaks(samples: DataFrame, key: str, order: str, value: str, limit: float, need: int) -> DataFrame:
    """Emits a row when a key has had ``need`` values in a row over ``limit``; the streak lives in keyed state.

    Rows of one batch are taken in ``order``; batches follow one another.
    """
    schema = f"{key} bigint, at double, streak int"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("_order", kind="stable")
        out = []
        for at, over in zip(rows["_order"], rows["_value"] > limit):
            streak = streak + 1 if over else 0
            if streak == need:
                out.append((k[0], float(at), streak))
        state.update((streak,))
        yield pd.DataFrame(out, columns=[key, "at", "streak"])

    plain = samples.select(F.col(key).cast("bigint").alias(key), F.col(order).alias("_order"), F.col(value).alias("_value"))
    return plain.groupBy(key).applyInPandasWithState(step, schema, "streak int", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs all data that is there now into an in-memory table (bounded results only) and returns it."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_updates(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Runs all data that is there now in update mode; each batch's changed rows are one folder of Parquet, written over if the
    batch is replayed. Returns the last row of each key, so neither a sink in memory nor the driver holds the result."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/_batch={batch}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends results exactly once to Parquet; a rerun resumes from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append"
    ).trigger(availableNow=True).start().awaitTermination()
