"""A journal of micro-batches: each is there whole or not at all, and can't be changed unseen.

A batch's rows go to a folder of its number; then a receipt with their count and digest, chained to the receipt before, is put
in place by a rename. Readers see batches that have a receipt. A writer that dies before the receipt
leaves a torn tail, which ``recover`` moves aside; the stream then sends the batch again, which writes it once. A batch that comes
again after its receipt is left as it is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.functions.canonical import canonical_row


@dataclass(frozen=True)
class Receipt:
    batch: int
    n: int
    digest: str
    previous: str

    @property
    def seal(self) -> str:
        return hashlib.sha256(f"{self.previous}\n{self.batch}\n{self.n}\n{self.digest}".encode()).hexdigest()


class Journal:
    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark._jvm
        self._fs = self._place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _folder(self, batch: int) -> str:
        return f"rows/batch-{batch:012d}"

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _digest(self, rows: DataFrame) -> tuple[int, str]:
        """Count, and a digest that doesn't depend on order: sums of two hashes of each row's canonical JSON, as 128 bits."""
        shown = canonical_row(rows, self.schema.fieldNames())
        parts = [F.coalesce(F.sum(F.xxhash64(shown, F.lit(k)).cast("decimal(20,0)")), F.lit(0)) for k in (1, 2)]
        n, *sums = rows.agg(F.count("*"), *parts).first()
        return n, "".join(f"{int(s) % (1 << 64):016x}" for s in sums)

    def receipts(self) -> list[Receipt]:
        names = [n for n in self._names("receipts") if n.endswith(".json")]
        if not names:
            return []
        told = self.spark.read.text(f"{self.path}/receipts", pathGlobFilter="*.json", wholetext=True).collect()
        return sorted((Receipt(**json.loads(r.value)) for r in told), key=lambda r: r.batch)

    def write(self, rows: DataFrame, batch: int, before_receipt: Callable[[], None] | None = None) -> None:
        """The sink's function. ``before_receipt`` is called between rows and receipt, to try what a crash there does."""
        held = self.receipts()
        if held and held[-1].batch >= batch:
            return
        place = f"{self.path}/{self._folder(batch)}"
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(place)
        n, digest = self._digest(self.spark.read.schema(self.schema).parquet(place))
        if before_receipt is not None:
            before_receipt()
        receipt = Receipt(batch, n, digest, held[-1].seal if held else "")
        self._fs.mkdirs(self._place("receipts"))
        draft = self._place(f"receipts/_draft-{batch:012d}")
        out = self._fs.create(draft, True)
        out.write(json.dumps(receipt.__dict__, sort_keys=True).encode())
        out.close()
        if not self._fs.rename(draft, self._place(f"receipts/{batch:012d}.json")):
            raise RuntimeError(f"batch {batch} has a receipt already")

    def recover(self) -> list[int]:
        """Moves rows without a receipt to ``torn``, and returns their batches."""
        held = {r.batch for r in self.receipts()}
        torn = [b for b in (int(n.rpartition("-")[2]) for n in self._names("rows")) if b not in held]
        self._fs.mkdirs(self._place("torn"))
        for batch in torn:
            n = len(self._names("torn"))
            self._fs.rename(self._place(self._folder(batch)), self._place(f"torn/{n:06d}-batch-{batch:012d}"))
        return torn

    def read(self) -> DataFrame:
        """Rows of all batches with a receipt."""
        places = [f"{self.path}/{self._folder(r.batch)}" for r in self.receipts()]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def verify(self) -> list[tuple[int, str]]:
        """Findings (batch, what): link, missing, count, digest, or torn (rows without a receipt). A sound journal has none."""
        found, previous, held = [], "", self.receipts()
        for r in held:
            if r.previous != previous:
                found.append((r.batch, "link"))
            previous = r.seal
            if not self._fs.exists(self._place(self._folder(r.batch))):
                found.append((r.batch, "missing"))
                continue
            n, digest = self._digest(self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._folder(r.batch)}"))
            found += [(r.batch, "count")] if n != r.n else [(r.batch, "digest")] if digest != r.digest else []
        known = {r.batch for r in held}
        return found + [(b, "torn") for b in (int(n.rpartition("-")[2]) for n in self._names("rows")) if b not in known]


def stream_into(stream: DataFrame, journal: Journal, checkpoint: str, before_receipt: Callable[[int], None] | None = None) -> None:
    """Runs what is there now into the journal; after a crash, run again with the same checkpoint."""
    journal.recover()

    def write(rows: DataFrame, batch: int) -> None:
        journal.write(rows, batch, None if before_receipt is None else lambda: before_receipt(batch))

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def quarantine(rows: DataFrame, key: list[str], intent, terminal) -> DataFrame:
    """Keys that have an intent and no terminal: what was under way when the writer died. It must not be sent again unseen."""
    marks = rows.groupBy(*key).agg(F.count_if(intent).alias("n_intents"), F.count_if(terminal).alias("_ends"))
    return marks.where("n_intents > 0 AND _ends = 0").drop("_ends")


def still_due(planned: DataFrame, rows: DataFrame, key: list[str], intent, terminal) -> DataFrame:
    """Planned keys that neither ended nor are in quarantine: what a resumed run may start."""
    begun = rows.where(intent | terminal).select(*key)
    return planned.join(begun, key, "left_anti")
