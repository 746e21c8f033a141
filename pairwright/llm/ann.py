"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Vectors are assigned to the nearest of about sqrt(n) coarse centroids; what is
left is cut into sub-vectors, each coded by one of up to 256 codewords. A query
visits the cells with the best centroids, each raised by a share of the length of its longest
residual. In a cell, asymmetric distance tables (query sub-vector times codeword) rank all codes, and
those that may be among the best of their block by what their codes lose, ``RERANK`` at least, are
reranked by their exact inner product on the original vectors, in double precision.
How many cells a query visits, and that share, are set against brute force: the true neighbours
of up to ``ASKED`` of the queries, taken in hash order, are found among all entries, and the cells
visited hold ``COVER`` of them. This is one pass over the table, whatever its size.

Centroids and codewords are trained on at most ``SAMPLE`` vectors taken in hash
order; every vector is indexed. Equal vectors are one index entry with the
smallest ids of the copies, as many as a result can hold. A cell is cut into
blocks of about ``BLOCK`` entries and its queries likewise, so no group of an
exchange grows with the table, and a query's result per block is ``k + 1`` rows.

Edge cases: vectors that are null, empty, zero, of another length than most, or
with null or non-finite components take no part; nor do rows without an id; rows
that repeat an id with the same vector count once; with fewer candidates than k
all are returned; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE = 16384
MAX_CELLS = 4096
BLOCK = 4096
RERANK = 128
ASKED = 256
#: Shares of a cell's longest residual that its rank may take in.
SHARES = (0.0, 0.25, 0.5, 1.0)
#: A code's error along a query is taken to stay within so many standard deviations of errors in a random direction.
MARGIN = 4.0
COVER = 0.985
SUB_WIDTH = 4
ROUNDS = 12


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's method; an empty cluster takes a point far from its centroid."""
    generator = np.random.default_rng(seed)
    centres = x[generator.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near, far = _nearest(x, centres)
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the closest centre and the squared distance to it."""
    norms = (centres**2).sum(axis=1)
    near, far = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        gap = norms[None, :] - 2 * part @ centres.T
        near[i : i + 4096] = gap.argmin(axis=1)
        far[i : i + 4096] = gap.min(axis=1) + (part**2).sum(axis=1)
    return near, far


@dataclass
class Index:
    """Coarse centroids, codewords per sub-vector, the number of cells to visit and what raises a cell's rank, by unit of the query's length."""

    centroids: np.ndarray
    codewords: list[np.ndarray]
    cuts: list[int]
    probes: int
    lift: np.ndarray | float = 0.0

    @classmethod
    def train(cls, x: np.ndarray, cells: int, k: int, seed: int = 7) -> Index:
        cells = max(1, min(cells, len(x)))
        centroids = _kmeans(x, cells, seed)
        near, _ = _nearest(x, centroids)
        rest = x - centroids[near]
        width = x.shape[1]
        cuts = [*range(0, width, SUB_WIDTH), width]
        words = [_kmeans(np.ascontiguousarray(rest[:, a:b]), min(256, len(x)), seed) for a, b in zip(cuts, cuts[1:])]
        return cls(centroids, words, cuts, cells)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Cells from the most promising on, for each query."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        return np.argsort(-(queries @ self.centroids.T + lengths[:, None] * self.lift), axis=1, kind="stable")

    def calibrate(self, queries: np.ndarray, asked: np.ndarray, cells: np.ndarray, reach: np.ndarray) -> None:
        """Sets the cells to visit by true neighbours: number of the query and cell of each. ``reach`` is the length of each cell's longest residual."""
        found = []
        for share in SHARES if len(asked) else ():
            self.lift = share * reach
            needed = np.sort((self.order(queries)[asked] == cells[:, None]).argmax(axis=1))
            found.append((int(needed[min(len(needed) - 1, int(np.ceil(COVER * len(needed))))]) + 1, share))
        self.probes, share = min(found, default=(len(self.centroids), 0.0))
        self.lift = share * reach

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes."""
        near, _ = _nearest(x, self.centroids)
        rest = x - self.centroids[near]
        codes = [_nearest(rest[:, a:b], w)[0] for a, b, w in zip(self.cuts, self.cuts[1:], self.codewords)]
        return near, np.stack(codes, axis=1).astype(np.uint8)

    def losses(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the residuals, and of what the codes leave of them."""
        rest = x - self.centroids[cell]
        coded = np.concatenate([w[codes[:, m]] for m, w in enumerate(self.codewords)], axis=1)
        return np.sqrt((rest**2).sum(axis=1)), np.sqrt(((rest - coded) ** 2).sum(axis=1))

    def visit(self, queries: np.ndarray) -> np.ndarray:
        return self.order(queries)[:, : self.probes]

    def approximate(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Scores of all codes of a cell for all queries, from asymmetric distance tables."""
        score = np.repeat((queries @ self.centroids[cell])[:, None], len(codes), axis=1)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            score += (queries[:, a:b] @ self.codewords[m].T)[:, codes[:, m]]
        return score


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull())
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 0))


def _true_cells(coded: DataFrame, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the vectors ``asked`` (a bounded number) and cells of their ``k`` nearest among all entries, by brute force."""
    shared = coded.sparkSession.sparkContext.broadcast(asked)

    def nearest(batches):
        own = shared.value
        score, cell = np.full((len(own), k), -np.inf), np.zeros((len(own), k), dtype=np.int32)
        for batch in batches:
            for start in range(0, batch.num_rows if len(own) else 0, 4096):
                piece = batch.slice(start, 4096)
                new = np.concatenate((score, own @ _matrix(piece.column("v").to_pandas()).T), axis=1)
                cells = np.concatenate((cell, np.broadcast_to(np.asarray(piece.column("cell")), (len(own), piece.num_rows))), axis=1)
                best = np.argpartition(-new, k - 1, axis=1)[:, :k]
                score, cell = np.take_along_axis(new, best, axis=1), np.take_along_axis(cells, best, axis=1)
        q, place = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score[q, place]), pa.array(cell[q, place], pa.int32())], ["q", "score", "cell"])

    found = coded.select("cell", "v").mapInArrow(nearest, "q int, score double, cell int")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell"))
    rows = found.withColumn("place", place).where(F.col("place") <= k).select("q", "cell").toPandas()
    return rows["q"].to_numpy(), rows["cell"].to_numpy()


def nearest_neighbours(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for queries whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = _clean(vectors, id_col, vector_col)
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    common = widths.orderBy(F.desc("n"), "width").first()
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == common["width"])
    order = Window.partitionBy("v").orderBy("id")
    nodes = (
        rows.withColumn("copy", F.dense_rank().over(order))
        .where(F.col("copy") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .select(F.xxhash64("v").alias("node"), "ids", "v")
    )
    total = nodes.count()
    sample = nodes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toPandas()
    index = Index.train(_matrix(sample["v"]), min(MAX_CELLS, max(1, round(total**0.5))), k)
    trained = spark.sparkContext.broadcast(index)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v").to_pandas())
                cell, codes = trained.value.encode(x)
                far, loss = trained.value.losses(x, cell, codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), *batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(loss)],
                    ["cell", "node", "ids", "v", "code", "far", "loss"],
                )

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v").to_pandas())
                cells = shared.value.visit(x)
                at = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.ravel().astype(np.int32)), batch.column("node").take(at), batch.column("v").take(at)],
                    ["cell", "query", "qv"],
                )

    coded = written(nodes.mapInArrow(encode, "cell int, node bigint, ids array<bigint>, v array<double>, code binary, far double, loss double"))
    asking = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", F.xxhash64("v").alias("query"), "v")
    # MAX_CELLS rows of two numbers at most
    reach = np.zeros(len(index.centroids))
    for row in coded.groupBy("cell").agg(F.max("far").alias("far")).collect():
        reach[row.cell] = row.far
    some = asking.select("query", "v").dropDuplicates(["query"]).orderBy(F.xxhash64("query"), "query").limit(ASKED).toPandas()
    asked = _matrix(some["v"])
    index.calibrate(asked, *_true_cells(coded, asked, k + 1), reach)
    shared = spark.sparkContext.broadcast(index)
    routed = asking.select(F.col("query").alias("node"), "v").dropDuplicates(["node"]).mapInArrow(
        route, "cell int, query bigint, qv array<double>"
    )
    # MAX_CELLS rows of two numbers at most
    entries = coded.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    visits = routed.groupBy("cell").agg(F.count("*").alias("n")).select(
        F.col("cell").alias("q_cell"), F.ceil(F.col("n") / BLOCK).cast("int").alias("q_blocks")
    )
    parts = F.broadcast(entries.join(visits, F.col("cell") == F.col("q_cell")).select("cell", "blocks", "q_blocks"))
    coded = (
        coded.join(parts, "cell")
        .withColumn("block", F.pmod("node", F.col("blocks")).cast("int"))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .select("cell", "block", "q_block", "node", "ids", "v", "code", "loss")
    )
    routed = (
        routed.join(parts, "cell")
        .withColumn("q_block", F.pmod("query", F.col("q_blocks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", "block", "q_block", "query", "qv")
    )

    def search(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(entries) and len(queries):
            least = entries["ids"].map(lambda x: x[0]).to_numpy(dtype=np.int64)
            by = np.argsort(least, kind="stable")  # so that equal scores keep the smaller id first
            x = _matrix(entries["v"])[by]
            ids = entries["ids"].to_numpy()[by]
            codes = np.frombuffer(b"".join(entries["code"]), dtype=np.uint8).reshape(len(x), -1)[by]
            asked = _matrix(queries["qv"])
            error = entries["loss"].to_numpy()[by] * min(1.0, MARGIN / x.shape[1] ** 0.5)
            names, cell = queries["query"].to_numpy(), int(entries["cell"].iloc[0])
            least_kept, most = max(0, len(x) - RERANK), max(0, len(x) - k - 1)
            for i in range(0, len(asked), 256):
                part = asked[i : i + 256]
                rough = shared.value.approximate(part, cell, codes)
                for q, name, row in zip(part, names[i : i + 256], rough):
                    slack = error * np.sqrt((q**2).sum())
                    high = row + slack
                    cut = min(np.partition(high, least_kept)[least_kept], np.partition(row - slack, most)[most])
                    best = np.flatnonzero(high >= cut)
                    score = (x[best] * q).sum(axis=1)
                    first = np.argsort(-score, kind="stable")[: k + 1]
                    out += [(name, score[j], ids[best[j]]) for j in first]
        return pd.DataFrame(out, columns=["query", "score", "ids"])

    keys = ["cell", "block", "q_block"]
    found = (
        coded.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(search, "query bigint, score double, ids array<bigint>")
    )
    near = Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("ids", 1))
    found = found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1)
    each = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = (
        found.select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(each))
        .where(F.col("place") <= k + 1)
    )
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    own = F.filter("near", lambda x: x["vec_id"] != F.col("id"))
    return (
        asking.select("id", "query")
        .distinct()
        .join(lists, "query")
        .select(F.col("id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("rank", "hit"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
    )
