"""Corpus pipeline: five operators in order, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwright.llm.common import discard, written
from pairwright.llm.decontamination import drop_contaminated
from pairwright.llm.linededup import drop_lines
from pairwright.llm.quality import keep_good
from pairwright.llm.sentencepiece import MODEL_PATH, encode_decode, read_model
from pairwright.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. A null text scores as an empty one; equal texts score alike, so
    repeated rows stay or go together."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat, or nearly repeat, an earlier line. Null and empty texts stay as they are; a null id
    comes first; rows that share an id are told apart, and one of repeated rows keeps its lines."""
    return drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of the smallest id and, where rows share it, the first of them. Null and
    empty texts are one group; rows without an id stay."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts hold none; rows of one text stay or go together."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """The documents' columns with token_ids, and round_trip: whether they decode to the text. A null text is coded as an empty
    one; repeated rows are coded alike. Where a document column has one of these names, or the name decoded, ours begin with "new_"."""
    prefix, held = "", {c.lower() for c in docs.columns}
    while held & {f"{prefix}{n}" for n in ("token_ids", "decoded", "round_trip")}:
        prefix += "new_"
    coded = encode_decode(docs, read_model(model_path), keep=tuple(docs.columns), prefix=prefix)
    return coded.drop(f"{prefix}decoded")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: Discriminant scores, SimHash and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
