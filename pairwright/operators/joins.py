"""Joins by content: containment, n-gram leaks, two-tier hashes, nearest position, ledgers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.functions.folding import normalized
from pairwright.session import scratch

GRAM = 25
STRIDE = 24
#: Sizes up to which a side travels to all tasks: characters of the small texts, candidate pairs, characters of an automaton.
SMALL_CHARS, PAIRS, AUTOMATON_CHARS = 1 << 21, 1 << 18, 1 << 19
#: Texts whose hits are sent on together.
SCAN_ROWS = 256


def grams(text: Column, size: int) -> Column:
    """Substrings of ``size`` characters at every offset; none of shorter texts."""
    last = F.char_length(text) - size
    starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.expr("array()").cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def strided_grams(text: Column, size: int = GRAM, stride: int = STRIDE) -> Column:
    """Substrings of ``size`` = ``stride`` + 1 characters at every ``stride``-th offset, in time linear in the text: pieces of
    ``stride`` characters, each with the first character of the next one."""
    if size != stride + 1:
        raise ValueError("a gram is a piece and one character")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    joined = F.zip_with(pieces, F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda a, b: F.concat(a, F.substring(b, 1, 1)))
    return F.filter(joined, lambda g: g.isNotNull())


def leak_candidates(
    small: DataFrame, large: DataFrame, small_id: str, large_id: str, small_text: str, large_text: str
) -> DataFrame:
    """Pairs of ids that share a gram of ``GRAM`` characters: every offset of the small side, every ``STRIDE``-th of the large.

    Any run of GRAM + STRIDE - 1 = 48 characters that two texts share holds one
    of the large side's grams, so no such pair is lost. Grams of a small side of up to
    ``SMALL_CHARS`` characters are matched in the large side's scan, without a shuffle.
    """
    left = small.select(F.col(small_id), F.explode(F.array_distinct(grams(F.col(small_text), GRAM))).alias("gram"))
    right = large.select(F.col(large_id), F.explode(F.array_distinct(strided_grams(F.col(large_text)))).alias("gram"))
    chars = small.agg(F.coalesce(F.sum(F.char_length(small_text)), F.lit(0))).first()[0]
    return right.join(F.broadcast(left) if chars <= SMALL_CHARS else left, "gram").select(small_id, large_id).distinct()


def _with_texts(
    pairs: DataFrame, small: DataFrame, large: DataFrame, small_id: str, large_id: str, small_text: str, large_text: str
) -> DataFrame:
    """Candidate pairs with both texts; few pairs go to the large texts, not the texts to them."""
    pairs = pairs.join(small.select(small_id, F.col(small_text).alias("_small")), small_id).persist()
    few = pairs.agg(F.coalesce(F.sum(F.char_length("_small") + 32), F.lit(0))).first()[0] <= 64 * PAIRS
    return large.select(large_id, F.col(large_text).alias("_large")).join(F.broadcast(pairs) if few else pairs, large_id)


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder: what follows reads their columns rather than computing them anew."""
    path = scratch(rows.sparkSession, "texts") + "/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def contains_join(
    small: DataFrame,
    large: DataFrame,
    small_id: str,
    large_id: str,
    small_text: str,
    large_text: str,
    form: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Pairs where the large text contains the whole small one, which isn't empty, both in the given form (as they are without one).

    Items of 48 characters or more are found by grams and verified exactly, if they are many. Others of any length are found by an
    automaton of all of them, in one pass over each text; where they come to more than ``AUTOMATON_CHARS``
    characters, there are several automata, by hash, and a pass for each.
    """
    sides = small_id, large_id, small_text, large_text
    if form is not None:
        small = _once(small.select(small_id, form(F.col(small_text)).alias(small_text)))
        large = _once(large.select(large_id, form(F.col(large_text)).alias(large_text)))
    held = small.where(F.char_length(small_text) > 0)
    long = held.where(F.char_length(small_text) >= GRAM + STRIDE - 1)
    if (long.agg(F.sum(F.char_length(small_text))).first()[0] or 0) > AUTOMATON_CHARS:
        found = _with_texts(leak_candidates(long, large, *sides), long, large, *sides)
        found = found.where(F.contains("_large", F.col("_small"))).select(small_id, large_id)
        short = held.where(F.char_length(small_text) < GRAM + STRIDE - 1)
    else:
        found, short = small.crossJoin(large.select(large_id)).select(small_id, large_id).limit(0), held
    texts = short.select(F.col(small_text).alias("_x")).distinct()
    blocks = -(-(texts.agg(F.sum(F.char_length("_x"))).first()[0] or 0) // AUTOMATON_CHARS)
    for block in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("_x"), F.lit(blocks)) == block)
        hits = _scan_for([r[0] for r in own.collect()], large, large_id, large_text)
        found = found.unionByName(hits.join(short.withColumnRenamed(small_text, "_x"), "_x").select(small_id, large_id))
    return found


def _scan_for(items: list[str], large: DataFrame, large_id: str, large_text: str) -> DataFrame:
    """Rows (large_id, _x) for each of ``items`` that a text contains, once a text."""
    shared = large.sparkSession.sparkContext.broadcast(items)
    rows = large.where(F.col(large_text).isNotNull()).select(large_id, large_text)
    schema = StructType([*rows.select(large_id).schema.fields, *StructType.fromDDL("_x string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for item in shared.value:
            automaton.add_word(item, item)
        automaton.make_automaton()
        for batch in batches:
            for start in range(0, batch.num_rows, SCAN_ROWS):
                piece = batch.slice(start, SCAN_ROWS)
                at, found = [], []
                for i, text in enumerate(piece.column(1).to_pylist()):
                    hits = {item for _, item in automaton.iter(text)}
                    at += [i] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def leak_audit(private: DataFrame, public: DataFrame, private_id: str, public_id: str, private_text: str, public_text: str, size: int = 48) -> DataFrame:
    """Pairs in which a private text shows up in a public one after normalisation, and how (column kind).

    ``grams``: a private text of ``size`` characters or more shares any run of so many. ``whole``: a shorter one occurs whole,
    if it has 20 characters, or 12 and a digit or three words; what is shorter still says nothing.
    """
    sides = private_id, public_id, private_text, public_text
    private = _once(private.select(private_id, normalized(F.col(private_text)).alias(private_text)))
    public = _once(public.select(public_id, normalized(F.col(public_text)).alias(public_text)))
    chars, x = F.char_length(private_text), F.col(private_text)
    telling = (chars >= 20) | ((chars >= 12) & (x.rlike(r"\p{Nd}") | (F.size(F.split(x, " ")) >= 3)))
    whole = contains_join(private.where((chars < size) & telling), public, *sides).withColumn("kind", F.lit("whole"))
    grams = ngram_leak(private.where(chars >= size), public, *sides, size=size).select(private_id, public_id, F.lit("grams").alias("kind"))
    return whole.unionByName(grams)


def ngram_leak(
    small: DataFrame, large: DataFrame, small_id: str, large_id: str, small_text: str, large_text: str, size: int = 48
) -> DataFrame:
    """Pairs that share a run of ``size`` characters (48 or more), with the number of the small side's grams found."""
    if size < GRAM + STRIDE - 1:
        raise ValueError(f"runs under {GRAM + STRIDE - 1} characters could be missed")
    sides = small_id, large_id, small_text, large_text
    joined = _with_texts(leak_candidates(small, large, *sides), small, large, *sides)
    found = F.size(F.filter(F.array_distinct(grams(F.col("_small"), size)), lambda g: F.contains(F.col("_large"), g)))
    return joined.withColumn("n_grams", found.cast("long")).where("n_grams > 0").select(small_id, large_id, "n_grams")


def hash_match(local: DataFrame, hub: DataFrame, digest: str, name: str) -> DataFrame:
    """status per local file: MATCH by digest, else MISMATCH if the name is known, else NOT_ON_HUB; n_hits counts the matches.

    ``hub`` rows may repeat; they are summed up before the joins.
    """
    by_digest = hub.groupBy(digest).agg(F.count("*").alias("_same"))
    by_name = hub.groupBy(name).agg(F.count("*").alias("_named"))
    joined = local.join(by_digest, digest, "left").join(by_name, name, "left")
    status = F.when(F.col("_same") > 0, "MATCH").when(F.col("_named") > 0, "MISMATCH").otherwise("NOT_ON_HUB")
    hits = F.coalesce(F.col("_same"), F.when(F.col("_named") > 0, F.col("_named")), F.lit(0))
    return joined.withColumn("status", status).withColumn("n_hits", hits).drop("_same", "_named")


def nearest_position(marks: DataFrame, tokens: DataFrame, by: str, mark: str, token: str, value: str) -> DataFrame:
    """For each mark the token nearest to its offset within the same text; ties take the lower offset, and of tokens of one offset the
    least value. Both sides are sorted together by text and offset; a mark looks at the token before and the one after."""
    none = F.lit(None).cast(tokens.select(F.struct(F.col(token).alias("at"), F.col(value).alias("v"))).schema[0].dataType)
    once = tokens.where(F.col(token).isNotNull()).groupBy(by, token).agg(F.min(value).alias("v"))
    held = once.select(by, F.col(token).alias("pos"), F.lit(0).alias("side"), F.struct(F.col(token).alias("at"), "v").alias("tok"))
    asked = marks.where(F.col(mark).isNotNull()).select(by, F.col(mark).alias("pos")).distinct().select(by, "pos", F.lit(1).alias("side"), none.alias("tok"))
    both = held.unionByName(asked)
    upto = Window.partitionBy(by).rowsBetween(Window.unboundedPreceding, 0)
    # looking on is looking back in falling order; a frame to the end would be summed anew for each row
    found = both.withColumn("low", F.last("tok", True).over(upto.orderBy("pos", "side"))).withColumn(
        "high", F.last("tok", True).over(upto.orderBy(F.desc("pos"), "side"))
    )
    lower = F.col("high").isNull() | (F.col("pos") - F.col("low.at") <= F.col("high.at") - F.col("pos"))
    found = found.where("side = 1").withColumn("_t", F.when(F.col("low").isNotNull() & lower, F.col("low")).otherwise(F.col("high")))
    found = found.where("_t IS NOT NULL")
    return found.select(by, F.col("pos").alias(mark), F.col("_t.at").alias(token), F.col("_t.v").alias(value))


def ledger_audit(intents: DataFrame, terminals: DataFrame, key: str) -> DataFrame:
    """One row per key: how many intents and terminals it has, and the finding."""
    a = intents.groupBy(key).agg(F.count("*").alias("n_intents"))
    b = terminals.groupBy(key).agg(F.count("*").alias("n_terminals"))
    zero = F.lit(0).cast("long")
    full = a.join(b, key, "full_outer").select(
        key, F.coalesce("n_intents", zero).alias("n_intents"), F.coalesce("n_terminals", zero).alias("n_terminals")
    )
    finding = (
        F.when(F.col("n_terminals") == 0, "open")
        .when(F.col("n_intents") == 0, "orphan")
        .when((F.col("n_intents") > 1) | (F.col("n_terminals") > 1), "repeated")
        .otherwise("closed")
    )
    return full.withColumn("finding", finding)


def remainder(rows: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key isn't done yet: what a resumed run has left."""
    return rows.join(done, key, "left_anti")


def positional_zip(a: DataFrame, b: DataFrame, pos: str) -> DataFrame:
    """Row i of one side beside row i of the other, by an explicit position column; missing ones give nulls."""
    left = a.select(pos, *[F.col(c).alias(f"{c}_a") for c in a.columns if c != pos])
    right = b.select(pos, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != pos])
    return left.join(right, pos, "full_outer")


def members(rows: DataFrame, known: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key is known; a key that repeats on the other side doesn't repeat rows."""
    return rows.join(known, key, "left_semi")
