"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words (as written, cut at ASCII white space). A line is
removed if an earlier line (by document id, then line number) has the same set,
or one of Jaccard similarity ``SIMILARITY`` (0.8) or more. Lines without words are
kept. Words are ordered by rarity over the whole corpus, so two lines that match
share one of their first ``n - ceil(0.8 n) + 1`` words; positional and length
filters drop pairs that cannot reach the overlap; so does a
parity bitmap of the words (64 bits, 128 for sets over ``SHORT`` words), whose differing
bits are at most the differing words; pairs left are verified on the words themselves.

Texts are cut into words once; the word hashes stay on the executors' disks until the sets are made.
Rarity is the number of lines that hold a word, counted in ``2**BUCKET_BITS`` hash buckets, a table
of fixed size that goes into the plan; it orders words only, so sharing a bucket costs speed,
never a match. Equal sets are one node with its first line. A word in the prefix
of many nodes (about ``HOT`` or more) pairs each of them with its first node only; just those
that this doesn't settle are joined in full. Which texts a verification reads is
narrowed by a bitmap of fixed size before the exact join.

Edge cases: null and empty texts have one empty line, which stays; a null id
sorts before all others; rows with the same id, null ids included, are told apart by
a row number and are earlier and later than each other in no particular order, so one
of repeated rows keeps its lines; lines of any length are
compared whole; an empty table gives an empty result; columns of any name stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, written

BUCKET_BITS = 18
#: Counters of neighbouring buckets that one group holds: few groups fit the fast map of a partial aggregate.
SIDE = 4
HOT = 256
SAMPLED = 4
BITMAP_BITS = 23
#: Sets up to this size have the first 64 bits of the parity bitmap only.
SHORT = 64
#: Smallest set that can match a different one: 4 of 5 words.
LEAST = 4


def _words(line: Column) -> Column:
    odd = F.lit(False)
    for c in ("\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(c))
    return F.array_remove(F.when(odd, F.split(line, r"[\x09\x0B-\x0D ]+")).otherwise(F.split(line, " ")), "")


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc", "row", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc``, a long in the order of doc_id, for ids that aren't whole numbers."""
    ids = docs.where(F.col("in.doc_id").isNotNull()).select(F.col("in.doc_id").alias("id")).distinct().orderBy("id")
    # partitions of a sorted table are in order, and so are these numbers
    ids = written(ids.select("id", F.monotonically_increasing_id().alias("doc")))
    return docs.join(ids, F.col("in.doc_id") == F.col("id"), "left").select("in", "text", "doc")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``in`` (all their columns), with text, doc (the id as a long) and row.

    ``row`` tells rows of the same id apart. It is 0 where no id repeats; otherwise the table
    is written with it, as numbers of rows may differ each time a plan runs.
    """
    rows = docs.select(F.struct("*").alias("in"), "text")
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = rows.withColumn("doc", F.col("in.doc_id").cast("long")) if whole else _numbered(rows)
    if rows.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty():
        return rows.withColumn("row", F.lit(0).cast("bigint"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def _constant(df: DataFrame, value: object, kind: str) -> Column:
    """A value of fixed size as a scalar subquery; as a literal it would stand in every printed plan."""
    return written(df.sparkSession.createDataFrame([(value,)], f"value {kind}")).scalar()


def _hashed(docs: DataFrame) -> DataFrame:
    """doc, row, line_no and the hashes of the distinct words of every line, kept on disk: the first job that reads it makes it."""
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    return _lines(docs).select("doc", "row", "line_no", hashes.alias("hashes")).persist(StorageLevel.DISK_ONLY)


def _rarity_table(hashed: DataFrame) -> Column:
    """For each hash bucket (top bits of a word's hash) the long whose exclusive or with a hash is the word's code.

    A code's top byte is a class from 0 (rare) to 127 by the lines that hold the bucket's words; 56 bits of the hash follow.
    """
    spark, size = hashed.sparkSession, 1 << BUCKET_BITS
    bucket = F.shiftrightunsigned("word", 64 - BUCKET_BITS).cast("int")
    words = hashed.select(F.explode("hashes").alias("word")).select(
        bucket.bitwiseAND(F.lit(SIDE - 1)).alias("side"), F.shiftright(bucket, SIDE.bit_length() - 1).alias("group")
    )
    groups = words.groupBy("group").agg(*[F.count_if(F.col("side") == k).alias(f"n{k}") for k in range(SIDE)])
    counts = (
        groups.select("group", F.posexplode(F.array(*[f"n{k}" for k in range(SIDE)])).alias("side", "n"))
        .where("n > 0")
        .select(
            (F.col("group") * SIDE + F.col("side")).alias("bucket"),
            F.least(F.lit(127), F.floor(F.log2("n") * 4)).cast("int").alias("rank"),
        )
    )
    # the table is assembled in pieces of 512 buckets; its size never changes
    every = spark.range(size).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    bucket, kept = F.col("bucket").cast("long"), BUCKET_BITS - 8
    top = F.shiftleft(F.coalesce("rank", F.lit(0)).cast("long"), kept).bitwiseOR(bucket.bitwiseAND(F.lit((1 << kept) - 1)))
    mask = F.shiftleft(top.bitwiseXOR(bucket), 64 - BUCKET_BITS)
    pieces = every.groupBy(F.shiftright("bucket", 9).alias("piece")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bucket", mask.alias("mask")))), lambda x: x["mask"]).alias("masks")
    )
    masks = [m for row in sorted(pieces.collect(), key=lambda row: row["piece"]) for m in row["masks"]]
    return _constant(hashed, masks, "array<bigint>")


def _codes(hashes: Column, ranks: Column) -> Column:
    """A line's distinct words as numbers, rarest first: rarity class, then 56 bits of the word's hash.

    ``ranks`` is named once, so that the optimizer puts the subquery in its place and no row carries it.
    """

    def code(h: Column) -> Column:
        mask = F.get(ranks, F.shiftrightunsigned(h, 64 - BUCKET_BITS))
        # never null, so that arrays of codes are sorted as plain longs
        return F.coalesce(mask.bitwiseXOR(h), F.lit(0).cast("long"))

    return F.sort_array(F.transform(hashes, code))


def _flip(bits: Column, code: Column) -> Column:
    """Fold that flips one of 64 bits for each word. Two sets' bits differ in no more places than their words do."""
    return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(code)))


def _flip_half(bits: Column, code: Column) -> Column:
    """The same for about half of the words: with those flipped here and the others, a set has 128 bits."""
    return bits.bitwiseXOR(F.call_function("shiftleft", code.bitwiseAND(F.lit(1)), F.hash(code)))


def _bit(id_col: str) -> Column:
    """Number of an id's bit, from 1 as Spark's bitmap functions count."""
    return F.pmod(F.xxhash64(id_col), F.lit(1 << BITMAP_BITS)) + 1


def _bitmap(ids: DataFrame) -> bytes:
    """A bit for each id's hash; fixed size."""
    bit = _bit("id")
    parts = ids.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    size, out = 4096, bytearray((1 << BITMAP_BITS) // 8)
    for row in parts.collect():
        out[(row["part"] - 1) * size : row["part"] * size] = row["bits"]
    return bytes(out)


def _may_hold(bitmap: Column, id_col: str) -> Column:
    bit = _bit(id_col)
    place = (F.bitmap_bucket_number(bit) - 1) * 32768 + F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1


def _verified(pairs: DataFrame, docs: DataFrame, order: Order) -> DataFrame:
    """Those of the pairs (b, a) whose words have the similarity; column b, distinct."""
    ids = pairs.select(F.col("b").alias("id")).unionAll(pairs.select(F.col("a").alias("id")))
    if order.line_bits is not None:  # texts without a line of these are not cut at all
        rows = _constant(docs, _bitmap(ids.select(F.shiftright("id", order.line_bits).alias("id"))), "binary")
        docs = docs.withColumn("row_id", order.row).where(_may_hold(rows, "row_id"))
    texts = _lines(docs).select(order.line.alias("id"), "line").where(_may_hold(_constant(docs, _bitmap(ids), "binary"), "id"))
    texts = written(texts)
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a")
    wa, wb = F.array_distinct(_words(F.col("line_a"))), F.array_distinct(_words(F.col("line_b")))
    # one struct, so that neither set is made again for each use
    sets = F.array(F.struct(wa.alias("a"), wb.alias("b")))
    enough = F.exists(sets, lambda s: F.size(F.array_intersect(s["a"], s["b"])) * 9 >= (F.size(s["a"]) + F.size(s["b"])) * 4)
    found = written(both.where(enough).select("b").distinct())
    discard(texts)
    return found


@dataclass
class Order:
    """A row, and a row and line number, as one number each; ``line_bits`` is None where a long doesn't hold them."""

    row: Column
    line: Column
    line_bits: int | None


def _order(lines: DataFrame) -> Order:
    part, within = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    low, high, most, parts, rows = lines.agg(
        F.min("doc"), F.max("doc"), *[F.coalesce(F.max(c), F.lit(0)) for c in (F.col("line_no"), part, within)]
    ).first()
    line_bits, row_bits = max(1, int(most).bit_length()), int(rows).bit_length()
    copy_bits = int(parts).bit_length() + row_bits
    reach = max(abs(low or 0), abs(high or 0)) + 2
    doc = F.coalesce(F.col("doc").cast("decimal(20,0)"), F.lit((low or 0) - 1).cast("decimal(20,0)"))
    copy = part * F.lit(1 << row_bits) + within
    if reach << (copy_bits + line_bits) < 1 << 62:
        row = doc.cast("long") * F.lit(1 << copy_bits) + copy
        return Order(row, row * F.lit(1 << line_bits) + F.col("line_no"), line_bits)
    row = (doc * F.lit(1 << copy_bits).cast("decimal(18,0)") + copy).cast("decimal(38,0)")
    return Order(row, (row * F.lit(1 << line_bits).cast("decimal(18,0)") + F.col("line_no")).cast("decimal(38,0)"), None)


def _places(nodes: DataFrame) -> DataFrame:
    rows = nodes.select("id", "n", "bits", "more_bits", F.posexplode("prefix").alias("pos", "code"))
    return rows.select("id", "n", "bits", "more_bits", "pos", F.hash("code").alias("word"))


def _sides(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("word", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "bits", "more_bits", "pos")])


def _hot_words(nodes: DataFrame, hot: int) -> DataFrame:
    """Words that stand in the prefixes of about ``hot`` nodes or more, from every ``SAMPLED``-th node.

    A word's class bounds its lines from above, so those of the classes below aren't counted. This
    only chooses how a word's nodes are compared; either way finds all matches.
    """
    some = nodes.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select(F.explode("prefix").alias("code"))
    words = some.where(F.shiftright("code", 56) >= min(127, int(4 * math.log2(hot)))).select(F.hash("code").alias("word"))
    return written(words.groupBy("word").agg(F.count("*").alias("held")).where(F.col("held") * SAMPLED > hot).select("word"))


def _reach() -> Column:
    """a is earlier than b; the first shared word of a pair bounds its overlap, the bits its difference."""
    both = F.col("a_n") + F.col("b_n")
    left = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    bits = F.col("a_bits").bitwiseXOR(F.col("b_bits"))
    half = F.col("a_more_bits").bitwiseXOR(F.col("b_more_bits"))  # null unless both are long
    apart = F.bit_count(bits.bitwiseXOR(F.coalesce(half, F.lit(0).cast("long")))) + F.coalesce(F.bit_count(half), F.lit(0))
    return (F.col("a_id") < F.col("b_id")) & (left * 9 >= both * 4) & (apart * 9 <= both)


def _candidates(nodes: DataFrame, heavy: DataFrame, heavy_rows: DataFrame) -> DataFrame:
    """Pairs (b, a) with the number of shared prefix words: all pairs of a normal word, first node only of a hot one."""
    normal = _places(nodes).join(heavy, "word", "left_anti")
    met = _sides(normal, "a").join(_sides(normal, "b"), "word").where(_reach())
    columns = ("id", "n", "bits", "more_bits", "pos")
    first = heavy_rows.groupBy("word").agg(F.min_by(F.struct(*columns), "id").alias("a"))
    first = first.select("word", *[F.col(f"a.{c}").alias(f"a_{c}") for c in columns])
    led = _sides(heavy_rows, "b").join(first, "word").where(_reach()).select(F.col("b_id").alias("b"), F.col("a_id").alias("a"))
    pairs = met.select(F.col("b_id").alias("b"), F.col("a_id").alias("a")).unionAll(led)
    return written(pairs.groupBy("b", "a").agg(F.count("*").alias("shared")))


def _rest(pairs: DataFrame, best: DataFrame, settled: DataFrame, heavy_rows: DataFrame) -> DataFrame:
    """Candidates of nodes that their best pair didn't settle, now with all pairs of hot words."""
    open_pairs = pairs.join(settled, "b", "left_anti").join(best, ["b", "a"], "left_anti").select("b", "a")
    late = heavy_rows.join(settled.select(F.col("b").alias("id")), "id", "left_anti")
    hot_pairs = _sides(heavy_rows, "a").join(_sides(late, "b"), "word").where(_reach())
    return written(open_pairs.unionAll(hot_pairs.select(F.col("b_id").alias("b"), F.col("a_id").alias("a"))).distinct())


def _near(nodes: DataFrame, docs: DataFrame, order: Order, hot: int) -> DataFrame:
    """Nodes (column b) with an earlier node of the similarity."""
    heavy = _hot_words(nodes, hot)
    heavy_rows = written(_places(nodes).join(heavy, "word", "left_semi"))
    pairs = _candidates(nodes, heavy, heavy_rows)
    release(docs)
    best = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")))
    settled = _verified(best, docs, order)
    more = _rest(pairs, best, settled, heavy_rows)
    discard(heavy, heavy_rows, pairs, best)
    release(docs)
    late = _verified(more, docs, order)
    discard(more)
    release(docs)
    return settled.unionAll(late).distinct()


@dataclass
class Lines:
    """The table of all lines, and those of them that go (doc, row, line_no, exact)."""

    every: DataFrame
    gone: DataFrame


def removed_lines(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, line_no and exact (a repeat of the same set) of every removed line of ``docs`` (doc_id, text)."""
    docs = _keyed(docs.select("doc_id", "text"))
    gone = _removed(docs, hot).gone.select(F.col("doc").alias("gone"), F.col("row").alias("gone_row"), "line_no", "exact")
    same = F.col("doc").eqNullSafe(F.col("gone")) & (F.col("row") == F.col("gone_row"))
    return gone.join(docs, same).select("in.doc_id", "line_no", "exact")


def _nodes(hashed: DataFrame, ranks: Column, order: Order) -> DataFrame:
    """The sets of the lines with words, each with its first line (id); codes go from the hashes into the groups unwritten."""
    # by the size of the hashes: a filter by that of the codes would make them twice
    codes = hashed.where(F.size("hashes") > 0).select(order.line.alias("id"), "hashes", ranks.alias("ranks"))
    codes = codes.select("id", _codes(F.col("hashes"), F.col("ranks")).alias("codes"))
    n, none = F.size("codes"), F.lit(0).cast("long")
    sets = codes.select(
        "id",
        n.alias("n"),
        F.xxhash64("codes").alias("k1"),
        F.xxhash64("codes", F.lit(1)).alias("k2"),
        F.aggregate("codes", none, _flip).alias("bits"),
        F.when(n > SHORT, F.aggregate("codes", none, _flip_half)).alias("more_bits"),
        F.slice("codes", 1, n - F.ceil(n * F.lit(0.8) - F.lit(1e-9)).cast("int") + 1).alias("prefix"),
    )
    return written(sets.groupBy("k1", "k2", "n", "bits", "more_bits", "prefix").agg(F.min("id").alias("id")))


def _removed(docs: DataFrame, hot: int = HOT) -> Lines:
    """The lines of rows from ``_keyed``."""
    docs = docs.select("doc", "row", "text")
    hashed = _hashed(docs)
    ranks = _rarity_table(hashed)
    every = written(hashed.select("doc", "row", "line_no", F.size("hashes").alias("n")))
    lines = every.where("n > 0")
    order = _order(lines)
    nodes = _nodes(hashed, ranks, order)
    hashed.unpersist()
    release(docs)
    near = _near(nodes.where(F.col("n") >= LEAST).select("id", "n", "bits", "more_bits", "prefix"), docs, order, hot)
    # one line of each set is its node; the others repeat it
    own = lines.select("doc", "row", "line_no", order.line.alias("own"))
    marked = nodes.select("id").join(near.select(F.col("b").alias("id"), F.lit(True).alias("near")), "id", "left")
    gone = own.join(marked.hint("shuffle_hash"), F.col("own") == F.col("id"), "left").where(F.col("id").isNull() | F.col("near"))
    return Lines(every, gone.select("doc", "row", "line_no", F.col("id").isNull().alias("exact")))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_kept and removed_sha256 (removed line numbers, sorted, comma-joined)."""
    docs = _keyed(docs.select("doc_id", "text"))
    lines = _removed(docs)
    gone = lines.gone.groupBy(F.col("doc").alias("gone"), F.col("row").alias("gone_row")).agg(
        F.count_if("exact").alias("n_exact"),
        F.count_if(~F.col("exact")).alias("n_near"),
        F.array_join(F.transform(F.array_sort(F.collect_list("line_no")), lambda x: x.cast("string")), ",").alias("numbers"),
    )
    same = F.col("doc").eqNullSafe(F.col("gone")) & (F.col("row") == F.col("gone_row"))
    # every row has a line, if only an empty one
    held = lines.every.groupBy(F.col("doc").alias("held"), F.col("row").alias("held_row")).agg(F.count("*").alias("n_lines"))
    whole = F.col("doc").eqNullSafe(F.col("held")) & (F.col("row") == F.col("held_row"))
    rows = docs.select("in.doc_id", "doc", "row").join(held, whole).join(gone, same, "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id",
        "n_lines",
        F.coalesce("n_exact", zero).alias("n_exact"),
        F.coalesce("n_near", zero).alias("n_near"),
        (F.col("n_lines") - F.coalesce("n_exact", zero) - F.coalesce("n_near", zero)).alias("n_kept"),
        F.sha2(F.coalesce("numbers", F.lit("")).cast("binary"), 256).alias("removed_sha256"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without removed lines in ``text``. Every document stays, if only with an empty text; n_chars, if there, is recounted."""
    names, kinds = docs.columns, docs.schema
    docs = _keyed(docs)
    gone = _removed(docs).gone.groupBy(F.col("doc").alias("gone"), F.col("row").alias("gone_row"))
    gone = gone.agg(F.collect_set("line_no").alias("numbers"))
    same = F.col("doc").eqNullSafe(F.col("gone")) & (F.col("row") == F.col("gone_row"))
    rows = docs.join(gone, same, "left")
    lines = F.split("text", "\n")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("numbers"))
    # one struct, so that neither array is made again for each line
    parts = F.array(F.struct(lines.alias("lines"), numbers.alias("numbers")))
    kept = F.transform(parts, lambda p: F.array_join(F.transform(p["numbers"], lambda i: F.get(p["lines"], i)), "\n"))
    text = F.when(F.col("numbers").isNull(), F.col("text")).otherwise(F.get(kept, F.lit(0)))
    rows = rows.select("in", text.alias("text"))
    out = {"text": F.col("text")}
    if "n_chars" in names:
        out["n_chars"] = F.char_length("text").cast(kinds["n_chars"].dataType)
    return rows.select(*[out.get(c, F.col(f"in.`{c}`")).alias(c) for c in names])


__all__ = ["drop_lines", "line_report", "removed_lines"]
