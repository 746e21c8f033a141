"""Constraint checks as data: one row per check with its verdict and a detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, MapType, NumericType, StringType, StructType


def check_rows(rows: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """All constraints in one pass: name, ok, n_rows, n_bad. A null verdict counts as bad."""
    sums = rows.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, c in enumerate(constraints.values())],
    )
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("n_bad")) for i, n in enumerate(constraints)])
    return sums.select("n_rows", F.inline(each)).select("name", (F.col("n_bad") == 0).alias("ok"), "n_rows", "n_bad")


def schema_differences(rows: DataFrame, expected: StructType) -> list[str]:
    """What differs from an exact schema: missing, unexpected and retyped columns."""
    have, want = ({f.name: f.dataType for f in s.fields} for s in (rows.schema, expected))
    return (
        [f"missing {n}" for n in want if n not in have]
        + [f"unexpected {n}" for n in have if n not in want]
        + [f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}" for n in want if n in have and have[n] != want[n]]
    )


def forbidden_fields(kind: DataType, names: set[str], path: str = "") -> list[str]:
    """Paths of fields with a forbidden name, at any depth of a schema."""
    if isinstance(kind, StructType):
        found = []
        for f in kind.fields:
            here = f"{path}.{f.name}" if path else f.name
            found += ([here] if f.name in names else []) + forbidden_fields(f.dataType, names, here)
        return found
    if isinstance(kind, ArrayType):
        return forbidden_fields(kind.elementType, names, f"{path}[]")
    if isinstance(kind, MapType):
        return forbidden_fields(kind.valueType, names, f"{path}{{}}")
    return []


def pattern_counts(rows: DataFrame, text: str, patterns: dict[str, str], needles: dict[str, str] | None = None) -> DataFrame:
    """rows_hit and matches per named pattern over a text column, in one pass, each pattern tried once a text.

    A pattern's needle is a text that every match holds; texts without it are passed by without trying the pattern.
    """
    counts = []
    for i, (name, p) in enumerate(patterns.items()):
        tried = F.regexp_count(F.col(text), F.lit(p))
        needle = (needles or {}).get(name)
        tried = tried if needle is None else F.when(F.contains(F.col(text), F.lit(needle)), tried).otherwise(0)
        counts.append(tried.alias(f"c{i}"))
    sums = rows.select(*counts).agg(
        *[F.count_if(F.col(f"c{i}") > 0).alias(f"r{i}") for i in range(len(counts))], *[F.sum(f"c{i}").alias(f"m{i}") for i in range(len(counts))]
    )
    zero = F.lit(0).cast("long")
    each = [F.struct(F.lit(n).alias("pattern"), F.col(f"r{i}").alias("rows_hit"), F.coalesce(f"m{i}", zero).alias("matches")) for i, n in enumerate(patterns)]
    return sums.select(F.inline(F.array(*each)))


def truthy(rows: DataFrame, name: str) -> Column:
    """Whether an optional field holds something: a column that isn't there, null, false, zero and what is empty don't; NaN does."""
    if name not in rows.columns:
        return F.lit(False)
    kind, c = rows.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (ArrayType, MapType)):
        full = F.size(c) > 0
    elif isinstance(kind, StringType):
        full = c != ""
    elif isinstance(kind, BinaryType):
        full = F.octet_length(c) > 0
    elif isinstance(kind, BooleanType):
        full = c
    elif isinstance(kind, NumericType):
        full = c != 0
    else:
        full = c.isNotNull()
    return F.coalesce(full, F.lit(False))


def redact(text: Column, patterns: list[str], mark: str = "[redacted]") -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, mark)
    return text


def filled_columns(rows: DataFrame) -> DataFrame:
    """Only the columns that have a value in some row."""
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in rows.columns]).first()
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if counts[c]])


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def has_bit(hex_text: Column, bit: int) -> Column:
    """Bit test on a text such as '0x4'."""
    number = F.conv(F.regexp_replace(F.lower(hex_text), "^0x", ""), 16, 10).cast("long")
    return number.bitwiseAND(F.lit(bit)) != 0


def verify_manifest(files: DataFrame, manifest: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """status per path: ok, changed, missing (only listed) or unlisted."""
    have = files.select(path, F.col(digest).alias("_have"))
    want = manifest.select(path, F.col(digest).alias("_want"))
    status = (
        F.when(F.col("_have").isNull(), "missing")
        .when(F.col("_want").isNull(), "unlisted")
        .when(F.col("_have") == F.col("_want"), "ok")
        .otherwise("changed")
    )
    return have.join(want, path, "full_outer").select(path, status.alias("status"))


def whitelist(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns, in this order; one that isn't there fails rather than being left out."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"no column {missing[0]}")
    return rows.select(*columns)
