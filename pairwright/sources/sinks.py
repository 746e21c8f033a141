"""Sinks: appended JSON Lines, suite summaries, fixed-format CSV, whole JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.aggregates import cell_summary


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def suite_summary(outcomes: DataFrame) -> DataFrame:
    """One row per label and suite, as a run appends it."""
    return cell_summary(outcomes, ["label", "suite"], F.coalesce("correct", F.lit(False)), F.col("wall_s"))


def fixed(value: Column, places: int) -> Column:
    """Text with a fixed number of decimals, empty for null."""
    return F.coalesce(F.format_string(f"%.{places}f", value.cast("double")), F.lit(""))


def general(value: Column, digits: int = 6) -> Column:
    """Shortest text of so many significant digits, as C's %g gives it: no trailing zeros."""
    v = value.cast("double")
    exponent = F.floor(F.log10(F.abs(v)))
    plain = F.format_string(f"%.{digits - 1}e", v)
    mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(plain, "e", 1), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    power = F.substring_index(plain, "e", -1)
    places = F.greatest(F.lit(0), F.lit(digits - 1) - exponent).cast("int")
    decimal = F.round(v.cast("decimal(38,18)"), 18).cast("string")
    shown = F.when(v == 0, "0").when(
        (exponent < -4) | (exponent >= digits), F.concat(mantissa, F.lit("e"), power)
    )
    cut = F.array_max(F.array(*[F.when(places == p, fixed(v, p)) for p in range(digits + 5)]))
    trimmed = F.when(F.contains(cut, F.lit(".")), F.regexp_replace(F.regexp_replace(cut, "0+$", ""), r"\.$", "")).otherwise(cut)
    return F.when(v.isNull(), "").otherwise(F.coalesce(shown, trimmed, decimal))


def write_csv(rows: DataFrame, path: str, formats: dict[str, Column] | None = None) -> None:
    """One CSV folder with a header; named columns are written in their given text form."""
    shown = rows.withColumns(formats) if formats else rows
    shown.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def report_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text (column value)."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by folder of ``by``, so later filters on these columns prune files."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)
