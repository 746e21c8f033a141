"""Snapshots of a machine as text: comma-separated rows of its processors, memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a processor's row in order, the numbers among them, and keys of a memory table with their columns.
FIELDS = ("index", "name", "uuid", "temperature_c", "power_w", "memory_used_mib", "memory_total_mib", "utilization_percent", "graphics_clock_mhz")
NUMBERS = FIELDS[3:]
MEMORY = {"MemTotal": "total", "MemFree": "free", "MemAvailable": "available", "Cached": "cached", "Buffers": "buffers", "SwapFree": "swap_free"}
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _finite(field: Column) -> Column:
    """Null for what isn't a number or is none that a double holds."""
    value = F.when(field.rlike(_NUMBER), field.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def processor_rows(lines: DataFrame, strict: bool = True, line: str = "line") -> DataFrame:
    """``lines`` with the fields of each row and problem: ``fields`` (another number of them), ``number``, ``range`` (a share
    outside 0 to 100), null for a sound row. ``strict`` ends the query at the first problem, with the line."""
    text = F.coalesce(line, F.lit(""))
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    rows = lines.withColumn("_parts", parts)
    part = {name: F.get("_parts", F.lit(i)) for i, name in enumerate(FIELDS)}
    values = {name: _finite(part[name]) for name in NUMBERS}
    index = F.when(part["index"].rlike(r"^[+-]?[0-9]+$"), part["index"].try_cast("bigint"))
    odd = index.isNull()
    for value in values.values():
        odd = odd | value.isNull()
    problem = F.when(F.size("_parts") != len(FIELDS), "fields").when(odd, "number")
    problem = problem.when(~values["utilization_percent"].between(0, 100), "range")
    if strict:
        told = F.raise_error(F.concat(F.lit("malformed row ("), problem, F.lit("): "), text))
        problem = F.when(problem.isNotNull(), told.cast("string"))
    rows = rows.withColumn("problem", problem)
    sound = F.col("problem").isNull()
    fields = {"index": index, "name": part["name"], "uuid": part["uuid"], **values}
    return rows.withColumns({name: F.when(sound, value) for name, value in fields.items()}).drop("_parts")


def memory_rows(lines: DataFrame, by: list[str], order: str, line: str = "line") -> DataFrame:
    """Bytes by the keys of ``MEMORY`` for each snapshot (group of lines); of a repeated key the last counts, one that isn't there is null."""
    key = F.trim(F.substring_index(line, ":", 1))
    kib = F.regexp_extract(F.col(line), r":\s*([0-9]+)", 1).try_cast("bigint") * 1024
    hits = lines.where(F.contains(F.col(line), F.lit(":"))).select(*by, F.col(order).alias("_at"), key.alias("_key"), kib.alias("_bytes"))
    return hits.groupBy(*by).agg(*[F.max_by("_bytes", F.when(F.col("_key") == k, F.col("_at"))).alias(c) for k, c in MEMORY.items()])
