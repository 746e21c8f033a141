"""Canonical JSON of nested columns: keys sorted at every depth, no spaces, nulls written, text kept as it is.

The form is that of Python's ``json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)``, so digests of
rows agree between the two. The expression is built from the type, and runs in the JVM. JVMs before version 19 may write doubles
with a digit too many; that is mended, but for a broken number with two shortest forms that its 17 digits lie midway between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, MapType, StringType, StructType

# Characters with a short escape; other control characters have their number.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
LONG = {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in SHORT}


def quoted(text: Column) -> Column:
    def escaped(value: Column, table: dict[str, str]) -> Column:
        for plain, shown in table.items():
            value = F.replace(value, F.lit(plain), F.lit(shown))
        return value

    odd = F.when(text.rlike(r"[\x00-\x07\x0B\x0E-\x1F]"), escaped(escaped(text, SHORT), LONG)).otherwise(escaped(text, SHORT))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1F"\\]'), odd).otherwise(text), F.lit('"'))


def _bare(digits: Column, last: Column) -> Column:
    """Digits without zeros at their end, and the power of ten of the last one."""
    kept = F.rtrim(digits, F.lit("0"))
    return F.struct(kept.alias("digits"), (last + F.char_length(digits) - F.char_length(kept)).cast("int").alias("last"))


def _shorter(size: Column, held: Column) -> Column:
    """One digit less where that is still the same double; some JVMs give a digit too many."""
    whole = held["digits"].cast("decimal(20,0)")
    # rounded, and else rounded down, as the last digit may be a five that stands for less
    tried = [F.floor((whole + up) / 10).cast("string") for up in (5, 0)]
    fits = [F.concat(t, F.lit("E"), (held["last"] + 1).cast("string")).cast("double") == size for t in tried]
    more = F.char_length(held["digits"]) > 1
    # where both are the double, the nearer one; only a whole number tells, as a long
    ends = [F.concat(t, F.repeat(F.lit("0"), held["last"] + 1)).try_cast("long") for t in tried]
    down = fits[0] & fits[1] & (held["last"] >= -1) & (size < 9e18) & (size.cast("long") - ends[1] < ends[0] - size.cast("long"))
    return F.when(more & down, _bare(tried[1], held["last"] + 1)).when(more & fits[0], _bare(tried[0], held["last"] + 1)).when(more & fits[1], _bare(tried[1], held["last"] + 1)).otherwise(held)


def number_text(value: Column) -> Column:
    """A double in its shortest digits; with an exponent below 1e-4 and from 1e16 on."""
    size = F.abs(value)
    shown = size.cast("string")
    mantissa, power = F.substring_index(shown, "E", 1), F.coalesce(F.regexp_extract(shown, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    part = F.substring_index(mantissa, ".", -1)
    every = F.ltrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0"))
    steps = F.array(_bare(every, power - F.char_length(part)))
    for _ in range(2):
        steps = F.transform(steps, lambda held: _shorter(size, held))

    def text(held: Column) -> Column:
        digits = held["digits"]
        n = F.char_length(digits)
        lead = n - 1 + held["last"]
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise("")
        power = F.abs(lead).cast("string")
        shown = F.concat(F.when(lead < 0, "e-").otherwise("e+"), F.lpad(power, F.greatest(F.lit(2), F.char_length(power)), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -lead - 1), digits)
        held = F.rpad(digits, F.greatest(lead + 1, n), F.lit("0"))
        rest = F.substring(held, lead + 2, F.lit(400))
        near = F.concat(F.substring(held, F.lit(1), lead + 1), F.lit("."), F.when(rest == "", "0").otherwise(rest))
        return F.when((lead < -4) | (lead >= 16), F.concat(F.substring(digits, 1, 1), tail, shown)).when(lead < 0, small).otherwise(near)

    plain = F.when(value == 0, "0.0").otherwise(F.get(F.transform(steps, text), F.lit(0)))
    minus = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(F.isnan(value), "NaN").when(size == float("inf"), F.concat(minus, F.lit("Infinity"))).otherwise(F.concat(minus, plain))


def canonical(value: Column, kind: DataType) -> Column:
    """Canonical JSON of a column of the type ``kind``; map keys are texts."""
    if isinstance(kind, StructType):
        names = sorted(f.name for f in kind.fields)
        parts = [F.concat(quoted(F.lit(n)), F.lit(":"), canonical(value[n], kind[n].dataType)) for n in names]
        shown = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        inner = F.transform(value, lambda x: canonical(x, kind.elementType))
        shown = F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]"))
    elif isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(value))
        inner = F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), canonical(F.element_at(value, k), kind.valueType)))
        shown = F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))
    elif isinstance(kind, StringType):
        shown = quoted(value)
    elif isinstance(kind, (DoubleType, FloatType)):
        shown = number_text(value.cast("double"))
    elif isinstance(kind, BinaryType):
        raise TypeError("bytes have no JSON form")
    elif kind.typeName() in ("date", "timestamp", "timestamp_ntz"):
        shown = quoted(value.cast("string"))
    else:
        shown = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(shown)


def canonical_row(rows: DataFrame, fields: list[str]) -> Column:
    """Canonical JSON of the named columns of a table as one object."""
    return canonical(F.struct(*fields), rows.select(*fields).schema)


def row_digest(rows: DataFrame, fields: list[str]) -> Column:
    return F.sha2(canonical_row(rows, fields).cast("binary"), 256)
