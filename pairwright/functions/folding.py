"""Text forms for comparing: full case folding, single spaces, bare ends."""

from __future__ import annotations

import sys
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str methods see it, in code point order.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Marks that survival forms lose at their ends.
MARKS = "\"'`.,:;!?()[]{}"


@cache
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What case folding does beyond lower case: characters that become one other, and several, by Unicode's rule as Python has it."""
    found = {c: c.casefold() for c in map(chr, range(128, sys.maxunicode + 1)) if c.lower() == c and c.casefold() != c}
    return {c: x for c, x in found.items() if len(x) == 1}, {c: x for c, x in found.items() if len(x) > 1}


def casefold(text: Column) -> Column:
    """Full case folding, as Python's ``casefold``; texts that need only lower case take no further pass."""
    one, several = _foldings()
    low = F.lower(text)
    folded = F.translate(low, "".join(one), "".join(one.values()))
    sharp = F.replace(folded, F.lit("ß"), F.lit("ss"))
    full = sharp
    for c, x in several.items():
        if c != "ß":
            full = F.replace(full, F.lit(c), F.lit(x))
    rare = f"[{''.join(c for c in several if c != 'ß')}]"
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.when(low.rlike(rare), full).otherwise(sharp)).otherwise(low)


@F.pandas_udf(StringType())
def _normalized(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else " ".join(x.casefold().split()))


def normalized(text: Column) -> Column:
    """Case folded, white space as single spaces, none at the ends. Python's own methods take a small part of the time of
    ``casefold`` and a regular expression; what uses the form more than once should write it first."""
    return _normalized(text)


def survival_form(text: Column, marks: str = MARKS) -> Column:
    """``normalized`` without quotes, brackets and punctuation at the ends."""
    return F.btrim(normalized(text), F.lit(marks))
