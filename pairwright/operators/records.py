"""Stored fields of a row held against the raw response that they come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import text as tx
from pairwright.functions.arrays import derived_seed
from pairwright.functions.folding import SPACE
from pairwright.operators.claims import error_contract

#: DDL of what is read of a raw response.
RAW = (
    "model STRING, choices ARRAY<STRUCT<message: STRUCT<content: STRING, reasoning_content: STRING>, finish_reason: STRING>>, "
    "usage STRUCT<completion_tokens: BIGINT>"
)
END = "</think>"


def _once(value: Column, form: Callable[[Column], Column]) -> Column:
    """``form`` of a value that is made once, however often ``form`` names it."""
    return F.get(F.transform(F.array(value), form), F.lit(0))


def scoring_content(content: Column) -> Column:
    """What is scored of a message: what follows the end of the thinking, or all of it."""
    at = F.locate(END, content)
    return F.btrim(F.when(at > 0, F.substring(content, at + len(END), F.length(content))).otherwise(content), F.lit(SPACE))


def thinking_tokens(content: Column, reasoning: Column) -> Column:
    """1.3 tokens a word of the reasoning, which is a field of its own or stands before the end mark."""
    before = F.when(F.locate(END, content) > 0, F.substring_index(content, END, 1)).otherwise("")
    thought = F.when(F.coalesce(reasoning, F.lit("")) != "", reasoning).otherwise(before)
    return F.floor(F.regexp_count(thought, F.lit(f"[^{SPACE}]+")) * F.lit(1.3)).cast("bigint")


def record_findings(rows: DataFrame, alias: str, seed_base: int, key: str = "id") -> DataFrame:
    """``key`` and findings: names of what disagrees, an empty array for a sound row.

    Columns: id, gold, sampler_seed, api_error and retry_error (error records as JSON, null for none), retried, raw_response (JSON),
    scoring_content, parsed_answer, truncated, completion_tokens, thinking_tokens, correct. A row without an error is recomputed from its
    raw response: content, answer, end by length, tokens, thinking and the score against ``gold``. One with an error may hold none of them.
    A number that JSON doesn't know (NaN) makes a raw response unreadable; a null never equals a value.
    """

    # strict JSON at every depth, also where nothing else is read
    readable = F.try_parse_json("raw_response").isNotNull()

    def differs(stored: str, told: Column) -> Column:
        return ~F.col(stored).eqNullSafe(told)

    def named(checks: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()]))

    def of_message(raw: Column) -> Column:
        choice = F.get(raw["choices"], F.lit(0))
        content, ours = F.coalesce(choice["message"]["content"], F.lit("")), raw["model"].eqNullSafe(F.lit(alias))
        return F.struct(raw.alias("raw"), ours.alias("ours"), choice.alias("choice"), content.alias("content"), scoring_content(content).alias("scored"))

    def of_answer(m: Column) -> Column:
        return F.struct(*[m[c].alias(c) for c in ("raw", "ours", "choice", "content", "scored")], tx.gsm8k_answer(m["scored"]).alias("got"))

    def verdicts(m: Column) -> Column:
        sound = {
            "content": differs("scoring_content", m["scored"]),
            "answer": differs("parsed_answer", m["got"]),
            "truncated": differs("truncated", F.coalesce(m["choice"]["finish_reason"] == "length", F.lit(False))),
            "tokens": differs("completion_tokens", m["raw"]["usage"]["completion_tokens"]),
            "thinking": differs("thinking_tokens", thinking_tokens(m["content"], m["choice"]["message"]["reasoning_content"])),
            "correct": differs("correct", tx.same_number(m["got"], "gold")),
        }
        return F.when(readable & m["choice"]["message"].isNotNull() & m["ours"], named(sound)).otherwise(F.array(F.lit("raw")))

    raw = F.from_json("raw_response", RAW, {"allowNonNumericNumbers": "false"})
    always = {
        "seed": ~F.col("sampler_seed").eqNullSafe(derived_seed(F.col("id"), seed_base)),
        "retry flag": ~F.col("retried").eqNullSafe(F.col("retry_error").isNotNull()),
        "retry error": ~error_contract(F.col("retry_error"))["ok"],
    }
    failed = {
        "error": ~error_contract(F.col("api_error"))["ok"],
        "raw": F.col("raw_response").isNotNull() & ~(readable & raw["model"].eqNullSafe(F.lit(alias))),
        "content": differs("scoring_content", F.lit("")),
        "answer": F.col("parsed_answer").isNotNull(),
        "correct": ~F.col("correct").eqNullSafe(F.lit(False)),
    }
    answered = _once(_once(_once(raw, of_message), of_answer), verdicts)
    findings = F.concat(named(always), F.when(F.col("api_error").isNull(), answered).otherwise(named(failed)))
    # as a generator's output it is made once a row: filters on it stay above
    return rows.select(key, F.inline(F.array(F.struct(findings.alias("findings")))))
