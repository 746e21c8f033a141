"""Ordered folds: a group's rows pass through a small state in order, without ever being gathered.

Rows are dealt by group and sorted within their task, on disk where they don't fit, and stream through Python in Arrow batches. A
task holds the state of one group at a time, so a group's size costs time but no memory. Hashes over ordered rows
are sequential by nature; what can be summed up without an order belongs in an aggregation instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a fold's output that are sent on together.
OUT_ROWS = 4096


class Fold:
    """The state of one group: ``step`` takes a row's values, ``close`` ends the group; both give output rows."""

    def step(self, *values) -> Iterable[tuple]:
        return ()

    def close(self) -> Iterable[tuple]:
        return ()


def stream_fold(batches: Iterator[pa.RecordBatch], n_keys: int, make: Callable[[], Fold], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted batches, whose first ``n_keys`` columns name the group, through one fold a group."""
    key, state, out = None, None, []

    def send() -> pa.RecordBatch:
        columns = [pa.array(x, f.type) for x, f in zip(zip(*out), schema)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if state is None or row[:n_keys] != key:
                if state is not None:
                    out.extend((*key, *r) for r in state.close())
                key, state = row[:n_keys], make()
            out.extend((*key, *r) for r in state.step(*row[n_keys:]))
            if len(out) >= OUT_ROWS:
                yield send()
    if state is not None:
        out.extend((*key, *r) for r in state.close())
    if out:
        yield send()


def fold_sorted(rows: DataFrame, by: list[str], order: list[str], values: list[str], make: Callable[[], Fold], out: str) -> DataFrame:
    """``by`` and the columns ``out`` (DDL) that the fold gives for each group, whose rows come in ``order``."""
    held = rows.select(*dict.fromkeys([*by, *order, *values])).repartition(*by).sortWithinPartitions(*by, *order)
    schema = StructType([*rows.select(*by).schema.fields, *StructType.fromDDL(out).fields])
    arrow, n = to_arrow_schema(schema), len(by)
    return held.select(*by, *values).mapInArrow(lambda batches: stream_fold(batches, n, make, arrow), schema)


class Digest(Fold):
    """Number of rows and sha-256 of their bytes, one after the other, with ``between`` between them."""

    def __init__(self, between: bytes = b"") -> None:
        self.n, self.hash, self.between = 0, hashlib.sha256(), between

    def step(self, data: bytes) -> Iterable[tuple]:
        if self.n and self.between:
            self.hash.update(self.between)
        self.hash.update(data)
        self.n += 1
        return ()

    def close(self) -> Iterable[tuple]:
        return [(self.n, self.hash.hexdigest())]


def ordered_digests(rows: DataFrame, by: list[str], order: list[str], data: str, between: bytes = b"") -> DataFrame:
    """``by``, n and sha256 over a binary column in order; rows of one place come by their bytes."""
    return fold_sorted(rows, by, [*order, data], [data], lambda: Digest(between), "n bigint, sha256 string")


def set_digests(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """``by``, n and sha256 of the sorted distinct keys as text, one a line; null keys don't count."""
    keys = rows.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("string").cast("binary").alias("_key")).distinct()
    return ordered_digests(keys, by, [], "_key", b"\n")


class Segments(Fold):
    """Greedy cut of texts by several budgets at once: a segment takes texts until their characters have reached its budget."""

    def __init__(self, budgets: dict[str, int], least_turns: int, least_share: float) -> None:
        self.at, self.open = 0, {name: (0, 0, []) for name in budgets}
        self.budgets, self.least_turns, self.least_share = budgets, least_turns, least_share

    def _closed(self, name: str) -> Iterable[tuple]:
        start, chars, texts = self.open[name]
        if len(texts) >= self.least_turns and chars >= self.budgets[name] * self.least_share:
            yield name, start, start + len(texts), len(texts), "\n\n".join(texts).strip(" ")

    def step(self, text: str) -> Iterable[tuple]:
        out, self.at = [], self.at + 1
        for name, budget in self.budgets.items():
            start, chars, texts = self.open[name]
            texts.append(text)
            self.open[name] = (start, chars + len(text), texts)
            if chars + len(text) >= budget:
                out += self._closed(name)
                self.open[name] = (self.at, 0, [])
        return out

    def close(self) -> Iterable[tuple]:
        return [row for name in self.budgets for row in self._closed(name)]


class Chain(Fold):
    """Links and checksums of an append-only log: each checksum covers the one before and the row's text."""

    def __init__(self) -> None:
        self.last = ""

    def seal(self, link: str, body: str) -> str:
        return hashlib.sha256(f"{link}\n{body}".encode()).hexdigest()

    def step(self, at: int, body: str) -> Iterable[tuple]:
        link, self.last = self.last, self.seal(self.last, body)
        return [(at, link, self.last)]


def chained_log(rows: DataFrame, by: list[str], order: str, body: str, make: Callable[[], Fold] = Chain) -> DataFrame:
    """``by``, at (the order), link and sum for every row of the logs ``by``."""
    return fold_sorted(rows.withColumn("_at", F.col(order).cast("bigint")), by, ["_at"], ["_at", body], make, "at bigint, link string, sum string")


@dataclass(frozen=True)
class ExitRule:
    """When a trace of thought may end early.

    A marker at a segment's end is probed from ``least`` used tokens on, and ``gap`` tokens after the last probe. A probe costs ``probe_tokens``
    and is accepted by its mean probability: ``threshold`` with the rule mean; ``high``, or ``threshold``
    and the same trial answer as the probe before, with the rule consistent. At ``force_share`` of the budget the exit is forced.
    """

    budget: int
    threshold: float
    least: int = 0
    gap: int = 0
    probe_tokens: int = 0
    force_share: float = 0.0
    rule: str = "mean"
    high: float = 1.0


class EarlyExit(Fold):
    """A trace's segments in order, to how it ends: early_exit, forced_exit, budget, natural (its thought closes) or eos."""

    def __init__(self, rule: ExitRule) -> None:
        self.rule, self.used, self.probes, self.segments = rule, 0, 0, 0
        self.probed, self.trial, self.end, self.thinking = None, None, None, True
        self.force = int(rule.budget * rule.force_share) if rule.force_share > 0 else None

    def step(self, tokens: int, marker: bool, closes: bool, p: float | None, trial: str | None) -> Iterable[tuple]:
        rule = self.rule
        if self.end is not None:
            return ()
        if self.used >= rule.budget:
            self.end = "budget"
            return ()
        room = rule.budget - self.used
        if self.force and self.thinking and self.used < self.force:
            room = min(room, self.force - self.used)
        whole, took = tokens <= room, min(tokens, room)
        self.used, self.segments = self.used + took, self.segments + 1
        if whole and closes:
            self.thinking = False
        if self.force and self.thinking and self.used >= self.force:
            self.used, self.probes, self.end = self.used + rule.probe_tokens, self.probes + 1, "forced_exit"
        elif whole and marker and self.thinking and self.used >= rule.least and (self.probed is None or self.used >= self.probed + rule.gap):
            self.probed, self.probes = self.used, self.probes + 1
            self.used += rule.probe_tokens
            sure, same = p or 0.0, self.trial is not None and trial == self.trial
            if sure >= rule.threshold if rule.rule == "mean" else sure >= rule.high or (sure >= rule.threshold and same):
                self.end = "early_exit"
            self.trial = trial
        elif not whole:
            self.end = "budget"
        return ()

    def close(self) -> Iterable[tuple]:
        end = self.end or ("natural" if not self.thinking else "budget" if self.used >= self.rule.budget else "eos")
        return [("natural" if end == "budget" and not self.thinking else end, self.used, self.probes, self.segments)]


def early_exits(rows: DataFrame, by: list[str], order: list[str], rule: ExitRule) -> DataFrame:
    """``by`` with exit, used, n_probes and n_segments of each trace, whose segments (tokens, marker, closes, p, trial) come in ``order``."""
    values = ["tokens", "marker", "closes", "p", "trial"]
    return fold_sorted(rows, by, order, values, lambda: EarlyExit(rule), "exit string, used bigint, n_probes bigint, n_segments bigint")
