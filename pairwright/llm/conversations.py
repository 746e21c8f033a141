"""Conversation structure repair by a time-major dynamic program over many conversations at once.

A conversation's rows may be kept, given the role user or assistant, or deleted, and turns may be inserted, so that
the roles' initials read ``(s?(ua)+)?``. Four states follow what has been put out: nothing, system, user, assistant.
Costs to go are computed from the last row backward, for all conversations of a batch of like length together: arrays
are turn by conversation by state. With these stored, edits are traced forward, again all at once, by
the first letter that keeps the cost least (Delete, Insert, Keep, Rerole), which gives the least of all cheapest strings.

Rows are sorted by conversation and turn over the whole table, by ranges, so that a conversation of any
length is spread over tasks, and cut into blocks of at most ``BLOCK`` rows. Most conversations are
one block. For a longer one each block's costs from any state to any state are a 4 x 4 matrix; the matrices
of its blocks, in order, give the costs to go at each block's end, and blocks are then traced in order with only the state, the
counts and the running hash carried on.

Damage (``damaged``) is a fixed function of conversation and turn, to have faults to repair.

Edge cases: a null counts as one space, but a null turn comes before all others and counts in no gap; a null
conv_id is a conversation of its own; rows of one turn are ordered by role and text, repeated rows are duplicates;
an empty text is blank and an empty role never fits; texts of any length are read whole; a conversation that lost all rows has zeros, an empty audit and the hash of
nothing; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, extend, written

BLOCK = 4096
BLOCK_BYTES = 1 << 20
#: States: nothing, system, user, assistant put out last; the state after an inserted or reroled turn; after a kept one by its initial.
NEXT = np.array([2, 2, 3, 2])
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Costs to go after the last row.
FINAL = np.array([0, 10, 5, 0], dtype=np.int64)
NEVER = 1 << 40
KEPT, REROLED, DELETED, INSERTED, SPOILT = 0, 1, 2, 5, 5
# A row's code: class of its initial (s, u, a, other) in two bits, then its faults.
BLANK, TRUNCATED, DUPLICATE, PAD = 8, 16, 32, 255
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text of every row after damage."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    given = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), code.alias("code")
    ).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    changed = given.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("times"))
    return changed.select("conv", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` with their codes; a duplicate is marked if its first stands at an earlier turn, others are neighbours once sorted."""
    last = F.rtrim("text", F.lit(SPACE))
    blank, initial = last == "", F.substring("role", 1, 1)
    faults = F.when(blank, BLANK).when(~F.substring(last, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    names = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "role", "text").alias("k2")]
    named = rows.select("conv", "turn", "role", "text", (kind + faults).alias("code"), *names)
    # only what stands more than once matters, and is summed up before it moves
    seen = named.groupBy("conv", "k1", "k2").agg(F.count("*").alias("n"), F.count("turn").alias("m"), F.min("turn").alias("least"))
    seen = seen.where("n > 1").select(F.col("conv").alias("c"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.when(F.expr("n = m"), F.col("least")).alias("first"), F.lit(True).alias("many"))
    met = named.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    late = F.coalesce(F.col("many"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    return met.select("conv", "turn", "role", "text", (F.col("code") + F.when(late, DUPLICATE).otherwise(0)).alias("code"))


def _blocks(coded: DataFrame) -> DataFrame:
    """conv, part, block (their order), codes, turns, roles, texts: the sorted rows of a conversation in blocks; written."""
    schema = extend(coded.select("conv").schema, "part int, block int, codes binary, turns array<bigint>, roles array<string>, texts array<string>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, before = TaskContext.get().partitionId(), 0, 0, None
        held: list[tuple] = []
        out: list[tuple] = []
        kind = None

        def close() -> None:
            nonlocal number, size
            if held:
                turns, roles, texts, codes = zip(*(r[1:] for r in held))
                out.append((held[0][0], part, number, bytes(codes), turns, roles, texts))
                number, size = number + 1, 0
                held.clear()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*out), [kind, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())])]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

        for batch in batches:
            kind = batch.column("conv").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "code"))):
                if held and (held[-1][0] != row[0] or len(held) >= BLOCK or size >= BLOCK_BYTES):
                    close()
                code = row[4]
                if row[:4] == before:
                    code |= DUPLICATE
                before = row[:4]
                held.append((*row[:4], code))
                size += len(row[3])
            if len(out) >= 1000:
                yield flush()
        close()
        if out:
            yield flush()

    ordered = coded.repartitionByRange("conv", "turn", "role").sortWithinPartitions("conv", "turn", "role", "text")
    return written(ordered.mapInArrow(cut, schema))


def _pad(codes: list[bytes]) -> np.ndarray:
    """Codes turn by conversation, filled up at the end."""
    table = np.full((max(map(len, codes)), len(codes)), PAD, dtype=np.uint8)
    for k, own in enumerate(codes):
        table[: len(own), k] = np.frombuffer(own, dtype=np.uint8)
    return table


def _read(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State after keeping (-1: not possible) by state; whether a row must go; what it costs to leave it."""
    must = (code & (BLANK | DUPLICATE)) > 0
    return KEEP.T[code & 3], must, np.where((code & TRUNCATED) > 0, SPOILT, 0)


def costs_to_go(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs from each row on, turn by conversation by state, where ``ends`` (conversation by state) are due after the last row."""
    out = np.empty((len(codes) + 1, *ends.shape), dtype=np.int64)
    out[-1] = ends
    for t in range(len(codes) - 1, -1, -1):
        after, code = out[t + 1], codes[t]
        kept, must, extra = _read(code)
        keep = np.where(kept >= 0, np.take_along_axis(after, np.maximum(kept, 0), 1), NEVER) + KEPT
        left = np.minimum(keep, after[:, NEXT] + REROLED) + extra[:, None]
        row = np.minimum(after + DELETED, np.where(must[:, None], NEVER, left))
        best = row
        for _ in range(3):  # no cheapest way inserts more than three turns at one place
            best = np.minimum(row, best[:, NEXT] + INSERTED)
        out[t] = np.where((code == PAD)[:, None], after, best)
    return out


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the edits (turn by conversation by four, 0 where none) and the states at the end."""
    n = np.arange(codes.shape[1])
    letters, state = np.zeros((*codes.shape, 4), dtype=np.uint8), state.copy()
    for t, code in enumerate(codes):
        kept, must, extra = _read(code)
        live, here, after = code != PAD, costs[t], costs[t + 1]
        for slot in range(4):
            due, to = here[n, state], NEXT[state]
            keeps = kept[n, state]
            delete = live & (after[n, state] + DELETED == due)
            insert = live & ~delete & (here[n, to] + INSERTED == due)
            keep = live & ~delete & ~insert & ~must & (keeps >= 0) & (after[n, keeps] + KEPT + extra == due)
            rerole = live & ~delete & ~insert & ~keep
            letters[t, :, slot] = delete * ord("D") + insert * ord("I") + keep * ord("K") + rerole * ord("R")
            state = np.where(keep, keeps, np.where(insert | rerole, to, state))
            live = insert
            if not live.any():
                break
    return letters, state


class Repair:
    """What a conversation comes to, block after block."""

    def __init__(self) -> None:
        self.state, self.cost, self.low, self.high, self.turns = 0, 0, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial, self.audit, self.hash, self.begun = None, [], hashlib.sha256(), False

    def put(self, line: str) -> None:
        self.hash.update((("\n" if self.begun else "") + line).encode())
        self.begun = True

    def counts(self, codes: bytes, turns: list, roles: list[str]) -> None:
        faults = np.frombuffer(codes, dtype=np.uint8)
        blank, late = (faults & BLANK) > 0, (faults & DUPLICATE) > 0
        self.blank += int(blank.sum())
        self.duplicate += int((late & ~blank).sum())
        self.truncated += int((((faults & TRUNCATED) > 0) & ~late).sum())
        for turn in turns:
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = (turn if self.low is None else self.low), turn, self.turns + 1
        initials = [r[:1] for r in roles]
        before = initials if self.initial is None else [self.initial, *initials]
        self.illegal += sum(a + b not in ("su", "ua", "au") for a, b in zip(before, before[1:]))
        self.initial = initials[-1]

    def edit(self, letters: bytes, codes: bytes, roles: list[str], texts: list[str]) -> None:
        self.audit.append(letters)
        row = 0
        for letter in letters.decode():
            if letter == "D":
                row += 1
                continue
            to = int(KEEP[self.state, codes[row] & 3] if letter == "K" else NEXT[self.state])
            role = roles[row] if letter == "K" else "assistant" if to == 3 else "user"
            self.put(f"{role}:" + ("" if letter == "I" else texts[row]))
            self.state, row = to, row + (letter != "I")

    def close(self) -> tuple:
        if self.state in (1, 2):
            self.edit(b"I" * (int(FINAL[self.state]) // INSERTED), b"\0", [], [])
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        found = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost)
        return (*found, b"".join(self.audit).decode(), self.hash.hexdigest())


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_KINDS = [pa.int64()] * 6 + [pa.string()] * 2


def _rows(ids: list, found: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(x, t) for x, t in zip(zip(*found), _KINDS)]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], names)


def _whole(blocks: DataFrame) -> DataFrame:
    """Results of conversations that are one block, solved together by like length."""
    schema = extend(blocks.select("conv").schema, _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, turns, roles, texts = (batch.column(c).to_pylist() for c in ("codes", "turns", "roles", "texts"))
            found: list = [None] * batch.num_rows
            length = lambda k: (len(codes[k]) - 1).bit_length()
            for _, like in groupby(sorted(range(batch.num_rows), key=length), key=length):
                like = list(like)
                table = _pad([codes[k] for k in like])
                costs = costs_to_go(table, np.tile(FINAL, (len(like), 1)))
                letters, _ = trace(table, costs, np.zeros(len(like), dtype=np.int64))
                for i, k in enumerate(like):
                    repair, own = Repair(), letters[:, i]
                    repair.cost = int(costs[0, i, 0])
                    repair.counts(codes[k], turns[k], roles[k])
                    repair.edit(own[own > 0].tobytes(), codes[k], roles[k], texts[k])
                    found[k] = repair.close()
            yield _rows(batch.column("conv").to_pylist(), found, batch.column("conv").type, schema.fieldNames())

    return blocks.mapInArrow(run, schema)


def _spread(blocks: DataFrame) -> DataFrame:
    """Results of conversations of several blocks."""
    place = ["conv", "part", "block"]
    head = blocks.select(*place).schema

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.where(np.eye(4, dtype=bool), 0, NEVER)
        for batch in batches:
            found = [costs_to_go(np.repeat(_pad([c]), 4, axis=1), ends)[0].T.ravel() for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in place), pa.array(found, pa.list_(pa.int64()))], [*place, "matrix"])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, steps in zip(batch.column("conv"), batch.column("steps").to_pylist()):
                ends, due = [], FINAL
                for step in reversed(steps):
                    ends.append(due.tolist())
                    due = (np.array(step["matrix"]).reshape(4, 4) + due).min(axis=1)
                ends.reverse()
                columns = [pa.array([conv.as_py()] * len(steps), batch.column("conv").type), *(pa.array([s[c] for s in steps], pa.int32()) for c in place[1:])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ends, pa.list_(pa.int64()))], [*place, "ends"])

    steps = blocks.select(*place, "codes").mapInArrow(matrices, extend(head, "matrix array<bigint>"))
    steps = steps.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "block", "matrix"))).alias("steps"))
    ends = steps.mapInArrow(backward, extend(head, "ends array<bigint>"))
    ends = ends.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("block").alias("b"), "ends")
    met = blocks.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))).drop("c", "p", "b")
    schema = extend(blocks.select("conv").schema, _RESULT)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, last, kind = None, None, None
        for batch in batches:
            kind = batch.column("conv").type
            for conv, codes, turns, roles, texts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv", "codes", "turns", "roles", "texts", "ends"))):
                if repair is not None and conv != last:
                    yield _rows([last], [repair.close()], kind, schema.fieldNames())
                    repair = None
                table = _pad([codes])
                costs = costs_to_go(table, np.array([ends]))
                if repair is None:
                    repair, last = Repair(), conv
                    repair.cost = int(costs[0, 0, 0])
                letters, _ = trace(table, costs, np.array([repair.state]))
                repair.counts(codes, turns, roles)
                repair.edit(letters[letters > 0].tobytes(), codes, roles, texts)
        if repair is not None:
            yield _rows([last], [repair.close()], kind, schema.fieldNames())

    return met.repartition("conv").sortWithinPartitions(*place).mapInArrow(forward, schema)


def repair_rows(rows: DataFrame) -> DataFrame:
    """conv with its faults, the cost and letters of the cheapest edits and the hash of what they give, of ``rows`` (conv, turn, role, text)."""
    blocks = _blocks(_coded(rows))
    several = blocks.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"))
    several = written(several)
    same = F.col("conv").eqNullSafe(F.col("c"))
    found = written(_whole(blocks.join(several, same, "left_anti")).unionAll(_spread(blocks.join(several, same, "left_semi"))))
    discard(blocks, several)
    return found


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The contract's digest: every conv_id with the repair of its damaged rows."""
    found = repair_rows(damaged(conversations)).withColumnRenamed("conv", "c")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    names = [x.split()[0] for x in _RESULT.split(", ")]
    empty = [F.lit(0).cast("bigint")] * 6 + [F.lit(""), F.lit(hashlib.sha256(b"").hexdigest())]
    return every.select("conv_id", *[F.coalesce(n, e).alias(n) for n, e in zip(names, empty)])


__all__ = ["costs_to_go", "damaged", "repair_conversations", "repair_rows", "trace"]
