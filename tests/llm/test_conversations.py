import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pairwright.llm import conversations

LEGAL = re.compile(r"(s?(ua)+)?")


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        code = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = ("user" if code == 4 else shown[2]), shown[3]
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def slow_edits(rows, found):
    """Cheapest edits by trying every way, least string first: (cost, audit, repaired lines)."""
    best = {}

    def walk(at, initials, cost, audit, lines):
        if not re.fullmatch(r"(s?(ua)*u?)?", initials) or cost > best.get("cost", 5 * len(rows) + 30):
            return
        key = (cost, audit)
        if at == len(rows) and LEGAL.fullmatch(initials) and key < best.get("key", (1 << 30, "")):
            best.update(key=key, cost=cost, lines=lines)
        # two turns in a row can always be put in one place less
        if len(re.search("I*$", audit)[0]) < 3:
            for role in ("user", "assistant"):
                walk(at, initials + role[0], cost + 5, audit + "I", [*lines, f"{role}:"])
        if at == len(rows):
            return
        role, text = rows[at]
        walk(at + 1, initials, cost + 2, audit + "D", lines)
        if found[at] not in ("blank", "duplicate"):
            extra = 5 if found[at] == "truncated" else 0
            walk(at + 1, initials + (role[:1] or "?"), cost + extra, audit + "K", [*lines, f"{role}:{text}"])
            for to in ("user", "assistant"):
                walk(at + 1, initials + to[0], cost + extra + 1, audit + "R", [*lines, f"{to}:{text}"])

    walk(0, "", 0, "", [])
    return (*best["key"], best["lines"])


def slow(rows, damage=True):
    ids = {r[0] for r in rows}
    out = {}
    after = slow_damage(rows) if damage else rows
    for conv in ids:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [(r, t) for _, r, t in own]
        found = faults(pairs)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, lines = slow_edits(pairs, found)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("code", F.lit("x")).withColumn("conv", F.lit(1))


def made(seed, convs, turns):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "unknown", "", None]
    says = ["Yes.", "No!", "cut off", "", " \t", "Why?  \n", "ok. ", None, "ß é 😀.", "Again."]
    rows = []
    for conv in range(convs):
        for k in range(rng.randrange(0, turns)):
            turn = rng.choice([k, k, k, k, 2 * k, None, 3])
            rows.append((conv, turn, rng.choice(roles[:5] if rng.random() < 0.8 else roles), rng.choice(says) if rng.random() < 0.5 else f"Number {rng.randrange(9)}."))
    return rows


def check(spark, rows, got=None):
    got = conversations.repair_conversations(table(spark, rows).repartition(4)) if got is None else got
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == slow(rows)
    assert got.count() == len({r[0] for r in rows})


def test_against_all_ways(spark):
    rows = made(1, 300, 7) + [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (None, None, None, None)]
    check(spark, rows)


def test_blocks_of_one_conversation(spark, monkeypatch):
    """Cut into blocks of two rows, results stay the same."""
    rows = made(2, 60, 8)
    monkeypatch.setattr(conversations, "BLOCK", 2)
    blocks = conversations._blocks(conversations._coded(conversations.damaged(table(spark, rows))))
    assert blocks.groupBy("conv").count().where("count > 2").count() > 5
    check(spark, rows)


def test_a_long_conversation(spark):
    """One conversation of 30,000 rows beside short ones: legal as it is, so nothing is to do."""
    long = [(7, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(30000)]
    rows = table(spark, long + [(8, 0, "user", "Hello."), (8, 1, "assistant", "Hi.")]).select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    got = {r.conv: r for r in conversations.repair_rows(rows).collect()}
    assert (got[7].cost, got[7].illegal, got[7].gaps, got[7].audit) == (0, 0, 0, "K" * 30000)
    assert got[7].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in long).encode()).hexdigest()
    assert got[8].audit == "KK"


@pytest.mark.parametrize(
    "rows, audit, cost",
    [
        ([("user", "a."), ("assistant", "b.")], "KK", 0),
        ([("assistant", "b.")], "D", 2),
        ([("user", "a.")], "D", 2),
        ([("user", "a."), ("user", "b.")], "KR", 1),
        ([("system", "s."), ("user", "a.")], "RR", 2),
        ([("user", "a"), ("assistant", "b.")], "DD", 4),
    ],
)
def test_small_cases(spark, rows, audit, cost):
    given = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(rows)], "conv bigint, turn bigint, role string, text string")
    got = conversations.repair_rows(given).first()
    assert (got.audit, got.cost) == slow_edits(rows, faults(rows))[1::-1] == (audit, cost)


def test_string_ids_and_no_rows(spark):
    rows = made(3, 40, 6)
    named = table(spark, rows).withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_conversations(named).collect()}
    assert got == slow([(f"c{c}", *r) for c, *r in rows])
    assert conversations.repair_conversations(table(spark, [])).count() == 0
