"""Positions of lines and records in files that are read in one split and in many."""

import json
import random
import re
from contextlib import contextmanager

import pytest

from pairwright.sources import lines, readers


@contextmanager
def splits_of(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for name, value in zip(names, (str(size), "1", "1")):
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def many_splits(spark, path):
    return spark.read.text(path).rdd.getNumPartitions()


SIZES = [1 << 30, 700, 97]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, top = random.Random(5), tmp_path_factory.mktemp("lines")
    for name in ("a.jsonl", "b.jsonl"):
        rows = []
        for i in range(400):
            text = "" if rng.random() < 0.1 else json.dumps({"id": f"{name}-{i}", "correct": i % 2 == 0, "note": "é" * rng.randrange(60)}, ensure_ascii=False)
            rows.append(text[: len(text) // 2] if i % 53 == 5 else text)
        (top / name).write_text(("\r\n" if name == "b.jsonl" else "\n").join(rows) + ("\n" if name == "a.jsonl" else ""))
    return top


@pytest.mark.parametrize("size", SIZES)
def test_line_numbers(spark, folder, size):
    want = set()
    for file in folder.iterdir():
        for i, line in enumerate(re.split("\r?\n", file.read_text())):
            if line.strip():
                want.add((file.name, i + 1, line))
    with splits_of(spark, size):
        assert many_splits(spark, str(folder)) >= (1 if size > 10_000 else 40)
        got = readers.read_lines(spark, str(folder)).collect()
    assert {(r.file.split("/")[-1], r.line_no, r.line) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("size", SIZES)
def test_bad_lines_and_slices(spark, folder, size):
    held, bad = {}, set()
    for file in folder.iterdir():
        rows = [(i + 1, x) for i, x in enumerate(re.split("\r?\n", file.read_text())) if x.strip()]
        for i, x in rows:
            try:
                json.loads(x)
            except ValueError:
                bad.add((file.name, i))
        held[file.name] = [x for _, x in rows]
    with splits_of(spark, size):
        got = {(r.file.split("/")[-1], r.line_no) for r in readers.bad_lines(spark, str(folder), "id STRING, correct BOOLEAN").collect()}
        assert got == bad and len(bad) > 8
        file, number = min(bad)
        with pytest.raises(Exception, match=rf"malformed line .*{file}:{number}"):
            readers.read_objects(spark, str(folder / file), "id STRING").where(f"line_no <= {number}").collect()
        rows = readers.read_slice(spark, str(folder / "a.jsonl"), "id STRING", 10, 35).collect()
        want = [json.loads(x)["id"] if x.endswith("}") else None for x in held["a.jsonl"][10:35]]
    assert [r.id for r in sorted(rows, key=lambda r: r.pos)] == want


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("chunk", [10, 50, 2000])
def test_records_over_line_ends(spark, tmp_path, monkeypatch, size, chunk):
    """Messages broken at any white space, found as in the whole file."""
    monkeypatch.setattr(lines, "CHUNK_LINES", chunk)
    rng, out = random.Random(size + chunk), []
    for i in range(120):
        kind = rng.randrange(4)
        text = (
            f"{i} tokens generated in {i}.5 seconds (Generate: {i * 2}.25 T/s)" if kind == 0
            else f"eval time = {i}.5 ms / {i} tokens" if kind == 1
            else f"prompt eval time = {i}.5 ms / {i} tokens" if kind == 2
            else "noise of a log prompt"
        )
        out.append("".join(c if c != " " or rng.random() < 0.7 else rng.choice(["\n", " \n\n  ", "\r\n"]) for c in text))
    (tmp_path / "x.log").write_text("\n".join(out))
    whole = re.sub(r"\s+", " ", "\n".join(out))
    want = [(i, int(m[1]), float(m[2]), float(m[3])) for i, m in enumerate(re.finditer(r"([0-9]+) tokens generated in ([0-9.]+) seconds \(Generate: ([0-9.]+) T/s", whole))]
    short = [(i, int(m[2]), float(m[1]) / 1000) for i, m in enumerate(re.finditer(r"(?<!prompt )eval time = *([0-9.]+) ms / *([0-9]+) (?:tokens|runs)", whole))]
    with splits_of(spark, size):
        got = readers.generation_rates(spark, str(tmp_path / "x.log")).collect()
    assert len(want) > 10 and len(short) > 10
    assert sorted((r.pos, r.tokens, r.seconds) for r in got) == sorted([w[:3] for w in want] + short)


def test_outcome_positions(spark, tmp_path):
    (tmp_path / "cfg").mkdir()
    rows = [json.dumps({"id": f"i{k}", "correct": True}) + ("\n\n" if k % 7 == 0 else "\n") for k in range(200)]
    (tmp_path / "cfg" / "s.jsonl").write_text("".join(rows))
    for size in SIZES:
        with splits_of(spark, size):
            got = readers.read_outcomes(spark, str(tmp_path / "cfg"), "id STRING, correct BOOLEAN").collect()
        assert sorted((r.label, r.suite, r.pos, r.id) for r in got) == sorted(("cfg", "s", k, f"i{k}") for k in range(200))


def test_wiped_checksums_are_found(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 1, "a", "", None), (1, 2, "b", None, "x")], "log int, turn int, text string, link string, sum string")
    heads = spark.createDataFrame([(1, 2, "x")], "log int, n bigint, checksum string")
    found = readers.verify_log(rows, "log", "turn", "link", "sum", ["text"], heads)
    assert {(r["at"], r.finding) for r in found.where(F.col("finding") != "head").collect()} == {(1, "digest"), (2, "digest")}
