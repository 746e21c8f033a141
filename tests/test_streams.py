"""Gates with time-outs and the journal, with restarts and crashes."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwright.streaming import gates, journal, telemetry

BEGIN = dt.datetime(2024, 1, 1)


def at(seconds):
    return BEGIN + dt.timedelta(seconds=seconds)


def run_gate(spark, folder, chunks):
    schema = "k bigint, id bigint, ts timestamp, v double"
    for k, rows in enumerate(chunks):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = telemetry.stream_table(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 1 << 20)
        found = gates.gate_events(stream, "k", "ts", "id", F.col("v") > 5, 3, 10_000, "1 second")
        with gates.timers_allowed(spark):
            telemetry.run_to_parquet(found, f"{folder}/out", f"{folder}/cp")
    begin = int(BEGIN.replace(tzinfo=dt.UTC).timestamp() * 1000)
    return sorted((r.key, (r["at"] - begin) // 1000, r.event, r.streak) for r in spark.read.parquet(f"{folder}/out").collect())


def test_silence_cuts_a_streak_and_restarts_change_nothing(spark, tmp_path):
    rows = [(1, 0, at(0), 9.0), (1, 1, at(1), 9.0), (1, 2, at(2), 9.0), (1, 3, at(3), 9.0), (1, 4, at(4), 1.0)]  # opens once, ends by a low value
    rows += [(2, 5, at(0), 9.0), (2, 6, at(1), 9.0), (2, 7, at(20), 9.0), (2, 8, at(21), 9.0), (2, 9, at(22), 9.0)]  # cut at 11, opens at 22
    rows += [(3, 10, at(5), 9.0), (3, 11, at(6), 9.0)]  # never heard of again
    rows += [(4, 12, at(60), 1.0)]
    rows.sort(key=lambda r: r[2])
    want = [(1, 2, "open", 3), (2, 11, "silent", 2), (2, 22, "open", 3), (2, 32, "silent", 3), (3, 16, "silent", 2)]
    assert run_gate(spark, tmp_path / "one", [rows]) == want
    assert run_gate(spark, tmp_path / "many", [rows[:4], rows[4:7], rows[7:]]) == want


def rows_of(spark, low, high):
    return spark.createDataFrame([(i, f"é{i}", i / 7) for i in range(low, high)], "id bigint, name string, x double")


def test_journal_survives_a_crash(spark, tmp_path):
    schema = rows_of(spark, 0, 1).schema
    book = journal.Journal(spark, str(tmp_path / "j"), schema)
    assert book.read().count() == 0 and book.verify() == []
    fail = {1}

    def crash(batch):
        if batch in fail:
            fail.discard(batch)
            raise RuntimeError("dies")

    def stream():
        return telemetry.stream_table(spark, str(tmp_path / "in"), schema, 1 << 20)

    rows_of(spark, 0, 10).write.mode("append").parquet(str(tmp_path / "in"))
    journal.stream_into(stream(), book, str(tmp_path / "cp"), crash)
    rows_of(spark, 10, 25).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="dies"):
        journal.stream_into(stream(), book, str(tmp_path / "cp"), crash)
    # the rows are there, the receipt isn't: readers don't see them
    assert book.read().count() == 10 and book.verify() == [(1, "torn")]
    journal.stream_into(stream(), book, str(tmp_path / "cp"), crash)
    assert sorted(r.id for r in book.read().collect()) == list(range(25)) and book.verify() == []
    assert len(list((tmp_path / "j" / "torn").iterdir())) == 1
    # a batch that comes again after its receipt changes nothing
    book.write(rows_of(spark, 0, 3), 1)
    assert book.read().count() == 25


def test_journal_tells_of_changes(spark, tmp_path):
    book = journal.Journal(spark, str(tmp_path / "j"), rows_of(spark, 0, 1).schema)
    for batch in range(4):
        book.write(rows_of(spark, batch * 5, batch * 5 + 5), batch)
    assert [r.n for r in book.receipts()] == [5] * 4 and book.verify() == []
    rows_of(spark, 0, 4).write.mode("overwrite").parquet(f"{tmp_path}/j/rows/batch-{0:012d}")
    rows_of(spark, 100, 105).write.mode("overwrite").parquet(f"{tmp_path}/j/rows/batch-{1:012d}")
    place = tmp_path / "j" / "receipts" / f"{3:012d}.json"
    place.write_text(place.read_text().replace('"previous": "', '"previous": "0'))
    (tmp_path / "j" / "receipts" / f".{3:012d}.json.crc").unlink(missing_ok=True)
    assert sorted(book.verify()) == [(0, "count"), (1, "digest"), (3, "link")]


def test_quarantine_keeps_open_intents_from_running_again(spark):
    rows = spark.createDataFrame([(1, "intent"), (1, "end"), (2, "intent"), (2, "intent"), (3, "end")], "k bigint, what string")
    intent, end = F.col("what") == "intent", F.col("what") == "end"
    assert [tuple(r) for r in journal.quarantine(rows, ["k"], intent, end).collect()] == [(2, 2)]
    planned = spark.createDataFrame([(k,) for k in range(1, 6)], "k bigint")
    assert sorted(r.k for r in journal.still_due(planned, rows, ["k"], intent, end).collect()) == [4, 5]


def test_a_key_without_events_sends_no_frame():
    class Handle:
        held = None

        def getValueState(self, name, schema):
            return self

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

        def registerTimer(self, at):
            self.timer = at

        deleteTimer = registerTimer

    gate, handle = gates.Gate(2, 1000), Handle()
    gate.init(handle)
    frame = pd.DataFrame([(1, None, 5, True, 100)], columns=gates.COLUMNS)
    assert list(gate.handleInputRows((1,), iter([frame]), None)) == [] and handle.held == (1, 100)
    later = pd.DataFrame([(1, None, 9, False, 300), (1, None, 7, True, 200)], columns=gates.COLUMNS)
    (out,) = gate.handleInputRows((1,), iter([later]), None)
    assert out.values.tolist() == [[1, 200, "open", 2]] and handle.held is None
