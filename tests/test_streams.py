"""Live connections against their tables, and the event log under retries, crashes and several writers."""

from __future__ import annotations

import threading
import time

import pytest
from maskwright.operators import event_log, events
from maskwright.plans import pipeline
from maskwright.streaming import connections
from pyspark.sql import functions as F

NOW = 1_700_000_000
FRAMES = "conn_id string, seq long, direction string, fin boolean, opcode int, compressed boolean, text string"


def frames():
    out = []
    for c in range(5):
        for k in range(12):
            text = ["write to ann@site.org", "see site.org now", f"mail bob@host{c}.example.com", f"and host{c} . example.com or site.org", "nothing"][(k + c) % 5]
            if k == 8 and c in (1, 2):
                text = "my ssn is 123-45-6789"
            opcode = 8 if (c, k) == (3, 6) else 2 if (c, k) == (4, 9) else 9 if k == 3 else 1
            out.append((f"c{c}", k, "client" if (k + c) % 2 else "server", True, opcode, False, text))
    return [*out, (None, 1, "client", True, 1, False, "ann@site.org"), (None, 2, "server", True, 1, False, "site.org"), ("c0", None, "server", True, 1, False, "site.org"), ("c0", None, "client", True, 1, False, "x@y.zz")]


def streamed(spark, tmp_path, rows, schema, size, build):
    """The rows that a live query gives for micro-batches of ``size`` rows in order."""
    source, batches = tmp_path / "in", [rows[k : k + size] for k in range(0, len(rows), size)]
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"{n:04d}"))
        time.sleep(0.002)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    name = f"out{abs(hash(str(tmp_path)))}"
    query = build(live).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    return sorted(map(tuple, spark.table(name).collect()), key=str)


@pytest.mark.parametrize("size", [7, 1000])
def test_related_domains_of_a_stream(spark, tmp_path, size):
    rows = sorted(frames(), key=lambda r: (r[1] is None, r[1] or 0))
    want = sorted(map(tuple, connections.related_domains(spark.createDataFrame(rows, FRAMES), "conn_id", "seq").collect()), key=str)
    got = streamed(spark, tmp_path, rows, FRAMES, size, lambda live: connections.related_domains(live, "conn_id", "seq"))
    assert got == want and sum(bool(r[-1]) for r in want) > 20


def test_related_domains_one_frame_at_a_time(spark, tmp_path):
    rows = [r for r in sorted(frames()[:24], key=lambda r: r[1])][:9]
    want = sorted(map(tuple, connections.related_domains(spark.createDataFrame(rows, FRAMES), "conn_id", "seq").collect()), key=str)
    assert streamed(spark, tmp_path, rows, FRAMES, 1, lambda live: connections.related_domains(live, "conn_id", "seq")) == want


POLICY = {"ssn": "block"}


def by_hand(rows):
    """The state machine of one connection, frame by frame."""
    import re

    out, known, ended = [], {}, set()
    for c, k, direction, _, opcode, _, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0)):
        alone = c is None or k is None
        if not alone and c in ended:
            continue
        if opcode == 1:
            blocked = "123-45" in text
            names = re.findall(r"@([a-z0-9.]+)", text)
            related = set() if alone or direction == "client" else known.get(c, set())
            shown = re.sub(r"[a-z]+@[a-z0-9.]+", "[email]", text)
            for d in related:
                shown = re.sub(r"(?<![a-z@.])" + d.replace(".", r" ?\. ?") + r"(?![a-z.])", "[domain]", shown)
            out.append((c, k, direction, "blocked" if blocked else "protected", None if blocked else shown))
            if blocked and not alone:
                ended.add(c)
            elif not alone and direction == "client":
                known.setdefault(c, set()).update(names)
        else:
            out.append((c, k, direction, "closed" if opcode == 2 else "passed", None if opcode == 2 else text))
            if opcode != 9:
                ended.add(c)
    return sorted(out, key=str)


def test_connections_of_a_table(spark):
    got = connections.protect_connections(spark.createDataFrame(frames(), FRAMES), POLICY, default="redact", salt="s").collect()
    assert sorted(map(tuple, got), key=str) == by_hand(frames())


@pytest.mark.parametrize("size", [9, 1000])
def test_connections_of_a_stream(spark, tmp_path, size):
    rows = sorted(frames(), key=lambda r: (r[1] is None, r[1] or 0))
    assert streamed(spark, tmp_path, rows, FRAMES, size, lambda live: connections.protect_connections(live, POLICY, default="redact", salt="s")) == by_hand(frames())


def test_a_silent_connection_is_forgotten(spark, tmp_path):
    """After the timeout neither its domains nor its end are known."""
    source = tmp_path / "in"
    put = lambda n, rows: spark.createDataFrame(rows, FRAMES).coalesce(1).write.parquet(str(source / n))
    put("a", [("c", 1, "client", True, 1, False, "ann@site.org"), ("c", 2, "server", True, 1, False, "site.org"), ("c", 3, "client", True, 1, False, "ssn 123-45-6789")])
    live = spark.readStream.schema(FRAMES).parquet(str(source / "*"))
    done = connections.protect_connections(live, POLICY, default="redact", salt="s", idle_ms=200)
    query = done.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="100 milliseconds").start()
    try:
        until = time.time() + 120
        while spark.table("silent").count() < 3 and time.time() < until:
            time.sleep(0.2)
        time.sleep(6)
        put("b", [("c", 4, "server", True, 1, False, "site.org")])
        while spark.table("silent").count() < 4 and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted((r["seq"], r["output"]) for r in spark.table("silent").collect() if r["output"]) == [(1, "[email]"), (2, "[domain]"), (4, "site.org")]


# The log


EVENTS = "operation_id string, seq int, level string, event_type string, kind string, reference string, action string, message string"


def made(spark, tag, n=20):
    return spark.createDataFrame([(f"{tag}{k}", s, "info", "detection", "email", None, "detected", "m") for k in range(n) for s in range(3)], EVENTS)


def test_log_rows_are_numbered_without_gaps(spark):
    rows = events.log_rows(made(spark, "o", 50), NOW, 100).collect()
    assert sorted(r["id"] for r in rows) == list(range(100, 250))
    at = {r["id"]: r["operation_id"] for r in rows}
    assert sum(at[i] != at[i + 1] for i in range(100, 249)) == 49


def test_appends_of_one_second_and_a_batch_again(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    first = event_log.append(made(spark, "a"), path, "w/1", 0, NOW).collect()
    event_log.append(made(spark, "b"), path, "w/1", 1, NOW)
    again = event_log.append(made(spark, "a"), path, "w/1", 0, NOW + 50).collect()
    key = lambda r: (r["id"], r["operation_id"], r["timestamp"])
    assert sorted(map(key, first)) == sorted(map(key, again))
    rows = event_log.read(spark, path).collect()
    assert len(rows) == 120 and sorted(r["id"] for r in rows) == list(range(1, 121)) and {r["timestamp"] for r in rows} == {NOW}
    assert max(r["id"] for r in rows if r["operation_id"][0] == "a") < min(r["id"] for r in rows if r["operation_id"][0] == "b")


def test_a_crash_between_reserving_and_writing_leaves_a_gap_only(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    event_log.reserve(spark, path, 10)
    event_log.append(made(spark, "a", 2), path, "w", 0, NOW)
    assert sorted(r["id"] for r in event_log.read(spark, path).collect()) == list(range(11, 17))
    assert event_log.append(made(spark, "x", 0), path, "w", 1, NOW).count() == 0


def test_writers_at_once_get_ranges_of_their_own(spark, tmp_path):
    path, got = f"file://{tmp_path}/log", []

    def run():
        for _ in range(8):
            got.append(event_log.reserve(spark, path, 5))

    threads = [threading.Thread(target=run) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(1, 161, 5))


def test_event_sink_of_a_stream(spark, tmp_path):
    made(spark, "op", 3).write.parquet(str(tmp_path / "in"))
    path = f"file://{tmp_path}/log"
    for check in ("check", "lost-check"):  # the second run has lost its checkpoint, and replays its batch
        query = event_log.write_events(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), path, str(tmp_path / check), "sink", lambda: NOW)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    log = event_log.read(spark, path).orderBy("id").collect()
    assert [r["id"] for r in log] == list(range(1, 10)) and all(r["timestamp"] == NOW for r in log)
    for k in range(3):
        assert len({r["id"] for r in log if r["operation_id"] == f"op{k}"}) == 3


# Rows of their own


def test_no_reference_is_shared_without_deduplication(spark):
    df = spark.createDataFrame([(None, "ann@site.org"), (None, "ann@site.org"), (1, "ann@site.org"), (1, "ann@site.org")], "id long, text string")
    rows = pipeline.protect(df, {}, salt="s", deduplicate=False).collect()
    assert len({r["plan"]["replacements"][0]["ref_id"] for r in rows}) == 4


def test_chunks_without_a_stream_pass_alone(spark):
    from maskwright.streaming import streams

    rows = [(None, 1, b"mail a@b.co"), (None, 2, b"x"), ("s", 1, b"y" * 100), ("s", 2, b"z"), (None, 3, None)]
    got = streams.transform_chunks(spark.createDataFrame(rows, "stream_id string, seq long, chunk binary"), lambda t: t.upper()).collect()
    assert sorted(bytes(r["chunk"]) for r in got if r["stream_id"] is None) == [b"MAIL A@B.CO", b"X"]
    assert b"".join(bytes(r["chunk"]) for r in sorted((r for r in got if r["stream_id"] == "s"), key=lambda r: r["seq"])) == b"Y" * 100 + b"Z"


@pytest.mark.parametrize("size", [2, 100])
def test_live_chunks_without_a_stream_pass_alone(spark, tmp_path, size):
    from maskwright.streaming import streams

    rows = [(None, 1, b"mail a", False), ("s", 1, b"y" * 100, False), (None, 2, b"x", False), ("s", 2, b"z", True)]
    got = streamed(spark, tmp_path, rows, "stream_id string, seq long, chunk binary, last boolean", size, lambda live: streams.transform_stream(live, lambda t: t.upper()))
    assert sorted(bytes(c) for s, _, c in got if s is None) == [b"MAIL A", b"X"]
    assert b"".join(bytes(c) for s, _, c in sorted((r for r in got if r[0]), key=lambda r: r[1])) == b"Y" * 100 + b"Z"


def test_protection_stays_on_for_other_types(spark):
    from maskwright.functions import scalars as fn

    given = {'{"enabled":false}': False, '{"enabled":"false"}': True, '{"enabled":0}': True, '{"enabled":true}': True, '{"enabled":null}': True, "{}": True, "disabled": False, " Disabled ": False, "": True, "{bad": True}
    rows = spark.createDataFrame([(k,) for k in given], "s string").select("s", fn.protection_enabled(F.col("s")).alias("on")).collect()
    assert {r["s"]: r["on"] for r in rows} == given
    assert spark.createDataFrame([(None,)], "s string").select(fn.protection_enabled(F.col("s"))).first()[0] is True


def test_texts_are_searched_once_where_stores_are_asked(spark):
    """One search for each text that may hold something, kept for both the question and the answer."""
    df = spark.createDataFrame([(1, "ann@site.org"), (2, "plain"), (3, "123-45-6789 or 4")], "id long, text string")
    vault = spark.createDataFrame([], "key string, value string, created_at long, updated_at long")
    plan = pipeline.protect(df, {}, salt="s", vault=vault)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
