"""Captures cut anywhere, base58 texts, leaks over a whole log, events of proxied requests."""

from __future__ import annotations

import random

import pytest
from maskwright.functions import scalars as fn
from maskwright.operators import events
from maskwright.plans import views
from maskwright.sources import tables
from pyspark.sql import functions as F


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_a_capture_cut_at_any_byte_gives_its_events_once(spark, tmp_path, end):
    made = [f"event: e{k}{end}data: {'x' * (k % 7)}{k}é" for k in range(12)]
    body = (end * 2).join(made) + end * 2 + end + f"data: last{end}"
    (tmp_path / "a.sse").write_bytes(body.encode())
    want = [e.replace(end, "\n") for e in made] + ["data: last"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in [*range(1, len(body.encode()) + 3, 29), 5, 100_000]:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            rows = tables.read_captures(spark, str(tmp_path / "a.sse")).orderBy("pos").collect()
            assert [r["event"] for r in rows] == want, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_base58(spark):
    rnd = random.Random(3)
    given = [bytes(32), bytes(31) + b"\x01", b"\xff" * 32, bytes(3) + b"\x10" * 29, bytes(range(32))] + [bytes(rnd.randrange(4)) + rnd.randbytes(32) for _ in range(300)]
    given = [g[:32] for g in given]

    def plain(b):
        n, out = int.from_bytes(b, "big"), ""
        while n:
            n, r = divmod(n, 58)
            out = fn.BASE58[r] + out
        return "1" * (len(b) - len(b.lstrip(b"\0"))) + out

    rows = spark.createDataFrame([(g.hex(),) for g in given], "h string").select("h", fn.base58(F.col("h")).alias("b")).collect()
    assert {r["h"]: r["b"] for r in rows} == {g.hex(): plain(g) for g in given}
    assert plain(bytes.fromhex("00" * 31 + "3a")) == "1" * 31 + "21"


def test_leaks_are_those_of_comparing_all(spark):
    rnd = random.Random(6)
    values = [("email", f"u{k}@s{k % 3}.org") for k in range(40)] + [("domain", "s1.org"), ("x", "ab"), ("x", "q"), ("x", "a.b"), ("x", ""), ("phone", "+14155550100")]
    said = [f"sent {rnd.choice(values)[1]} to {rnd.choice(['nobody', rnd.choice(values)[1]])}" if k % 3 else f"found at {k}" for k in range(80)] + [None, "a.b c"]
    log = spark.createDataFrame([(k, m, None if k % 5 else f"r{k}", "done") for k, m in enumerate(said)], "id long, message string, reference string, action string")
    got = events.leaks(log, spark.createDataFrame(values * 2, "kind string, value string"))
    prints = {r["v"]: r["f"] for r in spark.createDataFrame(values, "k string, v string").select("v", fn.fingerprint(F.col("k"), F.col("v")).alias("f")).collect()}
    full = ["\x1f".join(x for x in (m, None if k % 5 else f"r{k}", "done") if x is not None) for k, m in enumerate(said)]
    want = sorted((k, kind, prints[v]) for k, m in enumerate(full) for kind, v in set(values) if v and v in m)
    assert sorted((r["id"], r["kind"], r["fingerprint"]) for r in got.collect()) == want and len(want) > 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def rows_joined(df) -> list[int]:
    """Rows made by each join of the plan that was run, broadcasts counted as too many."""
    made, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if "Broadcast" in name:
                made.append(10**9)
            elif "Join" in name:
                made.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return made


def test_leaks_of_like_values_and_texts_make_no_product(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("01") for _ in range(n))
    values, said = sorted({word(rnd.choice((10, 12))) for _ in range(600)}), [word(40) for _ in range(600)]
    log = spark.createDataFrame([(k, m, None, "x") for k, m in enumerate(said)], "id long, message string, reference string, action string")
    got = events.leaks(log, spark.createDataFrame([("n", v) for v in values], "kind string, value string"))
    assert len(got.collect()) == sum(v in m for m in said for v in values) > 1000
    assert 1000 < max(rows_joined(got)) < len(values) * len(said) / 3


@pytest.mark.parametrize("value", ["q", "ab", "é😀c", "0123", "x" * 16, "0123456789abcdef😀" * 9, "a.b\nc.d\n" * 5])
def test_leaks_anywhere_in_a_text(spark, value):
    said = [f"{'é' * k}{value}{'-' * (k % 3)}" for k in range(35)] + [value[:-1] + "#" + value[1:], value]
    log = spark.createDataFrame([(k, m, None, None) for k, m in enumerate(said)], "id long, message string, reference string, action string")
    got = events.leaks(log, spark.createDataFrame([("a", value), ("b", value)], "kind string, value string")).collect()
    assert sorted((r["id"], r["kind"]) for r in got) == [(k, kind) for k, m in enumerate(said) if value in m for kind in "ab"]


def test_leaks_of_no_values(spark):
    log = spark.createDataFrame([(1, "m", None, "x")], "id long, message string, reference string, action string")
    got = events.leaks(log, spark.createDataFrame([("a", "")], "kind string, value string"))
    assert got.columns == ["id", "kind", "fingerprint"] and got.collect() == []


def test_proxied_requests_say_what_happened(spark):
    schema = "operation_id string, target string, provider string, method string, status int, streaming boolean, detections int, replacements int, tokenized int, blocked int, bypass boolean, missing_key boolean, encoded boolean, removed_headers int, content_type string, content_encoding string, intercepted boolean"
    base = ("t", "p", "POST", 200, True, 1, 1, 1, 0)
    rows = [
        ("plain", *base, False, False, False, 0, "text/event-stream", None, False), ("bypass", *base, True, False, False, 0, None, None, False), ("key", *base, False, True, False, 0, None, None, False),
        ("encoded", *base, False, False, True, 0, None, None, False), ("written", *base, None, None, None, 2, "x" * 100, "gzip", True),
    ]
    got: dict = {}
    for r in events.proxy_events(spark.createDataFrame(rows, schema)).orderBy("operation_id", "seq").collect():
        got.setdefault(r["operation_id"], []).append((r["action"], r["message"]))
    assert [a for a, _ in got["plain"]] == ["route", "request_protection", "provider_response"] and "content_type=text/event-stream content_encoding=none" in got["plain"][-1][1]
    assert got["bypass"] == [("bypassing", "target=t")]
    assert [a for a, _ in got["key"]] == ["route", "config_required"] and [a for a, _ in got["encoded"]] == ["route", "blocked"]
    assert [a for a, _ in got["written"]] == ["route", "request_protection", "request_integrity_headers_removed", "provider_response", "intercepted_response_write"]
    assert f"content_type={'x' * 80} content_encoding=gzip" in got["written"][3][1] and got["plain"][0][1] == "target=t provider=p method=POST"


def test_ranges():
    now = 1_700_000_123
    assert views.since_of("today", now) % 86_400 == 0 and 0 <= now - views.since_of("today", now) < 86_400
    assert views.since_of("7d", now) == now - 604_800 and views.since_of("all", now) is None
