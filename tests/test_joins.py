"""Joins of scale against brute force: consents at each row's time, and rules as a table."""

from __future__ import annotations

import random

import pytest
from maskwright.operators import consent, traffic
from maskwright.plans import pipeline
from pyspark.sql import functions as F

NOW = 1_700_000_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_time_cover_it_once(spark):
    rnd = random.Random(1)
    spans = [(a, a + n) for a, n in [(0, 0), (0, 1), (5, 86_400), (-70, 140), (-(1 << 41), 1 << 42), (NOW, 3), (NOW - 1, 40_000), (31, 2), (32, 32), (0, 1024)]] + [(rnd.randrange(-5000, 5000), rnd.randrange(6000, 9000)) for _ in range(40)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", consent.time_pieces(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        a, b = max(r["a"], -consent.FAR), min(r["b"], consent.FAR)
        at = a
        for level, place in sorted(((x["level"], x["place"]) for x in r["p"]), key=lambda x: x[1] * consent.BASE ** x[0]):
            assert place * consent.BASE**level == at
            at += consent.BASE**level
        assert at == b if b > a else not r["p"]
        assert len(r["p"]) <= 2 * 7 * 14 + 2


def test_consents_at_their_time(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(400):
        made = NOW + rnd.randrange(0, 200_000)
        ends = made + rnd.choice([1, 60, 86_400, 10_000_000, 1 << 50])
        rows.append((f"c{k:03}", rnd.choice(["email", "odd"]), f"f{rnd.randrange(6)}", None, rnd.choice(["global", "global", "other"]), made, ends, made + rnd.randrange(100_000) if rnd.random() < 0.3 else None, "u", None))
    consents = spark.createDataFrame(rows, consent.SCHEMA)
    asked = [("email", f"f{rnd.randrange(7)}", NOW + rnd.randrange(-1000, 300_000)) for _ in range(600)] + [("email", "f1", r[5]) for r in rows[:50]] + [("email", "f1", r[6]) for r in rows[:50]] + [("email", "f1", None), ("email", None, NOW)]
    got = consent.active_at(spark.createDataFrame(asked, "kind string, value_fingerprint string, at long"), consents)
    want = {}
    for kind, print_, at in asked:
        live = [(r[6], r[0]) for r in rows if print_ == r[2] and at is not None and r[4] == "global" and r[5] <= at < min(r[6], r[7] if r[7] is not None else r[6]) and at < 1 << 40]
        want[kind, print_, at] = max(live)[1] if live else None
    assert {(r["kind"], r["value_fingerprint"], r["at"]): r["consent_id"] for r in got.collect()} == want and sum(v is not None for v in want.values()) > 200
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_each_row_is_protected_as_of_its_time(spark):
    value = spark.createDataFrame([("email", "ann@site.org")], "kind string, value string")
    consents = consent.grant(value, NOW, ttl=100)
    df = spark.createDataFrame([(k, "ann@site.org", t) for k, t in enumerate([NOW - 1, NOW, NOW + 99, NOW + 100, None])], "id long, text string, at long")
    got = {r["id"]: r["output"] for r in pipeline.protect(df, {"email": "redact"}, consents=consents, now=F.col("at"), salt="s", expand=False).collect()}
    assert got == {0: "[email]", 1: "ann@site.org", 2: "ann@site.org", 3: "[email]", 4: "[email]"}


# Rules


def host_of(x):
    x = (x or "").strip().rstrip(".")
    for scheme in ("https://", "http://", "wss://", "ws://"):
        x = x.removeprefix(scheme)
    return x.split("/")[0].split(":")[0].lower()


def domain(pattern, host):
    pattern = host_of(pattern)
    if not pattern or not host:
        return False
    if pattern.startswith(("*.", ".")):
        suffix = pattern.lstrip("*")[1:]
        return host == suffix or host.endswith("." + suffix)
    return pattern == host


def matches(m, o):
    host, path, port, protocol, process = o
    def url(u):
        u = u.strip()
        if u.startswith("/"):
            return path is not None and path.startswith(u)
        rest = u.split("://", 1)[-1].split("/", 1)
        return bool(u) and domain(u, host) and (len(rest) == 1 or not rest[1] or (path or "").startswith("/" + rest[1]))
    return any(m.values()) and all([
        not m["domains"] or any(domain(d, host) for d in m["domains"]), not m["ips"] or any(host_of(i) == host for i in m["ips"]), not m["urls"] or any(url(u) for u in m["urls"]),
        not m["ports"] or port in m["ports"], not m["protocols"] or protocol in m["protocols"], not m["process_names"] or (process or "").lower() in [p.lower() for p in m["process_names"]],
    ])


def made_rules(n, rnd):
    hosts = [f"h{k}.zone{k % 40}.example" for k in range(n // 4)]
    rules = []
    for k in range(n):
        m = {x: [] for x in ("domains", "ips", "urls", "ports", "protocols", "process_names")}
        host = rnd.choice(hosts)
        for kind in rnd.sample(sorted(m), rnd.choice([1, 1, 2])) if k % 50 else []:
            m[kind] = {
                "domains": [rnd.choice([host, "*." + host.split(".", 1)[1], "." + host, "HTTPS://" + host.upper() + "."])], "ips": [rnd.choice([f"10.0.0.{k % 250}", host])], "urls": [rnd.choice([f"/v1/{k % 90}", "/v1/messages/" + "x" * (k % 40), f"https://{host}/v{k % 3}", host, f"*.zone{k % 40}.example/v1", " "])],
                "ports": [rnd.choice([80, 443, 8000 + k % 500])], "protocols": [rnd.choice(["https", "http", "wss"])], "process_names": [f"Proc{k % 300}"],
            }[kind]
        rules.append((f"r{k}", rnd.random() < 0.9, rnd.randrange(20), k, m, rnd.choice(["inspect", "block", "allow"])))
    return rules, hosts


@pytest.mark.parametrize("restricted", [False, True])
def test_five_thousand_rules_as_a_table(spark, restricted):
    rnd = random.Random(5)
    rules, hosts = made_rules(5000, rnd)
    seen = []
    for _ in range(400):
        host = rnd.choice([rnd.choice(hosts), "sub." + rnd.choice(hosts), f"zone{rnd.randrange(40)}.example", f"10.0.0.{rnd.randrange(255)}", "else.where", ""])
        seen.append((host, rnd.choice([None, f"/v1/{rnd.randrange(100)}/x", "/v1/messages/" + "x" * rnd.randrange(45), "/v2"]), rnd.choice([None, 80, 443, 8000 + rnd.randrange(500)]), rnd.choice(["https", "ftp", "ws"]), rnd.choice([None, f"proc{rnd.randrange(300)}"])))
    seen += seen[:30]
    table = spark.createDataFrame(rules, "id string, enabled boolean, priority int, ordinal int, match struct<domains:array<string>,ips:array<string>,urls:array<string>,ports:array<int>,protocols:array<string>,process_names:array<string>>, action string")
    only = spark.createDataFrame([(f"r{k}",) for k in range(0, 5000, 3)], "id string") if restricted else None
    df = spark.createDataFrame([(k, *o) for k, o in enumerate(seen)], "n long, host string, path string, port int, protocol string, process_name string")
    got = traffic.decide_by_table(df, table, "pass", only)
    want = {}
    for n, o in enumerate(seen):
        hit = [(p, k, i, a) for i, on, p, k, m, a in rules if on and (not restricted or k % 3 == 0) and matches(m, o)]
        want[n] = (max(hit)[2], max(hit)[3]) if hit else (None, "pass")
    assert {r["n"]: (r["app_id"], r["action"]) for r in got.collect()} == want and sum(w[0] is not None for w in want.values()) > 200
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_table_and_expression_agree(spark):
    rnd = random.Random(8)
    rules, hosts = made_rules(60, rnd)
    df = spark.createDataFrame([(k, rnd.choice(hosts), f"/v1/{k % 20}", 443, "https", f"proc{k % 30}") for k in range(100)], "n long, host string, path string, port int, protocol string, process_name string")
    table = spark.createDataFrame(rules, "id string, enabled boolean, priority int, ordinal int, match struct<domains:array<string>,ips:array<string>,urls:array<string>,ports:array<int>,protocols:array<string>,process_names:array<string>>, action string")
    listed = [{"id": i, "enabled": on, "priority": p, "match": m, "action": a} for i, on, p, _, m, a in rules]
    of = lambda d: sorted((r["n"], r["app_id"], r["action"]) for r in d.select("n", F.coalesce("app_id", F.lit("")).alias("app_id"), "action").collect())
    assert of(traffic.decide_by_table(df, table, "pass")) == of(traffic.decide(df, listed, "pass"))
