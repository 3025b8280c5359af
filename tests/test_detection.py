from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions import scalars as fn
from maskwright.functions import detect as detect_
from maskwright.functions.detect import detections


@pytest.fixture(scope="module")
def detect(spark):
    def run(text, related=None):
        df = spark.createDataFrame([(text, related)], "text string, related array<string>")
        spans = df.select(detections(F.col("text"), F.col("related") if related is not None else None).alias("s")).first()[0]
        for s in spans:
            assert text.encode()[s["start"] : s["end"]].decode() == s["value"]
        return [(s["kind"], s["value"]) for s in spans]

    return run


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to ann@site.org please", [("email", "ann@site.org")]),
        ("ann@ site.org", [("email", "ann@ site.org")]),
        ("ann @site.org", [("email", "ann @site.org")]),
        ("ann@site . org", [("email", "ann@site . org")]),
        ("ann@site.org. Then", [("email", "ann@site.org")]),
        ("é ann@site.org", [("email", "ann@site.org")]),
        ("ann@site.org and site.org here", [("email", "ann@site.org"), ("domain", "site.org")]),
        ("ann@my-site.org and my-site . ORG here", [("email", "ann@my-site.org"), ("domain", "my-site . ORG")]),
        ("ann@site.org, api.site.org", [("email", "ann@site.org")]),
        ("ann@site.org (site.org site.org)", [("email", "ann@site.org"), ("domain", "site.org")]),
        ("call +14155550100 now", [("phone", "+14155550100")]),
        ("call 415-555-0100 or 415.555.0100", [("phone", "415-555-0100"), ("phone", "415.555.0100")]),
        ("call (415) 555-0100", []),
        ("x(415) 555-0100", [("phone", "(415) 555-0100")]),
        ("ssn 123-45-6789", [("ssn", "123-45-6789")]),
        ("ssn 666-45-6789 000-12-3456 900-12-3456 123-00-4567 123-45-0000", []),
        ("card 4111-1111-1111-1111", [("cc", "4111-1111-1111-1111")]),
        ("card 4111-1111-1111-1112 0000-0000-0000-0000", []),
        ("123-45-6789 and a@b.co", [("ssn", "123-45-6789"), ("email", "a@b.co")]),
        ("é4111111111111111", []),
        ("", []),
    ],
)
def test_detection(detect, text, want):
    assert detect(text) == want


def test_related_domains(detect):
    assert detect("see site.org today", ["Site.Org.", "bad_name", "x"]) == [("domain", "site.org")]
    assert detect("see site.org today", []) == []
    assert detect("a\t.\r\nco atr.nco", ["a.co"]) == [("domain", "a\t.\r\nco")]


def test_null_text(spark):
    assert spark.createDataFrame([(None,)], "t string").select(detections(F.col("t")).alias("s")).first()[0] == []


def test_spans_are_disjoint_and_ordered(spark):
    rnd = random.Random(0)
    parts = ["a@b.co", "b.co", "+14155550100", "415-555-0100", "123-45-6789", "4111 1111 1111 1111", " ", ".", "é", "@", "x"]
    rows = [("".join(rnd.choices(parts, k=12)),) for _ in range(400)]
    for r in spark.createDataFrame(rows, "t string").select("t", detections(F.col("t")).alias("s")).collect():
        end = 0
        for s in r["s"]:
            assert s["start"] >= end and r["t"].encode()[s["start"] : s["end"]].decode() == s["value"]
            end = s["end"]


def one(spark, column, **values):
    names = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("kind", "value", "want"), [("email", "Ann@ Site.ORG", "Ann@site.org"), ("domain", "Site . ORG..", "site.org"), ("phone", "415-555", "415-555")])
def test_canonical(spark, kind, value, want):
    assert one(spark, fn.canonical(F.col("k"), F.col("v")), k=kind, v=value) == want


def test_reference_ids(spark):
    alphabet = fn.BASE58

    def decode(id_):
        n = 0
        for c in id_:
            n = n * 58 + alphabet.index(c)
        ones = len(id_) - len(id_.lstrip("1"))
        return bytes(ones) + n.to_bytes((n.bit_length() + 7) // 8, "big")

    rnd = random.Random(1)
    ids = ["".join(rnd.choices(alphabet, k=22)) for _ in range(3000)] + ["1" * k + "".join(rnd.choices(alphabet, k=22 - k)) for k in range(1, 22) for _ in range(30)]
    ids += list(fn.LARGEST_ID[:1]) + ["1" + fn.LARGEST_ID[1], "11" + fn.LARGEST_ID[2], "short", "0" * 22, "l" * 22]
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", fn.valid_reference_id(F.col("i")).alias("ok")).collect()
    for r in got:
        assert r["ok"] == (bool(re.fullmatch(f"[{alphabet}]{{22}}", r["i"])) and len(decode(r["i"])) == 16), r["i"]
    made = spark.range(2000).select(fn.reference_id("salt", F.lit("email"), F.col("id").cast("string")).alias("i"))
    assert made.where(fn.valid_reference_id(F.col("i"))).distinct().count() == 2000


@pytest.mark.parametrize(
    ("host", "want"),
    [("https://A.Example.com:443/x", "a.example.com"), ("wss://h/x", "h"), ("[::1]:80", "::1"), ("h.example..", "h.example"), (" h:1 ", "h"), ("ftp://h/x", "ftp")],
)
def test_normalize_host(spark, host, want):
    assert one(spark, fn.normalize_host(F.col("h")), h=host) == want


def test_messages(spark):
    m = "target=, provider=p; blocked=3, n=x"
    assert one(spark, fn.field_value(F.col("m"), "provider"), m=m) == "p"
    assert one(spark, fn.numeric_field(F.col("m"), "blocked"), m=m) == 3
    assert one(spark, fn.numeric_field(F.col("m"), "n"), m=m) is None
    assert one(spark, fn.actor_from_message(F.col("m")), m=m) is None  # an empty target hides the provider
    assert one(spark, fn.actor_from_message(F.col("m")), m="provider=p") == "p"
    assert one(spark, fn.actor_from_operation(F.col("o")), o="-1") is None


@pytest.mark.parametrize(
    ("event", "action", "message", "want"),
    [
        ("policy_decision", "allow", "", "granted"), ("policy_decision", "redact", "", "sealed"), ("policy_decision", "block", "", "denied"), ("policy_decision", "odd", "", None),
        ("consent", "any", "", "granted"), ("redaction", "any", "", "sealed"), ("proxy_failure", "provider_down", "", "denied"), ("detection", "detected", "", None), ("consent", None, "", None),
        ("proxy_forward", "request_protection", "blocked=1 tokenized=2", "denied"), ("proxy_forward", "request_protection", "tokenized=2", "sealed"), ("proxy_forward", "request_protection", "", "granted"),
    ],
)
def test_decisions(spark, event, action, message, want):
    assert one(spark, fn.decision(F.col("e"), F.col("a"), F.col("m")), e=event, a=action, m=message) == want


def test_day_labels(spark):
    assert one(spark, fn.day_label(F.col("t")), t=951_782_400) == "2000-02-29"
    assert one(spark, fn.day_label(F.col("t")), t=-5) == "1970-01-01"
    assert one(spark, fn.audit_id(F.col("t")), t=255) == "evt_00000000000000ff"


def test_settings_and_states(spark, tmp_path):
    from maskwright.sources.tables import Settings

    path = tmp_path / "s.toml"
    path.write_text('default_action = "redact"\nconsent_ttl = 5\n[policy]\nemail = "block"\n')
    s = Settings.load(path, {"MASKWRIGHT_CONSENT_TTL": "7", "MASKWRIGHT_STRICT": "yes", "MASKWRIGHT_RELATED_DOMAINS": "a.b, ,a.b,c.d"}, default_action="block")
    assert (s.default_action, s.consent_ttl, s.strict, s.policy, s.related_domains) == ("block", 7, True, {"email": "block"}, ("a.b", "c.d"))
    with pytest.raises(ValueError):
        Settings.load(None, {"MASKWRIGHT_STRICT": "maybe"})
    assert one(spark, fn.connect_state(F.col("d"), F.col("p"), F.lit(True)), d="connected", p="ready") == "protected"
    assert one(spark, fn.connect_state(F.col("d"), F.col("p"), F.lit(False)), d="connected", p="ready") == "paused"
    assert one(spark, fn.connect_state(F.col("d"), F.col("p"), F.lit(True)), d="stale", p="ready") == "degraded"
    assert one(spark, fn.protection_enabled(F.col("s")), s='{"enabled": false}') is False
    assert one(spark, fn.protection_enabled(F.col("s")), s=" Disabled\n") is False
    assert one(spark, fn.protection_enabled(F.col("s")), s="") is True
    assert one(spark, fn.unsupported_encoding(F.col("s")), s="identity, gzip") is True
    assert one(spark, fn.is_event_stream(F.col("s")), s="Text/Event-Stream; charset=utf-8") is True
    assert one(spark, fn.render_template(F.col("s"), proxy_url=F.lit("u")), s="x {{proxy_url}}") == "x u"


PIECES = ["a.co", "b.co", "sub.a.co", "A . Co", "a .co", "a. co", "b.c-d.co", "a", "co", ".", " ", "  ", "\n", "_", "-", "@", "é", "ſ.co", "K.co", "x@a.co", "\t.\r\n", ",", "(", "1.a.co", "..", "İ.co"]


def test_many_domains_in_one_pass_are_those_of_the_patterns(spark):
    """Boundaries that are used up, spaced dots, folded letters and long names, on texts made of their pieces."""
    rnd = random.Random(11)
    domains = ["a.co", "b.co", "sub.a.co", "b.c-d.co", "s.co", "k.co", "i.co", "co.a.co", "co.co", "a.co.b.co"]
    texts = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(t, domains) for t in texts], "t string, d array<string>")
    both = [F.array_sort(f(F.col("t"), F.col("d"))).alias(n) for f, n in ((detect_.domain_regex_matches, "slow"), (detect_.domain_matches, "quick"))]
    rows = df.select("t", *both).collect()
    assert all(r["slow"] == r["quick"] for r in rows) and sum(len(r["quick"]) for r in rows) > 1000


def test_ten_thousand_domains_in_a_long_text(spark):
    names = [f"host{k}.zone{k % 7}.example" for k in range(10_000)]
    text = " ".join(f"see {n} and {n.replace('.', ' . ')}," for n in names) + " x" * 200_000 + " " + "y." * 20_000 + "z" * 100_000 + " host1.zone1.example.co"
    df = spark.createDataFrame([(text, names)], "t string, d array<string>")
    began = time.perf_counter()
    got = df.select(detections(F.col("t"), F.col("d")).alias("s")).first()["s"]
    assert len(got) == 20_000 and {s["kind"] for s in got} == {"domain"} and time.perf_counter() - began < 60
    assert {fn_name(s["value"]) for s in got} == set(names)


def fn_name(value):
    return re.sub(r"\s", "", value)
