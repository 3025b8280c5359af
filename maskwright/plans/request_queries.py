"""More engine queries: requests, routes, readiness, bodies and streams, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import headers, structured
from ..functions import scalars as fn
from ..functions.detect import detections
from ..operators import consent, traffic
from ..streaming import connections, streams
from . import oracles as O
from .queries import NOW, SALT, _read, _redacted, _split, query

# Requests


KINDS_OF_CONTENT = "CASE o_orderkey % 4 WHEN 0 THEN 'text/event-stream' WHEN 1 THEN 'Text/Event-Stream ; charset=utf-8' WHEN 2 THEN 'application/json' END"
ENCODINGS = "CASE o_orderkey % 5 WHEN 0 THEN 'identity' WHEN 1 THEN 'gzip' WHEN 2 THEN 'Identity, br' WHEN 3 THEN ' , identity' END"


@query("SELECT o_orderkey AS id, coalesce(o_orderkey % 4 < 2, false) AS is_stream, coalesce(o_orderkey % 5 IN (1, 2), false) AS unsupported, o_totalprice <= 100000 AND NOT coalesce(o_orderkey % 5 IN (1, 2), false) AS accepted FROM orders")
def request_bodies(spark, sf_dir):
    """Which bodies are event streams, which are encoded, and which may be rewritten."""
    rows = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{KINDS_OF_CONTENT} AS content_type", f"{ENCODINGS} AS encoding", "o_totalprice AS size")
    return rows.select("id", fn.is_event_stream(F.col("content_type")).alias("is_stream"), fn.unsupported_encoding(F.col("encoding")).alias("unsupported"), fn.acceptable_body(F.col("size"), F.col("encoding"), 100_000).alias("accepted"))


@query("SELECT p_partkey AS id, trim(p_brand) || '|' || trim(p_type) AS items FROM part")
def csv_lists(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat(' ', p_brand, ' , ,', p_type, ',', p_brand, ',') AS raw")
    return rows.select("id", F.array_join(fn.csv_list(F.col("raw")), "|").alias("items"))


@query("SELECT c_custkey AS id, 'http://' || c_name || '/' || c_mktsegment || '?' || c_name || '{{other}}' AS url FROM customer")
def template_render(spark, sf_dir):
    url = fn.render_template(F.lit("http://{{host}}/{{path}}?{{host}}{{other}}"), host=F.col("c_name"), path=F.col("c_mktsegment"))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), url.alias("url"))


FLAGS = """CASE c_custkey % 6 WHEN 0 THEN '{"enabled":false}' WHEN 1 THEN '{"x": 1, "enabled": true}' WHEN 2 THEN concat(' Disabled ', chr(10)) WHEN 3 THEN 'on' WHEN 4 THEN 'disabled' END"""


@query("SELECT c_custkey AS id, c_custkey % 6 NOT IN (0, 2, 4) AS enabled FROM customer")
def protection_flags(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fn.protection_enabled(F.expr(FLAGS)).alias("enabled"))


GATES = "o_orderkey AS id, o_orderkey % 7 <> 0 AS known, CASE o_orderkey % 4 WHEN 0 THEN 'https' WHEN 1 THEN 'web_socket' WHEN 2 THEN 'http' ELSE 'https' END AS protocol, CASE o_custkey % 3 WHEN 0 THEN 'explicit_proxy' WHEN 1 THEN 'system_proxy' ELSE 'tun' END AS mode, o_custkey % 2 = 0 AS proxy, o_custkey % 5 = 0 AS tun, o_orderkey % 3 <> 0 AS enabled, o_orderkey % 11 <> 0 AS host_allowed, o_custkey % 4 <> 0 AS consented, o_custkey % 13 <> 0 AS installed, o_orderkey % 2 = 0 AS adapter"


@query(f"""WITH g AS (SELECT {GATES} FROM orders), r AS (SELECT *, CASE WHEN NOT known THEN 'unknown' WHEN protocol IN ('https', 'web_socket') THEN 'requires_interception' ELSE 'protectable' END AS route,
 CASE WHEN mode = 'explicit_proxy' OR mode = 'system_proxy' AND proxy OR mode = 'tun' AND tun THEN 'ready' WHEN mode = 'tun' THEN 'needs_tun_install' ELSE 'needs_system_proxy_install' END AS capture,
 CASE WHEN NOT known THEN 'not_ai_traffic' WHEN protocol = 'http' THEN 'not_required' WHEN NOT enabled THEN 'disabled' WHEN NOT host_allowed THEN 'host_not_allowed' WHEN NOT consented THEN 'needs_user_consent' WHEN NOT installed THEN 'needs_local_ca' ELSE 'ready' END AS trust FROM g)
SELECT id, route, capture, trust, CASE WHEN capture <> 'ready' THEN 'needs_routing' WHEN NOT consented THEN 'needs_user_consent' WHEN trust <> 'ready' THEN 'needs_trust' WHEN NOT adapter THEN 'needs_adapter' ELSE 'ready' END AS interception FROM r""")
def readiness_ladders(spark, sf_dir):
    """Route, capture, trust and interception readiness; the two middle ones are paired by position."""
    g = _read(spark, sf_dir, "orders").selectExpr(*_split(GATES))
    c = F.col
    plain = ~c("protocol").isin("https", "web_socket")
    routing = g.select(c("id").alias("ordinal"), fn.route_readiness(c("known"), c("protocol")).alias("route"), fn.capture_readiness(c("mode"), c("proxy"), c("tun")).alias("routing"))
    trust = g.select(c("id").alias("ordinal"), fn.trust_readiness(c("known"), plain, c("enabled"), c("host_allowed"), c("consented"), c("installed")).alias("trust"), "consented", "adapter")
    return traffic.readiness(routing, trust).select(c("ordinal").alias("id"), "route", c("routing").alias("capture"), "trust", c("readiness").alias("interception"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'passthrough' WHEN o_orderkey % 5 = 0 THEN 'target' WHEN o_orderkey % 2 = 0 AND o_custkey % 2 = 1 THEN 'config_required' ELSE 'passthrough' END AS auth FROM orders""")
def auth_decisions(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 3 = 0 THEN 'generic' ELSE 'known' END AS provider", "o_orderkey % 5 = 0 AS target_key", "CASE WHEN o_orderkey % 2 = 0 THEN 'KEY' END AS key_env", "o_custkey % 2 = 0 AS caller_key")
    return rows.select("id", fn.auth_decision(*[F.col(c) for c in ("provider", "target_key", "key_env", "caller_key")]).alias("auth"))


@query("""SELECT id, CASE WHEN daemon = 'stale' THEN 'degraded' WHEN daemon = 'connected' AND plan = 'blocked' THEN 'degraded' WHEN plan <> 'ready' THEN 'needs_setup' WHEN daemon = 'disconnected' THEN 'disconnected' WHEN enabled THEN 'protected' ELSE 'paused' END AS state
FROM (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'connected' WHEN 1 THEN 'stale' ELSE 'disconnected' END AS daemon, CASE o_custkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'needs_action' ELSE 'blocked' END AS plan, o_orderkey % 2 = 0 AS enabled FROM orders)""")
def connect_states(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE o_orderkey % 3 WHEN 0 THEN 'connected' WHEN 1 THEN 'stale' ELSE 'disconnected' END AS daemon", "CASE o_custkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'needs_action' ELSE 'blocked' END AS plan", "o_orderkey % 2 = 0 AS enabled")
    return rows.select("id", fn.connect_state(F.col("daemon"), F.col("plan"), F.col("enabled")).alias("state"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'close' WHEN o_orderkey % 12 = 1 AND o_custkey % 3 > 0 THEN 'transform' WHEN o_orderkey % 12 IN (8, 9, 10) THEN 'pass' ELSE 'close' END AS action FROM orders")
def frame_actions(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), connections.frame_action(F.expr("o_custkey % 3 > 0"), F.expr("o_orderkey % 12"), F.expr("o_orderkey % 5 = 0")).alias("action"))


HELD = "map('Host', 'h', 'X-Keep', c_name, 'Digest', 'd', CASE WHEN c_custkey % 2 = 0 THEN 'Connection' ELSE 'CONNECTION' END, CASE WHEN c_custkey % 3 = 0 THEN 'close, X-Gone' ELSE 'close' END, 'x-gone', 'g', 'Authorization', 'a', 'Accept-Encoding', 'br')"


@query("SELECT c_custkey AS id, concat_ws(',', CASE WHEN c_custkey % 5 > 0 THEN 'Authorization' END, CASE WHEN c_custkey % 4 > 0 THEN 'Digest' END, 'X-Keep', CASE WHEN c_custkey % 3 > 0 THEN 'x-gone' END) AS request, concat_ws(',', 'Accept-Encoding', 'Authorization', 'Host', 'X-Keep', CASE WHEN c_custkey % 3 > 0 THEN 'x-gone' END) AS response, c_name AS kept FROM customer")
def header_rewrite(spark, sf_dir):
    """Headers of forwarded requests and returned responses; Connection counts in any case."""
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(HELD).alias("h"))
    sent = headers.forwarded(headers.without_integrity(F.col("h"), F.col("id") % 4 == 0), F.col("id") % 5 == 0)
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return rows.select("id", names(sent).alias("request"), names(headers.returned(F.col("h"))).alias("response"), sent["X-Keep"].alias("kept"))


# Rules, routes, targets and profiles

RULES = [
    {"id": "ips", "priority": 1, "action": "observe", "match": {"ips": ["10.0.0.1", "10.0.0.2:80"]}},
    {"id": "ports", "priority": 3, "action": "bypass", "match": {"ports": [443, 8080], "process_names": ["Curl", "wget"]}},
    {"id": "procs", "priority": 2, "action": "inspect", "match": {"process_names": ["PYTHON"]}},
    {"id": "shut", "priority": 9, "action": "block", "match": {"ports": [443]}},
]
SEEN = "o_orderkey AS id, concat('10.0.0.', cast(o_custkey % 4 as string)) AS host, CASE o_orderkey % 4 WHEN 0 THEN 443 WHEN 1 THEN 8080 WHEN 2 THEN 80 END AS port, 'https' AS protocol, '/p' AS path, CASE o_custkey % 5 WHEN 0 THEN 'CURL' WHEN 1 THEN 'python' WHEN 2 THEN 'Wget' END AS process_name"


@query(f"""SELECT id, CASE WHEN port IN (443, 8080) AND lower(process_name) IN ('curl', 'wget') THEN 'ports' WHEN process_name = 'python' THEN 'procs' WHEN host IN ('10.0.0.1', '10.0.0.2') THEN 'ips' END AS app_id FROM (SELECT {SEEN} FROM orders)""")
def rule_filters(spark, sf_dir):
    """Rules on addresses, ports and processes, restricted to the enabled apps."""
    seen = _read(spark, sf_dir, "orders").selectExpr(*_split(SEEN))
    return traffic.decide(seen, RULES, "allow", {"ips", "ports", "procs"}).select("id", "app_id")


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:]*)', 1)) AS host FROM pages), r AS (SELECT host, arg_min(page_id, page_id) AS target FROM h WHERE page_id % 3 = 0 GROUP BY host)
SELECT h.page_id AS id, r.host IS NOT NULL AS known, r.target FROM h LEFT JOIN r ON r.host = h.host""")
def host_routes(spark, sf_dir):
    """The first route of each request's host."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), fn.normalize_host(F.col("url")).alias("host"))
    routes = pages.where("id % 3 = 0").select(F.upper("host").alias("host"), F.col("id").alias("target"), F.col("id").alias("ordinal"))
    return traffic.route_of(pages, routes).select("id", "known", "target")


@query("SELECT n_name AS name, n_regionkey AS provider, n_name AS upstream FROM nation WHERE n_nationkey % 3 > 0")
def missing_targets(spark, sf_dir):
    routes = _read(spark, sf_dir, "nation").selectExpr("n_name AS name", "n_regionkey AS provider", "n_name AS upstream", "n_nationkey")
    return traffic.missing_targets(routes.drop("n_nationkey"), routes.where("n_nationkey % 3 = 0").drop("n_nationkey"))


@query("SELECT s_nationkey % 3 AS name, s_nationkey % 2 AS provider, 'u' AS upstream, min(s_suppkey) AS ordinal FROM supplier GROUP BY ALL")
def distinct_targets(spark, sf_dir):
    return traffic.distinct_targets(_read(spark, sf_dir, "supplier").selectExpr("s_nationkey % 3 AS name", "s_nationkey % 2 AS provider", "'u' AS upstream", "s_suppkey AS ordinal"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 OR n_nationkey >= 20 THEN 'new' ELSE 'old' END AS source FROM nation")
def profile_upsert(spark, sf_dir):
    nations = _read(spark, sf_dir, "nation")
    old = nations.where("n_nationkey < 20").selectExpr("n_nationkey AS id", "'old' AS source", "n_nationkey AS ordinal")
    new = nations.where("n_nationkey % 4 = 0 OR n_nationkey >= 20").selectExpr("n_nationkey AS id", "'new' AS source", "n_nationkey AS ordinal")
    return traffic.upsert_profiles(old, new).select("id", "source")


@query("""WITH p AS (SELECT r_regionkey AS ordinal, r_regionkey AS id FROM region WHERE r_regionkey <> 3), a AS (SELECT p.ordinal, n_nationkey, n_nationkey % 7 AS app FROM p JOIN nation ON n_regionkey = p.id),
f AS (SELECT app, min(ordinal * 1000 + n_nationkey) AS place FROM a GROUP BY app) SELECT app AS app_id, CAST(row_number() OVER (ORDER BY place) AS INT) AS ordinal FROM f""")
def profile_apps(spark, sf_dir):
    """The apps of the enabled profiles, each once, in order of first mention."""
    apps = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", (F.col("n_nationkey") % 7).alias("app")))), lambda x: x["app"])
    profiles = _read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(apps.alias("traffic_app_ids"))
    chosen = _read(spark, sf_dir, "region").where("r_regionkey <> 3").selectExpr("r_regionkey AS id", "r_regionkey AS ordinal")
    return traffic.traffic_apps(chosen, profiles)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || ',x' WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'd' END AS profiles FROM customer")
def enabled_choice(spark, sf_dir):
    """The enabled list, else the active profile, else the default."""
    listed = F.expr("CASE WHEN c_custkey % 3 = 0 THEN array(c_name, 'x') END")
    active = F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END")
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(traffic.enabled_profiles(listed, active, F.array(F.lit("d"))), ",").alias("profiles"))


# Bodies and streams


TURN_SQL = "text || ' mail u' || conv_id || '@site' || turn % 3 || '.example.com or 415-555-' || lpad(CAST(turn % 1000 AS VARCHAR), 4, '0') || '.'"


def _as_turn() -> Column:
    return F.concat(F.col("text"), F.lit(" mail u"), F.col("conv_id").cast("string"), F.lit("@site"), (F.col("turn") % 3).cast("string"), F.lit(".example.com or 415-555-"), F.lpad((F.col("turn") % 1000).cast("string"), 4, "0"), F.lit("."))


def _data(text: Column, shape: int) -> Column:
    """The JSON of a delta event of one of seven shapes."""
    delta = F.struct(text.alias("text"))
    content = F.array(F.struct(F.lit("x").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), text.alias("text")))
    return F.to_json(
        [
            F.struct(delta.alias("delta")), F.struct(text.alias("delta")), F.struct(F.array(F.struct(F.struct(F.lit(None).cast("string").alias("content")).alias("delta")), F.struct(F.struct(text.alias("content")).alias("delta"))).alias("choices")),
            F.struct(text.alias("completion")), F.struct(text.alias("text")), F.struct(content.alias("content")), F.struct(F.struct(content.alias("content")).alias("message")),
        ][shape]
    )


def _any_shape(text: Column) -> Column:
    out = _data(text, 0)
    for k in range(1, 7):
        out = F.when((F.col("conv_id") + F.col("turn")) % 7 == k, _data(text, k)).otherwise(out)
    return out


@query("SELECT conv_id, turn, text AS delta FROM conversations")
def json_text_delta(spark, sf_dir):
    """Whole turns, read back from the JSON of all seven shapes."""
    rows = _read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", structured.delta_text(_any_shape(F.col("text"))).alias("delta"))


REDACTED = f"WITH {O.spans('SELECT conv_id * 100000 + turn AS id, conv_id, turn, ' + TURN_SQL + ' AS text FROM conversations')}, " + O.spliced("""SELECT id, start, "end", '[' || kind || ']' AS new FROM kept""")


@query(REDACTED + " SELECT id // 100000 AS conv_id, id % 100000 AS turn, output AS text FROM done")
def sse_rewrite(spark, sf_dir):
    """Each turn as an event stream of two deltas that cut its address; the rewritten stream's text is the redacted turn."""
    text = _as_turn()
    cut = F.instr(text, "@site")
    event = lambda t: F.concat(F.lit("event: delta\r\ndata: "), _any_shape(t), F.lit("\r\n\r\n"))
    rows = _read(spark, sf_dir, "conversations").withColumn("cut", cut)
    body = F.concat(event(F.expr("left(full, cut)")), event(F.expr("substring(full, cut + 1)")))
    done = structured.map_streams(rows.withColumn("full", text).select("conv_id", "turn", body.alias("body")), _redacted)
    return done.select("conv_id", "turn", structured.stream_text("body").alias("text"))


@query("SELECT conv_id, turn, replace(text, 'e', 'EE') AS text FROM conversations")
def byte_stream(spark, sf_dir):
    """Each turn as byte chunks that cut its characters; mapped in order and joined again."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("raw"))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.octet_length("raw"), F.lit(1)), F.lit(37)))
    chunks = rows.withColumn("seq", at).select(F.concat_ws("/", "conv_id", "turn").alias("stream_id"), "seq", F.expr("substring(raw, seq, 37)").alias("chunk"))
    done = streams.transform_chunks(chunks, lambda t: t.replace("e", "EE"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("chunk").alias("x")))), lambda c: c["x"]), "")
    whole = done.groupBy("stream_id").agg(F.decode(F.unhex(text), "UTF-8").alias("text"))
    part = lambda k: F.split("stream_id", "/")[k].cast("long")
    return whole.select(part(0).alias("conv_id"), part(1).alias("turn"), "text")


@query("SELECT c_custkey AS id, '{\"a\":[\"call [phone]\",1],\"b\":{\"email\":\"[email] and ' || c_name || '\",\"n\":' || c_custkey || '}}' AS body FROM customer")
def json_bodies(spark, sf_dir):
    body = F.expr("""concat('{"b": {"n":', cast(c_custkey as string), ', "email": "user', cast(c_custkey as string), '@a.example.com and ', c_name, '"}, "a": ["call +1415', lpad(cast(c_custkey as string), 7, '0'), '", 1]}')""")
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), body.alias("body"))
    return structured.map_bodies(rows, _redacted)


SITE = "'site' || (conv_id + turn) % 5 || '.example.com'"


@query(f"SELECT a.conv_id, a.turn, coalesce(string_agg(DISTINCT {SITE.replace('conv_id', 'b.conv_id').replace('turn', 'b.turn')}, ',' ORDER BY {SITE.replace('conv_id', 'b.conv_id').replace('turn', 'b.turn')}), '') AS related FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn < a.turn GROUP BY a.conv_id, a.turn")
def related_domains_by_conv(spark, sf_dir):
    """Every turn's own text names a site; later turns know it."""
    text = F.concat(F.col("text"), F.lit(" mail a@Site"), ((F.col("conv_id") + F.col("turn")) % 5).cast("string"), F.lit(".example.com or so"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return connections.related_domains(rows).select("conv_id", "turn", F.array_join("related", ",").alias("related"))


GATED = "text || CASE WHEN turn >= 3 AND (conv_id + turn) % 4 = 0 THEN ' my ssn is 123-45-6789' WHEN turn = 0 THEN ' mail a@site.example.com' ELSE ' see site.example.com now' END"


@query("WITH e AS (SELECT conv_id, min(turn) AS last FROM conversations WHERE turn >= 3 AND (conv_id + turn) % 4 = 0 GROUP BY conv_id), z AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0) SELECT c.conv_id, c.turn, CASE WHEN c.turn = last THEN 'blocked' ELSE 'protected' END AS status, CASE WHEN c.turn = last THEN NULL ELSE text || CASE WHEN turn = 0 THEN ' mail [email]' WHEN z.conv_id IS NOT NULL THEN ' see [domain] now' ELSE ' see site.example.com now' END END AS output FROM conversations c LEFT JOIN e ON e.conv_id = c.conv_id LEFT JOIN z ON z.conv_id = c.conv_id WHERE last IS NULL OR c.turn <= last")
def conversation_gate(spark, sf_dir):
    """Whole turns protected with the domains seen before; a blocked turn ends its conversation."""
    tail = F.when((F.col("turn") >= 3) & ((F.col("conv_id") + F.col("turn")) % 4 == 0), " my ssn is 123-45-6789").when(F.col("turn") == 0, " mail a@site.example.com").otherwise(" see site.example.com now")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("text"))
    return connections.protect_conversations(rows, {"ssn": "block"}, default="redact", salt=SALT).select("conv_id", "turn", "status", "output")


@query("SELECT c_custkey AS id, lower(c_mktsegment) || c_custkey % 3 || '.example.com' AS domain FROM customer UNION ALL SELECT c_custkey, lower(c_mktsegment) || c_custkey % 3 || '.example.com' FROM customer WHERE c_custkey % 2 = 0")
def related_domain_hits(spark, sf_dir):
    """Domains known from elsewhere are found in texts without an address, in any case, but not inside longer names."""
    domain = F.concat(F.lower("c_mktsegment"), (F.col("c_custkey") % 3).cast("string"), F.lit(".example.com"))
    text = F.concat(F.col("c_name"), F.lit(" see ("), F.initcap(domain), F.lit(") and www."), domain, F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("; "), F.regexp_replace(domain, r"\.example", " .example"))).otherwise(""))
    df = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("text"), domain.alias("domain"))
    spans = df.select("id", F.explode(detections(F.col("text"), F.array(F.concat("domain", F.lit(".")), F.lit("bad_")))).alias("s"))
    return spans.select("id", fn.canonical(F.col("s.kind"), F.col("s.value")).alias("domain"))


FRAME = """CASE WHEN turn % 5 = 4 AND conv_id % 3 = 0 THEN 9 WHEN turn = 6 AND conv_id % 5 = 0 THEN 8 WHEN turn = 5 AND conv_id % 7 = 0 THEN 2 ELSE 1 END"""
SAID = """text || CASE WHEN turn >= 3 AND (conv_id + turn) % 4 = 0 THEN ' my ssn is 123-45-6789' WHEN turn = conv_id % 4 THEN ' mail a@site.example.com' ELSE ' see site.example.com now' END"""


@query(f"""WITH f AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'client' ELSE 'server' END AS direction, {FRAME} AS opcode, text, turn >= 3 AND (conv_id + turn) % 4 = 0 AS bad FROM conversations),
 e AS (SELECT conv_id, min(turn) AS last FROM f WHERE opcode IN (2, 8) OR opcode = 1 AND bad GROUP BY conv_id),
 n AS (SELECT conv_id, min(turn) AS named FROM f WHERE turn = conv_id % 4 AND NOT bad AND opcode = 1 AND direction = 'client' GROUP BY conv_id)
SELECT f.conv_id, f.turn, direction, CASE WHEN opcode = 2 THEN 'closed' WHEN opcode IN (8, 9) THEN 'passed' WHEN bad THEN 'blocked' ELSE 'protected' END AS status,
 CASE WHEN opcode IN (8, 9) THEN text || CASE WHEN bad THEN ' my ssn is 123-45-6789' WHEN turn = f.conv_id % 4 THEN ' mail a@site.example.com' ELSE ' see site.example.com now' END
 WHEN opcode = 2 OR bad THEN NULL ELSE text || CASE WHEN turn = f.conv_id % 4 THEN ' mail [email]' WHEN direction = 'server' AND turn > named THEN ' see [domain] now' ELSE ' see site.example.com now' END END AS output
FROM f LEFT JOIN e ON e.conv_id = f.conv_id LEFT JOIN n ON n.conv_id = f.conv_id WHERE last IS NULL OR f.turn <= last""")
def connection_frames(spark, sf_dir):
    """Turns as frames of two directions: a block, a closing frame or a binary one in either ends both."""
    rows = _read(spark, sf_dir, "conversations")
    direction = F.when(F.col("role") == "user", "client").otherwise("server")
    frames = rows.select("conv_id", "turn", direction.alias("direction"), F.lit(True).alias("fin"), F.expr(FRAME).alias("opcode"), F.lit(False).alias("compressed"), F.expr(SAID).alias("text"))
    return connections.protect_connections(frames, {"ssn": "block"}, connection="conv_id", seq="turn", default="redact", salt=SALT)


GRANTED = "concat('c', o_orderkey) AS id, 'email' AS kind, concat('f', o_custkey % 40) AS value_fingerprint, {now} + (o_orderkey * 7919) % 500000 AS created_at, 3600 + (o_orderkey * 31) % 200000 AS ttl, (o_orderkey * 13) % 90000 AS gone, o_orderkey % 5 = 0 AS revoked"
MOMENTS = "concat('f', l_suppkey % 45) AS value_fingerprint, {now} + (l_orderkey * 104729 + l_linenumber * 7) % 700000 AS at"


@query(f"""WITH c AS (SELECT *, created_at + ttl AS expires_at, CASE WHEN revoked THEN least(created_at + ttl, created_at + gone) ELSE created_at + ttl END AS until FROM (SELECT {GRANTED.format(now=NOW)} FROM orders)),
 m AS (SELECT DISTINCT {MOMENTS.format(now=NOW)} FROM lineitem)
SELECT 'email' AS kind, m.value_fingerprint, m.at, arg_max(c.id, (c.expires_at, c.id)) AS consent_id FROM m LEFT JOIN c ON c.value_fingerprint = m.value_fingerprint AND c.created_at <= m.at AND m.at < c.until GROUP BY ALL""")
def consent_as_of(spark, sf_dir):
    """The longest lasting of the consents that held at each moment."""
    rows = _read(spark, sf_dir, "orders").selectExpr(*_split(GRANTED.format(now=NOW)))
    revoked = F.when(F.col("revoked"), F.col("created_at") + F.col("gone"))
    consents = rows.select("id", "kind", "value_fingerprint", F.lit(None).cast("string").alias("vault_key"), F.lit("global").alias("scope"), "created_at", (F.col("created_at") + F.col("ttl")).alias("expires_at"), revoked.alias("revoked_at"), F.lit("user").alias("created_by"), F.lit(None).cast("string").alias("reason"))
    asked = _read(spark, sf_dir, "lineitem").selectExpr("'email' AS kind", *_split(MOMENTS.format(now=NOW)))
    return consent.active_at(asked, consents)


TABLE_HOST = "split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1)"


@query(f"""WITH p AS (SELECT page_id, lower({TABLE_HOST}) AS host, CASE WHEN url LIKE 'https://%' THEN 'https' ELSE 'http' END AS protocol, nullif(regexp_extract(url, '^[a-z]+://[^/]*(/.+)$', 1), '') AS path FROM pages),
 r AS (SELECT page_id AS ordinal, page_id % 7 AS priority, page_id % 4 AS form, host, path, substr(host, position('.' IN host) + 1) AS zone FROM p WHERE page_id % 2 = 0),
 m AS (SELECT p.page_id, r.* FROM p JOIN r ON form = 0 AND p.host = r.host UNION ALL SELECT p.page_id, r.* FROM p JOIN r ON form = 2 AND contains(r.host, '.') AND (p.host = zone OR ends_with(p.host, '.' || zone)) AND starts_with(p.path, left(r.path, 6)))
SELECT p.page_id AS id, 'r' || arg_max(m.ordinal, (m.priority, m.ordinal)) AS app_id FROM p LEFT JOIN m ON m.page_id = p.page_id GROUP BY p.page_id""")
def traffic_rule_table(spark, sf_dir):
    """As many rules as half of the pages: their hosts, and their zones with the beginning of a path."""
    pages = traffic.observations(_read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"))
    rows = pages.where("id % 2 = 0")
    zone = F.expr("substring(host, instr(host, '.') + 1)")
    none = lambda t="string": F.array().cast(f"array<{t}>")
    zoned = F.when(F.col("host").contains(".") & F.col("path").isNotNull(), F.array(F.concat(F.lit("*."), zone)))
    match = F.struct(
        F.when(F.col("id") % 4 == 0, F.array(F.upper("host"))).otherwise(zoned).alias("domains"), none().alias("ips"), F.when(F.col("id") % 4 == 2, F.array(F.left("path", F.lit(6)))).otherwise(none()).alias("urls"),
        none("int").alias("ports"), none().alias("protocols"), none().alias("process_names"),
    )
    rules = rows.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.lit(True).alias("enabled"), (F.col("id") % 7).cast("int").alias("priority"), F.col("id").alias("ordinal"), match.alias("match"), F.lit("inspect").alias("action"))
    return traffic.decide_by_table(pages, rules, "allow").select("id", "app_id")


@query("SELECT conv_id, coalesce(string_agg(replace(text, 'e', '*'), '' ORDER BY turn), '') AS text FROM conversations GROUP BY conv_id")
def event_stream(spark, sf_dir):
    """Each conversation as an event stream in chunks of 41 bytes, rewritten with a tail of four events; its deltas read back."""
    rows = _read(spark, sf_dir, "conversations")
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("text")).alias("delta"))), F.lit("\n\n"))
    raw = rows.select("conv_id", "turn", F.encode(event, "UTF-8").alias("raw"))
    at = F.explode(F.sequence(F.lit(1), F.octet_length("raw"), F.lit(41)))
    chunks = raw.withColumn("k", at).select(F.col("conv_id").cast("string").alias("stream_id"), (F.col("turn") * 1_000_000_000 + F.col("k")).alias("seq"), F.expr("substring(raw, k, 41)").alias("chunk"))
    done = streams.transform_chunks(chunks, lambda t: t.replace("e", "*"), "events")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("chunk").alias("x")))), lambda c: c["x"]), "")
    whole = done.groupBy("stream_id").agg(F.decode(F.unhex(body), "UTF-8").alias("body"))
    return whole.select(F.col("stream_id").cast("long").alias("conv_id"), structured.stream_text("body").alias("text"))


TYPED = "CASE c_custkey % 3 WHEN 0 THEN concat('data: {\"text\":\"', c_name, '\"}', chr(10), chr(10)) WHEN 1 THEN concat('{\"a\":\"', c_name, '\",\"c_name\":', c_custkey, '}') ELSE concat('c_name ', c_name) END"


@query(f"SELECT id, kind, CASE WHEN id % 3 = 1 THEN replace(replace(body, 'Customer', 'CUSTOMER'), 'c_name', 'c_name') ELSE replace(body, 'Customer', 'CUSTOMER') END AS body FROM (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'text/event-stream; charset=utf-8' WHEN 1 THEN 'application/json' END AS kind, {TYPED} AS body FROM customer)")
def typed_bodies(spark, sf_dir):
    """Bodies mapped as their content type says: events, JSON values (not keys), or text."""
    kind = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'text/event-stream; charset=utf-8' WHEN 1 THEN 'application/json' END")
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), kind.alias("kind"), F.expr(TYPED).alias("body"))
    return structured.map_typed(rows, lambda t: t.replace("Customer", "CUSTOMER"), "body", "kind")


BOUND = "concat('app', s_suppkey % 60) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'allow' ELSE 'inspect' END AS action, s_suppkey % 5 > 0 AS ruled, CASE WHEN s_suppkey % 7 > 0 THEN 'p' END AS provider, CASE WHEN s_suppkey % 11 > 0 THEN 'u' ELSE '' END AS upstream"


@query(f"""WITH r AS (SELECT {BOUND} FROM supplier) SELECT 'id used twice' AS problem, id AS app_id FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'inspects without a rule', id FROM r WHERE action = 'inspect' AND NOT ruled
 UNION ALL SELECT 'inspects without provider', id FROM r WHERE action = 'inspect' AND provider IS NULL UNION ALL SELECT 'inspects without upstream', id FROM r WHERE action = 'inspect' AND upstream = ''
 UNION ALL SELECT 'enabled app does not exist', 'app' || n_nationkey * 9 FROM nation WHERE 'app' || n_nationkey * 9 NOT IN (SELECT id FROM r)""")
def rule_problems(spark, sf_dir):
    """What is wrong with a table of rules."""
    rows = _read(spark, sf_dir, "supplier").selectExpr(*_split(BOUND))
    none = lambda t="string": F.array().cast(f"array<{t}>")
    match = F.struct(F.when(F.col("ruled"), F.array(F.lit("x"))).otherwise(none()).alias("domains"), none().alias("ips"), none().alias("urls"), none("int").alias("ports"), none().alias("protocols"), none().alias("process_names"))
    enabled = _read(spark, sf_dir, "nation").selectExpr("concat('app', n_nationkey * 9) AS id")
    return traffic.problems(rows.withColumn("match", match), enabled)


TARGETS_HELD = "concat('t', s_suppkey % 70) AS name, concat('p', s_suppkey % 9) AS provider, concat('https://H', s_suppkey % 50, '.example:443/x') AS upstream, s_suppkey AS ordinal"
ASKED = "o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN concat('p', o_custkey % 11) END AS provider_hint, CASE WHEN o_orderkey % 3 = 0 THEN concat('t', o_orderkey % 90) END AS name_hint, concat('h', o_orderkey % 60, '.example') AS host"


@query(f"""WITH t AS (SELECT *, lower(split_part(split_part(upstream, '://', 2), ':', 1)) AS h FROM (SELECT {TARGETS_HELD} FROM supplier)), r AS (SELECT {ASKED} FROM orders),
 m AS (SELECT r.id, min(t.ordinal) FILTER (t.name = r.name_hint OR t.h = r.host) AS near, min(t.ordinal) AS mine FROM r JOIN t ON t.provider = r.provider_hint GROUP BY r.id)
SELECT r.id, t.name AS target FROM r LEFT JOIN m ON m.id = r.id JOIN t ON t.ordinal = coalesce(m.near, m.mine, (SELECT min(ordinal) FROM t))""")
def route_targets(spark, sf_dir):
    """Targets as a table: hinted provider with hinted name or host, else the provider's first, else the first of all."""
    targets = _read(spark, sf_dir, "supplier").selectExpr(*_split(TARGETS_HELD))
    return traffic.choose_target_by_table(_read(spark, sf_dir, "orders").selectExpr(*_split(ASKED)), targets).select("id", "target")
