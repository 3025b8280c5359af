"""More engine queries: vault, consents, events and reports, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect
from ..functions import scalars as fn
from ..operators import consent, event_log, events, vault
from ..sources import tables
from ..sources.shared import fresh
from . import oracles as O
from . import pipeline, reports, views
from .queries import ACTION, COMPOSED_SQL, CONSENT_SQL, LOG_SQL, NOW, OPEN, POLICY, SALT, STORE_SQL, TYPED_SQL, _composed, _consents, _log, _own_consents, _read, _split, _spread, _store, _typed_store, query

DAY = "strftime(to_timestamp({c}) AT TIME ZONE 'UTC', '%Y-%m-%d')"
#: Every customer's address, its reference id, and whether the vault has it.
MAIL = "concat('user', cast({k} as string), '@mail', cast({k} % 7 as string), '.example.com')"
MAIL_ID = O.reference_id("old", "'email'", "(" + MAIL.format(k="c_custkey") + ")")


def _mail(k: str = "c_custkey"):
    return F.expr(MAIL.format(k=k))


def _held(spark, sf_dir, condition: str) -> DataFrame:
    """A vault with the addresses of the customers that ``condition`` picks, under references of its own salt."""
    rows = _read(spark, sf_dir, "customer").where(condition).select(_mail().alias("value"))
    key = fn.reference_key(F.lit("email"), fn.reference_id("old", F.lit("email"), F.col("value")))
    return rows.select(key.alias("key"), "value", F.lit(NOW - 50).cast("long").alias("created_at"), F.lit(NOW - 50).cast("long").alias("updated_at"))


# Vault


@query(f"SELECT * FROM ({STORE_SQL}) WHERE key = 'phone:000007'")
def vault_lookup(spark, sf_dir):
    return vault.get(_store(spark, sf_dir), "phone:000007")


@query(f"SELECT key, split_part(key, ':', 1) AS kind, value, {DAY.format(c='created_at')} AS first_seen, '[' || key || ']' AS reference FROM ({STORE_SQL}) WHERE key = 'phone:000007'")
def wallet_detail(spark, sf_dir):
    return views.wallet_detail(_store(spark, sf_dir), "phone:000007")


@query(f"SELECT count(*) AS total FROM ({STORE_SQL})")
def vault_count(spark, sf_dir):
    return vault.count(_store(spark, sf_dir))


@query(f"SELECT 'phone:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key, c_custkey % 5 <> 0 AS existed FROM customer")
def vault_deleted(spark, sf_dir):
    keys = _read(spark, sf_dir, "customer").selectExpr("concat('phone:', lpad(cast(c_custkey as string), 6, '0')) AS key")
    return vault.deleted(_store(spark, sf_dir), keys)


@query(f"""SELECT c_custkey AS id, 'to [email:' || CASE WHEN c_custkey % 2 = 0 THEN {MAIL_ID} ELSE {O.reference_id(SALT, "'email'", "(" + MAIL.format(k="c_custkey") + ")")} END || '] and more' AS output FROM customer""")
def vault_reuse(spark, sf_dir):
    """Values that the vault knows keep their reference, others get a new one."""
    texts = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("to "), _mail(), F.lit(" and more")).alias("text"))
    return pipeline.protect(texts, {}, vault=_held(spark, sf_dir, "c_custkey % 2 = 0"), salt=SALT).select("id", "output")


@query(f"""SELECT 'email:' || {MAIL_ID} AS key, {MAIL.format(k="c_custkey")} AS value, CAST({NOW - 50} AS BIGINT) AS created_at, CAST(CASE WHEN c_custkey % 3 = 0 THEN {NOW} ELSE {NOW - 50} END AS BIGINT) AS updated_at FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'email:' || {O.reference_id(SALT, "'email'", "(" + MAIL.format(k="c_custkey") + ")")}, {MAIL.format(k="c_custkey")}, {NOW}, {NOW} FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0""")
def vault_touch(spark, sf_dir):
    """Writing what protecting found: known values are touched, others inserted."""
    held = _held(spark, sf_dir, "c_custkey % 2 = 0")
    texts = _read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), _mail().alias("text"))
    return vault.write_values(held, pipeline.written_values(pipeline.protect(texts, {}, vault=held, salt=SALT)), NOW)


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT kind, count(*) AS n, count(*) AS n_references FROM kept GROUP BY kind")
def write_without_dedup(spark, sf_dir):
    """Every detection has a reference of its own."""
    done = pipeline.protect(_composed(spark, sf_dir), {}, salt=SALT, deduplicate=False)
    rows = done.select(F.explode("decisions").alias("d")).select("d.kind", "d.ref_id")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("ref_id").alias("n_references"))


class Refusing:
    """A store that takes no value with a 3 in it."""

    def put(self, rows):
        return [None if "3" in value else id_ for _, value, id_ in rows]

    def get(self, keys):
        return [None] * len(keys)


@query(f"""WITH {O.spans(COMPOSED_SQL)} SELECT kind, CASE WHEN contains({O.canonical()}, '3') THEN 'redact_only_fallback' ELSE 'tokenized' END AS mode, count(*) AS n,
 count(DISTINCT CASE WHEN NOT contains({O.canonical()}, '3') THEN {O.canonical()} END) AS n_references FROM kept GROUP BY ALL""")
def vault_client_fallback(spark, sf_dir):
    """Values that the store refuses are redacted, others have references."""
    done = pipeline.protect_through(_composed(spark, sf_dir), {}, Refusing, salt=SALT)
    rows = done.select(F.explode("plan.replacements").alias("r")).select("r.kind", "r.mode", "r.ref_id")
    return rows.groupBy("kind", "mode").agg(F.count("*").alias("n"), F.countDistinct("ref_id").alias("n_references"))


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT id, kind, start, '[' || kind || ']' AS shown FROM kept WHERE {ACTION(OPEN)} IN ('tokenize', 'redact')")
def vault_down(spark, sf_dir):
    """Where the vault cannot be written, values are redacted."""
    done = pipeline.protect(_composed(spark, sf_dir), OPEN, salt=SALT, vault_available=F.lit(False))
    return done.select("id", F.explode("plan.replacements").alias("r")).select("id", "r.kind", "r.start", F.col("r.text").alias("shown"))


@query("SELECT c_custkey AS id, 'a note, ' || CASE WHEN c_custkey % 4 = 0 THEN '[email]' ELSE 'kept' END AS output FROM customer")
def pluggable_policy(spark, sf_dir):
    """A policy given as an expression: only addresses at one host are redacted."""
    text = F.concat(F.lit("a note, "), F.expr("CASE WHEN c_custkey % 4 = 0 THEN concat('x', cast(c_custkey as string), '@in.example.com') ELSE concat('y', cast(c_custkey as string), '@out.example.com') END"))
    texts = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("text"))
    done = pipeline.protect(texts, lambda s: F.when(s["value"].endswith("@in.example.com"), "redact").otherwise("allow"), salt=SALT)
    return done.select("id", F.regexp_replace("output", "y[0-9]+@out.example.com", "kept").alias("output"))


# References in texts


def _mixed(spark, sf_dir) -> DataFrame:
    """Texts with the reference of a customer, that of the next one and a malformed one."""
    ref = lambda k: fn.reference_display(F.lit("email"), fn.reference_id("old", F.lit("email"), _mail(k)))
    text = F.concat(F.lit("é "), ref("c_custkey"), F.lit(" by \\["), F.substring(ref("(c_custkey + 1)"), 2, 28), F.lit("\\] not [email] [cc:short]"))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("text"))


MIXED = f"""mixed AS (SELECT a.c_custkey AS id, a.c_custkey % 3 <> 0 AS own, b.c_custkey IS NOT NULL AS next, {MAIL.format(k='a.c_custkey')} AS own_value, {MAIL.format(k='(a.c_custkey + 1)')} AS next_value
 FROM customer a LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) b ON b.c_custkey = a.c_custkey + 1)"""
MIXED_ID = {k: O.reference_id("old", "'email'", f"{k}_value") for k in ("own", "next")}
STATUS = "CASE WHEN own AND next THEN 'resolved' WHEN own OR next THEN 'partial' ELSE 'unresolved' END"
OUTPUT = f"""CASE WHEN own OR next THEN 'é ' || CASE WHEN own THEN own_value ELSE '[email:' || {MIXED_ID['own']} || ']' END || ' by ' || CASE WHEN next THEN next_value ELSE '\\[email:' || {MIXED_ID['next']} || '\\]' END || ' not [email] [cc:short]' END"""


def _third(spark, sf_dir) -> DataFrame:
    return _held(spark, sf_dir, "c_custkey % 3 <> 0")


@query(f"WITH {MIXED} SELECT id, {STATUS} AS status, {OUTPUT} AS output FROM mixed")
def resolve_texts(spark, sf_dir):
    return pipeline.resolve(_mixed(spark, sf_dir), _third(spark, sf_dir)).select("id", "status", "output")


@query(f"WITH {MIXED} SELECT id, CAST(own AS INT) + CAST(next AS INT) AS resolved, 2 - CAST(own AS INT) - CAST(next AS INT) AS missing FROM mixed")
def resolve_missing(spark, sf_dir):
    done = pipeline.resolve(_mixed(spark, sf_dir), _third(spark, sf_dir))
    return done.select("id", F.size("resolved").alias("resolved"), F.size("missing").alias("missing"))


@query(f"WITH {MIXED} SELECT id, CASE WHEN own AND next THEN 'resolved' ELSE 'failed_strict' END AS status, CASE WHEN own AND next THEN {OUTPUT} END AS output FROM mixed")
def resolve_strict(spark, sf_dir):
    return pipeline.resolve(_mixed(spark, sf_dir), _third(spark, sf_dir), strict=True).select("id", "status", "output")


@query(f"""WITH {MIXED}, n AS (SELECT sum(CAST(own AS INT) + CAST(next AS INT)) AS there, count(*) * 2 AS every FROM mixed)
SELECT 'vault_read' AS event_type, 'vault_read_succeeded' AS action, there AS n FROM n UNION ALL SELECT 'resolve', 'resolved', there FROM n UNION ALL SELECT 'resolve', 'missing', every - there FROM n""")
def resolve_events(spark, sf_dir):
    rows = events.resolve_events(pipeline.resolve(_mixed(spark, sf_dir), _third(spark, sf_dir)))
    return rows.groupBy("event_type", "action").agg(F.count("*").alias("n"))


@query(f"WITH {MIXED} SELECT count(*) AS texts, count(*) * 2 AS \"references\", sum(CAST(own AS INT) + CAST(next AS INT)) AS resolved, sum(2 - CAST(own AS INT) - CAST(next AS INT)) AS missing, CAST(0 AS BIGINT) AS read_failures FROM mixed")
def resolve_summary(spark, sf_dir):
    return reports.resolve_summary(pipeline.resolve(_mixed(spark, sf_dir), _third(spark, sf_dir)))


@query(f"WITH {MIXED} SELECT id, {STATUS} AS status, CAST(own AS INT) + CAST(next AS INT) AS resolved, CASE WHEN NOT own THEN 'email:' || {MIXED_ID['own']} WHEN NOT next THEN 'email:' || {MIXED_ID['next']} END AS first_open FROM mixed")
def resolve_reports(spark, sf_dir):
    done = reports.resolve_reports(pipeline.resolve(_mixed(spark, sf_dir), _third(spark, sf_dir)))
    get = lambda p: F.get_json_object("report", p)
    return done.select("id", get("$.status").alias("status"), get("$.summary.resolved").cast("int").alias("resolved"), get("$.unresolved[0].key").alias("first_open"))


@query(f"""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'from ' || {MAIL.format(k="c_custkey")} || ' or x@y.example.com' WHEN 1 THEN 'write [email] for 5' WHEN 2 THEN '{pipeline.BLOCKED}' ELSE 'no value here' END AS output FROM customer""")
def inbound_choice(spark, sf_dir):
    """What resolves is returned as it is; else the text is protected; a blocked one is replaced."""
    ref = fn.reference_display(F.lit("email"), fn.reference_id("old", F.lit("email"), _mail()))
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("from "), ref, F.lit(" or x@y.example.com"))).when(k == 1, "write a@b.example.com for 5").when(k == 2, "my ssn is 123-45-6789").otherwise("no value here")
    texts = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("text"))
    return pipeline.inbound(texts, _held(spark, sf_dir, "c_custkey % 4 = 0"), {"email": "redact", "ssn": "block"}, salt=SALT)


@query(f"SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'on to ' || {MAIL.format(k='c_custkey')} ELSE 'on to [email:' || {MAIL_ID} || ']' END AS expanded, 'on to [email:' || {MAIL_ID} || ']' AS plain FROM customer")
def protect_with_expansion(spark, sf_dir):
    """References of consented values are expanded before protecting, unless that is switched off."""
    ref = fn.reference_display(F.lit("email"), fn.reference_id("old", F.lit("email"), _mail()))
    texts = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("on to "), ref).alias("text"))
    held, own = _held(spark, sf_dir, "true"), _own_consents(spark, sf_dir)
    run = lambda expand, name: pipeline.protect(texts, {}, consents=own, now=NOW, vault=held, salt=SALT, expand=expand).select("id", F.col("output").alias(name))
    return run(True, "expanded").join(run(False, "plain"), "id")


# Consents


@query(f"""WITH v AS ({TYPED_SQL}), asked AS (SELECT key FROM v UNION ALL SELECT 'phone:' || {O.reference_id('gone', "'phone'", 'c_name')} FROM customer)
SELECT CASE WHEN v.key IS NOT NULL THEN 'granted' ELSE 'value_not_found' END AS state, count(*) AS n FROM asked LEFT JOIN v ON v.key = asked.key WHERE asked.key LIKE 'phone:%' GROUP BY ALL
UNION ALL SELECT 'invalid_reference', count(*) FROM v WHERE key LIKE 'note:%'""")
def grant_references(spark, sf_dir):
    held = _typed_store(spark, sf_dir)
    gone = _read(spark, sf_dir, "customer").select(fn.reference_key(F.lit("phone"), fn.reference_id("gone", F.lit("phone"), F.col("c_name"))).alias("key"))
    good, bad = consent.grant_references(held.select("key").union(gone), held, NOW)
    return good.select(F.lit("granted").alias("state")).union(bad.select("error")).groupBy("state").agg(F.count("*").alias("n"))


@query(f"SELECT id, created_at FROM ({CONSENT_SQL}) ORDER BY created_at DESC, id LIMIT 50")
def consent_page(spark, sf_dir):
    """The first page of the consent list, in its own order."""
    return consent.listed(_consents(spark, sf_dir), 50).select("id", "created_at")


@query(f"SELECT CASE kind WHEN 'phone' THEN 'phone' ELSE 'email' END AS kind, count(*) AS n FROM (SELECT DISTINCT CASE kind WHEN 'phone' THEN 'phone' ELSE 'email' END AS kind, value_fingerprint FROM ({CONSENT_SQL}) WHERE scope = 'global' AND revoked_at IS NULL AND expires_at > {NOW}) GROUP BY ALL")
def consent_unknown_tag(spark, sf_dir):
    """A kind that is not known counts as an address."""
    odd = _consents(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "phone", "phone").otherwise("fax-number"))
    return consent.active(odd, NOW).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT kind, count(*) AS n, count(DISTINCT {O.canonical()}) AS n_consents FROM kept WHERE kind = 'email' AND id % 3 = 0 GROUP BY kind")
def consent_events(spark, sf_dir):
    done = pipeline.protect(_composed(spark, sf_dir), {**POLICY, "ssn": "allow"}, consents=_own_consents(spark, sf_dir), now=NOW, salt=SALT)
    rows = events.protect_events(done).where("event_type = 'consent' AND action LIKE 'allow:%'")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("action").alias("n_consents"))


# Log


@query(f"""WITH {O.spans(COMPOSED_SQL)}, n AS (SELECT id, count(*) AS k, count(DISTINCT CASE WHEN {ACTION(OPEN)} = 'tokenize' THEN kind || {O.canonical()} END) AS w FROM kept GROUP BY id)
SELECT CAST({NOW} AS BIGINT) AS timestamp, 2 * sum(3 * k + w) AS n, CAST(1 AS BIGINT) AS first_id, 2 * sum(3 * k + w) AS last_id, 2 * sum(3 * k + w) AS ids, count(*) AS operations FROM n""")
def log_append(spark, sf_dir):
    """Two appends within one second, one of them again as after a crash: ids without gap or repeat, each event once."""
    made, path = events.protect_events(pipeline.protect(_composed(spark, sf_dir), OPEN, salt=SALT)), fresh(spark, "log")
    for batch, now in ((0, NOW), (1, NOW), (0, NOW + 9)):
        event_log.append(made, path, "job", batch, now)
    rows = event_log.read(spark, path)
    return rows.groupBy("timestamp").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("id").alias("ids"), F.countDistinct("operation_id").alias("operations"))


@query(f"SELECT id, level FROM ({LOG_SQL}) ORDER BY id DESC LIMIT 100")
def log_page(spark, sf_dir):
    """The first page of the log, newest first."""
    return events.newest_first(_log(spark, sf_dir)).limit(100).select("id", "level")


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT (SELECT count(*) FROM src) AS texts, CAST(0 AS BIGINT) AS leaks")
def events_name_no_value(spark, sf_dir):
    """No event of a text holds any of its values."""
    done = pipeline.protect(_composed(spark, sf_dir), OPEN, salt=SALT)
    said = events.protect_events(done).groupBy("operation_id").agg(F.array_join(F.collect_list(F.concat_ws(" ", "message", "reference", "action")), " ").alias("said"))
    rows = done.select(F.col("id").cast("string").alias("operation_id"), "decisions").join(said, "operation_id")
    return rows.agg(F.count("*").alias("texts"), F.count_if(F.exists("decisions", lambda d: F.col("said").contains(d["value"]))).alias("leaks"))


LEAKY = "c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN concat('sent to ', user_of, ' today') WHEN c_custkey % 9 = 1 THEN concat('seen <', phone_of, '>') ELSE concat('found at bytes ', c_custkey % 50, '..', c_custkey) END AS message, concat('email:', c_custkey) AS reference, 'detected' AS action"
OTHERS = "*, concat('user', cast((c_custkey * 7 + 3) % 4000 as string), '@mail', cast(((c_custkey * 7 + 3) % 4000) % 7 as string), '.example.com') AS user_of, concat('+1415', lpad(cast((c_custkey * 3) % 4000 as string), 7, '0')) AS phone_of"


@query(f"""WITH {O.spans(COMPOSED_SQL)}, v AS (SELECT DISTINCT kind, {O.canonical()} AS value FROM kept), l AS (SELECT {LEAKY} FROM (SELECT {OTHERS} FROM customer))
SELECT l.id, v.kind, {O.fingerprint("v.kind", "v.value")} AS fingerprint FROM l JOIN v ON contains(l.message || chr(31) || l.reference || chr(31) || l.action, v.value)""")
def log_leaks(spark, sf_dir):
    """Events that hold a value of any text, planted ones of other operations among them."""
    log = _read(spark, sf_dir, "customer").selectExpr(*_split(OTHERS)).selectExpr(*_split(LEAKY))
    decided = pipeline.decide(_composed(spark, sf_dir, spread=True), OPEN, salt=SALT)
    return events.leaks(log, decided.select("kind", F.col("canonical").alias("value")))


WORD = "CAST('0x' || substr(h, 8 * w + 1, 8) AS BIGINT)"


@query(f"""WITH {O.spans(COMPOSED_SQL)}, f AS (SELECT DISTINCT kind, {O.canonical()} AS canonical, {O.fingerprint()} AS h FROM kept),
 d AS (SELECT *, list_reduce(list_prepend(list_transform(range(9), lambda x: CAST(0 AS HUGEINT)), list_transform(range(8), lambda w: [CAST({WORD} AS HUGEINT)])),
  lambda digits, word: list_reduce(list_prepend([word[1]], list_transform(digits, lambda x: [x])), lambda a, b: list_concat(a[1:len(a) - 1], [(a[len(a)] + 4294967296 * b[1]) % {fn.FIVE}, (a[len(a)] + 4294967296 * b[1]) // {fn.FIVE}]))[1:9]) AS digits FROM f)
SELECT kind, canonical, repeat('1', len(regexp_extract(h, '^(?:00)*')) // 2) || ltrim(list_aggregate(list_transform(list_reverse(digits), lambda d: list_aggregate(list_transform([11316496, 195112, 3364, 58, 1], lambda k: substr('{fn.BASE58}', CAST((d // k) % 58 + 1 AS INT), 1)), 'string_agg', '')), 'string_agg', ''), '1') AS print FROM d""")
def fingerprint_base58(spark, sf_dir):
    """Fingerprints in base58, by long division on both sides."""
    decided = pipeline.decide(_composed(spark, sf_dir), OPEN, salt=SALT)
    rows = decided.select("kind", "canonical").distinct()
    return rows.select("kind", "canonical", fn.base58(fn.fingerprint(F.col("kind"), F.col("canonical"))).alias("print"))


PROXY = "cast(o_orderkey as string) AS operation_id, concat('t', cast(o_custkey % 4 as string)) AS target, o_orderkey % 3 AS detections, o_orderkey % 3 AS replacements, o_orderkey % 2 AS tokenized, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS blocked, CASE WHEN o_orderkey % 5 > 0 THEN 200 END AS status, o_orderkey % 2 = 0 AS streaming"


@query(f"""WITH p AS (SELECT {PROXY} FROM orders), e AS (SELECT 'route_decision' AS event_type, 'route' AS action, 'info' AS level, 'target=' || target AS message FROM p
UNION ALL SELECT 'proxy_forward', 'request_protection', 'info', 'target=' || target || ' detections=' || detections || ' replacements=' || replacements || ' tokenized=' || tokenized || ' blocked=' || blocked FROM p
UNION ALL SELECT 'proxy_forward', 'blocked', 'warn', 'target=' || target || ' blocked=' || blocked FROM p WHERE blocked > 0
UNION ALL SELECT 'proxy_forward', 'provider_response', 'info', 'target=' || target || ' status=' || status || ' streaming=' || streaming FROM p WHERE blocked = 0 AND status IS NOT NULL
UNION ALL SELECT 'proxy_failure', 'provider_down', 'error', 'target=' || target FROM p WHERE blocked = 0 AND status IS NULL) SELECT event_type, action, level, message, count(*) AS n FROM e GROUP BY ALL""")
def proxy_events(spark, sf_dir):
    rows = events.proxy_events(_read(spark, sf_dir, "orders").selectExpr(*_split(PROXY)))
    return rows.groupBy("event_type", "action", "level", "message").agg(F.count("*").alias("n"))


# Reports and states


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT s.id, 'protected' AS status, count(kind) AS detections, count(*) FILTER ({ACTION(OPEN)} = 'tokenize') AS tokenized FROM src s LEFT JOIN kept k ON k.id = s.id GROUP BY s.id")
def filter_reports(spark, sf_dir):
    done = reports.filter_reports(pipeline.protect(_composed(spark, sf_dir), OPEN, salt=SALT))
    get = lambda p: F.get_json_object("report", p)
    return done.select("id", get("$.status").alias("status"), get("$.summary.detections").cast("long").alias("detections"), get("$.summary.tokenized").cast("long").alias("tokenized"))


@query("SELECT CASE max(CASE n_nationkey % 6 WHEN 5 THEN 2 WHEN 3 THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS state FROM nation")
def health_fold(spark, sf_dir):
    return reports.worst_state(_read(spark, sf_dir, "nation").selectExpr("CASE n_nationkey % 6 WHEN 5 THEN 'unhealthy' WHEN 3 THEN 'degraded' ELSE 'healthy' END AS state"))


@query("SELECT CASE max(CASE WHEN r_regionkey = 1 THEN 1 ELSE 0 END) WHEN 1 THEN 'needs_action' ELSE 'ready' END AS state FROM region")
def setup_fold(spark, sf_dir):
    return reports.worst_state(_read(spark, sf_dir, "region").selectExpr("CASE WHEN r_regionkey = 1 THEN 'needs_action' ELSE 'ready' END AS state"), reports.SETUP)


RECORDS = "s_suppkey % 2 = 0 AS applied, s_suppkey % 3 = 0 AS rollback_available, s_suppkey % 5 = 0 AS modified, CASE WHEN s_suppkey % 7 = 0 THEN s_name END AS error"


@query(f"SELECT count(*) FILTER (applied) AS applied, count(*) FILTER (applied AND rollback_available) AS rollback_ready, count(*) FILTER (modified) AS modified, count(error) AS record_errors FROM (SELECT {RECORDS} FROM supplier)")
def doctor_counts(spark, sf_dir):
    return reports.doctor_counts(_read(spark, sf_dir, "supplier").selectExpr(*_split(RECORDS)))


@query("SELECT n_name AS name, CASE WHEN n_regionkey = 0 THEN 'block_on_error' ELSE 'redact_only' END AS mode, n_nationkey % 4 = 0 AS reduced FROM nation")
def failure_modes(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").selectExpr("n_name AS name", "CASE WHEN n_regionkey = 0 THEN 'block_on_error' END AS failure_mode", "CASE WHEN n_nationkey % 4 = 0 THEN array(n_name) ELSE array() END AS diagnostics")
    return reports.failure_modes(rows, "redact_only")


# Stores, files and sinks


@query(f"SELECT * FROM ({CONSENT_SQL})")
def stored_consents(spark, sf_dir):
    """A store written as a snapshot and read back."""
    path = fresh(spark, "consents")
    tables.write_snapshot(_consents(spark, sf_dir), path)
    return tables.read_store(spark, path, "consents")


@query(f"WITH {O.spans(COMPOSED_SQL)}, " + O.spliced("""SELECT id, start, "end", '[' || kind || ']' AS new FROM kept""") + " SELECT output AS line FROM done")
def text_files(spark, sf_dir):
    """Redacted texts written as files, and read back whole."""
    path = fresh(spark, "texts")
    done = pipeline.protect(_composed(spark, sf_dir), {}, default="redact", salt=SALT)
    tables.write_texts(done, path)
    files, invalid = tables.valid_only(tables.read_texts(spark, f"{path}/part-*"))
    lines = files.unionByName(invalid.select("id", F.lit("not UTF-8").alias("text")))
    return lines.select(F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))


IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"


@query(f"SELECT doc_id AS id, unnest(regexp_extract_all(text, '{IP}')) AS value FROM documents")
def custom_detector(spark, sf_dir):
    """A detector of one's own beside the built-in ones."""
    own = detect.Detector("ip", 5, IP, lambda t: t.contains("."))
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.select("id", F.explode(detect.matches(F.col("text"), own)).alias("s")).select("id", "s.value")


@query(f"""WITH {O.spans("SELECT conv_id * 1000 + turn AS id, text || ' mail a@site.org' AS text FROM conversations")},
 k AS (SELECT id, count(*) AS n FROM kept GROUP BY id) SELECT 'detection' AS event_type, sum(n) AS n, sum(n) AS ids FROM k UNION ALL SELECT 'policy_decision', sum(n), sum(n) FROM k UNION ALL SELECT 'redaction', sum(n), sum(n) FROM k""")
def event_sink(spark, sf_dir):
    """A live stream of messages protected, its events in the log; the stream runs again without its checkpoint, as after a loss."""
    schema = _read(spark, sf_dir, "conversations").schema
    path = fresh(spark, "sink")
    for _ in range(2):
        live = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversation*.parquet")
        rows = live.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", F.lit(" mail a@site.org")).alias("text"))
        made = events.protect_events(pipeline.protect(rows, {}, default="redact", salt=SALT))
        event_log.write_events(made, path, fresh(spark, "check"), "sink", lambda: NOW, once=True).awaitTermination()
    log = event_log.read(spark, path)
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


APP = "n_nationkey AS place, concat('app', n_nationkey) AS id, n_regionkey % 2 = 0 AS enabled, CAST(n_nationkey % 5 AS INT) AS priority, concat('*.', lower(n_name), '.example') AS domain, CASE WHEN n_regionkey = 1 THEN 'inspect' ELSE 'allow' END AS action"


@query(f"SELECT 'made' AS name, 'allow' AS default_action, CAST(row_number() OVER (ORDER BY place) - 1 AS INT) AS ordinal, id, enabled, priority, domain, action FROM (SELECT {APP} FROM nation)")
def profile_file(spark, sf_dir):
    """A traffic profile written as JSON and loaded again, an app a row."""
    path = fresh(spark, "profile")
    rows = _read(spark, sf_dir, "nation").selectExpr(*_split(APP))
    app = F.struct("place", "id", "enabled", "priority", F.struct(F.array("domain").alias("domains")).alias("match"), "action")
    apps = rows.agg(F.array_sort(F.collect_list(app)).alias("apps"))
    apps.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit("made").alias("name"), F.lit("allow").alias("default_action"), "apps")).alias("value")).write.text(path)
    return tables.read_profile(spark, path).select("name", "default_action", "ordinal", "id", "enabled", "priority", F.col("match.domains")[0].alias("domain"), "action")


@query("SELECT concat('p', s_suppkey) AS id, s_name AS name, concat('app', s_nationkey, ',app', s_suppkey % 3) AS apps FROM supplier")
def profile_folder(spark, sf_dir):
    """Integration profiles as a folder of JSON files, a profile a file, read with one schema.

    Making a file costs milliseconds however small it is, so all cores make
    files, and each task moves its own into the folder.
    """
    path = fresh(spark, "profiles")
    rows = _spread(_read(spark, sf_dir, "supplier"), "s_suppkey")
    apps = F.array(F.concat(F.lit("app"), "s_nationkey"), F.concat(F.lit("app"), F.col("s_suppkey") % 3))
    profiles = rows.select(F.concat(F.lit("p"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), apps.alias("traffic_app_ids"), F.lit(1).alias("other"))
    profiles.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)
    return tables.read_profiles(spark, path).select("id", "name", F.array_join("traffic_app_ids", ",").alias("apps"))
