"""The engine's queries over the driver's tables, each with its DuckDB twin.

Stores are derived from the tables the same way on both sides; expressions
written once in SQL are valid in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rewrite
from ..functions import scalars as fn
from ..functions.detect import DETECTORS, detections, matches
from ..operators import consent, events, traffic, vault
from ..operators.policy import decide as policy_decide
from ..sources.shared import kept
from . import oracles as O
from . import pipeline, reports, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW, SALT = 1_700_000_000, "query-salt"

#: Texts with every kind of value, composed from customers.
COMPOSED = """concat('Mail user', cast(c_custkey as string), ' @ Mail', cast(c_custkey % 7 as string), '.example.com or call +1415', lpad(cast(c_custkey as string), 7, '0'),
 ' - ssn ', lpad(cast(c_custkey % 999 as string), 3, '0'), '-', lpad(cast(c_custkey % 100 as string), 2, '0'), '-', lpad(cast(c_custkey % 10000 as string), 4, '0'),
 ', see mail', cast(c_custkey % 7 as string), ' . example.com today; été 415-555-', lpad(cast(c_custkey % 10000 as string), 4, '0'), ' card 4111 1111 1111 111', cast(c_custkey % 10 as string), '.')"""
COMPOSED_SQL = f"SELECT c_custkey AS id, {COMPOSED} AS text FROM customer"
DOCS_SQL = "SELECT doc_id AS id, text FROM documents"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to all cores by ``key``, however few tasks read its file."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def _composed(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    rows = _read(spark, sf_dir, "customer")
    return (_spread(rows, "c_custkey") if spread else rows).select(F.col("c_custkey").alias("id"), F.expr(COMPOSED).alias("text"))


def _spans(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", *more, F.explode(detections(F.col("text"))).alias("s")).select("id", *more, "s.*")


def _redacted(text: Column) -> Column:
    """A text with all its spans redacted, as one expression."""
    return rewrite.splice(text, F.transform(detections(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), fn.placeholder(s["kind"]).alias("text"))))


def _of(kind: str) -> Column:
    return matches(F.col("text"), next(d for d in DETECTORS if d.kind == kind))


# Detection


def _detector(name: str, kind: str, pattern: str, valid: str, source: str, on_docs: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _docs(spark, sf_dir) if on_docs else _composed(spark, sf_dir)
        return df.select("id", F.explode(_of(kind)).alias("s")).select("id", "s.start", "s.value")

    run.__name__ = name
    query(f"""WITH src AS ({source}), m AS (SELECT id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM src),
    raw AS (SELECT id, CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0) AS INT) AS start, m[i] AS value
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)) SELECT * FROM raw WHERE {valid}""")(run)


_detector("detect_email", "email", O.E, "true", DOCS_SQL, True)
_detector("detect_card_luhn", "cc", O.C, O.LUHN, DOCS_SQL, True)
_detector("detect_phone", "phone", O.P, "true", COMPOSED_SQL, False)
_detector("detect_ssn", "ssn", O.S, O.SSN, COMPOSED_SQL, False)


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT id, start, value FROM kept WHERE kind = 'domain'")
def detect_derived_domain(spark, sf_dir):
    return _spans(_composed(spark, sf_dir)).where("kind = 'domain'").select("id", "start", "value")


@query(f"WITH {O.spans(DOCS_SQL)} SELECT * FROM kept")
def detect_spans(spark, sf_dir):
    return _spans(_docs(spark, sf_dir))


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT * FROM kept")
def detect_spans_composed(spark, sf_dir):
    return _spans(_composed(spark, sf_dir))


@query(f"WITH {O.spans('SELECT page_id AS id, html AS text FROM pages')} SELECT id, kind, value FROM kept")
def detect_pages(spark, sf_dir):
    return _spans(_read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))).select("id", "kind", "value")


@query(f"WITH {O.spans(DOCS_SQL)} SELECT lang, kind, count(*) AS n, count(DISTINCT id) AS texts FROM kept JOIN documents ON doc_id = id GROUP BY ALL")
def pii_by_lang(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), "lang").groupBy("lang", "kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("texts"))


@query(f"WITH {O.spans(DOCS_SQL)} SELECT source, count(*) AS n FROM kept JOIN documents ON doc_id = id GROUP BY ALL")
def pii_by_source(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), "source").groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT kind, count(*) AS n, count(DISTINCT {O.canonical()}) AS n_values FROM kept GROUP BY kind")
def pii_distinct_values(spark, sf_dir):
    value = fn.canonical(F.col("kind"), F.col("value"))
    return _spans(_composed(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct(value).alias("n_values"))


# Scalars


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT DISTINCT kind, {O.canonical()} AS canonical, {O.fingerprint()} AS fingerprint FROM kept")
def fingerprint(spark, sf_dir):
    k, v = F.col("kind"), F.col("value")
    return _spans(_composed(spark, sf_dir)).select("kind", fn.canonical(k, v).alias("canonical"), fn.fingerprint(k, v).alias("fingerprint")).distinct()


HOST = r"""CASE WHEN regexp_matches(h, '^\[[^\]]*\]') THEN lower(regexp_extract(h, '^\[([^\]]*)\]', 1)) ELSE lower(split_part(h, ':', 1)) END"""
HOST_OF = r"split_part(regexp_replace(regexp_replace(trim({u}), '\.+$', ''), '^(?:https|http|wss|ws)://', ''), '/', 1)"


@query(f"SELECT page_id AS id, {HOST} AS host, regexp_extract(url, '^[a-z]+://[^/]*(/.+)$', 1) AS path FROM (SELECT *, {HOST_OF.format(u='url')} AS h FROM pages)")
def normalize_host(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), fn.normalize_host(F.col("url")).alias("host"), F.coalesce(fn.pattern_path(F.col("url")), F.lit("")).alias("path"))


@query("SELECT c_custkey AS id, CASE WHEN len(c_name) > 4 THEN left(c_name, 4) || '...' ELSE c_name END AS preview, '[' || lower(c_mktsegment) || ']' AS placeholder, 'evt_' || lpad(lower(hex(c_custkey)), 16, '0') AS audit_id FROM customer")
def value_previews(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fn.preview(F.col("c_name")).alias("preview"), fn.placeholder(F.lower("c_mktsegment")).alias("placeholder"), fn.audit_id(F.col("c_custkey")).alias("audit_id"))


# Policies and rewriting

POLICY = {"email": "tokenize", "phone": "redact", "ssn": "block", "domain": "allow", "cc": "redact"}
OPEN = {"email": "tokenize", "phone": "redact", "ssn": "redact", "domain": "tokenize", "cc": "tokenize"}
ACTION = lambda p: "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{a}'" for k, a in p.items()) + " END"


@query(f"WITH {O.spans(DOCS_SQL)}, {O.spliced(chr(10) + 'SELECT id, start, ' + chr(34) + 'end' + chr(34) + ', ' + chr(39) + '[' + chr(39) + ' || kind || ' + chr(39) + ']' + chr(39) + ' AS new FROM kept')} SELECT id, output FROM done")
def redact_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", _redacted(F.col("text")).alias("output"))


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT id, kind, {ACTION(POLICY)} AS action, start FROM kept")
def policy_decisions(spark, sf_dir):
    d = policy_decide(detections(F.col("text")), POLICY)
    return _composed(spark, sf_dir).select("id", F.explode(d).alias("d")).select("id", "d.kind", "d.action", "d.start")


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT s.id, CASE WHEN bool_or(kind = 'ssn') THEN 'blocked' ELSE 'protected' END AS status, count(kind) AS n FROM src s LEFT JOIN kept k ON k.id = s.id GROUP BY s.id")
def block_gate(spark, sf_dir):
    return pipeline.protect(_composed(spark, sf_dir), POLICY, salt=SALT).select("id", "status", F.size("decisions").cast("long").alias("n"))


def _reps(policy: dict[str, str]) -> str:
    token = f"'[' || kind || ':' || {O.reference_id(SALT, 'kind', '(' + O.canonical() + ')')} || ']'"
    return f"""SELECT id, start, "end", CASE WHEN {ACTION(policy)} = 'tokenize' THEN {token} ELSE '[' || kind || ']' END AS new FROM kept WHERE {ACTION(policy)} IN ('tokenize', 'redact')"""


@query(f"WITH {O.spans(COMPOSED_SQL)}, {O.spliced(_reps(OPEN))} SELECT id, 'protected' AS status, output FROM done")
def tokenize_text(spark, sf_dir):
    return pipeline.protect(_composed(spark, sf_dir), OPEN, salt=SALT).select("id", "status", "output")


@query(f"WITH {O.spans(DOCS_SQL)}, {O.spliced(_reps(OPEN))} SELECT id, 'protected' AS status, output FROM done")
def tokenize_documents(spark, sf_dir):
    return pipeline.protect(_docs(spark, sf_dir), OPEN, salt=SALT).select("id", "status", "output")


def _vault(spark, sf_dir, now: int = NOW) -> DataFrame:
    """The vault after tokenizing all composed texts."""
    empty = spark.createDataFrame([], "key string, value string, created_at long, updated_at long")
    return vault.write_values(empty, pipeline.written_values(pipeline.protect(_composed(spark, sf_dir), OPEN, salt=SALT)), now)


VAULT_SQL = f"vault AS (SELECT DISTINCT kind || ':' || {O.reference_id(SALT, 'kind', 'canonical')} AS key, canonical AS value, CAST({NOW} AS BIGINT) AS created_at, CAST({NOW} AS BIGINT) AS updated_at FROM (SELECT kind, {O.canonical()} AS canonical FROM kept WHERE {ACTION(OPEN)} = 'tokenize'))"


@query(f"WITH {O.spans(COMPOSED_SQL)}, {VAULT_SQL} SELECT * FROM vault")
def vault_dedup(spark, sf_dir):
    return _vault(spark, sf_dir)


@query(f"""WITH {O.spans(COMPOSED_SQL)}, toks AS ({_reps({k: 'tokenize' for k in OPEN})}), {O.spliced('SELECT id, start, "end", CASE WHEN kind IN (' + chr(39) + 'email' + chr(39) + ',' + chr(39) + 'domain' + chr(39) + ') THEN ' + O.canonical() + ' ELSE value END AS new FROM kept')} SELECT id, 'resolved' AS status, output FROM done""")
def roundtrip(spark, sf_dir):
    every = {k: "tokenize" for k in OPEN}
    made = pipeline.protect(_composed(spark, sf_dir, spread=True), every, salt=SALT)
    done = kept(made.select("id", F.col("output").alias("text"), pipeline.written().alias("written")))
    empty = spark.createDataFrame([], "key string, value string, created_at long, updated_at long")
    stored = vault.write_values(empty, pipeline.distinct_values(done), NOW)
    return pipeline.resolve(done.select("id", "text"), stored).select("id", "status", "output")


@query(f"WITH {O.spans(COMPOSED_SQL)}, {VAULT_SQL} SELECT kind, count(*) AS n, min(value) AS first_value, max(value) AS last_value FROM (SELECT split_part(key, ':', 1) AS kind, value FROM vault) GROUP BY kind")
def vault_by_kind(spark, sf_dir):
    return _vault(spark, sf_dir).groupBy(fn.kind_from_key(F.col("key")).alias("kind")).agg(F.count("*").alias("n"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))


# A plain vault of customers for the table operators

STORE = "concat(CASE WHEN c_custkey % 5 = 0 THEN 'note' ELSE 'phone' END, ':', lpad(cast(c_custkey as string), 6, '0'))"
STORE_SQL = f"SELECT {STORE} AS key, concat('v', cast(c_custkey % 40 as string)) AS value, CAST(1000 + c_custkey AS BIGINT) AS created_at, CAST(2000 + c_custkey AS BIGINT) AS updated_at FROM customer"


def _store(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(f"{STORE} AS key", "concat('v', cast(c_custkey % 40 as string)) AS value", "CAST(1000 + c_custkey AS BIGINT) AS created_at", "CAST(2000 + c_custkey AS BIGINT) AS updated_at")


@query(f"WITH s AS ({STORE_SQL}), u AS (SELECT key, 'new' AS value FROM s WHERE created_at % 3 = 0 UNION ALL SELECT 'phone:x' || s_suppkey, 'added' FROM supplier) SELECT coalesce(s.key, u.key) AS key, coalesce(u.value, s.value) AS value, coalesce(s.created_at, {NOW}) AS created_at, CASE WHEN u.key IS NULL THEN s.updated_at ELSE {NOW} END AS updated_at FROM s FULL JOIN u ON u.key = s.key")
def vault_upsert(spark, sf_dir):
    store = _store(spark, sf_dir)
    new = store.where("created_at % 3 = 0").select("key", F.lit("new").alias("value")).union(_read(spark, sf_dir, "supplier").selectExpr("concat('phone:x', cast(s_suppkey as string))", "'added'"))
    return vault.upsert(store, new, NOW)


@query(f"SELECT * FROM ({STORE_SQL}) WHERE key NOT IN (SELECT key FROM ({STORE_SQL}) WHERE created_at % 4 = 0)")
def vault_delete(spark, sf_dir):
    store = _store(spark, sf_dir)
    return vault.delete(store, store.where("created_at % 4 = 0"))


def _typed_store(spark, sf_dir) -> DataFrame:
    """Keys with real reference ids for three customers in four."""
    id_ = fn.reference_id(SALT, F.lit("phone"), F.col("c_name"))
    key = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("note:"), "c_name")).otherwise(fn.reference_key(F.lit("phone"), id_))
    return _read(spark, sf_dir, "customer").select(key.alias("key"), F.expr("concat('v', cast(c_custkey % 40 as string))").alias("value"), F.expr("CAST(1000 + c_custkey AS BIGINT)").alias("created_at"), F.expr("CAST(2000 + c_custkey AS BIGINT)").alias("updated_at"))


TYPED_SQL = f"SELECT CASE WHEN c_custkey % 4 = 0 THEN 'note:' || c_name ELSE 'phone:' || {O.reference_id(SALT, chr(39) + 'phone' + chr(39), 'c_name')} END AS key, 'v' || (c_custkey % 40) AS value, CAST(1000 + c_custkey AS BIGINT) AS created_at, CAST(2000 + c_custkey AS BIGINT) AS updated_at FROM customer"


@query(f"WITH v AS ({TYPED_SQL}) SELECT * EXCLUDE (n, p) FROM (SELECT *, key LIKE 'phone:%' AS p, row_number() OVER (PARTITION BY key LIKE 'phone:%', value ORDER BY key) AS n FROM v) WHERE n = 1 OR NOT p")
def vault_list(spark, sf_dir):
    return vault.listed(_typed_store(spark, sf_dir))


@query(f"SELECT split_part(key, ':', 1) AS kind, key, value FROM ({STORE_SQL}) WHERE contains(lower(value), '7') OR contains(lower(split_part(key, ':', 1)), '7') ORDER BY value DESC, key DESC")
def wallet_search_sort(spark, sf_dir):
    return views.wallet(_store(spark, sf_dir), "7", "value", True).select("kind", "key", "value")


@query(f"SELECT count(*) AS total FROM ({STORE_SQL}) WHERE contains(value, '7')")
def wallet_total(spark, sf_dir):
    return views.wallet_total(_store(spark, sf_dir), "7")


# Consents, derived from orders

CONSENT = f"""concat('c', cast(o_orderkey as string)) AS id, CASE WHEN o_custkey % 3 = 0 THEN 'email' ELSE 'phone' END AS kind, concat('fp', cast(o_custkey % 50 as string)) AS value_fingerprint,
 CASE WHEN o_orderkey % 4 = 0 THEN concat('phone:', lpad(cast(o_custkey as string), 6, '0')) END AS vault_key, CASE WHEN o_orderkey % 9 = 0 THEN 'local' ELSE 'global' END AS scope,
 CAST({NOW} - 1000 - o_orderkey AS BIGINT) AS created_at, CAST({NOW} - 500 + o_orderkey % 1000 AS BIGINT) AS expires_at,
 CASE WHEN o_orderkey % 7 = 0 THEN CAST({NOW} - 100 AS BIGINT) END AS revoked_at, lower(o_orderpriority) AS created_by, CAST(NULL AS string) AS reason"""
CONSENT_SQL = f"SELECT {CONSENT} FROM orders"


def _consents(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(*_split(CONSENT))


def _split(columns: str) -> list[str]:
    """The top-level comma-separated parts."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(columns[at:i])
            at = i + 1
    return [*parts, columns[at:]]


LIVE = f"scope = 'global' AND revoked_at IS NULL AND expires_at > {NOW}"


@query(f"SELECT kind, value_fingerprint, max_by(id, (expires_at, id)) AS consent_id FROM ({CONSENT_SQL}) WHERE {LIVE} GROUP BY ALL")
def consent_active_top1(spark, sf_dir):
    return consent.active(_consents(spark, sf_dir), NOW)


@query(f"SELECT CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at <= {NOW} THEN 'expired' ELSE 'active' END AS status, kind, count(*) AS n FROM ({CONSENT_SQL}) GROUP BY ALL")
def consent_status(spark, sf_dir):
    return consent.with_status(_consents(spark, sf_dir), NOW).groupBy("status", "kind").agg(F.count("*").alias("n"))


@query(f"WITH c AS ({CONSENT_SQL}), hit AS (SELECT DISTINCT kind, value_fingerprint, scope FROM c WHERE id LIKE 'c%3') SELECT c.id, CASE WHEN hit.kind IS NOT NULL AND c.revoked_at IS NULL THEN {NOW} ELSE c.revoked_at END AS revoked_at FROM c LEFT JOIN hit USING (kind, value_fingerprint, scope)")
def consent_revoke_group(spark, sf_dir):
    c = _consents(spark, sf_dir)
    return consent.revoke(c, c.where("id LIKE 'c%3'"), NOW).select("id", "revoked_at")


def _own_consents(spark, sf_dir) -> DataFrame:
    values = _read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.lit("email").alias("kind"), F.expr("concat('user', cast(c_custkey as string), '@MAIL', cast(c_custkey % 7 as string), '.Example.com')").alias("value"))
    return consent.grant(values, NOW - 10)


@query(f"WITH {O.spans(COMPOSED_SQL)} SELECT id, kind, start, CASE WHEN kind = 'email' AND id % 3 = 0 THEN 'allow' ELSE {ACTION(POLICY)} END AS action, kind = 'email' AND id % 3 = 0 AS consented FROM kept")
def consent_override(spark, sf_dir):
    rows = pipeline.decide(_composed(spark, sf_dir), POLICY, consents=_own_consents(spark, sf_dir), now=NOW, salt=SALT)
    return rows.select("id", "kind", "start", "action", F.col("consent_id").isNotNull().alias("consented"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('to user', c_custkey, '@mail', c_custkey % 7, '.example.com!') ELSE 'reference' END AS text FROM customer")
def expand_allowed(spark, sf_dir):
    """References come back as values where an active consent allows it; others stay."""
    value = F.expr("concat('user', cast(c_custkey as string), '@mail', cast(c_custkey % 7 as string), '.example.com')")
    base = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), value.alias("value"))
    ref = fn.reference_id(SALT, F.lit("email"), F.col("value"))
    stored = base.select(fn.reference_key(F.lit("email"), ref).alias("key"), "value", F.lit(NOW).cast("long").alias("created_at"), F.lit(NOW).cast("long").alias("updated_at"))
    texts = base.select("id", F.concat(F.lit("to "), fn.reference_display(F.lit("email"), ref), F.lit("!")).alias("text"))
    done = pipeline.expand_allowed(texts, stored, _own_consents(spark, sf_dir), NOW)
    return done.select("id", F.when(F.col("text").contains("["), "reference").otherwise(F.col("text")).alias("text"))


@query(f"WITH c AS ({CONSENT_SQL}), v AS ({STORE_SQL}) SELECT c.id, CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at <= {NOW} THEN 'expired' ELSE 'active' END AS status, created_by AS party, kind, CASE WHEN vault_key IS NULL THEN '[' || kind || ' grant]' ELSE coalesce(v.value, '[' || vault_key || ']') END AS value, strftime(to_timestamp(c.created_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS since, strftime(to_timestamp(c.expires_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS expires_at FROM c LEFT JOIN v ON v.key = vault_key WHERE contains(created_by, 'urgent')")
def allowed_view(spark, sf_dir):
    return views.allowed(_consents(spark, sf_dir), _store(spark, sf_dir), NOW, "urgent", "value")


# Events

EVENT_SQL = f"WITH {O.spans(COMPOSED_SQL)}, e AS (SELECT kind, 'detection' AS event_type, 'detected' AS action FROM kept UNION ALL SELECT kind, 'policy_decision', {ACTION(OPEN)} FROM kept UNION ALL SELECT kind, 'redaction', CASE WHEN {ACTION(OPEN)} = 'tokenize' THEN 'tokenized' ELSE 'redacted' END FROM kept UNION ALL SELECT DISTINCT ON (id, kind, c) kind, 'vault_write', 'vault_write_succeeded' FROM (SELECT id, kind, {O.canonical()} AS c FROM kept WHERE {ACTION(OPEN)} = 'tokenize'))"


@query(f"{EVENT_SQL} SELECT event_type, kind, action, count(*) AS n FROM e GROUP BY ALL")
def filter_events(spark, sf_dir):
    rows = events.protect_events(pipeline.protect(_composed(spark, sf_dir), OPEN, salt=SALT))
    return rows.groupBy("event_type", "kind", "action").agg(F.count("*").alias("n"))


@query(f"""WITH {O.spans(COMPOSED_SQL)}, w AS (SELECT DISTINCT id, kind, {O.canonical()} FROM kept WHERE {ACTION(OPEN)} = 'tokenize')
SELECT (SELECT count(*) FROM src) AS texts, CAST(0 AS BIGINT) AS blocked_texts, count(*) AS detections, count(*) FILTER ({ACTION(OPEN)} = 'tokenize') AS tokenized, CAST(0 AS BIGINT) AS fallback_redacted, count(*) FILTER ({ACTION(OPEN)} = 'redact') AS policy_redacted, CAST(0 AS BIGINT) AS blocked, (SELECT count(*) FROM w) AS vault_writes, CAST(0 AS BIGINT) AS vault_failures FROM kept""")
def report_summary(spark, sf_dir):
    return reports.filter_summary(pipeline.protect(_composed(spark, sf_dir), OPEN, salt=SALT))


LOG = """event_id AS id, CAST(1700000000 + event_id * 600 AS BIGINT) AS timestamp, concat(CASE WHEN user_id % 3 = 0 THEN 'agent' ELSE '' END, '-', cast(user_id % 97 as string)) AS operation_id,
 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level,
 CASE event_type WHEN 'error' THEN 'proxy_failure' WHEN 'signup' THEN 'consent' WHEN 'click' THEN 'policy_decision' WHEN 'view' THEN 'proxy_forward' ELSE 'redaction' END AS event_type,
 CASE WHEN event_id % 5 = 0 THEN 'email' END AS kind, CAST(NULL AS string) AS reference,
 CASE event_type WHEN 'error' THEN 'provider_down' WHEN 'signup' THEN 'allow:1' WHEN 'view' THEN 'request_protection' WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' WHEN 2 THEN 'redact' ELSE 'tokenize' END ELSE 'tokenized' END AS action,
 concat('target=', CASE WHEN event_id % 11 = 0 THEN concat('t', cast(user_id % 4 as string), ',') ELSE '' END, ' provider=p blocked=', cast(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END as string), '; detections=', cast(event_id % 2 as string)) AS message"""
LOG_SQL = f"SELECT {LOG} FROM events"


def _log(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*_split(LOG))


ACTORS_SQL = "actors AS (SELECT operation_id, arg_min(a, id) AS actor FROM (SELECT *, nullif(rtrim(regexp_extract(message, 'target=(\\S*)', 1), ','), '') AS a FROM l) WHERE a IS NOT NULL GROUP BY 1)"
DECIDED_SQL = f"""WITH l AS ({LOG_SQL}), {ACTORS_SQL}, d AS (SELECT l.*, coalesce(actor, nullif(split_part(l.operation_id, '-', 1), ''), 'local') AS actor, CASE WHEN event_type = 'policy_decision' THEN CASE action WHEN 'allow' THEN 'granted' WHEN 'block' THEN 'denied' ELSE 'sealed' END
 WHEN event_type = 'consent' THEN 'granted' WHEN event_type = 'redaction' THEN 'sealed' WHEN event_type = 'proxy_failure' THEN 'denied'
 WHEN contains(message, 'blocked=1') THEN 'denied' WHEN contains(message, 'detections=1') THEN 'sealed' ELSE 'granted' END AS decision FROM l LEFT JOIN actors ON actors.operation_id = l.operation_id)"""
SINCE = NOW + 100_000


@query(f"{DECIDED_SQL} SELECT id, timestamp AS ts, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, actor, coalesce(kind, CASE event_type WHEN 'proxy_forward' THEN 'request' WHEN 'proxy_failure' THEN 'provider' ELSE 'unknown' END) AS kind, decision, 'evt_' || lpad(lower(hex(id)), 16, '0') AS audit_id FROM d WHERE timestamp >= {SINCE} AND decision = 'granted'")
def activity_feed(spark, sf_dir):
    return views.activity(_log(spark, sf_dir), SINCE, "allowed")


@query(f"{DECIDED_SQL} SELECT count(*) AS total, count(*) FILTER (decision = 'granted') AS granted, count(*) FILTER (decision = 'sealed') AS sealed, count(*) FILTER (decision = 'denied') AS denied FROM d WHERE timestamp >= {SINCE}")
def activity_summary(spark, sf_dir):
    return views.activity_summary(_log(spark, sf_dir), SINCE)


@query(f"WITH l AS ({LOG_SQL}), {ACTORS_SQL} SELECT * FROM actors")
def operation_actor(spark, sf_dir):
    return events.operation_actors(_log(spark, sf_dir))


@query(f"{DECIDED_SQL} SELECT actor, count(*) AS total, count(*) FILTER (decision = 'granted') AS granted, count(*) FILTER (decision = 'sealed') AS sealed, count(*) FILTER (decision = 'denied') AS denied FROM d GROUP BY actor")
def insights_by_actor(spark, sf_dir):
    return views.insights(_log(spark, sf_dir))


@query(f"SELECT count(*) FILTER (level = 'info') AS info, count(*) FILTER (level = 'warning') AS warn, count(*) FILTER (level = 'ERROR') AS error FROM ({LOG_SQL})")
def system_counts(spark, sf_dir):
    return views.system_counts(_log(spark, sf_dir))


@query(f"SELECT id, timestamp AS ts, split_part(event_type, '_', 1) AS module, CASE level WHEN 'ERROR' THEN 'error' WHEN 'warning' THEN 'warn' ELSE 'info' END AS severity, message FROM ({LOG_SQL}) WHERE event_type LIKE 'proxy%' AND contains(message, 't1')")
def system_scope(spark, sf_dir):
    return views.system(_log(spark, sf_dir), "network", "T1")


TODAY = NOW + 90_000


@query(f"WITH l AS ({LOG_SQL}), t AS (SELECT * FROM l WHERE timestamp // 86400 = {TODAY // 86_400}), r AS (SELECT count(*) AS n FROM t WHERE event_type = 'redaction') SELECT r.n AS redacted_today, r.n AS blocked_today, (SELECT count(*) FROM t WHERE action = 'block') AS truly_blocked_today, (SELECT count(*) FROM ({CONSENT_SQL}) WHERE revoked_at IS NULL AND expires_at > {TODAY}) AS grants, (SELECT count(*) FROM region WHERE r_regionkey % 2 = 0) AS apps_mediated FROM r")
def connect_counts(spark, sf_dir):
    apps = _read(spark, sf_dir, "region").selectExpr("r_regionkey % 2 = 0 AS enabled")
    return views.connect_counts(_log(spark, sf_dir), _consents(spark, sf_dir), apps, TODAY)


@query(f"WITH l AS ({LOG_SQL}) SELECT id, label, value FROM (SELECT id, unnest(['event_type', 'level', 'kind', 'action', 'operation', 'audit_id']) AS label, unnest([event_type, level, kind, action, operation_id, 'evt_' || lpad(lower(hex(id)), 16, '0')]) AS value FROM l) WHERE value IS NOT NULL")
def event_evidence(spark, sf_dir):
    return events.evidence(_log(spark, sf_dir)).select("id", "label", "value")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, 'event of an older log, its raw preview left out; kind=' || n_name || '; destination=' || CAST(n_regionkey AS VARCHAR) AS message, 'info' AS level, n_name AS kind FROM nation")
def migrate_log(spark, sf_dir):
    old = _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS data_type", "cast(n_regionkey as string) AS destination", "n_name AS value_preview")
    return events.migrate_log(old).select("id", "message", "level", "kind")


# Traffic

RULES = [
    {"id": "wide", "priority": 1, "action": "observe", "match": {"domains": ["*.com", ".org", "*.net", "*.test", "*.example"]}},
    {"id": "paths", "priority": 5, "action": "inspect", "provider": "p", "upstream": "https://up.example", "match": {"urls": ["/a", "/p", "/1"]}},
    {"id": "secure", "priority": 5, "action": "bypass", "match": {"protocols": ["https"], "urls": ["/p", "/b"]}},
    {"id": "off", "priority": 9, "enabled": False, "action": "block", "match": {"protocols": ["https", "http"]}},
]


@query(f"""SELECT id, app_id, CASE app_id WHEN 'secure' THEN 'bypass' WHEN 'paths' THEN 'inspect' WHEN 'wide' THEN 'observe' ELSE 'allow' END AS action FROM (
SELECT page_id AS id, CASE WHEN lower(url) LIKE 'https://%' AND regexp_matches(path, '^/(p|b)') THEN 'secure' WHEN regexp_matches(path, '^/(a|p|1)') THEN 'paths'
WHEN regexp_matches(host, '(^|\\.)(com|org|net|test|example)$') THEN 'wide' END AS app_id FROM (SELECT *, {HOST} AS host, regexp_extract(url, '^[a-z]+://[^/]*(/.+)$', 1) AS path FROM (SELECT *, {HOST_OF.format(u='url')} AS h FROM pages)))""")
def traffic_decision(spark, sf_dir):
    seen = traffic.observations(_read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"))
    return traffic.decide(seen, RULES, "allow").select("id", "app_id", "action")


@query("SELECT n_regionkey % 3 AS host, max_by(n_name, n_nationkey) AS name, min(n_nationkey) AS ordinal FROM nation GROUP BY 1")
def route_dedupe(spark, sf_dir):
    routes = _read(spark, sf_dir, "nation").selectExpr("n_regionkey % 3 AS host", "n_name AS name", "n_nationkey AS ordinal")
    return traffic.distinct_routes(routes)


TARGETS = [{"name": "first", "provider": "red", "upstream": "https://a.example:1/x"}, {"name": "second", "provider": "red", "upstream": "https://B.example"}, {"name": "third", "provider": "blue", "upstream": "http://c.example"}]


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 1 THEN 'second' WHEN n_nationkey % 3 = 1 THEN 'third' ELSE 'first' END AS target FROM nation")
def route_target(spark, sf_dir):
    requests = _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "CASE n_nationkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' END AS provider_hint", "CAST(NULL AS string) AS name_hint", "CASE WHEN n_nationkey % 2 = 1 THEN 'b.example' ELSE 'z.example' END AS host")
    return traffic.choose_target(requests, TARGETS).select("id", "target")


@query("SELECT CASE WHEN r_regionkey IN (0, 1) THEN 'one' WHEN r_regionkey = 3 THEN 'p3' ELSE 'p4' END AS id, min(r_regionkey) AS ordinal FROM region WHERE r_regionkey <> 2 GROUP BY 1")
def enabled_profiles(spark, sf_dir):
    enabled = _read(spark, sf_dir, "region").selectExpr("concat('p', cast(r_regionkey as string)) AS id", "r_regionkey AS ordinal")
    aliases = spark.createDataFrame([("p0", "one"), ("p1", "one"), ("p2", None)], "alias string, id string")
    return traffic.canonical_profiles(enabled, aliases)
