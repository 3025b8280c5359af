"""Query views over vault, consents and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import consent, events, vault


def search(df: DataFrame, q: str | None, *columns: str) -> DataFrame:
    """Rows where a column contains ``q`` in any case; all rows for an empty ``q``."""
    if not q:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(q.lower()), F.lit(False))
    return df.where(hit)


def _sorted(df: DataFrame, column: str | None, then: list[Column], descending: bool) -> DataFrame:
    """Stable order; descending turns the whole list round, ties too."""
    keys = ([F.col(column)] if column else []) + then
    flip = lambda c: c.desc() if descending else c.asc()
    return df.orderBy(*[flip(k) for k in keys])


def wallet(vault_: DataFrame, q: str | None = None, sort: str = "recent", descending: bool = False) -> DataFrame:
    """key, kind, value, total (rows found): the listed vault, searched and sorted; recent means by key."""
    items = vault.listed(vault_).select("key", fn.kind_from_key(F.col("key")).alias("kind"), "value", "created_at", "updated_at")
    found = search(items, q, "kind", "value")
    return _sorted(found, sort if sort in ("kind", "value") else None, [F.col("key")], descending)


def wallet_total(vault_: DataFrame, q: str | None = None) -> DataFrame:
    return search(vault.listed(vault_).withColumn("kind", fn.kind_from_key(F.col("key"))), q, "kind", "value").agg(F.count("*").alias("total"))


def wallet_detail(vault_: DataFrame, key: str) -> DataFrame:
    row = vault.get(vault_, key)
    return row.select("key", fn.kind_from_key(F.col("key")).alias("kind"), "value", fn.day_label(F.col("created_at")).alias("first_seen"), F.concat(F.lit("["), "key", F.lit("]")).alias("reference"))


#: Ranges that a reader may choose, in days before today (UTC); all has no beginning.
RANGES = {"today": 0, "7d": 7, "30d": 30, "all": None}


def since_of(range_: str, now: int) -> int | None:
    """The first second of a named range: midnight for today, else so many days before ``now``."""
    days = RANGES[range_]
    return None if days is None else now - now % 86_400 if days == 0 else now - days * 86_400


def activity_events(log: DataFrame, since: int | None = None) -> DataFrame:
    """id, ts, day, actor, kind, decision, audit_id of the events that decide something."""
    actors = events.operation_actors(log)
    rows = log if since is None else log.where(F.col("timestamp") >= since)
    joined = rows.join(actors, "operation_id", "left")
    actor = F.coalesce("actor", fn.actor_from_operation(F.col("operation_id")), F.lit("local"))
    decided = joined.withColumn("decision", fn.decision(F.col("event_type"), F.col("action"), F.col("message"))).where("decision IS NOT NULL")
    return decided.select("id", F.col("timestamp").alias("ts"), fn.day_label(F.col("timestamp")).alias("day"), actor.alias("actor"), fn.event_kind(F.col("kind"), F.col("event_type"), F.col("action")).alias("kind"), "decision", fn.audit_id(F.col("id")).alias("audit_id"))


def activity(log: DataFrame, since: int | None = None, decision: str = "all", q: str | None = None) -> DataFrame:
    """Newest first; an unknown decision finds nothing."""
    rows = activity_events(log, since)
    wanted = {"all": None, "granted": "granted", "allowed": "granted", "sealed": "sealed", "denied": "denied"}
    if decision not in wanted:
        rows = rows.where(F.lit(False))
    elif wanted[decision]:
        rows = rows.where(F.col("decision") == wanted[decision])
    return search(rows, q, "actor", "kind").orderBy(F.desc("id"))


def activity_summary(log: DataFrame, since: int | None = None) -> DataFrame:
    """Counts after ``since``, before any other filter."""
    of = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return activity_events(log, since).agg(F.count("*").alias("total"), of("granted"), of("sealed"), of("denied"))


def system(log: DataFrame, scope: str = "issues", q: str | None = None) -> DataFrame:
    rows = log.select("id", F.col("timestamp").alias("ts"), fn.module(F.col("event_type")).alias("module"), fn.severity(F.col("level")).alias("severity"), "message", "event_type")
    if scope == "issues":
        rows = rows.where("severity <> 'info'")
    elif scope == "network":
        rows = rows.where(F.col("module").isin("proxy", "network", "trust"))
    elif scope != "all":
        rows = rows.where(F.col("module") == scope)
    return search(rows, q, "message", "event_type").drop("event_type").orderBy(F.desc("id"))


def system_counts(log: DataFrame) -> DataFrame:
    """By severity over all events, whatever the view's filters."""
    level = fn.severity(F.col("level"))
    return log.agg(*[F.count_if(level == s).alias(s) for s in ("info", "warn", "error")])


def allowed(consents: DataFrame, vault_: DataFrame, now: int, q: str | None = None, sort: str = "recent", descending: bool = False) -> DataFrame:
    """id, status, party, kind, value, since, expires_at of all grants, each status a list of its own."""
    values = vault_.select(F.col("key").alias("vault_key"), "value")
    rows = consent.with_status(consents, now).join(values, "vault_key", "left")
    kind = F.coalesce(fn.kind_tag(F.col("kind")), F.lit("email"))
    shown = F.when(F.col("vault_key").isNull(), F.concat(F.lit("["), kind, F.lit(" grant]"))).otherwise(F.coalesce("value", F.concat(F.lit("["), "vault_key", F.lit("]"))))
    grants = rows.select("id", "status", F.col("created_by").alias("party"), kind.alias("kind"), shown.alias("value"), fn.day_label(F.col("created_at")).alias("since"), fn.day_label(F.col("expires_at")).alias("expires_at"), "created_at")
    found = search(grants, q, "party", "kind", "value")
    column = {"kind": "kind", "party": "party", "value": "value", "expires": "expires_at"}.get(sort)
    flip = lambda c: c.desc() if descending else c.asc()
    order = ([flip(F.col(column))] if column else []) + [F.col("created_at").asc() if descending else F.col("created_at").desc(), flip(F.col("id"))]
    return found.orderBy("status", *order).drop("created_at")


def connect_counts(log: DataFrame, consents: DataFrame, apps: DataFrame, now: int) -> DataFrame:
    """grants, redacted_today, blocked_today (the same number, as the view defines it), truly_blocked_today, apps_mediated."""
    today = fn.epoch_day(F.col("timestamp")) == F.lit(now // 86_400)
    redacted = today & (F.col("event_type") == "redaction") & F.col("action").isin("tokenized", "redacted")
    blocked = today & (F.col("event_type") == "policy_decision") & (F.col("action") == "block")
    counts = log.agg(F.count_if(redacted).alias("redacted_today"), F.count_if(redacted).alias("blocked_today"), F.count_if(blocked).alias("truly_blocked_today"))
    grants = consent.with_status(consents, now).agg(F.count_if(F.col("status") == "active").alias("grants"))
    return counts.crossJoin(grants).crossJoin(apps.agg(F.count_if("enabled").alias("apps_mediated")))  # one row each


def insights(log: DataFrame, by: str = "actor", since: int | None = None) -> DataFrame:
    """Leaders by actor or kind: total and counts by decision. An extension of the view, which only counts."""
    of = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return activity_events(log, since).groupBy(by).agg(F.count("*").alias("total"), of("granted"), of("sealed"), of("denied"))
