"""Audit events derived from plans; no event carries a raw value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources.shared import kept

SCHEMA = "id long, timestamp long, operation_id string, level string, event_type string, kind string, reference string, action string, message string"
EVENT = "struct<level:string,event_type:string,kind:string,reference:string,action:string,message:string>"


def _event(level: str, type_: str, kind: Column | None, reference: Column | None, action: str | Column, message: str | Column) -> Column:
    text = lambda x: F.lit(None).cast("string") if x is None else F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(level).alias("level"), F.lit(type_).alias("event_type"), text(kind).alias("kind"), text(reference).alias("reference"), text(action).alias("action"), text(message).alias("message"))


def protect_events(protected: DataFrame) -> DataFrame:
    """operation_id, seq and the event columns for rows of `plans.pipeline.protect`.

    Two events a decision, then for each replacement its redaction, after one
    vault write per distinct reference, then failures, then consents used.
    """
    spot = lambda d: F.concat(F.lit("found at bytes "), d["start"].cast("string"), F.lit(".."), d["end"].cast("string"))
    decided = F.flatten(F.transform("decisions", lambda d: F.array(_event("info", "detection", d["kind"], None, "detected", spot(d)), _event("info", "policy_decision", d["kind"], None, d["action"], "action chosen by the policy"))))
    keys = F.transform("plan.replacements", lambda r: fn.reference_key(r["kind"], r["ref_id"]))

    def applied(r: Column, i: Column) -> Column:
        key = fn.reference_key(r["kind"], r["ref_id"])
        write = F.array(_event("info", "vault_write", r["kind"], key, "vault_write_succeeded", "value stored"))
        first = (r["mode"] == "tokenized") & (F.array_position(keys, key) == i + 1)
        done = (
            F.when(r["mode"] == "tokenized", _event("info", "redaction", r["kind"], key, "tokenized", "value replaced by its reference"))
            .when(r["mode"] == "redacted", _event("info", "redaction", r["kind"], None, "redacted", "value replaced by its kind, as the policy says"))
            .otherwise(_event("warn", "redaction", r["kind"], None, "fallback_redacted", "value replaced by its kind, as it could not be stored"))
        )
        return F.concat(F.when(first, write).otherwise(F.array().cast(f"array<{EVENT}>")), F.array(done))

    replaced = F.flatten(F.transform("plan.replacements", applied))
    failures = F.transform("plan.vault_failures", lambda f: _event("warn", "vault_write_failed", f["kind"], None, "vault_write_failed", "value not stored"))
    used = F.filter("decisions", lambda d: d["consent_id"].isNotNull())
    allowed = F.transform(used, lambda d: _event("info", "consent", d["kind"], None, F.concat(F.lit("allow:"), d["consent_id"]), "value passed under a consent"))
    every = F.concat(*[x.cast(f"array<{EVENT}>") for x in (decided, replaced, failures, allowed)])
    return protected.select(F.col("id").cast("string").alias("operation_id"), F.posexplode(every).alias("seq", "e")).select("operation_id", "seq", "e.*")


def resolve_events(resolved: DataFrame) -> DataFrame:
    """The same for rows of `plans.pipeline.resolve`."""

    def of(r: Column) -> Column:
        read = F.array(_event("info", "vault_read", r["kind"], r["key"], "vault_read_succeeded", "stored value read"), _event("info", "resolve", r["kind"], r["key"], "resolved", "reference replaced by its value"))
        gone = F.array(_event("warn", "resolve", r["kind"], r["key"], "missing", "no stored value for this reference"))
        failed = F.array(_event("warn", "vault_read_failed", r["kind"], r["key"], "vault_read_failed", "stored value not readable"))
        return F.when(r["state"] == "resolved", read).when(r["state"] == "missing", gone).otherwise(failed)

    return resolved.select(F.col("id").cast("string").alias("operation_id"), F.posexplode(F.flatten(F.transform("refs", of))).alias("seq", "e")).select("operation_id", "seq", "e.*")


def request_message(**counters: Column) -> Column:
    """k=v tokens, as read back by `functions.scalars.field_value`."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in counters.items()])


#: Blocks that an append is numbered in.
BLOCKS = 4096


def log_rows(events: DataFrame, now: int, first_id: int = 0) -> DataFrame:
    """Rows for the event log, numbered without gaps from ``first_id``; an operation's events keep together and in order.

    Operations are dealt to blocks by a hash, each block is numbered on its own
    and moved on by the sizes of the blocks before it, so no task sees the
    whole append. `operators.event_log` reserves ranges of ids.
    """
    block = F.pmod(F.xxhash64("operation_id", F.floor(F.col("seq") / 65_536)), F.lit(BLOCKS))
    held = events.withColumn("__block", block)
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = held.groupBy("__block").agg(F.count("*").alias("__n")).select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    row = F.row_number().over(Window.partitionBy("__block").orderBy("operation_id", "seq")) - 1
    placed = held.withColumn("__row", row).join(starts, "__block")
    id_ = F.lit(first_id).cast("long") + F.col("__start") + F.col("__row")
    return placed.select(id_.alias("id"), F.lit(now).cast("long").alias("timestamp"), "operation_id", "level", "event_type", "kind", "reference", "action", "message")


def proxy_events(requests: DataFrame) -> DataFrame:
    """Events of proxied requests, from rows (operation_id, target, status, streaming, and a plan's counters).

    One route decision a request; then its protection with the counters as
    key=value tokens, or that it was blocked; then the provider's answer, or
    that the provider was down (status null). Where these columns are there,
    also: provider, method, path and request_bytes with the route; bypass (the
    request passed unread, and nothing else is said); missing_key and encoded
    (it was refused before it was read); removed_headers; content_type and
    content_encoding with the answer; intercepted (the answer was written back).
    """
    has = lambda c: c in requests.columns
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if has(c) else F.lit(False)
    some = lambda *names: {c: F.col(c) for c in names if has(c)}
    header = lambda c: {c: F.coalesce(F.left(c, F.lit(80)), F.lit("none"))} if has(c) else {}
    none = F.array().cast(f"array<{EVENT}>")
    target = {"target": F.col("target")}
    route = _event("info", "route_decision", None, None, "route", request_message(**target, **some("provider", "method", "path", "request_bytes")))
    counters = {c: F.col(c) for c in ("detections", "replacements", "tokenized", "blocked")}
    protection = _event("info", "proxy_forward", None, None, "request_protection", request_message(**target, **counters))
    stop = _event("warn", "proxy_forward", None, None, "blocked", request_message(**target, blocked=F.col("blocked")))
    answer = _event("info", "proxy_forward", None, None, "provider_response", request_message(**target, status=F.col("status"), **header("content_type"), **header("content_encoding"), streaming=F.col("streaming")))
    written = _event("info", "proxy_forward", None, None, "intercepted_response_write", request_message(**target, status=F.col("status"), **header("content_type"), streaming=F.col("streaming")))
    down = _event("error", "proxy_failure", None, None, "provider_down", request_message(**target))
    bypass = _event("info", "proxy_bypass", None, None, "bypassing", request_message(**target))
    no_key = _event("error", "proxy_failure", None, None, "config_required", request_message(**target))
    unread = _event("warn", "proxy_failure", None, None, "blocked", request_message(**target, reason=F.lit("encoded")))
    when = lambda test, event: F.when(test, F.array(event)).otherwise(none)
    stripped = when(F.coalesce("removed_headers", F.lit(0)) > 0, _event("info", "proxy_forward", None, None, "request_integrity_headers_removed", request_message(**target, count=F.col("removed_headers")))) if has("removed_headers") else none
    answered = F.when(F.col("status").isNull(), F.array(down)).otherwise(F.concat(F.array(answer), when(flag("intercepted"), written)))
    read = F.when(F.col("blocked") > 0, F.array(protection, stop)).otherwise(F.concat(F.array(protection), stripped, answered))
    rest = F.when(flag("missing_key"), F.array(no_key)).when(flag("encoded"), F.array(unread)).otherwise(read)
    every = F.when(flag("bypass"), F.array(bypass)).otherwise(F.concat(F.array(route), rest))
    return requests.select("operation_id", F.posexplode(every).alias("seq", "e")).select("operation_id", "seq", "e.*")


#: Longest pieces by which values and texts meet.
PIECE = 16


def leaks(log: DataFrame, values: DataFrame) -> DataFrame:
    """(id, kind, fingerprint) for every event of ``log`` that holds any of the ``values`` (kind, value), of whatever operation.

    Texts are cut into pieces of a size, values have a piece of that size at
    each of as many offsets; the size is the largest power of two that a value
    is at least twice as long as, up to PIECE. Wherever a value stands in a
    text, just one piece of the text is the value's piece at one of these
    offsets. So pieces tell (by distinct piece, offset and length, not by
    value) where a value of which length may stand, and what stands there
    meets the values as a whole: the work grows with texts and values, not
    with their product. Texts said more than once are looked at once. Joins
    are by key, as nothing here is small enough to be sent to every task.
    """
    said = log.select("id", F.concat_ws("\x1f", "message", "reference", "action").alias("said")).withColumn("sid", F.unhex(F.sha2("said", 256)))
    texts = said.select("sid", "said").distinct()
    wanted = kept(values.where("value <> ''").select("kind", "value").distinct())
    size = F.least(F.expr("shiftleft(1, greatest(length(bin(length(value))) - 2, 0))"), F.lit(PIECE))
    held = wanted.select("value", F.length("value").alias("n"), size.alias("size"))
    sizes = [r["size"] for r in held.select("size").distinct().collect()]  # five at most
    if not sizes:
        return said.select("id", F.lit("").alias("kind"), F.lit("").alias("fingerprint")).limit(0)
    key = lambda n, piece: F.xxhash64(n, piece)
    offsets = held.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    asked = offsets.select(key(F.col("size"), F.expr("substring(value, offset + 1, size)")).alias("key"), "offset", "n").distinct()
    cut = lambda n: F.posexplode(F.regexp_extract_all("said", F.lit(f"(?s).{{{n}}}"), F.lit(0))).alias("k", "piece")
    pieces = [texts.select("sid", cut(n)).select("sid", (F.col("k") * n).alias("at"), key(F.lit(n), F.col("piece")).alias("key")) for n in sizes]
    spots = reduce(DataFrame.unionByName, pieces).join(asked.hint("merge"), "key").where("at >= offset").select("sid", (F.col("at") - F.col("offset") + 1).alias("start"), "n")
    parts = spots.join(texts.hint("merge"), "sid").select("sid", F.expr("substring(said, start, n)").alias("value"))
    met = parts.join(wanted.hint("merge"), "value").select("sid", "kind", fn.fingerprint(F.col("kind"), F.col("value")).alias("fingerprint")).distinct()
    return said.select("id", "sid").join(met.hint("merge"), "sid").select("id", "kind", "fingerprint")


def migrate_log(old: DataFrame) -> DataFrame:
    """Old event tables in today's columns; raw previews are never carried over."""
    has = lambda c: F.col(c) if c in old.columns else None
    legacy = {"value_preview", "data_type", "module_name"} & set(old.columns)
    message = fn.legacy_message(kind=has("data_type"), module=has("module_name"), destination=has("destination"), action=has("action")) if legacy else F.lit("")
    default = {"id": F.lit(None), "timestamp": F.lit(0), "operation_id": F.lit("legacy"), "level": F.lit("info"), "event_type": F.lit("legacy"), "kind": has("data_type"), "reference": None, "action": None, "message": message}
    columns = []
    for field in SCHEMA.split(", "):
        name, type_ = field.split(" ")
        own = has(name)
        value = own if own is not None else default[name] if default[name] is not None else F.lit(None)
        columns.append(value.cast(type_).alias(name))
    return old.select(*columns)


def evidence(events: DataFrame) -> DataFrame:
    """One row (id, pos, label, value) per field of an event that has one, in the order of display."""
    pairs = [("event_type", F.col("event_type")), ("level", F.col("level")), ("kind", F.col("kind")), ("reference", F.col("reference")), ("action", F.col("action")), ("operation", F.col("operation_id")), ("audit_id", fn.audit_id(F.col("id")))]
    rows = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in pairs])
    return events.select("id", F.posexplode(F.filter(rows, lambda x: x["value"].isNotNull())).alias("pos", "x")).select("id", "pos", "x.label", "x.value")


def operation_actors(events: DataFrame) -> DataFrame:
    """(operation_id, actor): the actor named by the earliest event of an operation that names one."""
    named = events.withColumn("actor", fn.actor_from_message(F.col("message"))).where("actor IS NOT NULL")
    return named.groupBy("operation_id").agg(F.min_by("actor", "id").alias("actor"))


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("id"))
