"""Protecting and resolving whole tables of texts.

A text's spans, decisions and output are made in its own row, whatever its id
is: null and repeated ids are only carried along. Where vault or consents must
be asked, the distinct values of a text travel under a hash of its content,
and only texts that may hold something meet what comes back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rewrite
from ..functions import scalars as fn
from ..functions.detect import detections, may_hold
from ..operators import consent as consents_
from ..operators import policy as policies
from ..operators import vault as vaults
from ..operators import vault_client
from ..sources.shared import kept

DECISION = "array<struct<kind:string,start:int,end:int,value:string,action:string,consent_id:string,ref_id:string>>"
FOUND = "array<struct<kind:string,canonical:string,consent_id:string,known_id:string>>"
#: What a reader sees in place of a blocked inbound text (our wording).
BLOCKED = "[blocked by policy]"


def _met(df: DataFrame, some: Column, looked: DataFrame, name: str, type_: str) -> DataFrame:
    """``df`` with column ``name`` of ``looked`` (__content, name) for the rows that ``some`` holds for; only these meet the join."""
    asked = df.where(some).join(looked, "__content", "left")
    return asked.unionByName(df.where(~some).withColumn(name, F.lit(None).cast(type_))).drop("__content")


def decided(df: DataFrame, policy: policies.Policy, default: str = "tokenize", consents: DataFrame | None = None, now: int | Column = 0, vault: DataFrame | None = None, salt: str = "", related: Column | None = None, id_col: str = "id", text_col: str = "text", deduplicate: bool = True) -> DataFrame:
    """``df`` with its decisions (column ``__decisions``): spans, actions with consents applied, and reference ids.

    References of new values are salted hashes, so equal values meet in one
    reference without a lookup; the salt must be given wherever something may
    be tokenized, or the hashes could be searched for known addresses. Without
    ``deduplicate`` the hash takes in the row's own number, too.

    ``now`` is one time for all rows, or a column with each row's own; a
    consent counts where it held then. Where the vault or consents are asked, texts that may hold something are
    searched once and kept; only those that hold something meet the answers.
    """
    if not salt and (callable(policy) or "tokenize" in {policy.get(k, default) for k in fn.KINDS}):
        raise ValueError("tokenizing needs a salt")
    text = F.col(text_col)
    columns = df.columns
    if not deduplicate:
        df = df.withColumn("__row", F.monotonically_increasing_id())
    spans = policies.decide(detections(text, related), policy, default)
    known = vault is not None and deduplicate

    def one(s: Column, hit: Column | None) -> Column:
        action = s["action"] if hit is None else F.when((s["action"] != "block") & hit["consent_id"].isNotNull(), "allow").otherwise(s["action"])
        own = () if deduplicate else (F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("__row").cast("string"), s["start"].cast("string"))
        new_id = fn.reference_id(salt, s["kind"], fn.canonical(s["kind"], s["value"]), *own)
        ref = new_id if hit is None or not known else F.coalesce(hit["known_id"], new_id)
        consent = F.lit(None).cast("string") if hit is None else F.when(s["action"] != "block", hit["consent_id"])
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), action.alias("action"), consent.alias("consent_id"), F.when(action == "tokenize", ref).alias("ref_id"))

    if consents is None and not known:
        return df.withColumn("__decisions", F.transform(spans, lambda s: one(s, None)).cast(DECISION)).select(*columns, "__decisions")

    some = may_hold(text, related)
    searched = kept(df.where(some).withColumn("__spans", spans))
    own_time = isinstance(now, Column)
    moment = now.cast("long") if own_time else F.lit(None).cast("long")
    held = searched.where(F.size("__spans") > 0).withColumn("__at", moment).withColumn("__content", F.sha2(F.to_json(F.struct("__spans", "__at")), 256))
    values = held.select("__content", "__at", F.explode("__spans").alias("s")).where("s.action <> 'block'" if not known else "true")
    asked = values.select("__content", F.col("__at").alias("at"), F.col("s.kind").alias("kind"), fn.canonical(F.col("s.kind"), F.col("s.value")).alias("canonical")).distinct()
    if consents is None:
        asked = asked.withColumn("consent_id", F.lit(None).cast("string"))
    else:
        asked = asked.withColumn("value_fingerprint", fn.fingerprint(F.col("kind"), F.col("canonical")))
        live = consents_.active_at(asked.where("at IS NOT NULL"), consents) if own_time else consents_.active(consents, now)
        asked = asked.join(live, ["kind", "value_fingerprint", *(["at"] if own_time else [])], "left").drop("value_fingerprint")
    if known:
        refs = vaults.first_references(vault).select("kind", F.col("value").alias("canonical"), F.col("ref_id").alias("known_id"))
        asked = asked.join(refs, ["kind", "canonical"], "left")
    else:
        asked = asked.withColumn("known_id", F.lit(None).cast("string"))
    found = asked.where("consent_id IS NOT NULL OR known_id IS NOT NULL").groupBy("__content").agg(F.collect_list(F.struct("kind", "canonical", "consent_id", "known_id")).alias("__found"))

    def with_hit(s: Column) -> Column:
        hit = fn.let(fn.canonical(s["kind"], s["value"]), lambda v: F.get(F.filter("__found", lambda h: (h["kind"] == s["kind"]) & (h["canonical"] == v)), F.lit(0)))
        return fn.let(hit, lambda h: one(s, h))

    met = held.join(found, "__content", "left").withColumn("__decisions", F.transform("__spans", with_hit).cast(DECISION))
    none = F.array().cast(DECISION)
    empty = searched.where(F.size("__spans") == 0).withColumn("__decisions", none)
    rest = df.where(~some).withColumn("__decisions", none)
    return met.select(*columns, "__decisions").unionByName(empty.select(*columns, "__decisions")).unionByName(rest.select(*columns, "__decisions"))


def decide(df: DataFrame, policy: policies.Policy, default: str = "tokenize", consents: DataFrame | None = None, now: int = 0, vault: DataFrame | None = None, salt: str = "", related: Column | None = None, id_col: str = "id", text_col: str = "text", deduplicate: bool = True) -> DataFrame:
    """Exploded decisions: id, pos, kind, start, end, value, action, canonical, consent_id, ref_id."""
    rows = decided(df, policy, default, consents, now, vault, salt, related, id_col, text_col, deduplicate)
    every = F.posexplode_outer("__decisions").alias("pos", "d")  # for an inner one Spark would make all decisions twice, first to see if there are any
    flat = rows.select(F.col(id_col).alias("id"), every).where("pos IS NOT NULL").select("id", "pos", "d.*")
    return flat.withColumn("canonical", fn.canonical(F.col("kind"), F.col("value")))


def _references(df: DataFrame, text_col: str) -> tuple[DataFrame, Column, DataFrame]:
    """``df`` with a content hash, which rows may hold references, and the distinct (__content, key) of these."""
    held = df.withColumn("__content", F.sha2(text_col, 256))
    some = F.coalesce(F.col(text_col).rlike(rewrite.REFERENCE), F.lit(False))
    keys = held.where(some).select("__content", F.explode(rewrite.find_references(F.col(text_col))).alias("r")).select("__content", "r.kind", "r.key").distinct()
    return held, some, keys


def _of(found: str, key: Column) -> Column:
    return F.get(F.filter(found, lambda f: f["key"] == key), F.lit(0))


def expand_allowed(df: DataFrame, vault: DataFrame, consents: DataFrame, now: int, text_col: str = "text") -> DataFrame:
    """References whose values have an active consent are replaced by the values; other columns and rows are unchanged."""
    held, some, keys = _references(df, text_col)
    valued = keys.join(vault.select("key", "value"), "key").withColumn("value_fingerprint", fn.fingerprint(F.col("kind"), F.col("value")))
    allowed = valued.join(consents_.active(consents, now), ["kind", "value_fingerprint"], "left_semi")
    found = allowed.groupBy("__content").agg(F.collect_list(F.struct("key", "value")).alias("__found"))
    refs = rewrite.find_references(F.col(text_col))
    valued_refs = F.transform(refs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), _of("__found", r["key"])["value"].alias("text")))
    new = rewrite.splice(F.col(text_col), F.filter(valued_refs, lambda r: r["text"].isNotNull()))
    met = _met(held, some, found, "__found", "array<struct<key:string,value:string>>")
    return met.withColumn(text_col, F.when(F.col("__found").isNull(), F.col(text_col)).otherwise(new)).select(*df.columns)


Available = Column | Callable[[Column], Column]


def plan(decisions: Column, vault_available: Available | None = None) -> Column:
    """struct(replacements, vault_failures, blocked) of a text's decisions; ``vault_available`` holds for a row, or is asked for each decision."""

    def up(d: Column) -> Column:
        told = vault_available(d) if callable(vault_available) else vault_available
        return F.lit(True) if told is None else F.coalesce(told, F.lit(True))

    def replaced(d: Column) -> Column:
        tokenized = (d["action"] == "tokenize") & up(d)
        mode = F.when(d["action"] == "redact", "redacted").when(tokenized, "tokenized").otherwise("redact_only_fallback")
        text = F.when(tokenized, fn.reference_display(d["kind"], d["ref_id"])).otherwise(fn.placeholder(d["kind"]))
        return F.struct(d["start"].alias("start"), d["end"].alias("end"), text.alias("text"), mode.alias("mode"), d["kind"].alias("kind"), F.when(tokenized, d["ref_id"]).alias("ref_id"))

    changed = F.filter(decisions, lambda d: d["action"].isin("tokenize", "redact"))
    failed = F.filter(decisions, lambda d: (d["action"] == "tokenize") & ~up(d))
    failures = F.array_distinct(F.transform(failed, lambda d: F.struct(d["kind"].alias("kind"), fn.canonical(d["kind"], d["value"]).alias("value"))))
    blocked = F.filter(decisions, lambda d: d["action"] == "block")
    return F.struct(
        F.transform(changed, replaced).alias("replacements"),
        F.transform(failures, lambda f: F.struct(f["kind"].alias("kind"), fn.preview(f["value"]).alias("value_preview"))).alias("vault_failures"),
        F.transform(blocked, lambda d: F.struct(d["kind"].alias("kind"), d["start"].alias("start"), d["end"].alias("end"))).alias("blocked"),
    )


def shielded(df: DataFrame, policy: policies.Policy, vault_available: Available | None = None, text_col: str = "text", **options) -> DataFrame:
    """``df`` with the column ``__protected``: struct(status, output, decisions, plan), all made in the row."""
    return _shielded(decided(df, policy, text_col=text_col, **options), vault_available, text_col)


def _shielded(rows: DataFrame, up: Available | None, text_col: str) -> DataFrame:
    def made(d: Column) -> Column:
        blocked = F.exists(d, lambda x: x["action"] == "block")

        def out(full: Column) -> Column:
            nothing = F.struct(F.slice(full["replacements"], 1, 0).alias("replacements"), F.slice(full["vault_failures"], 1, 0).alias("vault_failures"), full["blocked"].alias("blocked"))
            output = F.when(~blocked, rewrite.splice(F.col(text_col), full["replacements"]))
            return F.struct(F.when(blocked, "blocked").otherwise("protected").alias("status"), output.alias("output"), d.alias("decisions"), F.when(blocked, nothing).otherwise(full).alias("plan"))

        return fn.let(plan(d, up), out)

    return rows.withColumn("__protected", fn.let(F.col("__decisions"), made)).drop("__decisions")


def protect_through(df: DataFrame, policy: policies.Policy, connect: vault_client.Connect, id_col: str = "id", text_col: str = "text", batch: int = vault_client.BATCH, **options) -> DataFrame:
    """`protect` with a vault behind a client: id, status, output, decisions, plan.

    The distinct values that unblocked texts would tokenize are put in batches,
    each once; a value that could not be stored is redacted wherever it stands
    (mode redact_only_fallback), with one failure in each text. Values that the
    store knows take its ids.
    """
    rows = kept(decided(df, policy, id_col=id_col, text_col=text_col, **options))
    open_ = F.exists("__decisions", lambda d: d["action"] == "tokenize") & ~F.exists("__decisions", lambda d: d["action"] == "block")
    asking = rows.where(open_).withColumn("__content", F.sha2(F.to_json("__decisions"), 256))
    flat = asking.select("__content", F.explode("__decisions").alias("d")).where("d.action = 'tokenize'")
    wanted = flat.select("__content", F.col("d.kind").alias("kind"), fn.canonical(F.col("d.kind"), F.col("d.value")).alias("value"), "d.ref_id").distinct()
    stored = vault_client.put_values(wanted, connect, batch)
    found = wanted.join(stored, ["kind", "value"]).groupBy("__content").agg(F.collect_list(F.struct("kind", "value", "stored_id")).alias("__stored"))

    def named(d: Column) -> Column:
        hit = fn.let(fn.canonical(d["kind"], d["value"]), lambda v: F.get(F.filter("__stored", lambda h: (h["kind"] == d["kind"]) & (h["value"] == v)), F.lit(0)))
        ref = F.when(d["action"] == "tokenize", hit["stored_id"])
        return F.struct(*[d[c].alias(c) for c in ("kind", "start", "end", "value", "action", "consent_id")], ref.alias("ref_id"))

    met = asking.join(found, "__content").withColumn("__decisions", F.transform("__decisions", named).cast(DECISION))
    every = met.select(*df.columns, "__decisions").unionByName(rows.where(~open_).select(*df.columns, "__decisions"))
    return _shielded(every, lambda d: d["ref_id"].isNotNull(), text_col).select(F.col(id_col).alias("id"), "__protected.*")


def resolve_through(df: DataFrame, connect: vault_client.Connect, strict: bool = False, id_col: str = "id", text_col: str = "text", batch: int = vault_client.BATCH) -> DataFrame:
    """`resolve` with a vault behind a client; each distinct key is asked once."""
    _, _, keys = _references(df, text_col)
    values, failed = vault_client.get_values(keys, connect, batch)
    return resolve(df, values, failed, strict, id_col, text_col)


def protect(df: DataFrame, policy: policies.Policy, default: str = "tokenize", consents: DataFrame | None = None, now: int = 0, vault: DataFrame | None = None, salt: str = "", related: Column | None = None, vault_available: Column | None = None, expand: bool = True, deduplicate: bool = True, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, status, output, decisions, plan for every row of ``df``; ids may be null or repeated.

    A text with a blocked span is blocked as a whole: no output, no references
    written. Without vault and consents no row leaves its task.
    """
    if expand and vault is not None and consents is not None:
        df = expand_allowed(df, vault, consents, now, text_col)
    done = shielded(df, policy, vault_available, text_col, default=default, consents=consents, now=now, vault=vault, salt=salt, related=related, id_col=id_col, deduplicate=deduplicate)
    return done.select(F.col(id_col).alias("id"), "__protected.*")


def written() -> Column:
    """array<struct<kind,value,ref_id>> of what was tokenized in a row of `protect`; null for blocked texts."""

    def stored(d: Column) -> Column:
        return (d["action"] == "tokenize") & F.exists("plan.replacements", lambda r: (r["start"] == d["start"]) & (r["mode"] == "tokenized"))

    value = lambda d: F.struct(d["kind"].alias("kind"), fn.canonical(d["kind"], d["value"]).alias("value"), d["ref_id"].alias("ref_id"))
    return F.when(F.col("status") == "protected", F.transform(F.filter("decisions", stored), value))


def written_values(protected: DataFrame) -> DataFrame:
    """(kind, value, ref_id) that protecting tokenized: what `operators.vault.write_values` takes."""
    return distinct_values(protected.select(written().alias("written")))


def distinct_values(rows: DataFrame) -> DataFrame:
    """The distinct values of column ``written``, made by `written`; texts are not made twice to see whether they have any."""
    return rows.select(F.explode_outer("written").alias("w")).where("w IS NOT NULL").select("w.*").distinct()


def resolved(df: DataFrame, vault: DataFrame, failed: DataFrame | None = None, strict: bool = False, text_col: str = "text") -> DataFrame:
    """``df`` with the column ``__resolved``: struct(status, output, refs, resolved, missing, read_failures)."""
    held, some, keys = _references(df, text_col)
    broken = (vault.sparkSession.createDataFrame([], "key string") if failed is None else failed).select("key", F.lit(True).alias("broken")).distinct()
    looked = keys.join(vault.select("key", "value"), "key", "left").join(broken, "key", "left").where("value IS NOT NULL OR broken")
    found = looked.groupBy("__content").agg(F.collect_list(F.struct("key", "value", F.coalesce("broken", F.lit(False)).alias("broken"))).alias("__found"))

    def one(r: Column) -> Column:
        def with_hit(hit: Column) -> Column:
            state = F.when(hit["broken"], "failed").when(hit["value"].isNull(), "missing").otherwise("resolved")
            return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"), r["key"].alias("key"), hit["value"].alias("text"), state.alias("state"))

        return fn.let(_of("__found", r["key"]), with_hit)

    def made(refs: Column) -> Column:
        of = lambda s: F.filter(refs, lambda r: r["state"] == s)
        open_ = F.exists(refs, lambda r: r["state"] != "resolved")
        none = ~F.exists(refs, lambda r: r["state"] == "resolved")
        status = F.when(F.size(refs) == 0, "no_references").when(open_ & F.lit(strict), "failed_strict").when(none, "unresolved").when(open_, "partial").otherwise("resolved")
        output = F.when(status.isin("partial", "resolved"), rewrite.splice(F.col(text_col), of("resolved")))
        return F.struct(status.alias("status"), output.alias("output"), refs.alias("refs"), of("resolved").alias("resolved"), of("missing").alias("missing"), of("failed").alias("read_failures"))

    met = _met(held, some, found, "__found", "array<struct<key:string,value:string,broken:boolean>>")
    refs = F.coalesce(F.transform(rewrite.find_references(F.col(text_col)), one), F.array().cast("array<struct<start:int,end:int,kind:string,key:string,text:string,state:string>>"))
    return met.withColumn("__resolved", fn.let(refs, made)).drop("__found")


def resolve(df: DataFrame, vault: DataFrame, failed: DataFrame | None = None, strict: bool = False, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, status, output, and the references of each text: resolved, missing, read_failures.

    ``failed`` lists keys that cannot be read (column key). Output is null
    where a text has no reference or none resolves, and under ``strict`` where
    any does not. Ids may be null or repeated.
    """
    return resolved(df, vault, failed, strict, text_col).select(F.col(id_col).alias("id"), "__resolved.*")


def inbound(df: DataFrame, vault: DataFrame, policy: policies.Policy, resolve_first: bool = True, protect_too: bool = True, id_col: str = "id", text_col: str = "text", **options) -> DataFrame:
    """(id, output) of inbound texts: resolved where a reference resolves, else protected, else as they are.

    Only texts without a resolved reference are searched and protected.
    """
    out = F.col(id_col).alias("id")
    if not resolve_first:
        left, done = df, None
    else:
        tried = kept(resolved(df, vault, text_col=text_col).withColumn("__out", F.col("__resolved.output")).select(*df.columns, "__out"))
        done = tried.where("__out IS NOT NULL").select(out, F.col("__out").alias("output"))
        left = tried.where("__out IS NULL").drop("__out")
    if protect_too:
        held = shielded(left, policy, text_col=text_col, vault=vault, id_col=id_col, **options)
        left = held.select(out, F.when(F.col("__protected.status") == "blocked", BLOCKED).otherwise(F.col("__protected.output")).alias("output"))
    else:
        left = left.select(out, F.col(text_col).alias("output"))
    return left if done is None else done.unionByName(left)
