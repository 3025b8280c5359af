"""Consents: time-limited permissions for values, kept as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn

SCHEMA = "id string, kind string, value_fingerprint string, vault_key string, scope string, created_at long, expires_at long, revoked_at long, created_by string, reason string"
SCOPE = "global"


def grant(values: DataFrame, now: int, ttl: int = 86_400, created_by: str = "user", reason: str | None = None) -> DataFrame:
    """Consent rows for (kind, value) and, if there, vault_key."""
    kind, value = F.col("kind"), F.col("value")
    key = F.col("vault_key") if "vault_key" in values.columns else F.lit(None).cast("string")
    print_ = fn.fingerprint(kind, value)
    id_ = F.left(F.sha2(F.concat_ws("\x1f", kind, print_, F.lit(str(now)), F.lit(created_by)), 256), F.lit(32))
    return values.select(
        id_.alias("id"), "kind", print_.alias("value_fingerprint"), key.alias("vault_key"), F.lit(SCOPE).alias("scope"),
        F.lit(now).cast("long").alias("created_at"), F.lit(now + ttl).cast("long").alias("expires_at"), F.lit(None).cast("long").alias("revoked_at"),
        F.lit(created_by).alias("created_by"), F.lit(reason).cast("string").alias("reason"),
    )


def grant_references(keys: DataFrame, vault: DataFrame, now: int, ttl: int = 86_400, created_by: str = "user") -> tuple[DataFrame, DataFrame]:
    """Consents for the values behind references (column key), and (key, error) of the others."""
    asked = keys.select("key").distinct().withColumn("ref", fn.parse_key(F.col("key")))
    named = asked.withColumn("norm", fn.reference_key(F.col("ref.kind"), F.col("ref.id")))
    held = named.join(vault.select(F.col("key").alias("norm"), "value"), "norm", "left")
    good = held.where("value IS NOT NULL").select(F.col("ref.kind").alias("kind"), "value", F.col("norm").alias("vault_key"))
    error = F.when(F.col("ref").isNull(), "invalid_reference").otherwise("value_not_found")
    return grant(good, now, ttl, created_by), held.where("value IS NULL").select("key", error.alias("error"))


def active(consents: DataFrame, now: int, scope: str = SCOPE) -> DataFrame:
    """(kind, value_fingerprint, consent_id): of the active consents the one that lasts longest, ties to the largest id."""
    live = consents.where((F.col("scope") == scope) & F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    kind = F.coalesce(fn.kind_tag(F.col("kind")), F.lit("email"))
    return live.groupBy(kind.alias("kind"), "value_fingerprint").agg(F.max_by("id", F.struct("expires_at", "id")).alias("consent_id"))


#: Times are seconds within 2**40 of 1970; pieces of time are BASE**level seconds long.
FAR, BASE, LEVELS = 1 << 40, 8, 14


def time_pieces(start: Column, end: Column) -> Column:
    """[start, end) as few aligned pieces: array<struct<level, place>>, each of BASE**level seconds from place * BASE**level."""
    widths = F.array(*[F.lit(BASE**k).cast("long") for k in range(LEVELS)])
    none = F.array().cast("array<struct<level:int,place:long>>")

    def step(acc: Column, k: Column) -> Column:
        def at(width: Column) -> Column:
            wide = width * BASE
            up, down = (F.ceil(acc["low"] / wide) * wide).cast("long"), (F.floor(acc["high"] / wide) * wide).cast("long")

            def cut(b: Column) -> Column:
                def span(a: Column, z: Column) -> Column:
                    places = F.sequence((a / width).cast("long"), (z / width).cast("long") - 1)
                    return F.when(z > a, F.transform(places, lambda i: F.struct(k.alias("level"), i.alias("place")))).otherwise(none)

                inside = (b["up"] <= b["down"]) & (k < LEVELS - 1)
                more = F.when(inside, F.concat(span(acc["low"], b["up"]), span(b["down"], acc["high"]))).otherwise(span(acc["low"], acc["high"]))
                return F.struct(F.when(inside, b["up"]).otherwise(acc["high"]).alias("low"), F.when(inside, b["down"]).otherwise(acc["high"]).alias("high"), F.concat(acc["out"], more).alias("out"))

            return fn.let(F.struct(up.alias("up"), down.alias("down")), cut)

        return fn.let(F.get(widths, k), at)

    low, high = F.greatest(start, F.lit(-FAR)), F.least(end, F.lit(FAR))
    zero = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), none.alias("out"))
    return F.when(high > low, F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), zero, step, lambda acc: acc["out"])).otherwise(none)


def active_at(asked: DataFrame, consents: DataFrame, scope: str = SCOPE, at: str = "at") -> DataFrame:
    """Distinct (kind, value_fingerprint, at) of ``asked`` with consent_id: what `active` would have said at that time, or null.

    A consent holds from its creation until it expires or is revoked. Its time
    is cut into aligned pieces, and each piece of a value keeps only its longest
    lasting consent, so a moment meets at most one row in each of LEVELS piece
    lengths, however many consents of a value overlap: a join on equal keys,
    with no range to test and no group to gather.
    """
    kind = F.coalesce(fn.kind_tag(F.col("kind")), F.lit("email"))
    until = F.when(F.col("revoked_at").isNull(), F.col("expires_at")).otherwise(F.least("expires_at", "revoked_at"))
    pieces = consents.where(F.col("scope") == scope).select(kind.alias("kind"), "value_fingerprint", "id", "expires_at", F.explode(time_pieces(F.col("created_at"), until)).alias("p"))
    best = pieces.groupBy("kind", "value_fingerprint", "p.level", "p.place").agg(F.max(F.struct("expires_at", "id")).alias("best"))
    moments = asked.select("kind", "value_fingerprint", F.col(at).cast("long").alias("at")).distinct()
    places = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("at") / (BASE**k)).cast("long").alias("place")) for k in range(LEVELS)])
    probes = moments.where(F.col("at").between(-FAR, FAR - 1)).select("kind", "value_fingerprint", "at", F.explode(places).alias("p")).select("kind", "value_fingerprint", "at", "p.*")
    held = probes.join(best, ["kind", "value_fingerprint", "level", "place"]).groupBy("kind", "value_fingerprint", "at").agg(F.max("best").alias("best"))
    same = F.col("m.kind").eqNullSafe(F.col("h.kind")) & F.col("m.value_fingerprint").eqNullSafe(F.col("h.value_fingerprint")) & F.col("m.at").eqNullSafe(F.col("h.at"))
    return moments.alias("m").join(held.alias("h"), same, "left").select("m.*", F.col("h.best.id").alias("consent_id"))


def revoke(consents: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Revoke the consents ``ids`` (column id) with all unrevoked ones of the same kind, value and scope."""
    group = ["kind", "value_fingerprint", "scope"]
    hit = consents.join(ids.select("id").distinct(), "id", "left_semi").select(*group, F.lit(True).alias("__hit")).distinct()
    revoked = F.when(F.col("__hit") & F.col("revoked_at").isNull(), F.lit(now).cast("long")).otherwise(F.col("revoked_at"))
    return consents.join(hit, group, "left").withColumn("revoked_at", revoked).select(*consents.columns)


def with_status(consents: DataFrame, now: int) -> DataFrame:
    return consents.withColumn("status", fn.consent_status(F.col("revoked_at"), F.col("expires_at"), F.lit(now)))


def listed(consents: DataFrame, page: int | None = None) -> DataFrame:
    """Newest first, ties by id; the first ``page`` of them if given."""
    rows = consents.orderBy(F.desc("created_at"), "id")
    return rows if page is None else rows.limit(page)
