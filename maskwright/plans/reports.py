"""Counters and reports over protected and resolved texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn


def plan_counters(plan: Column) -> dict[str, Column]:
    """Counts of one text's plan; references are counted once."""
    of = lambda mode: F.size(F.filter(plan["replacements"], lambda r: r["mode"] == mode))
    keys = F.transform(F.filter(plan["replacements"], lambda r: r["mode"] == "tokenized"), lambda r: fn.reference_key(r["kind"], r["ref_id"]))
    return {
        "tokenized": of("tokenized"),
        "fallback_redacted": of("redact_only_fallback"),
        "policy_redacted": of("redacted"),
        "blocked": F.size(plan["blocked"]),
        "vault_writes": F.size(F.array_distinct(keys)),
        "vault_failures": F.size(plan["vault_failures"]),
    }


def filter_reports(protected: DataFrame) -> DataFrame:
    """One JSON report per text, without raw values: status, counters, spans and diagnostics."""
    counters = plan_counters(F.col("plan"))
    spans = F.transform("decisions", lambda d: F.struct(d["kind"].alias("kind"), d["start"].alias("start"), d["end"].alias("end"), d["action"].alias("action")))
    diagnostics = F.transform("plan.vault_failures", lambda f: F.concat(F.lit("vault write failed for "), f["kind"], F.lit("; redacted instead")))
    report = F.struct("status", F.struct(F.size("decisions").alias("detections"), *[c.alias(k) for k, c in counters.items()]).alias("summary"), spans.alias("decisions"), diagnostics.alias("diagnostics"))
    return protected.select("id", F.to_json(report).alias("report"))


def filter_summary(protected: DataFrame) -> DataFrame:
    """The same counters over a whole table, in one aggregation."""
    counters = plan_counters(F.col("plan"))
    rows = protected.select("status", F.size("decisions").alias("detections"), *[c.alias(k) for k, c in counters.items()])
    return rows.agg(F.count("*").alias("texts"), F.count_if(F.col("status") == "blocked").alias("blocked_texts"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("detections", *counters)])


def resolve_reports(resolved: DataFrame) -> DataFrame:
    summary = F.struct(F.size("refs").alias("references"), F.size("resolved").alias("resolved"), F.size("missing").alias("missing"), F.size("read_failures").alias("read_failures"))
    open_ = F.transform(F.concat("missing", "read_failures"), lambda r: F.struct(r["key"].alias("key"), r["state"].alias("state")))
    return resolved.select("id", F.to_json(F.struct("status", summary.alias("summary"), open_.alias("unresolved"))).alias("report"))


def resolve_summary(resolved: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    return resolved.agg(F.count("*").alias("texts"), total("refs").alias("references"), total("resolved").alias("resolved"), total("missing").alias("missing"), total("read_failures").alias("read_failures"))


#: Orders in which states get worse (fixed values).
HEALTH, SETUP = ("healthy", "degraded", "unhealthy"), ("ready", "needs_action", "blocked")


def worst_state(states: DataFrame, order: tuple[str, ...] = HEALTH) -> DataFrame:
    """The worst of the states in column ``state``; the best where there is none."""
    rank = F.coalesce(F.max(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("state"))), F.lit(1)).cast("int")
    return states.agg(F.element_at(F.array(*[F.lit(s) for s in order]), rank).alias("state"))


def doctor_counts(records: DataFrame) -> DataFrame:
    """Over integration records (applied, rollback_available, modified, error)."""
    return records.agg(F.count_if("applied").alias("applied"), F.count_if(F.col("applied") & F.col("rollback_available")).alias("rollback_ready"), F.count_if("modified").alias("modified"), F.count_if(F.col("error").isNotNull()).alias("record_errors"))


def failure_modes(targets: DataFrame, default: str) -> DataFrame:
    """(name, mode, reduced): a target's own failure mode or the default; any diagnostic reduces protection."""
    return targets.select("name", F.coalesce("failure_mode", F.lit(default)).alias("mode"), (F.size("diagnostics") > 0).alias("reduced"))
