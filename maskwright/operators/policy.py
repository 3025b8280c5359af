"""Policies: spans to decisions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import ACTIONS

#: A policy maps kinds to actions, or makes an action column of a span column.
Policy = Mapping[str, str] | Callable[[Column], Column]


def action(span: Column, policy: Policy, default: str = "tokenize") -> Column:
    if callable(policy):
        return F.coalesce(policy(span), F.lit(default))
    if bad := {*policy.values(), default} - set(ACTIONS):
        raise ValueError(f"unknown actions: {sorted(bad)}")
    chosen = F.lit(default)
    for kind, name in policy.items():
        chosen = F.when(span["kind"] == kind, F.lit(name)).otherwise(chosen)
    return chosen


def decide(spans: Column, policy: Policy, default: str = "tokenize") -> Column:
    """array<struct<kind,start,end,value,action>>"""
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), action(s, policy, default).alias("action")))
