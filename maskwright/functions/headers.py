"""Header maps of rewritten bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as fn

# Headers that vouch for a body, and headers of one connection.
INTEGRITY = (
    "content-digest", "content-md5", "digest", "repr-digest", "signature", "signature-input", "x-content-digest",
    "x-content-md5", "x-body-digest", "x-body-sha256", "x-payload-digest", "x-payload-sha256", "x-signature",
)
CONNECTION = ("host", "content-length", "connection", "transfer-encoding", "te", "trailer", "upgrade", "keep-alive", "proxy-authorization", "proxy-authenticate", "accept-encoding")
RETURNED = (*INTEGRITY, "content-length", "connection", "transfer-encoding", "te", "trailer", "upgrade", "keep-alive", "proxy-authenticate")


def without_integrity(headers: Column, changed: Column) -> Column:
    """Headers that a changed body contradicts go; those of an unchanged body stay."""
    return F.map_filter(headers, lambda k, _: ~changed | ~F.lower(k).isin(*INTEGRITY))


def _named(headers: Column) -> Column:
    """Lower-case names that the Connection header, in any case, lists."""
    lists = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "connection")
    names = F.flatten(F.transform(lists, lambda e: F.split(F.coalesce(e["value"], F.lit("")), ",")))
    return F.transform(names, lambda x: F.lower(F.trim(x)))


def forwarded(headers: Column, own_authorization: Column) -> Column:
    """A request's headers without those of the connection, those it names itself, and an authorization that the target replaces."""
    return fn.let(_named(headers), lambda named: F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*CONNECTION) & ~F.array_contains(named, F.lower(k)) & ~(own_authorization & (F.lower(k) == "authorization"))))


def returned(headers: Column) -> Column:
    """A response's headers without those of the connection and those it names itself; a request's own are not special here."""
    return fn.let(_named(headers), lambda named: F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*RETURNED) & ~F.array_contains(named, F.lower(k))))
