"""Detection of sensitive spans as column expressions: text -> array of (kind, start, end, value).

Offsets are bytes of the UTF-8 text, half open. Everything runs inside the
JVM; each detector is guarded by a cheap test, so texts without an @ or three
digits never meet a costly pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,value:string>>"

# The patterns of the detected kinds. (?U) makes \d, \s and \b
# Unicode-aware.
EMAIL = r"[A-Za-z0-9._%+\-]+[ \t\r\n]*@[ \t\r\n]*[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+|[ \t\r\n]+\.[ \t\r\n]*[A-Za-z0-9\-]+)+"
PHONE = r"(?U)\+[1-9]\d{6,14}|\b(?:\(\d{3}\)\s?|\d{3}[\-.])\d{3}[\-.]\d{4}\b"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
CARD = r"(?U)\b(?:\d{4}[\s\-]?){3}\d{4}\b"
DOMAIN_BEFORE = r"(?iu)(?:^|[^A-Za-z0-9@._-])("
DOMAIN_AFTER = r")(?:$|[^A-Za-z0-9._-])"
DOMAIN_DOT = r"[ \\t\\r\\n]*\\.[ \\t\\r\\n]*"  # as a replacement, where a backslash escapes

# Names in chains: what stands between them, and the letters that fold to one of theirs.
CHAIN_DOT = r"[ \t\r\n]*\.[ \t\r\n]*"
CHAIN_BREAK = r"(?iu)(?<![^a-z0-9-])(?![ \t\r\n]*+\.[ \t\r\n]*+[a-z0-9-])[^a-z0-9-]++"
FOLDED = ("\u017f\u212a\u0131\u0130", "skii")
CHAINS = "array<struct<c:string,byte:int,char:int,opens:boolean,closes:boolean>>"
LABELS = "array<struct<n:string,b:int,c:int,eb:int,ec:int,opens:boolean,closes:boolean>>"
EVENTS = "array<struct<name:string,asked:int,c:int,ec:int,b:int,eb:int,value:string>>"
RANKED = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
#: Up to so many domains one pattern a domain is quicker than one pass for all.
FEW_DOMAINS = 4


@dataclass(frozen=True)
class Detector:
    """A kind, its place among spans with one start, its pattern, a guard and a check of the value."""

    kind: str
    rank: int
    pattern: str
    guard: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None = None


def _digits(text: Column) -> Column:
    return text.rlike(r"(?U)\d{3}")


#: Extend by appending; ranks decide ties, 1 is kept for domains.
DETECTORS = (
    Detector("email", 0, EMAIL, lambda t: t.contains("@")),
    Detector("phone", 2, PHONE, _digits),
    Detector("ssn", 3, SSN, _digits, scalars.valid_ssn),
    Detector("cc", 4, CARD, _digits, scalars.luhn_valid),
)


def _placed(gaps: Column, matches: Column) -> Column:
    """Byte spans from the texts between matches and the matches, both arrays of one length."""
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.octet_length(g).alias("gap"), m.alias("m"), F.octet_length(m).alias("n")))

    def add(at: Column, p: Column) -> tuple[Column, Column]:
        begin = at + p["gap"]
        span = F.struct(begin.alias("start"), (begin + p["n"]).alias("end"), p["m"].alias("value"))
        return begin + p["n"], F.array(span)

    return scalars.let(pairs, lambda p: scalars.running(p, F.lit(0), "array<struct<start:int,end:int,value:string>>", add))


def _pieces(text: Column, splitter: str | Column, pattern: Column) -> Column:
    """struct(gaps, found): all matches of a pattern (given for splitting, too) and the texts before each."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return scalars.let(found, lambda m: F.struct(F.slice(F.split(text, splitter, -1), F.lit(1), F.size(m)).alias("gaps"), m.alias("found")))


def located(text: Column, splitter: str | Column, pattern: Column) -> Column:
    """Byte spans of all matches of a pattern, found once."""
    return scalars.let(_pieces(text, splitter, pattern), lambda p: _placed(p["gaps"], p["found"]))


def matches(text: Column, detector: Detector) -> Column:
    """Spans of one detector, in text order, with its rank."""
    return all_matches(text, (detector,))


def all_matches(text: Column, detectors: tuple[Detector, ...]) -> Column:
    """Spans of several detectors, each in text order, with their ranks; places and checks are one expression for all."""

    def of(d: Detector) -> Column:
        pieces = F.when(d.guard(text), _pieces(text, d.pattern, F.lit(d.pattern)))
        return F.struct(F.lit(d.rank).alias("rank"), F.lit(d.kind).alias("kind"), pieces.alias("p"))

    def spans(d: Column) -> Column:
        placed = F.when(d["p"].isNotNull(), _placed(d["p"]["gaps"], d["p"]["found"])).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
        return F.transform(placed, lambda s: F.struct(s["start"].alias("start"), d["rank"].alias("rank"), s["end"].alias("end"), d["kind"].alias("kind"), s["value"].alias("value")))

    found = F.flatten(F.transform(F.array(*[of(d) for d in detectors]), spans))
    checks = [d for d in detectors if d.valid is not None]

    def valid(s: Column) -> Column:
        ok = F.when(s["kind"] == checks[0].kind, checks[0].valid(s["value"]))
        for d in checks[1:]:
            ok = ok.when(s["kind"] == d.kind, d.valid(s["value"]))
        return ok.otherwise(F.lit(True))

    return F.filter(found, valid) if checks else found


def _ranked(start: Column, end: Column, rank: int, kind: str, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), value.alias("value"))


def _none() -> Column:
    return F.array().cast(RANKED)


def known_domains(emails: Column, related: Column | None = None) -> Column:
    """Sorted distinct valid domains of found addresses and of related domains."""
    own = F.transform(emails, lambda e: F.substring_index(scalars.squeeze(e["value"]), "@", -1))
    every = own if related is None else F.concat(own, F.coalesce(related, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, scalars.normalize_domain), lambda d: d.isNotNull())))


def domain_regex_matches(text: Column, domains: Column) -> Column:
    """Whole mentions of each domain, one pattern a domain; a mention uses up the character on either side of it."""

    def tight(s: Column, value: Column) -> Column:
        begin = s["start"] + F.octet_length(F.left(s["value"], F.position(value, s["value"]) - 1))
        return _ranked(begin, begin + F.octet_length(value), 1, "domain", value)

    def of(domain: Column) -> Column:
        pattern = F.concat(F.lit(DOMAIN_BEFORE), F.regexp_replace(domain, r"\.", DOMAIN_DOT), F.lit(DOMAIN_AFTER))
        return scalars.let(pattern, lambda p: F.zip_with(located(text, p, p), F.regexp_extract_all(text, p, F.lit(1)), tight))

    return F.flatten(F.transform(domains, of))


def domain_chains(text: Column) -> Column:
    """All chains of names joined by dots, with places in bytes and characters, and whether a mention may begin and end at their ends.

    What parts chains is any run between names that is not one dot among
    blanks; both patterns are loops over single characters, so neither long
    runs nor long chains cost more than their length.
    """
    breaks = F.regexp_extract_all(text, F.lit(CHAIN_BREAK), F.lit(0))

    def of(found: Column) -> Column:
        pairs = F.zip_with(F.split(text, CHAIN_BREAK, -1), F.concat(found, F.array(F.lit(""))), lambda c, b: F.struct(c.alias("c"), b.alias("b")))

        def add(at: Column, p: Column) -> tuple[Column, Column]:
            piece = F.struct(p["c"].alias("c"), at["byte"].alias("byte"), at["char"].alias("char"), (~at["before"].isin("@", ".", "_")).alias("opens"), (~F.left(p["b"], F.lit(1)).isin(".", "_")).alias("closes"))
            onward = F.struct(
                (at["byte"] + F.octet_length(p["c"]) + F.octet_length(p["b"])).alias("byte"),
                (at["char"] + F.length(p["c"]) + F.length(p["b"])).alias("char"),
                F.right(p["b"], F.lit(1)).alias("before"),
            )
            return onward, F.when(p["c"].contains("."), F.array(piece)).otherwise(F.array().cast(CHAINS))

        zero = F.struct(F.lit(0).alias("byte"), F.lit(0).alias("char"), F.lit("").alias("before"))
        return scalars.let(pairs, lambda p: scalars.running(p, zero, CHAINS, add))

    return scalars.let(breaks, of)


def _mentions(chain: Column, most: Column) -> Column:
    """The names that a chain may mention, of 2 to ``most`` labels: where the character on each side is neither part of a name nor a dot."""
    pairs = F.zip_with(F.split(chain["c"], CHAIN_DOT, -1), F.concat(F.regexp_extract_all(chain["c"], F.lit(CHAIN_DOT), F.lit(0)), F.array(F.lit(""))), lambda n, d: F.struct(n.alias("n"), d.alias("d")))

    def add(at: Column, p: Column) -> tuple[Column, Column]:
        end_b, end_c = at["b"] + F.octet_length(p["n"]), at["c"] + F.length(p["n"])
        closes = F.when(p["d"] == "", chain["closes"]).otherwise(F.left(p["d"], F.lit(1)) != ".")
        label = F.struct(p["n"].alias("n"), at["b"].alias("b"), at["c"].alias("c"), end_b.alias("eb"), end_c.alias("ec"), at["opens"].alias("opens"), closes.alias("closes"))
        return F.struct((end_b + F.octet_length(p["d"])).alias("b"), (end_c + F.length(p["d"])).alias("c"), (F.right(p["d"], F.lit(1)) != ".").alias("opens")), F.array(label)

    zero = F.struct(chain["byte"].alias("b"), chain["char"].alias("c"), chain["opens"].alias("opens"))
    labels = scalars.let(pairs, lambda p: scalars.running(p, zero, LABELS, add))

    def of(parts: Column) -> Column:
        def begun(p: Column, i: Column) -> Column:
            last = F.least(F.size(parts), i + most)

            def ended(j: Column) -> Column:
                end = F.get(parts, j - 1)
                name = F.array_join(F.transform(F.slice(parts, i + 1, j - i), lambda x: x["n"]), ".")
                return F.struct(
                    F.lower(F.translate(name, *FOLDED)).alias("name"), F.lit(1).alias("asked"), p["c"].alias("c"), end["ec"].alias("ec"), p["b"].alias("b"), end["eb"].alias("eb"),
                    F.substring(chain["c"], p["c"] - chain["char"] + 1, end["ec"] - p["c"]).alias("value"),
                )

            some = F.filter(F.sequence(i + 2, last), lambda j: F.get(parts, j - 1)["closes"])
            return F.when(p["opens"] & (last >= i + 2), F.transform(some, ended)).otherwise(F.array().cast(EVENTS))

        return F.flatten(F.transform(parts, begun))

    return scalars.let(labels, of)


def domain_matches(text: Column, domains: Column) -> Column:
    """Whole mentions of each domain; a mention uses up the character on either side of it.

    A few domains are looked for by a pattern each. Many are met in one pass:
    all names that the text may mention and the domains are sorted by name
    together, and each run of one name is walked once, so that the cost grows
    with the text and with the domains, not with their product.
    """

    def one_pass(asked: Column) -> Column:
        most = F.array_max(F.transform(asked, lambda d: F.size(F.split(d, r"\."))))
        wanted = F.transform(asked, lambda d: F.struct(d.alias("name"), *[F.lit(0).alias(c) for c in ("asked", "c", "ec", "b", "eb")], F.lit("").alias("value")))
        named = scalars.let(most, lambda m: F.flatten(F.transform(domain_chains(text), lambda c: _mentions(c, m))))

        def add(at: Column, e: Column) -> tuple[Column, Column]:
            here = (e["asked"] == 1) & (e["name"] == at["name"]) & (e["c"] >= at["free"])
            onward = F.when(e["asked"] == 0, F.struct(e["name"].alias("name"), F.lit(0).alias("free"))).when(here, F.struct(at["name"].alias("name"), (e["ec"] + 2).alias("free"))).otherwise(at)
            return onward, F.when(here, F.array(_ranked(e["b"], e["eb"], 1, "domain", e["value"]))).otherwise(_none())

        zero = F.struct(F.lit("").alias("name"), F.lit(0).alias("free"))
        return scalars.let(F.array_sort(F.concat(wanted.cast(EVENTS), named)), lambda e: scalars.running(e, zero, RANKED, add))

    return scalars.let(domains, lambda d: F.when(F.size(d) <= FEW_DOMAINS, domain_regex_matches(text, d)).otherwise(one_pass(d)))


def keep_disjoint(spans: Column) -> Column:
    """Greedy by start, then detector rank: a span stays if it begins at or after the end of the last kept one."""

    def add(end: Column, s: Column) -> tuple[Column, Column]:
        span = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
        fits = s["start"] >= end
        return F.when(fits, s["end"]).otherwise(end), F.when(fits, F.array(span)).otherwise(F.array().cast(SPAN_TYPE))

    return scalars.let(F.array_sort(spans), lambda s: scalars.running(s, F.lit(0), SPAN_TYPE, add))


def may_hold(text: Column, related: Column | None = None) -> Column:
    """False only where `detections` finds nothing: none of the cheap guards holds, and no domain is looked for."""
    any_ = F.lit(False) if related is None else F.coalesce(F.size(related) > 0, F.lit(False))
    for d in DETECTORS:
        any_ = any_ | d.guard(text)
    return F.coalesce(any_, F.lit(False))


def detections(text: Column, related: Column | None = None, detectors: tuple[Detector, ...] = DETECTORS) -> Column:
    """All disjoint sensitive spans of a text, in order; null and empty texts have none.

    ``related``: an array of domains to look for besides those of the text's
    own addresses.
    """
    def with_domains(own: Column) -> Column:
        domains = domain_matches(text, known_domains(F.filter(own, lambda s: s["kind"] == "email"), related))
        if related is None:
            domains = F.when(F.exists(own, lambda s: s["kind"] == "email"), domains).otherwise(_none())
        return keep_disjoint(F.concat(own, domains))

    return F.coalesce(scalars.let(all_matches(text, detectors), with_domains), F.array().cast(SPAN_TYPE))
