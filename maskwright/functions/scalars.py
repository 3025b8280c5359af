"""Scalar functions over values, references, event messages, hosts and settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds and their spellings (fixed values).
KINDS = ("email", "domain", "phone", "ssn", "cc")
ALIASES = {"credit_card": "cc", "credit-card": "cc"}
ACTIONS = ("tokenize", "redact", "allow", "block")
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: Largest 22-character base58 texts of 16 bytes, after k leading ones (fixed values).
LARGEST_ID = ("YcVfxkQb6JRzqk5kF2tNLv", "8AQGAut7N92awznwCnjuQ", "2d7dWtQMvj9WttA3mMnW")
SPACE = r"[ \t\r\n]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, zero: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]], chunk: int = 256) -> Column:
    """What ``step`` yields over an array: (state, item) to (next state, array of ``out`` elements), joined.

    A fold that grows one list copies it at every item; here the list grows by
    chunks, so a text with very many items stays cheap.
    """
    none = F.array().cast(out)

    def add(acc: Column, item: Column) -> Column:
        state, new = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], new).alias("out"))

    def whole(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(items, k + 1, F.lit(chunk)), F.struct(acc["state"].alias("state"), none.alias("out")), add)
        return let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["out"], p["out"]).alias("out")))

    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(chunk))
    folded = F.aggregate(starts, F.struct(zero.alias("state"), none.alias("out")), whole, lambda acc: acc["out"])
    return F.when(F.size(items) > 0, folded).otherwise(none)


def squeeze(value: Column) -> Column:
    """Without blanks, tabs and line ends."""
    return F.regexp_replace(value, SPACE, "")


def normalize_domain(value: Column) -> Column:
    """Squeezed, lower case, without trailing dots; null unless a valid domain name."""
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return let(F.lower(F.regexp_replace(squeeze(value), r"\.+$", "")), lambda domain: F.when(domain.rlike(rf"^(?:{label}\.)+[a-z]{{2,63}}$"), domain))


def luhn_valid(value: Column) -> Column:
    """13 to 19 ASCII digits, not all zero, with a right check digit."""

    def check(digits: Column) -> Column:
        n = F.length(digits)

        def weigh(acc: Column, k: Column) -> Column:
            d = F.substring(digits, n - k, F.lit(1)).cast("int")
            return acc + F.when(k % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), weigh)
        return F.when(n.between(13, 19) & digits.rlike("[1-9]"), total % 10 == 0).otherwise(F.lit(False))

    return let(F.regexp_replace(value, "[^0-9]", ""), check)


def valid_ssn(value: Column) -> Column:
    """Nine digits whose area, group and serial numbers are assigned."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return digits.rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def canonical(kind: Column, value: Column) -> Column:
    """One spelling for one value: addresses with a lower-case domain, bare lower-case domains."""

    def address(tight: Column) -> Column:
        domain = F.substring_index(tight, "@", -1)
        return F.when(tight.contains("@"), F.concat(F.left(tight, F.length(tight) - F.length(domain)), F.lower(domain))).otherwise(tight)

    return F.when(kind == "email", let(squeeze(value), address)).when(kind == "domain", F.lower(F.regexp_replace(squeeze(value), r"\.+$", ""))).otherwise(value)


def fingerprint(kind: Column, value: Column, prefix: str = "maskwright-consent-v1") -> Column:
    """sha256 (hex) of a domain separator, the kind and the canonical value, split by zero bytes."""
    zero = F.unhex(F.lit("00"))
    encoded = F.concat(F.encode(F.lit(prefix), "UTF-8"), zero, F.encode(kind, "UTF-8"), zero, F.encode(canonical(kind, value), "UTF-8"))
    return F.sha2(encoded, 256)


#: Five characters of base 58 make one digit; nine such digits hold 32 bytes.
FIVE, WIDE = 58**5, 9


def base58(hex_: Column) -> Column:
    """The base58 text of 32 bytes given in hex, a leading 1 for each leading zero byte.

    Long division by folds: each 32-bit word is multiplied into nine digits of
    base 58**5, whose products stay within 64 bits.
    """
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hex_, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))

    def take(digits: Column, word: Column) -> Column:
        def carry(acc: Column, d: Column) -> Column:
            def split(x: Column) -> Column:
                rest = F.pmod(x, F.lit(FIVE))  # what is left divides exactly, below 2**33
                return F.struct(F.round((x - rest) / FIVE).cast("long").alias("rest"), F.concat(acc["out"], F.array(rest)).alias("out"))

            return let(acc["rest"] + d * F.lit(1 << 32), split)

        return F.aggregate(digits, F.struct(word.alias("rest"), F.array().cast("array<bigint>").alias("out")), carry, lambda acc: acc["out"])

    digits = F.aggregate(words, F.array(*[F.lit(0).cast("long")] * WIDE), take)
    letters = lambda d: F.concat(*[F.substring(F.lit(BASE58), (F.pmod(F.floor(d / F.lit(58**k)), F.lit(58)) + 1).cast("int"), F.lit(1)) for k in range(4, -1, -1)])
    text = F.regexp_replace(F.array_join(F.transform(F.reverse(digits), letters), ""), "^1+", "")
    zeros = F.length(F.regexp_extract(hex_, "^(?:00)*", 0)) / 2
    return F.when(F.length(hex_) == 64, F.concat(F.repeat(F.lit("1"), zeros.cast("int")), text))


def kind_tag(tag: Column) -> Column:
    """The kind that a tag names in any case, aliases included; null for others."""
    low = F.lower(tag)
    for alias, kind in ALIASES.items():
        low = F.when(low == alias, F.lit(kind)).otherwise(low)
    return F.when(low.isin(*KINDS), low)


def parse_action(tag: Column) -> Column:
    return F.when(F.lower(tag).isin(*ACTIONS), F.lower(tag))


def valid_reference_id(id_: Column) -> Column:
    """22 base58 characters that stand for exactly 16 bytes.

    The alphabet rises with its character codes, so after the leading ones
    (zero bytes) a comparison with the largest such text decides.
    """
    shape = id_.rlike(f"^[{BASE58}]{{22}}$")
    ones = F.length(F.regexp_extract(id_, "^1*", 0))
    rest = F.regexp_replace(id_, "^1+", "")
    fits = F.when(ones == 0, rest <= LARGEST_ID[0]).when(ones == 1, rest <= LARGEST_ID[1]).when(ones == 2, rest <= LARGEST_ID[2]).otherwise(F.lit(False))
    return F.coalesce(shape & fits, F.lit(False))


def reference_key(kind: Column, id_: Column) -> Column:
    return F.concat(kind, F.lit(":"), id_)


def reference_display(kind: Column, id_: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit(":"), id_, F.lit("]"))


def parse_key(key: Column) -> Column:
    """struct(kind, id) of a key, null unless both are valid."""
    kind, id_ = kind_tag(F.substring_index(key, ":", 1)), F.regexp_extract(key, "^[^:]*:(.*)$", 1)
    return F.when(kind.isNotNull() & valid_reference_id(id_), F.struct(kind.alias("kind"), id_.alias("id")))


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("]"))


def preview(value: Column) -> Column:
    """The first four characters, marked if there are more."""
    return F.when(F.length(value) > 4, F.concat(F.left(value, F.lit(4)), F.lit("..."))).otherwise(value)


def kind_from_key(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


# Events


def day_label(ts: Column) -> Column:
    """yyyy-MM-dd in UTC (the session's time zone must be UTC); before 1970 counts as 1970."""
    return F.date_format(F.timestamp_seconds(F.greatest(ts, F.lit(0))), "yyyy-MM-dd")


def epoch_day(ts: Column) -> Column:
    return F.floor(F.greatest(ts, F.lit(0)) / 86400)


def audit_id(id_: Column) -> Column:
    return F.concat(F.lit("evt_"), F.lpad(F.lower(F.hex(id_)), 16, "0"))


def field_value(message: Column, key: str) -> Column:
    """The first key=value token of a message, without commas and semicolons around it."""
    tokens = F.filter(F.split(message, r"\s+"), lambda t: t.startswith(f"{key}="))
    return F.regexp_replace(F.substring(F.get(tokens, F.lit(0)), len(key) + 2, 1 << 30), "^[,;]+|[,;]+$", "")


def numeric_field(message: Column, key: str) -> Column:
    value = field_value(message, key)
    return F.when(value.rlike(r"^\+?[0-9]+$"), value.try_cast("long"))


def actor_from_message(message: Column) -> Column:
    return F.nullif(F.coalesce(field_value(message, "target"), field_value(message, "provider")), F.lit(""))


def actor_from_operation(operation_id: Column) -> Column:
    return F.when(F.instr(operation_id, "-") > 1, F.substring_index(operation_id, "-", 1))


def decision(event_type: Column, action: Column, message: Column) -> Column:
    """granted, sealed, denied, or null for events that decide nothing."""
    n = {k: F.coalesce(numeric_field(message, k), F.lit(0)) for k in ("blocked", "replacements", "tokenized", "detections")}
    request = F.when(n["blocked"] > 0, "denied").when((n["replacements"] > 0) | (n["tokenized"] > 0) | (n["detections"] > 0), "sealed").otherwise("granted")
    policy = F.when(action == "allow", "granted").when(action.isin("tokenize", "redact"), "sealed").when(action == "block", "denied")
    return F.when(
        action.isNotNull(),
        F.when(event_type == "policy_decision", policy)
        .when(event_type == "consent", "granted")
        .when(event_type == "redaction", "sealed")
        .when((event_type == "proxy_forward") & (action == "request_protection"), request)
        .when((event_type == "proxy_failure") & (action == "provider_down"), "denied"),
    )


def event_kind(kind: Column, event_type: Column, action: Column) -> Column:
    named = F.when((event_type == "proxy_forward") & (action == "request_protection"), "request").when((event_type == "proxy_failure") & (action == "provider_down"), "provider")
    return F.coalesce(kind, named, F.lit("unknown"))


def severity(level: Column) -> Column:
    return F.when(F.lower(level) == "error", "error").when(F.lower(level).isin("warn", "warning"), "warn").otherwise("info")


def module(event_type: Column) -> Column:
    return F.substring_index(event_type, "_", 1)


def consent_status(revoked_at: Column, expires_at: Column, now: Column) -> Column:
    return F.when(revoked_at.isNotNull(), "revoked").when(expires_at <= now, "expired").otherwise("active")


def legacy_message(**parts: Column | None) -> Column:
    """A message for rows of the old event table, from those of its columns that exist."""
    text = F.lit("event of an older log, its raw preview left out")
    for name, column in parts.items():
        if column is not None:
            text = F.concat(text, F.lit(f"; {name}="), F.coalesce(column, F.lit("")))
    return text


# Hosts and requests


def normalize_host(host: Column) -> Column:
    """The bare lower-case host of a host, host:port, [IPv6]:port or URL."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(host), r"\.+$", ""), "^(?:https|http|wss|ws)://", "")
    before_path = F.substring_index(bare, "/", 1)
    bracketed = before_path.rlike(r"^\[[^\]]*\]")
    return F.lower(F.when(bracketed, F.regexp_extract(before_path, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(before_path, ":", 1)))


def normalize_route_host(host: Column) -> Column:
    """The narrower form for configured upstreams: http and https only, no IPv6, dots kept."""
    return F.lower(F.substring_index(F.substring_index(F.regexp_replace(F.trim(host), "^https?://", ""), "/", 1), ":", 1))


def pattern_path(pattern: Column) -> Column:
    """/path of a URL pattern, null where it has none."""
    rest = F.regexp_extract(F.regexp_replace(pattern, "^(?:https|http|wss|ws)://", ""), r"^[^/]*/(.+)$", 1)
    return F.when(rest != "", F.concat(F.lit("/"), rest))


def is_event_stream(content_type: Column) -> Column:
    return F.coalesce(F.exists(F.split(content_type, ";"), lambda p: F.lower(F.trim(p)) == "text/event-stream"), F.lit(False))


def unsupported_encoding(encoding: Column) -> Column:
    """Some token other than identity is named."""
    tokens = F.filter(F.transform(F.split(encoding, ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    return F.coalesce(F.exists(tokens, lambda p: p != "identity"), F.lit(False))


def acceptable_body(size: Column, encoding: Column, most: int = 32 << 20) -> Column:
    """Bodies that may be rewritten: not too long, and not encoded."""
    return F.coalesce(size <= most, F.lit(True)) & ~unsupported_encoding(encoding)


def csv_list(value: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: p != ""))


def render_template(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return template


def protection_enabled(state: Column) -> Column:
    """The JSON boolean ``enabled``, else the old text form; on where neither says off."""
    flag = F.try_variant_get(F.try_parse_json(state), "$.enabled", "string")
    typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(state), "$.enabled", "variant")) == "BOOLEAN"
    old = F.coalesce(F.lower(F.regexp_replace(state, r"^\s+|\s+$", "")) != "disabled", F.lit(True))
    return F.when(F.coalesce(typed, F.lit(False)), flag == "true").otherwise(old)


def route_readiness(known: Column, protocol: Column) -> Column:
    """What a transparent route needs: TLS protocols must be intercepted first."""
    return F.when(~known, "unknown").when(protocol.isin("https", "web_socket"), "requires_interception").otherwise("protectable")


def capture_readiness(mode: Column, system_proxy: Column, tun: Column) -> Column:
    return (
        F.when(mode == "explicit_proxy", "ready")
        .when(mode == "system_proxy", F.when(system_proxy, "ready").otherwise("needs_system_proxy_install"))
        .when(mode == "tun", F.when(tun, "ready").otherwise("needs_tun_install"))
    )


def first_gap(*gates: tuple[Column, str]) -> Column:
    """The name of the first gate that is not passed, else ready."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in gates], F.lit("ready"))


def trust_readiness(known: Column, plain: Column, enabled: Column, host_allowed: Column, consented: Column, installed: Column) -> Column:
    """Whether traffic of a route may be opened: a known route that is not readable as it is, and then the gates in order."""
    gates = first_gap((enabled, "disabled"), (host_allowed, "host_not_allowed"), (consented, "needs_user_consent"), (installed, "needs_local_ca"))
    return F.when(~known, "not_ai_traffic").when(plain, "not_required").otherwise(gates)


def interception_readiness(routing: Column, consented: Column, trust: Column, adapter: Column) -> Column:
    """From a route's capture readiness, the user's consent, its trust readiness and whether an adapter runs."""
    captured = first_gap((routing == "ready", "needs_routing"), (consented, "needs_user_consent"), (trust == "ready", "needs_trust"), (adapter, "needs_adapter"))
    return F.when(routing == "not_transparent_mode", "not_transparent_mode").otherwise(captured)


def auth_decision(provider: Column, target_key: Column, key_env: Column, caller_key: Column) -> Column:
    return (
        F.when(provider == "generic", "passthrough")
        .when(F.coalesce(target_key, F.lit(False)), "target")
        .when(key_env.isNotNull() & ~F.coalesce(caller_key, F.lit(False)), "config_required")
        .otherwise("passthrough")
    )


def connect_state(daemon: Column, plan: Column, enabled: Column) -> Column:
    """From the daemon (connected, stale, disconnected), the setup plan's state and the protection flag."""
    running = F.when(plan == "blocked", "degraded").when(plan == "needs_action", "needs_setup").when(enabled, "protected").otherwise("paused")
    stopped = F.when(plan.isin("needs_action", "blocked"), "needs_setup").otherwise("disconnected")
    return F.when(daemon == "connected", running).when(daemon == "stale", "degraded").otherwise(stopped)


def reference_id(salt: str, kind: Column, value: Column, *more: Column) -> Column:
    """A stable 22-character reference id, always one of 16 bytes.

    Digits are drawn from a salted sha256; the first is kept within 2..X, so
    the number lies between 58^21 and 2^128. Retried tasks give the same id.
    The salt keeps ids of different vaults apart and must stay secret.
    """
    zero = F.lit("\x1f")
    h = F.sha2(F.concat(F.lit(salt), zero, kind, zero, value, *[x for m in more for x in (zero, m.cast("string"))]), 256)
    alphabet = F.lit(BASE58)

    def spell(h: Column) -> Column:
        def digit(i: Column) -> Column:
            n = F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
            return F.substring(alphabet, F.when(i == 0, n % 30 + 2).otherwise(n % 58 + 1), F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(21)), digit), "")

    return let(h, spell)
