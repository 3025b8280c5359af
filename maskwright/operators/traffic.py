"""Traffic observations matched with app rules, and routes to targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn

APP = "struct<id:string,enabled:boolean,priority:int,match:struct<domains:array<string>,ips:array<string>,urls:array<string>,ports:array<int>,protocols:array<string>,process_names:array<string>>,action:string,adapter:string,provider:string,target_name:string,upstream:string>"
PROFILE = f"version int, name string, default_action string, apps array<{APP}>"


def domain_matches(pattern: Column, host: Column) -> Column:
    """Equal, or below the suffix of a ``*.suffix`` or ``.suffix`` pattern; both normalised before."""
    suffix = F.regexp_replace(pattern, r"^\*?\.", "")
    wide = pattern.startswith("*.") | pattern.startswith(".")
    below = (host == suffix) | host.endswith(F.concat(F.lit("."), suffix))
    return (pattern != "") & (host != "") & F.when(wide, below).otherwise(pattern == host)


def url_matches(pattern: Column, host: Column, path: Column) -> Column:
    """A path prefix, or a host with an optional path prefix."""
    trimmed = F.trim(pattern)
    starts = lambda p: F.coalesce(path.startswith(p), F.lit(False))
    own_path = fn.pattern_path(trimmed)
    whole = domain_matches(fn.normalize_host(trimmed), host) & F.when(own_path.isNull(), F.lit(True)).otherwise(starts(own_path))
    return F.when(trimmed == "", F.lit(False)).when(trimmed.startswith("/"), starts(trimmed)).otherwise(whole)


def rule_matches(rule: Column, seen: Column) -> Column:
    """All six filters of a rule (empty: passes) on an observation; a rule without any filter matches nothing."""
    host = seen["host"]
    free = lambda name: F.coalesce(F.size(rule[name]), F.lit(0)) == 0
    some = lambda name, test: free(name) | F.coalesce(F.exists(rule[name], test), F.lit(False))
    names = ("domains", "ips", "urls", "ports", "protocols", "process_names")
    empty = F.lit(True)
    for name in names:
        empty = empty & free(name)
    return (
        ~empty
        & some("domains", lambda d: domain_matches(fn.normalize_host(d), host))
        & some("ips", lambda i: fn.normalize_host(i) == host)
        & some("urls", lambda u: url_matches(u, host, seen["path"]))
        & some("ports", lambda p: p == seen["port"])
        & some("protocols", lambda p: p == seen["protocol"])
        & some("process_names", lambda p: F.lower(p) == F.lower(seen["process_name"]))
    )


def observations(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, path, port and protocol read from URLs."""
    url = F.col(url_col)
    port = F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://[^/\]]*?(?:\[[^\]]*\])?:([0-9]+)(?:/|$)", 1), F.lit("")).try_cast("int")
    return df.withColumn("host", fn.normalize_host(url)).withColumn("path", fn.pattern_path(url)).withColumn("port", port).withColumn("protocol", F.lower(F.regexp_extract(url, "^([a-zA-Z]+)://", 1))).withColumn("process_name", F.lit(None).cast("string"))


def decide(seen: DataFrame, rules: list[dict], default: str, enabled: set[str] | None = None) -> DataFrame:
    """Adds app_id and action of the matching rule with the highest priority, the last of equals; else the default.

    ``rules`` are an operator's configuration, validated by `check_rules`; they
    become one expression over each row, so observations are neither joined
    nor shuffled. With ``enabled`` only the enabled rules that it names apply.
    """
    observed = F.struct("host", "path", "port", "protocol", "process_name")
    chosen = F.lit(None).cast("struct<app_id:string,action:string>")
    for _, rule in sorted(enumerate(rules), key=lambda x: (x[1]["priority"], x[0])):
        if not rule.get("enabled", True) or (enabled is not None and rule["id"] not in enabled):
            continue
        kinds = {"ports": "int"}
        match = F.struct(*[F.array(*[F.lit(v) for v in rule["match"].get(k, [])]).cast(f"array<{kinds.get(k, 'string')}>").alias(k) for k in ("domains", "ips", "urls", "ports", "protocols", "process_names")])
        chosen = F.when(rule_matches(match, observed), F.struct(F.lit(rule["id"]).alias("app_id"), F.lit(rule["action"]).alias("action"))).otherwise(chosen)
    return seen.withColumn("__c", chosen).withColumn("app_id", F.col("__c.app_id")).withColumn("action", F.coalesce("__c.action", F.lit(default))).drop("__c")


def _wide_or_exact(pattern: Column) -> Column:
    """The key of a normalised domain pattern: a suffix, or a whole host."""
    wide = pattern.startswith("*.") | pattern.startswith(".")
    return F.struct(F.when(wide, "suffix").otherwise("host").alias("by"), F.regexp_replace(pattern, r"^\*?\.", "").alias("key"))


def _path_key(prefix: Column) -> Column:
    """As much of a path prefix as the largest power of two in its length."""
    size = F.pow(F.lit(2), F.floor(F.log2(F.length(prefix)))).cast("int")
    return F.struct(F.lit("path").alias("by"), F.left(prefix, size).alias("key"))


def rule_keys(match: Column) -> Column:
    """array<struct<by, key>>: one of these keys is among those of any observation that the rule matches.

    They come from the rule's most telling filter; a rule without any has none.
    """
    some = lambda name: F.coalesce(F.size(match[name]), F.lit(0)) > 0
    plain = lambda by, key: F.struct(F.lit(by).alias("by"), key.alias("key"))

    def of_url(url: Column) -> Column:
        return fn.let(F.trim(url), lambda u: F.when(u.startswith("/"), _path_key(u)).otherwise(_wide_or_exact(fn.normalize_host(u))))

    return (
        F.when(some("ips"), F.transform(match["ips"], lambda x: plain("host", fn.normalize_host(x))))
        .when(some("domains"), F.transform(match["domains"], lambda x: fn.let(fn.normalize_host(x), _wide_or_exact)))
        .when(some("urls"), F.transform(match["urls"], of_url))
        .when(some("process_names"), F.transform(match["process_names"], lambda x: plain("process", F.lower(x))))
        .when(some("ports"), F.transform(match["ports"], lambda x: plain("port", x.cast("string"))))
        .when(some("protocols"), F.transform(match["protocols"], lambda x: plain("protocol", x)))
    )


def observation_keys(seen: Column) -> Column:
    """All keys under which a rule that matches the observation may stand: a few for its labels, path and other fields."""
    plain = lambda by, key: F.struct(F.lit(by).alias("by"), key.alias("key"))
    labels = F.split(seen["host"], r"\.")
    suffixes = fn.let(labels, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: plain("suffix", F.array_join(F.slice(p, i, F.size(p)), "."))))
    path = F.coalesce(seen["path"], F.lit(""))
    sizes = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.length(path), F.lit(1)))).cast("int"))
    prefixes = F.when(path != "", F.transform(sizes, lambda k: plain("path", F.left(path, F.pow(F.lit(2), k).cast("int")))))
    others = F.array(plain("host", seen["host"]), plain("process", F.lower(seen["process_name"])), plain("port", seen["port"].cast("string")), plain("protocol", seen["protocol"]))
    none = F.array().cast("array<struct<by:string,key:string>>")
    return F.filter(F.concat(F.coalesce(suffixes, none), F.coalesce(prefixes, none), others), lambda k: k["key"].isNotNull())


def decide_by_table(seen: DataFrame, rules: DataFrame, default: str, enabled: DataFrame | None = None) -> DataFrame:
    """`decide` with the rules as a table (id, enabled, priority, ordinal, match, action), however many they are.

    Each rule stands under the keys of its most telling filter, each distinct
    observation under a few keys of its own; the two are joined on equal keys,
    and the rules met are tested whole. Of rules with equal filters under one
    key only the winner is kept. ``enabled`` (column id) restricts the rules.
    """
    live = rules.where(F.coalesce("enabled", F.lit(True)))
    live = live if enabled is None else live.join(enabled.select("id").distinct(), "id", "left_semi")
    keyed = live.select(F.struct("priority", "ordinal", "id", "action").alias("win"), "match", F.explode(F.array_distinct(rule_keys(F.col("match")))).alias("k"))
    table = keyed.groupBy("k.by", "k.key", F.to_json("match").alias("filters")).agg(F.max("win").alias("win"), F.first("match").alias("match"))

    fields = ("host", "path", "port", "protocol", "process_name")
    observed = seen.withColumn("__o", F.struct(*fields)).withColumn("__k", F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))
    distinct = observed.groupBy("__k").agg(F.first("__o").alias("o"))
    probes = distinct.select("__k", "o", F.explode(F.array_distinct(observation_keys(F.col("o")))).alias("k")).select("__k", "o", "k.by", "k.key")
    met = probes.join(table, ["by", "key"]).where(rule_matches(F.col("match"), F.col("o")))
    chosen = met.groupBy("__k").agg(F.max("win").alias("__w"))
    done = observed.join(chosen, "__k", "left")
    return done.select(*seen.columns, F.col("__w.id").alias("app_id"), F.coalesce("__w.action", F.lit(default)).alias("action"))


def check_rules(rules: list[dict], enabled: set[str] | None = None) -> list[str]:
    """What is wrong with a profile's rules; empty if nothing is."""
    found, ids = [], [r.get("id", "") for r in rules]
    found += ["an app has no id"] if any(not str(i).strip() for i in ids) else []
    found += [f"app id {i} is used twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for r in rules:
        if r.get("action") == "inspect":
            found += [] if any(r.get("match", {}).values()) else [f"app {r['id']} inspects without a rule"]
            found += [f"app {r['id']} inspects without {k}" for k in ("provider", "upstream") if not r.get(k)]
    return found + [f"enabled app {i} does not exist" for i in sorted((enabled or set()) - set(ids))]


def problems(rules: DataFrame, enabled: DataFrame | None = None) -> DataFrame:
    """`check_rules` for rules as a table: one row (problem, app_id) for each thing that is wrong."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    names = ("domains", "ips", "urls", "ports", "protocols", "process_names")
    filters = sum((F.coalesce(F.size(F.col("match")[n]), F.lit(0)) for n in names), F.lit(0))
    said = lambda df, what: df.select(F.lit(what).alias("problem"), F.col("id").alias("app_id"))
    inspects = rules.where("action = 'inspect'")
    found = said(rules.where(blank("id")), "no id").unionByName(said(rules.groupBy("id").count().where("count > 1"), "id used twice"))
    found = found.unionByName(said(inspects.where(F.coalesce(filters, F.lit(0)) == 0), "inspects without a rule"))
    for column in ("provider", "upstream"):
        found = found.unionByName(said(inspects.where(F.coalesce(F.col(column) == "", F.lit(True))), f"inspects without {column}"))
    return found if enabled is None else found.unionByName(said(enabled.select("id").distinct().join(rules, "id", "left_anti"), "enabled app does not exist"))


def distinct_routes(routes: DataFrame) -> DataFrame:
    """(host, ..., ordinal): one route a host, the last one's values at the first one's place."""
    rest = [c for c in routes.columns if c not in ("host", "ordinal")]
    last = F.max_by(F.struct(*rest), "ordinal")
    return routes.groupBy("host").agg(last.alias("r"), F.min("ordinal").alias("ordinal")).select("host", "r.*", "ordinal")


def distinct_targets(targets: DataFrame) -> DataFrame:
    """The first of each (name, provider, upstream)."""
    return targets.groupBy("name", "provider", "upstream").agg(F.min("ordinal").alias("ordinal"))


def route_of(seen: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds the first route of each observation's host; routes are deduplicated, so no row is repeated."""
    rest = [c for c in routes.columns if c not in ("host", "ordinal")]
    first = routes.groupBy(fn.normalize_host(F.col("host")).alias("host")).agg(F.min_by(F.struct(*rest), "ordinal").alias("route"))
    return seen.join(first, "host", "left").select(*seen.columns, F.col("route").isNotNull().alias("known"), "route.*")


def choose_target(requests: DataFrame, targets: list[dict]) -> DataFrame:
    """Adds target: the first of the hinted provider with the hinted name or upstream host, else of the provider, else the first of all."""
    exact = by_provider = F.lit(None).cast("string")
    for t in reversed(targets):
        host = fn.normalize_route_host(F.lit(t["upstream"]))
        mine = F.coalesce(F.col("provider_hint") == t["provider"], F.lit(False))
        near = F.coalesce(F.col("name_hint") == t["name"], F.lit(False)) | F.coalesce(fn.normalize_route_host(F.col("host")) == host, F.lit(False))
        exact = F.when(mine & near, F.lit(t["name"])).otherwise(exact)
        by_provider = F.when(mine, F.lit(t["name"])).otherwise(by_provider)
    return requests.withColumn("target", F.coalesce(exact, by_provider, F.lit(targets[0]["name"] if targets else None).cast("string")))


def choose_target_by_table(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """`choose_target` with the targets as a table (name, provider, upstream, ordinal): three joins on keys that targets hold once."""
    first = F.min(F.struct("ordinal", "name"))
    held = targets.withColumn("__host", fn.normalize_route_host(F.col("upstream")))
    by_name = held.groupBy(F.col("provider").alias("provider_hint"), F.col("name").alias("name_hint")).agg(first.alias("__n"))
    by_host = held.groupBy(F.col("provider").alias("provider_hint"), "__host").agg(first.alias("__h"))
    by_provider = held.groupBy(F.col("provider").alias("provider_hint")).agg(first.alias("__p"))
    top = held.agg(first.alias("t")).first()["t"]
    joined = requests.withColumn("__host", fn.normalize_route_host(F.col("host"))).join(by_name, ["provider_hint", "name_hint"], "left").join(by_host, ["provider_hint", "__host"], "left").join(by_provider, "provider_hint", "left")
    near = F.least(F.col("__n"), F.col("__h"))
    return joined.select(*requests.columns, F.coalesce(near["name"], F.col("__p.name"), F.lit(top["name"] if top else None).cast("string")).alias("target"))


def missing_targets(routes: DataFrame, targets: DataFrame) -> DataFrame:
    """Routes whose (name, provider, upstream) no target has."""
    return routes.join(targets, ["name", "provider", "upstream"], "left_anti")


def upsert_profiles(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Stored profiles take the place of bundled ones with their id, or follow them (order in column ordinal)."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in (id_col, "ordinal")]
    return both.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.struct("__new", "ordinal")).alias("p"), F.min(F.struct("__new", "ordinal")).alias("o")).select(id_col, "p.*", (F.col("o.__new") * 1_000_000 + F.col("o.ordinal")).alias("ordinal"))


def traffic_apps(profile_ids: DataFrame, profiles: DataFrame) -> DataFrame:
    """(app_id, ordinal): the apps of the chosen profiles, each once, in order of first mention."""
    rows = profile_ids.join(profiles, "id").select("ordinal", F.posexplode("traffic_app_ids").alias("pos", "app_id"))
    first = rows.groupBy("app_id").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    return first.select("app_id", F.row_number().over(Window.orderBy("at")).alias("ordinal"))  # a handful of apps


def canonical_profiles(enabled: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, ordinal): enabled ids with aliases (alias, id) replaced, many to one or to none (null), each once at its first place."""
    named = enabled.join(aliases.select(F.col("alias").alias("id"), F.col("id").alias("to"), F.lit(True).alias("known")), "id", "left")
    return named.select(F.when(F.col("known"), F.col("to")).otherwise(F.col("id")).alias("id"), "ordinal").where("id IS NOT NULL").groupBy("id").agg(F.min("ordinal").alias("ordinal"))


def enabled_profiles(from_file: Column, active: Column, default: Column) -> Column:
    """The enabled list of the state file, else the active profile alone, else the default."""
    return F.coalesce(from_file, F.when(active.isNotNull(), F.array(active)), default)


def readiness(routes: DataFrame, trust: DataFrame) -> DataFrame:
    """Routes and trust states, both by position (column ordinal), side by side: ordinal, routing and trust columns, readiness.

    Routes of one host keep their own state, as positions pair them.
    """
    rows = routes.join(trust, "ordinal")
    return rows.withColumn("readiness", fn.interception_readiness(F.col("routing"), F.col("consented"), F.col("trust"), F.col("adapter")))
