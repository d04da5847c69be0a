"""What events mean: names, families, protocols and where they come from, by ordered rules over text and attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents as D
from .text import any_of, first_case, not_negated, semantic_name

#: Names and values that the rules below use (fixed values).
PLACEHOLDERS = ("error", "event", "exception", "failure", "info", "log", "message", "none", "unknown", "warning")
WEAK = ("event", "info", "warning", "unknown")
FAMILIES = {
    "auth_failure": "authentication", "config_error": "configuration", "connection_reset": "network", "dependency_unreachable": "dependency", "dns_failure": "network", "http_5xx": "dependency", "instrumentation_mismatch": "observability",
    "missing_command": "configuration", "missing_file": "configuration", "monitoring_gap": "observability", "oom": "resource", "permission_denied": "authentication", "process_exit": "runtime", "restart_loop": "runtime",
    "service_start_failure": "runtime", "state_mismatch": "state", "timeout": "dependency",
}
FAMILY_TERMS = (
    ("network", ("tls", "ssl", "certificate", "dns", "socket", "tcp", "udp", "network", "connection_reset")),
    ("datastore", ("sql", "database", "postgres", "mysql", "sqlite", "redis")),
    ("authentication", ("auth", "credential", "permission", "forbidden", "unauthorized")),
    ("configuration", ("config", "missing_file", "missing_command", "schema")),
    ("resource", ("memory", "cpu", "disk", "quota", "oom", "resource")),
    ("runtime", ("process", "restart", "systemd", "kubernetes", "crashloop", "service_start")),
    ("observability", ("monitor", "metric", "heartbeat", "freshness", "instrumentation", "telemetry")),
    ("scheduler", ("scheduler", "scheduled", "cron", "job", "queue")),
    ("dependency", ("timeout", "deadline", "unreachable", "upstream", "dependency", "grpc", "http_5xx")),
)


def success_code(code: Column) -> Column:
    n = F.regexp_extract(code, r"^\D*(\d{1,3})\D*$", 1).try_cast("int")
    return F.when(n.isNull(), F.lower(code).isin("ok", "success", "successful")).otherwise((n == 0) | n.between(100, 399))


def generic_name(m: Column, t: Column, s: Column, server_error: Column) -> Column:
    """The name of an event by the first rule that its text meets; else by its severity. m: the message, t: with what its
    attributes say, s: the severity, all in lower case; server_error: whether a status among them is 5xx."""
    has = lambda *terms: any_of(t, terms)
    nothing = has("no such file or directory")
    return first_case([
        ("missing_command", nothing & has("can't open file", "execstart", "executable", "command", ".service", ".py", ".sh")), ("missing_file", nothing), ("missing_command", has("command not found", "executable file not found")),
        ("permission_denied", has("permission denied", "operation not permitted", "access denied")), ("service_start_failure", has("failed with result 'exit-code'", "failed to start", "main process exited")),
        ("restart_loop", has("start request repeated too quickly", "restart loop", "crashloop", "back-off restarting")), ("process_exit", has("process exited", "exited with status", "exit status")), ("connection_reset", has("connection reset")),
        ("http_5xx", F.contains(m, F.lit("http 5")) | m.rlike(r"\b(?:status|status_code|http_status|response_status)\s*[=:]\s*5\d\d\b") | server_error), ("timeout", not_negated(t, ("timed out", "timeout", "deadline exceeded"))),
        ("dns_failure", has("temporary failure in name resolution") | has("dns") & has("failure", "failed", "nxdomain")), ("auth_failure", has("unauthorized", "forbidden", "authentication failed", "authorization failed", "invalid credentials")),
        ("config_error", has("invalid config", "configuration error", "config_error", "bad configuration")), ("dependency_unreachable", has("connection refused", "unreachable", "no route to host", "upstream unavailable")),
        ("oom", not_negated(t, ("memory cgroup out of memory", "out of memory", "oom"))), ("state_mismatch", has("state mismatch", "status mismatch", "expected state", "actual state", "contradicts", "healthy but")),
        ("monitoring_gap", has("no logs received", "log gap", "metric missing", "metrics missing", "heartbeat missing", "freshness gap", "stale data", "no samples")),
        ("instrumentation_mismatch", has("instrumentation mismatch", "schema mismatch", "parser failed", "parse failed", "missing label", "missing metric label", "unknown field")),
        ("warning", s.isin("warn", "warning")), ("info", s.isin("trace", "debug", "info", "notice")),
    ], F.lit("unknown"))


def protocol(t: Column, keys: Column) -> Column:
    """t: the message with what its attributes say, in lower case; keys: the names of attributes."""
    key = lambda *ks: F.arrays_overlap(keys, F.array(*map(F.lit, ks)))
    has = lambda *terms: any_of(t, terms)
    return first_case([
        ("tls", has("tls", "ssl", "x509", "certificate")), ("grpc", has("grpc") | key("grpc_status")), ("dns", has("dns", "nxdomain")), ("http", key("http_status", "status_code", "response_status") | t.rlike(r"\bhttp(?:/\d(?:\.\d)?)?\b")),
        ("sql", key("sqlstate") | has("postgres", "mysql", "sqlite", "sqlstate")), ("systemd", has("systemd", ".service")), ("kubernetes", has("kubernetes", "k8s", "pod", "crashloop")), ("network", has("tcp", "udp", "socket", "connection reset", "connection refused")),
    ], F.lit(""))


def family(t: Column, name: Column) -> Column:
    """The family of a name, or else by the first terms in t, the name with its protocol and message in lower case."""
    known = F.lit(None).cast("string")
    for k, v in FAMILIES.items():
        known = F.when(name == k, F.lit(v)).otherwise(known)
    return F.coalesce(known, first_case([(f, any_of(t, terms)) for f, terms in FAMILY_TERMS], F.lit("general")))


def classified(events: DataFrame) -> DataFrame:
    """events (message, severity, attributes as JSON, template) with event_name, event_family, protocol, error_code,
    exception_class, template_fingerprint, and from what and how surely the name was taken.

    Attributes are parsed once for each different text of a batch, and the ladders below read columns: the lower-cased
    texts are not built again in each of their branches."""
    e = events.withColumn("__a", D.attribute_facts(F.col("attributes")))
    e = e.withColumns({
        "error_code": F.col("__a.code"), "exception_class": F.col("__a.thrown"), "__explicit": F.col("__a.explicit"), "__family": F.col("__a.family"), "__error": F.col("__a.server_error"), "__keys": F.col("__a.keys"),
        "__m": F.lower("message"), "__t": F.lower(F.concat_ws(" ", "message", F.nullif("__a.said", F.lit("")))), "__s": F.lower(F.trim("severity")), "template_fingerprint": F.concat(F.lit("tmpl-"), F.substring(F.sha2("template", 256), 1, 16)),
    }).drop("__a")
    e = e.withColumns({"protocol": protocol(F.col("__t"), F.col("__keys")), "__generic": generic_name(F.col("__m"), F.col("__t"), F.col("__s"), F.col("__error"))})
    said = (F.col("__explicit") != "") & ~F.col("__explicit").isin(*PLACEHOLDERS)
    thrown, strong = F.col("exception_class") != "", ~F.col("__generic").isin(*WEAK)
    coded = (F.col("error_code") != "") & ~success_code(F.col("error_code"))
    of = lambda name, source, sure: F.struct(name.alias("name"), source.alias("source"), F.lit(sure).alias("sure"))
    field, rule = F.lit("structured_field"), F.when(F.col("protocol") != "", "generic_protocol").otherwise("generic_rule")
    pick = (
        F.when(said, of(F.col("__explicit"), field, 0.98)).when(thrown, of(F.col("exception_class"), field, 0.96)).when(strong, of(F.col("__generic"), rule, 0.9))
        .when(coded, of(F.concat(F.lit("error_code_"), semantic_name(F.col("error_code"))), field, 0.9)).otherwise(of(F.col("__generic"), F.lit("template_fingerprint"), 0.55))
    )
    e = e.withColumn("__pick", pick).withColumn("event_name", F.col("__pick.name"))
    e = e.withColumn("__f", F.lower(F.concat_ws(" ", "event_name", "protocol", "message")))
    own = F.when(F.col("__family") != "", F.col("__family")).otherwise(family(F.col("__f"), F.col("event_name")))
    return e.withColumns({"event_family": own, "classification_source": F.col("__pick.source"), "confidence": F.col("__pick.sure")}).drop("__pick", "__explicit", "__generic", "__family", "__error", "__keys", "__m", "__t", "__s", "__f")


def overridden(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Classified events renamed by the first enabled rule of a trusted profile of which all conditions hold.

    rules: place, enabled, trust, term (in the message; null: any), protocol, family (null: any), event_name, event_family.
    There are few: they go along as one array, of which each event takes the first that it meets."""
    live = rules.where(F.col("enabled") & F.col("trust").isin("human_approved", "packaged_allowlist"))
    listed = live.agg(F.sort_array(F.collect_list(F.struct("place", "term", F.col("protocol").alias("r_protocol"), F.col("family").alias("r_family"), F.col("event_name").alias("r_name"), F.col("event_family").alias("r_new")))).alias("__rules"))
    free = lambda wanted, holds: wanted.isNull() | holds
    e = events.withColumn("__m", F.lower("message")).crossJoin(F.broadcast(listed))  # one row
    met = F.filter("__rules", lambda r: free(r["term"], F.contains(F.col("__m"), r["term"])) & free(r["r_protocol"], r["r_protocol"] == F.col("protocol")) & free(r["r_family"], r["r_family"] == F.col("event_family")))
    e = e.withColumn("__x", F.get(met, 0))
    return e.withColumns({
        "classification_source": F.when(F.col("__x").isNotNull(), "profile_rule").otherwise(F.col("classification_source")),
        "event_family": F.coalesce("__x.r_new", "event_family"), "event_name": F.coalesce("__x.r_name", "event_name"),
    }).drop("__x", "__m", "__rules")


#: Fields that a profile's rules may name, and trusts that count (fixed values).
RULE_FIELDS = ("event_name", "event_family", "component", "subsystem", "source", "protocol", "error_code", "exception_class")
RULE_TRUSTS = ("human_approved", "packaged_allowlist")


def profile_matched(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Classified events with profile_rule, and the name and family that it gives: of the first enabled rule of a trusted
    profile of which all conditions hold.

    rules: place, rule_id, enabled, trust, equals (map of a field of RULE_FIELDS to the values that it may have, made uniform
    as names), contains_all and contains_any (terms in template, message, name, component and source; null: no such
    condition, empty: never met), event_name, event_family (null: as it was). A rule without conditions is never met.
    Fields that events lack are empty, and equal nothing. Rules are few and go along as one array."""
    live = rules.where(F.col("enabled") & F.col("trust").isin(*RULE_TRUSTS))
    live = live.select("place", "rule_id", F.transform_values("equals", lambda _, v: F.transform(v, semantic_name)).alias("equals"), *[F.transform(c, lambda x: F.lower(x)).alias(c) for c in ("contains_all", "contains_any")], F.col("event_name").alias("r_name"), F.col("event_family").alias("r_family"))
    order = live.select(F.struct("place", "rule_id").alias("at"), F.struct("rule_id", F.map_entries("equals").alias("equals"), "contains_all", "contains_any", "r_name", "r_family").alias("rule"))
    listed = order.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "rule")), lambda a, b: F.when(a["at"] < b["at"], -1).otherwise(1)), lambda x: x["rule"]).alias("__rules"))
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in events.columns else F.lit("")
    own = F.create_map(*[x for c in RULE_FIELDS for x in (F.lit(c), semantic_name(have(c)))])
    text = F.lower(F.concat_ws(" ", *[have(c) for c in ("template", "message", "event_name", "component", "source")]))
    e = events.withColumns({"__own": own, "__text": text}).crossJoin(F.broadcast(listed))  # one row

    def holds(r: Column) -> Column:
        field = F.forall(r["equals"], lambda x: (F.col("__own")[x["key"]] != "") & F.array_contains(x["value"], F.col("__own")[x["key"]]))
        every = r["contains_all"].isNull() | ((F.size(r["contains_all"]) > 0) & F.forall(r["contains_all"], lambda t: F.contains(F.col("__text"), t)))
        some = r["contains_any"].isNull() | F.exists(r["contains_any"], lambda t: F.contains(F.col("__text"), t))
        return ((F.size(r["equals"]) > 0) | r["contains_all"].isNotNull() | r["contains_any"].isNotNull()) & field & every & some

    e = e.withColumn("__x", F.get(F.filter("__rules", holds), 0))
    return e.withColumns({
        "profile_rule": F.col("__x.rule_id"), "classification_source": F.when(F.col("__x").isNotNull(), "profile_rule").otherwise(F.col("classification_source")),
        "event_family": F.coalesce("__x.r_family", "event_family"), "event_name": F.coalesce("__x.r_name", "event_name"),
    }).drop("__own", "__text", "__rules", "__x")


#: What a generic message is completed with, in this order (fixed values).
SEMANTIC_KEYS = ("schema", "original_service", "action", "event_class", "state", "status", "result", "outcome", "sample_reason", "reason", "failure_reason", "error_type", "exception_type", "error", "phase", "health", "healthy", "ok", "connected", "changed", "triggered")


def enriched(message: Column, service: Column, first: Column) -> Column:
    """A message that says nothing, with the service and up to seven attributes that say something behind it. first: the
    first value of each attribute, a map (see documents.attribute_facts)."""
    said = lambda k: F.coalesce(F.try_element_at(first, F.lit(k)), F.lit(""))
    generic = F.lower(F.trim(message)).rlike(r"^(?:event|log|message|record|entry)(?:\s+[a-z0-9_.-]+=[^\s]+)*$")
    have = lambda k: F.contains(F.concat(F.lit(" "), F.lower(message)), F.lit(f" {k}="))
    empty = ("", "unknown", "none", "null", "n/a", "na")
    value = lambda c: F.substring(F.regexp_replace(c, "/", ":"), 1, 120)
    tokens = [F.when(~have("service") & ~F.lower(service).isin(*empty), F.concat(F.lit("service="), value(service)))]
    tokens += [F.when(~have(k) & ~F.lower(said(k)).isin(*empty), F.concat(F.lit(f"{k}="), value(said(k)))) for k in SEMANTIC_KEYS]
    more = F.array_join(F.slice(F.array_compact(F.array(*tokens)), 1, 8), " ")
    return F.when(generic, F.substring(F.trim(F.concat_ws(" ", message, more)), 1, 500)).otherwise(message)


#: Targets of event names (fixed values).
EVENT_TARGETS = {
    "missing_file": "job_configuration_mismatch", "missing_command": "job_configuration_mismatch", "permission_denied": "state_mismatch", "service_start_failure": "service_start_failure", "restart_loop": "restart_loop", "process_exit": "restart_loop",
    "timeout": "external_dependency_failure", "connection_reset": "network_error_signal", "dns_failure": "network_error_signal", "auth_failure": "external_dependency_failure", "config_error": "job_configuration_mismatch",
    "dependency_unreachable": "external_dependency_failure", "http_5xx": "user_impact_signal_gap", "oom": "resource_pressure", "state_mismatch": "state_mismatch", "monitoring_gap": "monitoring_gap", "instrumentation_mismatch": "instrumentation_mismatch",
}
SEVERITY_NUMBERS = {"trace": 1, "debug": 5, "info": 9, "notice": 10, "warn": 13, "warning": 13, "error": 17, "critical": 21, "alert": 22, "emergency": 23, "fatal": 24}


def looked_up(values: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


ITEM_KEY = ("event_name", "severity", "template", "component", "source_system", "error_code", "exception_class")


def item_stats(events: DataFrame, keys: Sequence[str] = ITEM_KEY) -> DataFrame:
    """One row for each of the seven-part keys: counts, times, the earliest example, and how many traces."""
    first = F.struct("ts", "event_id")
    return events.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("message", first).alias("example"), F.countDistinct(F.sha2("trace_id", 256)).alias("traces"), F.min_by("event_family", first).alias("event_family"), F.min_by("template_fingerprint", first).alias("template_fingerprint")
    )


def in_closed_window(events: DataFrame, start: str, end: str, keep_inferred: bool = True) -> DataFrame:
    """Events of [start, end]; those whose time was inferred are kept, or tested like others."""
    inside = F.col("ts").isNull() | F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return events.where(inside | F.col("inferred")) if keep_inferred else events.where(inside)


def signals(items: DataFrame) -> DataFrame:
    """Items rolled up by event name and target: counts, the highest severity, the dominant component, confidence."""
    i = items.withColumn("target", looked_up(EVENT_TARGETS, F.col("event_name"), "general")).withColumn("number", looked_up(SEVERITY_NUMBERS, F.col("severity"), 0))
    top = i.groupBy("event_name", "target", "component").agg(F.count("*").alias("c")).groupBy("event_name", "target").agg(F.min_by("component", F.struct(-F.col("c"), "component")).alias("component"))
    g = i.groupBy("event_name", "target").agg(F.sum("n").alias("n"), F.max("number").alias("number"), F.count("*").alias("items")).join(top, ["event_name", "target"])
    base = F.when(F.col("number") >= 17, 0.8).otherwise(0.65) + F.when(F.col("n") >= 5, 0.1).otherwise(0.0)
    return g.withColumn("confidence", F.when(F.col("event_name").isin("unknown", "info"), 0.35).otherwise(F.round(F.least(base, F.lit(0.95)), 2)))
