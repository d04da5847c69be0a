"""Evidence bundles: claims made by rules, claims of absence held against facts, and candidates from relations of items.

Items of a bundle: bundle_id, ref, place (their order), event_type, text (in lower case). Term and rule tables are fixed
values; a bundle's terms and facts are bits of a number, so that a bundle of any size is a sum of bits, and of its items
only the first few that a rule wants come together.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import overlapping
from .text import any_of

# ---- terms and rules of the local claims (fixed values)

TERMS = (
    "can't open file", "no such file or directory", "job_configuration_mismatch", "failed to start", ".service", "stream_transport", "ffmpeg tcp send sample", "rtmps", "youtube_health", "youtube", "watchdog",
    "service_health_failure", "healthy=false", "subsystems_status", "connection_pool_exhausted", "too many connections", "connection pool", "database_timeout", "http 500", "dependency_timeout", "runtime_restart", "crashloop",
    "auth_failure", "payment-gateway", "connection", "database", "ffmpeg", "error_count", "pattern", "deploy", "version", "metric", "unique_trace_count", "timeout", "http", "5xx", "dependency",
)
#: A term that holds where the metric of server errors is over zero, and one that every item has.
SERVER_ERRORS, EVERY = len(TERMS), len(TERMS) + 1
#: Causes, the first whose terms a bundle has: any one group of terms, all terms of a group.
CAUSE_RULES = (
    ("job_definition", (("can't open file",), ("no such file or directory",), ("job_configuration_mismatch",))),
    ("service_start", (("failed to start", ".service"),)),
    ("transport", (("stream_transport",), ("ffmpeg tcp send sample",), ("rtmps",))),
    ("live_health", (("youtube_health",), ("youtube", "watchdog"))),
    ("service_health", (("service_health_failure",), ("healthy=false",), ("subsystems_status",))),
    ("connection_pool", (("connection_pool_exhausted",), ("too many connections",), ("connection pool",))),
    ("database_timeout", (("database_timeout",),)),
    ("http_errors", ((SERVER_ERRORS,), ("http 500",))),
    ("dependency_timeout", (("dependency_timeout",),)),
    ("restart_loop", (("runtime_restart",), ("crashloop",))),
    ("authorization", (("auth_failure",),)),
    ("unknown", ((),)),
)
CONTRAST_RULES = (("live_service", (("stream_transport", "youtube_health"),)), ("dependency", (("payment-gateway",), ("dependency_timeout",))), ("none", ((),)))
#: What a role cites: items with any of the terms.
REF_SETS = {
    "hypothesis": ("connection", "database", "rtmps", "ffmpeg", "youtube", "error_count", "pattern"),
    "deploy": ("deploy", "version"),
    "verifier": ("metric", "error_count", "unique_trace_count", "rtmps", "youtube", "ffmpeg"),
    "contrast": ("timeout", "http", "5xx", "dependency", "youtube", "rtmps", "ffmpeg"),
    "any": (EVERY,),
}
CITED = 4

# ---- this library's words for causes, and what is missing and to be done for each kind of cause

CAUSES = {
    "job_definition": ("a configured job has no command or script", "job"), "service_start": ("a supervised service does not start", "job"), "transport": ("the stream's transport or sender is unstable", "transport"),
    "live_health": ("health checks of the live service are unstable", "live"), "service_health": ("a service is unhealthy or does not recover", "health"), "connection_pool": ("the database's connection pool is exhausted", "database"),
    "database_timeout": ("database calls time out", "database"), "http_errors": ("requests fail with server errors", "database"), "dependency_timeout": ("a downstream dependency times out", "database"),
    "restart_loop": ("the runtime restarts in a loop", "database"), "authorization": ("authorization is configured wrongly", "database"), "unknown": ("an unknown driver", "database"),
}
MISSING = {
    "job": ("unit file and whether its target exists", "install step of the script", "timer history and last good run"), "transport": ("socket retransmits and unsent bytes", "sender's error output in the window", "ingest health over time"),
    "live": ("results of the page probe", "transitions in the platform's API", "age of the resolver's cache"), "health": ("restarts by the supervisor", "snapshots of subsystem health", "log of recovery actions"), "database": ("pool metrics and saturation of dependencies",),
}
LASTING = {"job": "check unit paths when deploying", "transport": "collect transport counters and sender output", "live": "store probe, watchdog and API evidence", "health": "collect health snapshots and recovery actions", "database": "alert on pool saturation and guard deployments"}
CONTRASTS = {"live_service": "health of the live service may explain the symptoms without the transport", "dependency": "a slow downstream dependency may amplify the incident"}


def mask_of(terms: Sequence[str | int]) -> int:
    return sum(1 << (t if isinstance(t, int) else TERMS.index(t)) for t in set(terms))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, Sequence[Sequence[str | int]]]]) -> DataFrame:
    """place, name, mask: a row for each group of terms of a rule; a bundle meets it if it has all terms of the mask."""
    return spark.createDataFrame([(k, name, mask_of(group)) for k, (name, groups) in enumerate(rules) for group in groups], "place int, name string, mask long")


def found_terms(text: Column, terms: Sequence[str] = TERMS) -> Column:
    """The terms that stand in a text, as bits in their order: one automaton goes over each text once, for all terms."""

    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        import ahocorasick

        words = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            words.add_word(term, 1 << k)
        words.make_automaton()
        out = []
        for x in texts.to_pylist():
            own = 0
            for _, bit in words.iter(x or ""):
                own |= bit
            out.append(own)
        return pa.array(out, pa.int64())

    return bits(text)


def with_terms(items: DataFrame) -> DataFrame:
    """items with their bits. Texts are matched once each, however many items have them; also: metric_name, metric_value."""
    known = items.select("text").distinct().withColumn("__bits", found_terms(F.col("text")))
    errors = F.when((F.col("metric_name") == "http_5xx_count") & (F.col("metric_value") > 0), 1 << SERVER_ERRORS).otherwise(0)
    return items.join(known, "text", "left").withColumn("bits", F.coalesce("__bits", F.lit(0)).bitwiseOR(errors).bitwiseOR(F.lit(1 << EVERY))).drop("__bits")


def first_rule(bundles: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """bundles (bits) with the name and the place of the first rule that they meet; rules are a few rows, and go along as
    one array."""
    listed = rules.agg(F.sort_array(F.collect_list(F.struct("place", "mask", F.col("name").alias("rule")))).alias("__rules"))
    met = F.filter("__rules", lambda r: r["mask"].bitwiseAND(F.col("bits")) == r["mask"])
    out = bundles.crossJoin(F.broadcast(listed)).withColumn("__met", F.get(met, 0))  # one row
    return out.withColumns({name: F.col("__met.rule"), f"{name}_rule": F.col("__met.place")}).drop("__rules", "__met")


def first_refs(items: DataFrame, sets: dict[str, Sequence[str | int]], n: int = CITED) -> DataFrame:
    """bundle_id, cites, refs: for each bundle and set of terms the first n items, by place, that have one of the terms. The
    rows that are not among a task's first n do not leave it."""
    table = F.array(*[F.struct(F.lit(k).alias("cites"), F.lit(mask_of(terms)).alias("mask")) for k, terms in sets.items()])
    wanted = F.filter(table, lambda s: s["mask"].bitwiseAND(F.col("bits")) > 0)
    hit = items.select("bundle_id", "place", "ref", F.explode(wanted).alias("s")).select("bundle_id", "place", "ref", "s.cites")
    first = F.row_number().over(Window.partitionBy("bundle_id", "cites").orderBy("place", "ref"))
    top = hit.withColumn("k", first).where(F.col("k") <= n)
    refs = F.transform(F.sort_array(F.collect_list(F.struct("k", "ref"))), lambda x: x["ref"])
    return top.groupBy("bundle_id", "cites").agg(refs.alias("refs"))


def bundle_causes(items: DataFrame, causes: DataFrame, contrasts: DataFrame) -> DataFrame:
    """bundle_id, bits, cause, cause_rule, contrast, contrast_rule from items with terms."""
    bundles = items.groupBy("bundle_id").agg(F.bit_or("bits").alias("bits"))
    return first_rule(first_rule(bundles, causes, "cause"), contrasts, "contrast")


def _of(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def local_claims(causes: DataFrame, refs: DataFrame, bundles: DataFrame) -> DataFrame:
    """The claims of three roles on each bundle: claim_id, bundle_id, role, place, claim_type, claim_text, cause, refs,
    missing, temporary_action, permanent_action, authority.

    The hypothesis names the bundle's cause and, where there are deployments, has them validated; the verifier says what is
    missing and asks for it; the contrast gives another explanation, or says that there is none. A role cites the first
    items that its terms meet, or the bundle's first ones if they meet none. bundles: bundle_id, service, environment,
    window_start, window_end, deployments (their number).
    """
    cited = refs.groupBy("bundle_id").agg(F.map_from_entries(F.collect_list(F.struct("cites", "refs"))).alias("cited"))  # a row for each set of terms
    b = causes.join(cited, "bundle_id").join(bundles, "bundle_id")
    label, kind = (_of({k: v[i] for k, v in CAUSES.items()}, F.col("cause")) for i in (0, 1))
    missing = _of({k: "|".join(v) for k, v in MISSING.items()}, F.col("kind"))
    b = b.withColumns({"label": label, "kind": kind}).withColumns({"gaps": F.split(missing, r"\|"), "lasting": _of(LASTING, F.col("kind"))})
    refs_of = lambda s, n=CITED: F.slice(F.coalesce(F.try_element_at("cited", F.lit(s)), F.col("cited")["any"]), 1, n)
    none = F.array().cast("array<string>")
    where = F.concat_ws(" ", F.lit(""), "service", F.lit("in"), "environment", F.lit("from"), F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), F.lit("to"), F.date_format("window_end", "yyyy-MM-dd HH:mm:ss"))
    scope = F.when(F.col("deployments") > 0, F.concat(F.lit(", deployments in it: "), F.col("deployments").cast("string"))).otherwise("")
    other = F.col("contrast") != "none"

    def claim(role, place, kind, text, refs, missing=none, temporary="", lasting=F.lit(""), authority=""):
        c = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(role).alias("role"), F.lit(place).alias("place"), c(kind).alias("claim_type"), text.alias("claim_text"), refs.alias("refs"), missing.alias("missing"), F.lit(temporary).alias("temporary_action"), lasting.alias("permanent_action"), F.lit(authority).alias("authority"))

    every = F.array(
        claim("hypothesis_generator", 1, "support", F.concat(F.lit("leading hypothesis: "), "label", F.lit(";"), where, scope), refs_of("hypothesis"), F.col("gaps"), "keep mitigations reversible", F.col("lasting"), "service owner"),
        F.when(F.col("deployments") > 0, claim("hypothesis_generator", 2, "validation_target", F.lit("did the latest deployment change pools, timeouts or retries?"), refs_of("deploy", 3), F.array(F.lit("diff of the deployment and of its configuration")), authority="release owner")),
        claim("evidence_verifier", 1, "caveat", F.concat(F.lit("the bundle supports looking first at this: "), "label", F.lit(", but lacks telemetry")), refs_of("verifier"), F.col("gaps"), lasting=F.col("lasting"), authority="platform owner"),
        claim("evidence_verifier", 2, "next_data_needed", F.concat(F.lit("collect telemetry before this is closed: "), "label"), refs_of("verifier", 2), F.col("gaps"), authority="incident commander"),
        claim("contrast_agent", 1, F.when(other, "counter_evidence").otherwise("caveat"), F.coalesce(_of(CONTRASTS, F.col("contrast")), F.concat(F.lit("the logs hold no strong alternative to this: "), "label")), refs_of("contrast"), F.array(F.lit("latency and error budget of dependencies")), "check dependencies before changes that cannot be undone", F.lit("make health of dependencies an input"), "engineer on call"),
    )
    out = b.select("bundle_id", "cause", F.explode(F.array_compact(every)).alias("c")).select("bundle_id", "cause", "c.*")
    return out.withColumn("claim_id", F.concat(F.lit("lc-"), F.substring(F.sha2(F.concat_ws("|", "bundle_id", "role", F.col("place").cast("string")), 256), 1, 16)))


# ---- facts of a bundle, and claims of absence (fixed values)

FACTS = ("http_error", "checkout_failure", "pool_exhaustion", "timeout", "restart", "runtime_error", "checkout_500_signal", "db_pool_exhausted_signal", "deployment", "successful_checkout")
ABSENCE_MARKERS = ("no ", "not present", "not observed", "does not include", "does not contain", "were not provided", "was not provided", "are missing", "is missing", "contains 0", "only successful", "absence of")
#: Claims that are never contradicted: they are of a correlation, or of a part only.
PARTIAL = ("correlated", "this chunk", "current chunk")
#: What a claim says is absent, as patterns, and the fact that contradicts it.
DENIED = (
    ("http_error", r"http\s*(?:500|5xx)|http error"), ("checkout_failure", "checkout fail"), ("pool_exhaustion", "pool exhaust"), ("restart", r"\brestart(?:ed|s)?\b"), ("timeout", "timeout"),
    ("runtime_error", "error logs|failure signals|error signals|error patterns|error or failure evidence|failure evidence|errors or anomalies|500-status patterns"),
    ("checkout_500_signal", "checkout_500_count"), ("db_pool_exhausted_signal", "db_pool_exhausted_count"), ("deployment", "deployment logs|version anchors"),
)
STILL_MISSING = "HTTP 5xx time-series metrics tied to this review unit."
#: Requests that facts answer: the fact, the pattern, whether only for texts that speak of no metric. The first one is
#: answered in part: what is left of it is STILL_MISSING.
ANSWERED = (
    ("http_error", r"http\s*(?:500|5xx)\s+error\s+logs?\s+or\s+metrics?", False),
    ("http_error", r"http\s*(?:500|5xx)\s+error\s+logs?|checkout failure logs", True),
    ("pool_exhaustion", "pool exhaustion logs", True), ("restart", "restart events", True),
    ("runtime_error", "^(?:application error logs|runtime error logs|error logs)$", False),
    ("checkout_500_signal", r"http\s*(?:500|5xx)\s+(?:metric\s+)?counts?|checkout_500_count metric", False),
    ("db_pool_exhausted_signal", r"^db_pool_exhausted_count(?:\s+metric)?(?:\s+(?:data|metrics?|values))?$|metric deviations such as checkout_500_count or db_pool_exhausted_count", False),
    ("runtime_error", "runtime error logs|error or warning logs from the payment-api", False), ("restart", "restart or watchdog behavior logs", False), ("deployment", "^deployment event logs$", False),
)


def fact_bits(event_type: Column, text: Column) -> Column:
    """The facts that an item shows, as bits in the order of FACTS."""
    kind, t = F.lower(F.coalesce(event_type, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    http, failed = kind.isin("http_5xx", "http5xx") | t.rlike(r"\bhttp\s*(?:500|5\d\d|5xx)\b"), F.contains(t, F.lit("checkout fail"))
    shown = {
        "http_error": http, "checkout_failure": failed, "pool_exhaustion": F.contains(t, F.lit("pool exhaust")), "timeout": (kind == "timeout") | F.contains(t, F.lit("timeout")),
        "restart": (kind == "restart") | t.rlike(r"\brestart(?:ed|ing|s)?\b"), "runtime_error": http | failed | kind.isin("error", "fatal", "exception") | t.rlike(r"\b(?:failed|failure|exception)\b"),
        "checkout_500_signal": F.contains(t, F.lit("checkout_500_count")), "db_pool_exhausted_signal": F.contains(t, F.lit("db_pool_exhausted_count")), "deployment": any_of(t, ("deploy rollout", "deployment")) | (kind == "deployment_event"),
        "successful_checkout": F.contains(t, F.lit("checkout completed")) & any_of(t, ("status=200", "status=<num>")),
    }
    return sum((F.when(shown[f], 1 << k).otherwise(0).cast("long") for k, f in enumerate(FACTS)), F.lit(0).cast("long"))


def bundle_facts(items: DataFrame) -> DataFrame:
    """bundle_id, facts: all facts that its items show."""
    return items.groupBy("bundle_id").agg(F.bit_or(fact_bits(F.col("event_type"), F.col("text"))).alias("facts"))


def _shown(facts: Column, fact: str) -> Column:
    return facts.bitwiseAND(F.lit(1 << FACTS.index(fact))) > 0


def contradicted(text: Column, facts: Column) -> Column:
    """Whether a text claims that something is absent which the facts show."""
    t = F.lower(text)
    against = [t.rlike(pattern) & _shown(facts, fact) for fact, pattern in DENIED]
    return F.coalesce(any_of(t, ABSENCE_MARKERS) & ~any_of(t, PARTIAL) & _either(against), F.lit(False))


def _either(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def still_missing(text: Column, facts: Column) -> Column:
    """What of a request for evidence the facts leave open: the request, a smaller one, or null if they answer it."""
    t = F.lower(text)
    metric = F.contains(t, F.lit("metric"))
    met = [_shown(facts, fact) & t.rlike(pattern) & ~(F.lit(bare) & metric) for fact, pattern, bare in ANSWERED]
    return F.when(met[0], STILL_MISSING).when(_either(met[1:]), F.lit(None)).otherwise(text)


def _texts(column: str | Column) -> Column:
    given = F.transform(F.coalesce(column if isinstance(column, Column) else F.col(column), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.filter(given, lambda x: x != "")


def reconciled(claims: DataFrame, facts: DataFrame, absences: str, missing: str) -> DataFrame:
    """claims (bundle_id and two arrays of texts) with contradicted, and both arrays held against the bundle's facts: kept
    texts in their order, each once. A bundle without items has no facts, and keeps all."""
    out = claims.join(facts, "bundle_id", "left").withColumn("facts", F.coalesce("facts", F.lit(0).cast("long")))
    said = _texts(absences)
    return out.withColumns({
        "contradicted": F.filter(said, lambda x: contradicted(x, F.col("facts"))), absences: F.array_distinct(F.filter(said, lambda x: ~contradicted(x, F.col("facts")))),
        missing: F.array_distinct(F.array_compact(F.transform(_texts(missing), lambda x: still_missing(x, F.col("facts"))))),
    })


# ---- relations between items (fixed values)

POOL_TERMS, GATEWAY_TERMS = ("pool exhausted", "pool exhaustion", "db_pool_exhausted"), ("payment-gateway", "payment gateway")
#: Candidates that relations make: prefix of the id, target, subsystem, score, group, what is missing.
RELATION_CANDIDATES = {
    "deployment": ("rel-deploy-", "deployment_regression", "deployment_regression", 0.58, "evidence_relationship_deployment", ("diff of code and configuration since the last healthy revision",)),
    "gateway": ("rel-payment-gateway-", "external_dependency_health", "payment_gateway", 0.72, "evidence_relationship_payment_gateway", ("request ids, latency and errors on the gateway's side",)),
    "pool": ("rel-db-pool-", "database_connection_pool_exhaustion", "database_connection_pool", 0.93, "evidence_relationship_database_pool", ("query latency and hold times of connections", "pool configuration and deployment diff")),
}


def relation_edges(traces: DataFrame, overlaps: DataFrame, deployments: DataFrame) -> DataFrame:
    """relationship_type, left_id, right_id, shared, gap_s: one typed table of edges.

    traces: left_id, right_id, shared; overlaps: left_id, right_id; deployments: left_id, right_id, gap_s."""
    edge = lambda kind, shared, gap: [F.lit(kind).alias("relationship_type"), "left_id", "right_id", shared.cast("long").alias("shared"), gap.cast("long").alias("gap_s")]
    zero = F.lit(0)
    return (
        traces.select(*edge("shared_trace", F.col("shared"), zero)).unionByName(overlaps.select(*edge("overlapping_window_no_shared_trace", zero, zero)))
        .unionByName(deployments.select(*edge("deployment_precedes_signal", zero, F.col("gap_s"))))
    )


def relation_roles(items: DataFrame) -> DataFrame:
    """item_id, pool, gateway, impact: whether an item is of an exhausted pool, of a payment gateway, of server errors. items:
    item_id, event_type, text."""
    t = F.lower(F.concat_ws(" ", "event_type", "text"))
    return items.select("item_id", any_of(t, POOL_TERMS).alias("pool"), any_of(t, GATEWAY_TERMS).alias("gateway"), ((F.lower("event_type") == "http_5xx") | F.contains(t, F.lit("http 5"))).alias("impact"))


def suggesting_pairs(members: DataFrame, spans: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """traces and overlaps for relation_edges: of all pairs of items those that relationship_candidates makes a candidate of.

    members: item_id, trace_id; spans: item_id, s, e; items: item_id, event_type, text. A candidate's one end is of server
    errors, its other one of a pool (shared traces) or of a gateway (overlapping spans without them), so that only these
    sides meet: each by trace or by day, none left out."""
    told = relation_roles(items).where("pool or gateway or impact")
    of = members.where("trace_id is not null").join(told, "item_id").distinct()
    traced = spans.join(of.drop("trace_id").distinct(), "item_id")
    # an item of both kinds gives its pair from either side, alike
    ends = lambda p, *more: p.where("item_id != r_item_id").select(F.least("item_id", "r_item_id").alias("left_id"), F.greatest("item_id", "r_item_id").alias("right_id"), *more).distinct()

    def common(about):
        pairs = of.where(about).select("item_id", "trace_id").join(of.where("impact").select(F.col("item_id").alias("r_item_id"), "trace_id"), "trace_id")
        return ends(pairs.groupBy("item_id", "r_item_id").agg(F.count("*").alias("shared")), "shared")

    hit = traced.where("impact").select(*[F.col(c).alias(f"r_{c}") for c in ("item_id", "s", "e")])
    meet = ends(overlapping(traced.where("gateway").select("item_id", "s", "e"), hit, "s", "e", 86_400))
    return common("pool"), meet.join(common("gateway"), ["left_id", "right_id"], "left_anti")


def relationship_candidates(edges: DataFrame, items: DataFrame) -> DataFrame:
    """target_id, source, original_class, target, subsystem, component, score, group_id, refs, missing, relationship_type,
    shared, gap_s: what edges between items suggest. items: item_id, event_type, text.

    A deployment before a signal is a candidate by itself. Items that overlap without a shared trace are one if one of them
    is of a payment gateway and another of server errors; items that share traces, if one is of an exhausted pool and
    another of server errors. Both ends are looked up by joins; an end that is unknown says nothing.
    """
    told = relation_roles(items)
    out = edges
    for side in ("left", "right"):
        out = out.join(told.select(F.col("item_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in ("pool", "gateway", "impact")]), f"{side}_id", "left")
    end = lambda c: F.when(F.col(f"left_{c}"), F.col("left_id")).when(F.col(f"right_{c}"), F.col("right_id"))
    kind = F.col("relationship_type")
    out = out.withColumns({"impact": end("impact"), "about": F.when(kind == "overlapping_window_no_shared_trace", end("gateway")).when(F.col("shared") > 0, end("pool"))})
    pair = F.col("about").isNotNull() & F.col("impact").isNotNull() & (F.col("about") != F.col("impact"))
    rule = F.when(kind == "deployment_precedes_signal", "deployment").when(pair & (kind == "overlapping_window_no_shared_trace"), "gateway").when(pair, "pool")
    out = out.withColumn("rule", rule).where("rule is not null")
    value = lambda i, c=str: _of({k: c(v[i]) for k, v in RELATION_CANDIDATES.items()}, F.col("rule"))
    refs = F.when(F.col("rule") == "deployment", F.array("left_id", "right_id")).otherwise(F.array("about", "impact"))
    key = F.substring(F.sha2(F.concat_ws("|", kind, "left_id", "right_id", F.col("shared").cast("string"), F.col("gap_s").cast("string")), 256), 1, 16)
    return out.select(
        F.concat(value(0), key).alias("target_id"), F.lit("evidence_relationship").alias("source"), F.lit("validation_target").alias("original_class"), value(1).alias("target"), value(2).alias("subsystem"), value(2).alias("component"),
        value(3).cast("double").alias("score"), value(4).alias("group_id"), refs.alias("refs"), F.split(value(5, "|".join), r"\|").alias("missing"), "relationship_type", "shared", "gap_s",
    )
