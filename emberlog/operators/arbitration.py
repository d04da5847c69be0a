"""Arbitration of candidates from several sources: canonical keys, merged observations, roll-ups, caps and final classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import any_of, first_case

#: Units that are trusted where a candidate names them (fixed values).
TRUSTED_UNITS = ("database_connection_pool", "database_dependency", "deployment_regression", "job_configuration", "observability_contract", "payment_gateway", "resource_pressure", "runtime_recovery", "service_liveness", "traffic", "user_experience")
NAMELESS = ("general", "unknown", "none", "null")
#: Reasons that keep a candidate from being primary (fixed values).
BLOCKING = ("no_baseline_agreement_or_causal_alignment", "support_is_context_not_runtime_evidence", "single_metric_only", "severity_only_signal", "user_impact_unverified", "blocking_caveat_present", "cause_disagreement", "impact_disagreement", "core_missing_evidence", "target_type_divergence")


def token(col: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("general"))


def first_wins(sources: Sequence[DataFrame], key: str, *order: str) -> DataFrame:
    """The union of the sources with one row for each key: that of the first source, within it the first by order."""
    every = sources[0].withColumn("__source", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        every = every.unionByName(s.withColumn("__source", F.lit(k)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__source", *order)
    return every.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__source")


def with_evidence_identity(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates whose cited items speak of a payment gateway, and not of an exhausted pool, are of that subsystem.

    candidates: target_id, refs, subsystem, component; items: item_id, text."""
    t = F.lower("text")
    cited = candidates.select("target_id", F.explode("refs").alias("item_id")).join(items, "item_id")
    told = cited.groupBy("target_id").agg(F.max(any_of(t, ("payment-gateway", "payment gateway"))).alias("pay"), F.max(any_of(t, ("pool exhausted", "pool exhaustion", "db_pool_exhausted"))).alias("pool"))
    out = candidates.join(told, "target_id", "left").withColumn("__pay", F.coalesce(F.col("pay") & ~F.col("pool"), F.lit(False))).drop("pay", "pool")
    for c in ("subsystem", "component"):
        out = out.withColumn(c, F.when(F.col("__pay"), "payment_gateway").otherwise(F.col(c)))
    return out.drop("__pay")


def canonical_target(explicit: Column, text: Column, explicit_token: Column | None = None) -> Column:
    """The target that a candidate names, or else its text; explicit_token: the token of explicit, where it is a column
    already."""
    e, t = token(explicit) if explicit_token is None else explicit_token, F.lower(text)
    has = lambda *terms: any_of(t, terms)
    known = (
        F.when(e.isin("restart_loop", "process_restart", "process_restart_loop"), "process_restart_loop").when(e.isin("transport_failure", "transport_path_failure", "throughput_disappearance"), "transport_path_failure")
        .when(e.isin("freshness_signal_gap", "capture_freshness", "capture_freshness_gap"), "capture_freshness_gap").when(e.isin("external_dependency_failure", "external_dependency_health"), "external_dependency_health").otherwise(e)
    )
    pool = has("connection pool", "connection_pool", "db_pool", "checkout-db") | has("pool exhaust") & has("database", "postgres", "mysql", "sql", "db connection", "jdbc")
    guess = first_case([
        ("database_connection_pool_exhaustion", pool), ("database_timeout", has("database") & has("timeout", "timed out", "latency", "slow query")), ("external_dependency_timeout", has("payment-gateway", "payment gateway")),
        ("process_restart_loop", has("restart", "restarted", "crash", "crashed", "exit code", "process state", "loop")), ("resource_pressure", has("memory", "oom", "resource pressure", "memory_critical", "memory critical")),
        ("runtime_exception", has("traceback", "exception occurred", "unhandled exception", "request processing")),
        ("transport_path_failure", has("transport", "connection reset", "io error", "i/o error", "throughput", "send-path", "send path", "rtmps", "packet loss", "timeout", "timed out", "cloudflare", "tcp anchor", "anchor observer")),
        ("external_dependency_health", has("youtube", "external dependency", "watch url", "ingest health")), ("capture_freshness_gap", has("freshness", "capture", "chromium", "timestamp drift")),
        ("user_impact_signal_gap", has("audio", "viewer", "watch", "user impact", "user-impact", "customer impact")), ("observability_contract_mismatch", has("observability", "contract", "instrumentation")),
    ], F.lit("general_review"))
    return F.when(F.coalesce(explicit, F.lit("")).isin("", "general", "general_review", "validation_target"), guess).otherwise(known)


def canonical_unit(t: Column, s: Column, c: Column) -> Column:
    """What is reviewed: a trusted unit, else the component, else the subsystem; t, s, c: the tokens of target, subsystem and
    component."""
    subject = F.when(t == "database_connection_pool_exhaustion", "database_connection_pool").when((t == "deployment_regression") | (s == "deployment_regression") | (c == "deployment_regression"), "deployment_regression").when(c.isin(*TRUSTED_UNITS), c).when(s.isin(*TRUSTED_UNITS), s)
    fixed = subject.isin("transport_sender", "database_connection_pool", "database_dependency", "payment_gateway", "deployment_regression")
    return F.when(fixed, subject).when(~c.isin(*NAMELESS), c).when(~s.isin(*NAMELESS), s).otherwise(F.coalesce(subject, F.lit("general")))


def with_canonical_key(candidates: DataFrame) -> DataFrame:
    """candidates (target_id, evidence, target, subsystem, component, text) with canonical_target, unit, family and key."""
    # tokens are columns of their own: spelled out in every branch they would be hundreds of replacements
    c = candidates.withColumns({"__t": token(F.col("target")), "__s": token(F.col("subsystem")), "__c": token(F.col("component"))})
    c = c.withColumns({"canonical_target": canonical_target(F.col("target"), F.col("text"), F.col("__t")), "unit": canonical_unit(F.col("__t"), F.col("__s"), F.col("__c"))})
    c = c.withColumn("__u", token(F.col("unit")))
    named = ~F.col("__s").isin(*NAMELESS) | ~F.col("__u").isin(*NAMELESS)
    c = c.withColumn("family", F.when(named | (F.col("canonical_target") == "general_review"), "").otherwise(F.col("canonical_target")))
    return c.withColumn("canonical_key", F.substring(F.sha2(F.concat_ws("|", "evidence", "unit", "family"), 256), 1, 24)).drop("__t", "__s", "__c", "__u")


def _spread(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.select(by, F.explode(column).alias("x"))


def observations(keyed: DataFrame) -> DataFrame:
    """Candidates of one canonical key as one observation: the best one speaks for it; with the roll-up of its providers,
    evidence families and target types, and the score of its support.

    keyed: also score, original_class, providers, supporting, support_refs (arrays)."""
    by = "canonical_key"
    first = F.struct(-F.col("score"), F.when(F.col("original_class") == "primary_candidate", 0).otherwise(1), F.col("target_id"))
    g = keyed.groupBy(by).agg(
        F.min_by(F.struct("target_id", "canonical_target", "unit", "family", "original_class", "subsystem"), first).alias("top"), F.max("score").alias("score"), F.count("*").alias("sources"), F.count_if(F.size("supporting") > 0).alias("support_sources"),
        F.max((F.col("original_class") == "primary_candidate").cast("int")).alias("any_primary"), F.countDistinct("canonical_target").alias("target_types"), F.sort_array(F.collect_set("target_id")).alias("source_ids"),
    )
    one = F.col("x")
    p = _spread(keyed, by, "providers").groupBy(by).agg(F.countDistinct(one).alias("n_providers"))
    s = _spread(keyed, by, "supporting").groupBy(by, "x").agg(F.count("*").alias("c")).groupBy(by).agg(F.count("*").alias("n_supporting"), F.sum(F.col("c") - 1).alias("repeats"))
    family = F.upper(F.regexp_extract(F.trim(one), "^([^-]+)", 1))
    r = _spread(keyed, by, "support_refs").groupBy(by).agg(F.countDistinct(one).alias("n_refs"), F.countDistinct(family).alias("n_families"))
    for part in (p, s, r):
        g = g.join(part, by, "left")
    g = g.fillna(0, ["n_providers", "n_supporting", "repeats", "n_refs", "n_families"])
    n, f, k, m = F.col("n_supporting"), F.col("n_families"), F.col("support_sources"), F.col("n_refs")
    zero = lambda c: F.greatest(c, F.lit(0))
    bonus = F.when(n >= 3, 0.10).when(n == 2, 0.06).otherwise(0.0) + F.least(F.lit(0.06), zero(f - 1) * 0.03 + zero(m - 1) * 0.005) + F.least(F.lit(0.04), zero(k - 1) * 0.01) + F.least(F.lit(0.02), F.col("repeats") * 0.005) - F.least(F.lit(0.06), zero(F.col("target_types") - 1) * 0.03)
    support = F.when(n > 0, F.least(F.lit(1.0), 0.25 + F.least(n, F.lit(3)) * 0.15 + F.least(f, F.lit(3)) * 0.10 + F.least(k, F.lit(4)) * 0.05 + F.least(m, F.lit(6)) * 0.025)).otherwise(0.0)
    ratio = F.when((n >= 2) & (k >= 2), F.least(F.lit(1.0), n / F.greatest(k, n))).otherwise(0.0)
    kind = F.when(F.col("any_primary") == 1, "primary_candidate").otherwise(F.col("top.original_class"))
    return g.select(
        by, F.col("top.target_id").alias("representative"), "top.canonical_target", "top.unit", "top.family", "top.subsystem", kind.alias("original_class"), "score", "sources", k.alias("support_sources"), "n_providers", "n_supporting", "n_refs", "n_families", "target_types",
        F.array_join("source_ids", ",").alias("source_ids"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.18), bonus)), 4).alias("bonus"), F.round(support, 4).alias("support_score"), F.round(ratio, 4).alias("provider_ratio"),
    )


def convergence(obs: DataFrame) -> DataFrame:
    """Observations of several sources, the best supported first, and whether they converge: several providers, references
    and one target type."""
    ok = (F.col("n_supporting") >= 2) & (F.col("n_refs") >= 2) & (F.col("target_types") <= 1) & (F.col("support_score") >= 0.65)
    value = F.when(ok, F.when(F.col("support_score") >= 0.8, "strong").otherwise("partial")).otherwise("duplicate")
    return obs.where("sources > 1").withColumn("convergence", value).orderBy(F.desc("support_score"), F.desc("score"), "unit", "canonical_key").limit(5)


def agreement_dimensions(groups: DataFrame) -> DataFrame:
    """One row: how far reviewers agree on targets, evidence, causes and impact over all their claim groups.

    groups: target, refs, supporters, providers (numbers), all_providers, agreement, disagreement, impact."""
    a, d = F.col("agreement"), F.col("disagreement")
    g = groups.agg(
        F.max("all_providers").alias("total"), F.max(F.when(a, F.col("supporters"))).alias("most"), F.count_if(a).alias("n_agree"), F.count_if(d).alias("n_differ"), F.count_if(a & (F.col("refs") != "")).alias("n_cited"), F.count_if(a & F.col("impact")).alias("n_impact"),
    )
    whole = F.coalesce(F.col("most"), F.lit(0)) >= F.greatest(F.col("total"), F.lit(1))
    some, cited = F.col("n_agree") > 0, F.col("n_cited") > 0
    evidence = F.when(some & whole & cited, "strong").when(cited, "partial").otherwise("weak")
    cause = F.when(~some, "none").when(F.col("n_differ") > 0, "partial").otherwise("strong")
    impact = F.when(F.col("n_impact") == 0, "none").when(whole & (F.col("n_differ") == 0), "strong").otherwise("partial")
    out = g.select("total", F.col("n_agree").alias("agreements"), F.col("n_differ").alias("disagreements"), evidence.alias("evidence"), cause.alias("cause"), impact.alias("impact"), (some & whole & (evidence != "weak")).alias("technical_baseline"))
    return out.withColumn("incident_baseline", (F.col("cause") != "none") & (F.col("evidence") != "weak") & (F.col("impact") != "none"))


def arbitrated(obs: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Observations with reasons, capped score and final class.

    obs: also runtime (evidence of the run, not context), impact, severity_only, caveat, missing (booleans)."""
    o = obs.crossJoin(F.broadcast(dimensions.select("cause", F.col("impact").alias("impact_agreement"), "incident_baseline")))  # one row
    split = (F.col("cause") == "none") & ~F.col("incident_baseline")
    rules = (
        ("no_baseline_agreement_or_causal_alignment", split, None), ("support_is_context_not_runtime_evidence", ~F.col("runtime"), 0.50), ("support_without_evidence_id", F.col("n_refs") == 0, 0.55), ("single_metric_only", (F.col("n_refs") <= 1) & ~F.col("impact"), 0.70),
        ("severity_only_signal", F.col("severity_only"), 0.45), ("user_impact_unverified", ~F.col("impact"), 0.72), ("blocking_caveat_present", F.col("caveat"), 0.65), ("target_type_divergence", F.col("target_types") > 1, 0.72), ("cause_disagreement", split, None),
        ("impact_disagreement", (F.col("impact_agreement") == "none") & ~F.col("impact"), None), ("core_missing_evidence", F.col("missing"), None),
    )
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c, _ in rules]))
    caps = F.array_compact(F.array(*[F.when(c, F.lit(cap)) for _, c, cap in rules if cap is not None]))
    o = o.withColumn("reasons", reasons).withColumn("final_score", F.round(F.least(F.least(F.lit(1.0), F.col("score") + F.col("bonus")), F.coalesce(F.array_min(caps), F.lit(1.0))), 4))
    kind = (
        F.when(F.col("original_class") == "context", "monitor_only").when(F.array_contains("reasons", "support_without_evidence_id") & ~F.col("runtime"), "auto_archived").when(F.col("original_class").isin("monitor_only", "auto_archived"), F.col("original_class"))
        .when(F.arrays_overlap("reasons", F.array(*map(F.lit, BLOCKING))), "validation_target").when((F.col("original_class") == "primary_candidate") & F.col("runtime") & (F.col("final_score") >= 0.75), "primary_candidate").otherwise("validation_target")
    )
    return o.withColumn("final_class", kind)


# ---- output of reviewers: JSON that needs repair, and its checks

FENCE = r"(?s)```(?:json|JSON)?\s*\n?(.*?)```"


def repaired_json(raw: Column) -> Column:
    """struct of the text with syntax repaired (code fences, text around the object, literals of another language) and the
    rules that changed it, in their order."""
    fenced = F.regexp_extract_all(raw, F.lit(FENCE), F.lit(1))
    longest = F.array_max(F.transform(fenced, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    bare = F.regexp_replace(longest, r"^\s+|\s+$", "")
    one = F.when((F.size(fenced) > 0) & (bare != ""), bare).otherwise(raw)
    start = F.regexp_instr(one, F.lit(r"[{\[]"))
    inner = F.regexp_extract(one, r"(?s)([{\[].*[}\]])", 1)
    two = F.when((start > 0) & (inner != ""), inner).otherwise(one)
    three = two
    for word, to in (("None", "null"), ("True", "true"), ("False", "false")):
        three = F.regexp_replace(three, rf"([:\[,]\s*){word}(\s*[,\]}}])", f"$1{to}$2")
    rules = F.array_compact(F.array(F.when(one != raw, F.lit("strip_code_fence_wrapper")), F.when(two != one, F.lit("extract_json_window")), F.when(three != two, F.lit("python_literal_to_json_literal"))))
    return F.struct(three.alias("text"), F.array_join(rules, ",").alias("rules"))


def parse_status(raw: Column, repaired: Column) -> Column:
    """Whether a text is a JSON object as it is, after repair, or not at all."""
    good = lambda c: F.trim(c).startswith("{") & F.try_parse_json(c).isNotNull()
    return F.when(good(raw), "parsed_original").when(repaired["rules"] == "", "invalid_json").when(good(repaired["text"]), "parsed_repaired").otherwise("invalid_after_repair")


CLAIM_TYPES = ("support", "counter_evidence", "caveat", "validation_target", "next_data_needed", "insufficient_evidence")


def schema_errors(text: Column) -> Column:
    """What is wrong with a result: its version, summary or list of claims, or a claim's type or text."""
    of = lambda p: F.get_json_object(text, p)
    kinds, bodies = F.from_json(of("$.claims[*].claim_type"), "array<string>"), F.from_json(of("$.claims[*].claim_text"), "array<string>")
    n = F.json_array_length(of("$.claims"))
    return F.array_join(F.array_compact(F.array(
        F.when(of("$.schema_version").isNull(), F.lit("schema_version_missing")), F.when(F.coalesce(of("$.summary"), F.lit("")) == "", F.lit("summary_missing")), F.when(n.isNull(), F.lit("claims_missing")),
        F.when((n > 0) & F.exists(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: ~k.isin(*CLAIM_TYPES)), F.lit("claim_type_unknown")), F.when((n > 0) & (F.coalesce(F.size(bodies), F.lit(0)) < n), F.lit("claim_text_missing")),
    )), ",")


# ---- requests for more data

PATHS = r"(/[A-Za-z0-9._~+@%=\-][A-Za-z0-9._~+@%=/:\-]*|(?:deployment|systemd|scripts|src|app|ops|bin|lib)/[A-Za-z0-9._~+@%=/:\-]+)"
UNITS = r"\b[A-Za-z0-9_.@-]+\.(?:service|timer|path|socket)\b"
COMMANDS = ("execstart", "command=", "cmd=", "argv", "can't open file", "cannot open file")
STATES = ("failed", "failure", "exit-code", "exited", "restart", "started", "stopped", "inactive", "dead", "running", "activating", "main process exited")


def extracted(text: Column) -> list[Column]:
    """paths, missing paths (of lines that say that something is missing), units, words of states, and lines with commands (of
    up to 240 characters) in a text."""
    clean = lambda a: F.array_distinct(F.transform(a, lambda x: F.regexp_replace(x, r"[.,;:)'\"]+$", "")))
    path = clean(F.regexp_extract_all(text, F.lit(PATHS), F.lit(1)))
    lines = F.filter(F.split(text, r"\n"), lambda s: any_of(F.lower(s), ("no such file", "can't open file", "cannot open file", "missing", "not found")))
    lost = clean(F.flatten(F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit(PATHS), F.lit(1)))))
    unit = F.array_distinct(F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)))
    state = F.filter(F.array(*map(F.lit, STATES)), lambda w: F.contains(F.lower(text), w))
    trimmed = F.transform(F.split(text, r"\n"), lambda s: F.trim(s))
    command = F.array_distinct(F.transform(F.filter(trimmed, lambda s: any_of(F.lower(s), COMMANDS)), lambda s: F.substring(s, 1, 240)))
    return [path.alias("paths"), lost.alias("missing_paths"), unit.alias("units"), state.alias("states"), command.alias("commands")]


def request_rows(logs: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """The latest rows that each request's terms meet, from 20 to 100 of them; requests: request_id, terms. One pass over
    the logs; requests are few and broadcast."""
    text = F.lower(F.concat_ws(" ", "message", "template", "error_type", "labels"))
    n = max(20, min(100, limit))
    hit = logs.withColumn("__t", text).join(F.broadcast(requests), F.exists("terms", lambda x: F.contains("__t", x)) | (F.size("terms") == 0)).drop("__t")
    w = Window.partitionBy("request_id").orderBy(F.desc("ts"), F.desc("log_id"))
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def matched_paths(wanted: DataFrame, missing: DataFrame) -> DataFrame:
    """Missing paths that are wanted; if there is none, those that end in the name of a wanted one. Both: path."""
    same = missing.join(wanted.select("path"), "path", "left_semi").withColumn("how", F.lit("path"))
    name = F.element_at(F.split("path", "/"), -1)
    close = missing.withColumn("__b", name).join(wanted.select(name.alias("__b")).distinct(), "__b", "left_semi").drop("__b").withColumn("how", F.lit("name"))
    none = same.limit(1).agg((F.count("*") == 0).alias("__none"))
    return same.unionByName(close.join(F.broadcast(none), F.col("__none")).drop("__none")).distinct()


#: Folders that a collector may read, and the names of units (fixed values).
COLLECTED_ROOTS = ("/etc/systemd", "/lib/systemd", "/usr/lib/systemd", "/opt", "/srv", "/home", "/var/lib", "/var/log", "/run")
UNIT_NAME, UNIT_IN_TEXT = r"^[A-Za-z0-9_.@:-]+\.(?:service|timer|path|socket)$", r"\b[A-Za-z0-9_.@:-]+\.(?:service|timer|path|socket)\b"


def collected_path(path: Column) -> Column:
    """A path as a collector reads it: absolute, without doubled slashes and dots; null if it goes up or is outside the
    folders that may be read."""
    p = F.regexp_replace(F.trim(path), ":+$", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"/(?:\.?/)+", "/"), r"/\.$", "/"), r"(?<=.)/+$", "")
    inside = F.lit(False)
    for root in COLLECTED_ROOTS:
        inside = inside | (clean == root) | clean.startswith(f"{root}/")
    return F.when(p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..") & inside, clean)


def collector_targets(rows: DataFrame) -> DataFrame:
    """request_id, kind (unit or path), value: what a collector is to look at for each request, each once.

    rows: request_id, request_type, text, labels (JSON). Units are those that the text names or the labels give, at the top
    or nested; paths those of the text, but for a request for an installed artifact that has missing ones only these. What
    is no name of a unit, or no path that may be read, is left out."""
    paths, lost = extracted(F.col("text"))[:2]
    doc = F.try_parse_json("labels")
    given = F.array_compact(F.array(*[F.try_variant_get(doc, p, "string") for p in ("$.systemd_unit", "$.labels.systemd_unit")]))
    units = F.array_union(F.regexp_extract_all("text", F.lit(UNIT_IN_TEXT), F.lit(0)), F.coalesce(given, F.array().cast("array<string>")))
    rows = rows.select("request_id", "request_type", units.alias("units"), paths, lost)
    unit = rows.select("request_id", F.explode("units").alias("u")).select("request_id", F.lit("unit").alias("kind"), F.trim("u").alias("value")).where(F.col("value").rlike(UNIT_NAME))
    missing = rows.select("request_id", "request_type", F.explode("missing_paths").alias("p"))
    only = missing.where("request_type = 'installed_artifact'").select("request_id").distinct()
    other = rows.join(only, "request_id", "left_anti").select("request_id", "request_type", F.explode("paths").alias("p"))
    path = missing.unionByName(other).select("request_id", F.lit("path").alias("kind"), collected_path(F.col("p")).alias("value")).where("value is not null")
    return unit.unionByName(path).distinct()
