"""Signals of a bundle's metrics, patterns and operational evidence, and the candidate targets that they form.

A signal: signal_type, target, route, subsystem, evidence (array of ids), metric_name, severity, score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .semantics import looked_up
from .text import any_of, first_case, subsystem

#: Targets by terms of a text, the first that has one (fixed values); the first two come before all others.
TARGET_TERMS = (
    ("job_configuration_mismatch", ("can't open file", "no such file or directory", "configured command missing", "configured job command", "supervisor script is missing", "execstart target missing", "job configuration mismatch")),
    ("service_start_failure", ("failed to start", "main process exited", "service start failure")),
    ("throughput_disappearance", ("throughput dropped to zero", "traffic dropped to zero", "request count dropped to zero")),
    ("heartbeat_missing", ("heartbeat missing", "heartbeat dropped to zero", "liveness missing")),
    ("error_spike", ("error spike", "errors increased", "5xx")),
    ("warning_spike", ("warning spike", "warnings increased")),
    ("restart_loop", ("restart loop", "runtime restart", "crashloop")),
    ("state_mismatch", ("state mismatch", "healthy but dead", "contradicts")),
    ("external_dependency_failure", ("external dependency", "dependency failure", "dependency timeout")),
    ("network_error_signal", ("connection reset", "packet loss", "reconnect")),
    ("freshness_signal_gap", ("freshness gap", "stale data", "timestamp drift")),
    ("user_impact_signal_gap", ("user impact", "success rate", "experience signal")),
    ("resource_saturation", ("resource saturation", "cpu pressure", "memory pressure", "oom")),
    ("deployment_correlation", ("deployment", "deploy", "release", "rollout")),
    ("monitoring_gap", ("missing evidence", "observability gap", "log gap", "metric gap")),
    ("instrumentation_mismatch", ("instrumentation mismatch", "metric/log conflict", "metric conflict", "metric reports 0")),
    ("observability_contract_mismatch", ("observability contract", "health signal mismatch")),
)
PRIMARY = ("throughput_disappearance", "heartbeat_missing", "job_configuration_mismatch")
#: The subsystem that metrics of a target have (fixed values).
TARGET_SUBSYSTEMS = {"error_spike": "generic_runtime", "warning_spike": "generic_runtime", "restart_loop": "runtime_recovery", "network_error_signal": "network_transport", "heartbeat_missing": "service_liveness", "throughput_disappearance": "traffic", "latency_regression": "user_experience", "resource_saturation": "resource_pressure", "job_configuration_mismatch": "job_configuration", "service_start_failure": "runtime_recovery"}
POSITIVE = ("status=ok", "healthy=true", "watchdog_ok", "runtime_status=running", "status=running", "last_health_ok=true", "judgment=ok", "ok=true")
FAILURE = (
    "failed", "failure", "connect_failure", "timed out", "timeout", "connection reset", "crashloop", "exited with code", "exit code", "restarting in", "unhealthy", "healthy=false", "local_ok=false", "public_ok=false", "api_ok=false", "oauth_ok=false",
    "ingest_connected=false", "stream_active=false", "degraded", "network_down", "tcp_stall", "no such file", "not found", "missing",
)
REQUEST_TARGETS = {
    "throughput_signal": "throughput_disappearance", "process_state": "service_start_failure", "external_dependency_status": "external_dependency_failure", "network_path": "network_error_signal", "freshness_signal": "freshness_signal_gap", "user_impact_signal": "user_impact_signal_gap",
    "state_transition": "state_mismatch", "log_completeness": "monitoring_gap", "scheduler_history": "monitoring_gap", "deployment_correlation": "deployment_regression", "resource_pressure": "resource_pressure",
}
STOP = ("count", "query", "signal", "metric", "metrics", "stream", "stream_v3", "v3", "ops", "evidence", "status", "state", "path")


def target_of_text(text: Column) -> Column:
    return first_case([(t, any_of(F.lower(text), terms)) for t, terms in TARGET_TERMS], F.lit(""))


def signal(kind, target, route, sub, evidence: Column, severity, score, metric: Column | None = None) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(kind).alias("signal_type"), c(target).alias("target"), c(route).alias("route"), c(sub).alias("subsystem"), evidence.alias("evidence"), (metric if metric is not None else F.lit("")).alias("metric_name"), c(severity).alias("severity"), c(score).cast("double").alias("score"))


def metric_signals(metrics: DataFrame, explicit_profile: bool = False) -> DataFrame:
    """metrics: metric_id, metric_name, baseline_value, current_value and their semantics."""
    b, c, z, k, t = (F.col(x) for x in ("baseline_value", "current_value", "zero_behavior", "semantic_type", "core_target_type"))
    ids, name, sub = F.array("metric_id"), F.col("metric_name"), F.col("subsystem")
    known = lambda d: F.when(t == "", d).otherwise(t)
    strong = t.isin("restart_loop", "resource_pressure") & (c >= 5)
    quiet = F.lit(explicit_profile) & (sub == "generic_runtime") & k.isin("error", "warning")
    route = F.when(quiet, "monitor_only").when(strong, "primary_candidate").otherwise("validation_target")
    checked = route == "validation_target"
    pick = (
        F.when((z == "suspicious") & (b > 0) & (c == 0), signal("zero_is_bad_drop", known("throughput_disappearance"), "primary_candidate", sub, ids, "high", 0.92, name))
        .when((z == "healthy") & (c == 0) & (b >= 0), signal("zero_is_good_stable", known("monitoring_gap"), "monitor_only", sub, ids, "low", 0.25, name))
        .when((t != "") & k.isin("error", "warning", "restart", "resource") & (c > b) & (c > 0), signal("metric_spike", t, route, sub, ids, F.when(checked, "medium").otherwise("high"), F.when(checked, 0.72).otherwise(0.82), name))
    )
    return metrics.withColumn("s", pick).where("s is not null").select("s.*")


def pattern_signals(patterns: DataFrame) -> DataFrame:
    """patterns: pattern_id, template, example_log, error_type, hint. A pattern gives up to two signals."""
    t, e, h = F.lower(F.concat_ws(" ", "template", "example_log", "error_type")), F.col("error_type"), F.col("hint")
    has = lambda *terms: any_of(t, terms)
    well, bad = any_of(t, POSITIVE) & ~any_of(t, FAILURE), any_of(t, FAILURE)
    lost = (e == "job_configuration_mismatch") | has("can't open file", "cannot open file", "no such file or directory") & has("systemd", "execstart", ".service", ".py", ".sh", "configured")
    unstarted = (e == "service_start_failure") | has("failed to start")
    target = target_of_text(t)
    kinds = ("dependency_timeout", "runtime_restart", "service_health_failure", "job_configuration_mismatch", "service_start_failure")
    negative = ~well & (h.isin("high", "critical") | e.isin(*kinds) & (bad | (e != "runtime_restart")) | bad)
    named = ~lost & ~unstarted & (target != "") & negative
    primary = target.isin(*PRIMARY)
    sub = F.coalesce(F.nullif(looked_up(TARGET_SUBSYSTEMS, target, ""), F.lit("")), subsystem(t))
    ids = F.array("pattern_id")
    restart = ~well & (has("crashloop", "restart loop", "runtime restart", "exited with code", "restarting in") | (e == "runtime_restart") & (has("kind=restart") | bad))
    network = ~well & has("connection reset", "reconnect", "timeout", "timed out")
    reset = has("connection reset", "reconnect")
    first = (
        F.when(lost, signal("missing_command", "job_configuration_mismatch", "primary_candidate", "job_configuration", ids, "high", 0.90)).when(unstarted, signal("repeated_failure", "service_start_failure", "validation_target", "runtime_recovery", ids, "medium", 0.68))
        .when(named, signal("profile_log_pattern", target, F.when(primary, "primary_candidate").otherwise("validation_target"), sub, ids, F.when(h.isin("high", "critical"), "high").otherwise("medium"), F.when(primary, 0.86).otherwise(0.62)))
    )
    second = F.when(~named, F.when(restart, signal("restart_loop", "restart_loop", "validation_target", "runtime_recovery", ids, "medium", 0.66)).when(
        network, signal("network_or_external_error", F.when(reset, "network_error_signal").otherwise("external_dependency_failure"), "validation_target", F.when(reset, "network_transport").otherwise("downstream_dependency"), ids, "medium", 0.62)
    ))
    return patterns.select(F.explode(F.array_compact(F.array(first, second))).alias("s")).select("s.*")


def gap_signals(operational: DataFrame) -> DataFrame:
    """What the baseline had and the incident lacks; operational: evidence_id, need, subsystem, incident_count, baseline_count."""
    primary = F.col("need") == "throughput_signal"
    s = signal("evidence_gap", looked_up(REQUEST_TARGETS, F.col("need"), "monitoring_gap"), F.when(primary, "primary_candidate").otherwise("validation_target"), F.col("subsystem"), F.array("evidence_id"), F.when(primary, "high").otherwise("medium"), F.when(primary, 0.84).otherwise(0.58))
    return operational.where("incident_count = 0 and baseline_count > 0").select(s.alias("s")).select("s.*")


def _words(col: Column) -> Column:
    found = F.filter(F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_distinct(F.array_except(found, F.array(*map(F.lit, STOP)))))


def conflict_signals(operational: DataFrame, metrics: DataFrame) -> DataFrame:
    """Operational evidence whose words are related to those of a metric that reports zero.

    Both sides are a bundle's few rows of requests and metrics; the smaller one is broadcast."""
    o = operational.where("incident_count > 0").withColumn("ow", _words(F.concat_ws(" ", "request_id", "need")))
    m = metrics.where("current_value = 0 and zero_behavior <> 'suspicious'").select("metric_id", "metric_name", _words(F.col("metric_name")).alias("mw"))
    inside = lambda words, other: F.exists(words, lambda w: F.contains(F.array_join(other, " "), w))
    related = (F.size("ow") > 0) & (F.size("mw") > 0) & (F.arrays_overlap("ow", "mw") | inside(F.col("mw"), F.col("ow")) | inside(F.col("ow"), F.col("mw")))
    pairs = o.join(F.broadcast(m), related)
    return pairs.select(signal("log_metric_conflict", "instrumentation_mismatch", "validation_target", F.col("subsystem"), F.array("evidence_id", "metric_id"), "medium", 0.62, F.col("metric_name")).alias("s")).select("s.*")


def deduplicated(signals: DataFrame) -> DataFrame:
    """The signal of the highest score of each type, target, subsystem, evidence and metric, with an id."""
    s = signals.withColumn("ids", F.array_join("evidence", ","))
    key = ["signal_type", "target", "subsystem", "ids", "metric_name"]
    s = s.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "route", "severity"))).where("__n = 1").drop("__n")
    return s.withColumn("signal_id", F.concat(F.lit("SIG-"), F.substring(F.sha2(F.concat_ws("|", *key, "route"), 256), 1, 12)))


def candidate_targets(signals: DataFrame) -> DataFrame:
    """Signals of one target, subsystem and route as a target: its evidence, the highest score, a mode, reasons, actions;
    targets for validation have the best incident as their parent."""
    by = ["target", "subsystem", "route"]
    s = signals.where("route <> 'auto_archive'")
    g = s.groupBy(*by).agg(F.sort_array(F.collect_set("signal_id")).alias("signal_ids"), F.round(F.max("score"), 4).alias("score"), F.sort_array(F.collect_set("signal_type")).alias("kinds"))
    refs = s.select(*by, F.explode("evidence").alias("x")).groupBy(*by).agg(F.sort_array(F.collect_set("x")).alias("refs"))
    g = g.join(refs, by, "left")
    mode = F.when(F.col("route") == "monitor_only", "monitor_only").when((F.col("route") == "primary_candidate") & F.col("target").isin(*PRIMARY), "incident_candidate").otherwise("validation_target")
    why = F.when(mode == "incident_candidate", "strong signal routed as primary candidate").when(mode == "validation_target", "routed as validation target").otherwise("routed as monitor-only")
    act = F.when(mode == "incident_candidate", "review_evidence").when(F.col("target") == "instrumentation_mismatch", "compare_sources").otherwise("collect_more_data")
    key = F.concat(F.lit("CT-"), F.substring(F.sha2(F.concat_ws("|", *by, F.array_join("signal_ids", ",")), 256), 1, 10))
    g = g.withColumns({"mode": mode, "reasons": F.array_join(F.concat(F.transform("kinds", lambda x: F.concat(x, F.lit(" detected"))), F.array(why)), ";"), "action": act, "target_id": key})
    top = g.where("mode = 'incident_candidate'").agg(F.min_by("target_id", F.struct(-F.col("score"), "target_id")).alias("primary"))
    g = g.crossJoin(F.broadcast(top))  # one row
    return g.withColumn("parent", F.when(F.col("mode") == "validation_target", F.coalesce("primary", F.lit(""))).otherwise("")).drop("primary", "kinds")


def graph_counts(targets: DataFrame, modes: Sequence[str] = ("incident_candidate", "validation_target", "monitor_only")) -> DataFrame:
    return targets.agg(*[F.count_if(F.col("mode") == m).alias(m) for m in modes], F.countDistinct("target").alias("targets"))


#: Requests for evidence that a target asks for (fixed values).
REQUESTS = {
    "throughput_disappearance": ("throughput_signal_query", "process_state_query"), "heartbeat_missing": ("process_state_query", "log_completeness_query"), "job_configuration_mismatch": ("job_definition_query", "installed_artifact_query", "scheduler_history_query"),
    "network_error_signal": ("network_path_query",), "external_dependency_failure": ("external_dependency_status_query",), "service_start_failure": ("process_state_query",), "restart_loop": ("process_state_query", "state_transition_query"),
    "instrumentation_mismatch": ("instrumentation_consistency_query",), "monitoring_gap": ("log_completeness_query",), "error_spike": ("error_sample_query",), "user_impact_signal_gap": ("user_impact_signal_query",), "freshness_signal_gap": ("freshness_signal_query",),
    "state_mismatch": ("state_transition_query",), "deployment_correlation": ("deployment_correlation_query",), "resource_saturation": ("resource_state_query",),
}


def evidence_requests(targets: DataFrame) -> DataFrame:
    """The requests of all targets, each once, with how many ask for it and the highest score among them."""
    rules = targets.sparkSession.createDataFrame([(t, r) for t, rs in REQUESTS.items() for r in rs], "target string, request_id string")
    return targets.where("mode <> 'monitor_only'").join(F.broadcast(rules), "target").groupBy("request_id").agg(F.count("*").alias("asked_by"), F.max("score").alias("score"))
