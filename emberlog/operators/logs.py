"""Operators over the fact table of sanitized logs: fetches, patterns, metrics, operational evidence, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational as R
from . import text as T

KEYS = ("template", "error_type")
#: The 16 measures of a window's logs, as conditions to count (fixed values).
MEASURES = {
    "total_log_count": "true",
    "warn_count": "severity in ('WARN', 'WARNING')",
    "error_count": "severity in ('ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY')",
    "stream_transport_count": "error_type = 'stream_transport'",
    "active_stream_count": "contains(m, 'active stream') or contains(m, 'stream active')",
    "youtube_health_count": "error_type = 'youtube_health'",
    "youtube_ingest_count": "contains(m, 'youtube') and (contains(m, 'ingest') or contains(m, 'watch url') or contains(m, 'watchdog'))",
    "service_health_failure_count": "error_type = 'service_health_failure'",
    "runtime_restart_count": "error_type = 'runtime_restart'",
    "connection_reset_count": "contains(m, 'connection reset')",
    "rtmps_reconnect_count": "contains(m, 'rtmps') and (contains(m, 'reconnect') or contains(m, 'connect') or contains(m, 'send-path'))",
    "ffmpeg_process_state_count": "contains(m, 'ffmpeg') and (contains(m, 'exit') or contains(m, 'rc=') or contains(m, 'process') or contains(m, 'track finished'))",
    "audio_energy_count": "contains(m, 'audio_energy') or contains(m, 'audio energy') or contains(m, 'silence')",
    "capture_freshness_count": "contains(m, 'capture_freshness') or contains(m, 'capture freshness') or contains(m, 'chromium') or contains(m, 'renderer') or contains(m, 'crashpad')",
}
#: Requests for operational evidence: id, need, subsystem, and groups of terms of which each must occur (fixed values).
SPECS = (
    ("process_state_query", "process_state", "rtmps_ffmpeg", (("ffmpeg",), ("exit", "rc=", "process", "track finished", "systemd"))),
    ("throughput_signal_query", "throughput_signal", "rtmps_ffmpeg", (("rtmps", "stream_transport", "stream transport"), ("reconnect", "connect", "send-path", "tcp send"))),
    ("external_dependency_status_query", "external_dependency_status", "youtube_health", (("youtube", "watchdog", "watch url", "youtube_health"),)),
    ("user_impact_signal_query", "user_impact_signal", "audio_energy", (("audio_energy", "audio energy", "silence", "pulseaudio"),)),
    ("freshness_signal_query", "freshness_signal", "chromium_capture", (("capture_freshness", "capture freshness", "chromium", "renderer", "crashpad"),)),
    ("network_path_query", "network_path", "network_transport", (("connection reset", "notsent", "unacked", "packet", "retransmit"),)),
    ("state_transition_query", "state_transition", "runtime_recovery", (("stream_service_substate", "watchdog_ok", "substate", "systemd", "service state"),)),
)


def fetch(logs: DataFrame, service: str, environment: str, start: str, end: str, min_severity: str | None = None) -> DataFrame:
    """Logs of an environment in [start, end), of one service unless that is *, from a severity on; of repeated ids the latest."""
    rows = R.in_window(logs, start, end).where(F.col("environment") == environment)
    if service not in ("*", "__all__", f"{environment}-aggregate"):
        rows = rows.where(F.col("service") == service)
    if min_severity:
        rows = rows.where(F.col("severity_rank") >= T.SEVERITY_RANKS.get(min_severity.upper(), 0))
    return R.latest_by(rows, ["log_id"], F.desc("ts"))


def search_text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


def pattern_summaries(logs: DataFrame, service: str, environment: str, window: Sequence[str], baseline: Sequence[str], limit: int) -> DataFrame:
    """The most frequent patterns of a window with their count in another one."""
    scope = logs.where(F.col("environment") == environment)
    if service not in ("*", "__all__", f"{environment}-aggregate"):
        scope = scope.where(F.col("service") == service)
    out = R.with_baseline(R.patterns(R.in_window(scope, *window)), R.in_window(scope, *baseline), KEYS)
    return out.orderBy(F.desc("n"), *KEYS).limit(limit)


def severity_hint(n: Column, baseline: Column, rank: Column) -> Column:
    """critical for critical severities or five new rows, high for errors or four rows more, medium for two more."""
    return F.when((rank >= 50) | ((n >= 5) & (baseline == 0)), "critical").when((n - baseline >= 4) | (rank >= 40), "high").when(n - baseline >= 2, "medium").otherwise("low")


def hourly_patterns(logs: DataFrame, environment: str, window: Sequence[str], baseline: Sequence[str]) -> DataFrame:
    """Patterns by service and hour, with the baseline's mean of an active hour, the first log, an id and a hint."""
    rows = logs.where(F.col("environment") == environment)
    # here severities count as they are written, and unknown ones as INFO
    rank = F.expr("case severity when 'EMERGENCY' then 70 when 'ALERT' then 60 when 'CRITICAL' then 50 when 'ERROR' then 40 when 'WARN' then 30 when 'WARNING' then 30 else 20 end")
    hour = F.date_trunc("HOUR", "ts")
    first = F.struct("ts", "log_id")
    h = R.in_window(rows, *window).groupBy("service", "environment", hour.alias("window_start"), *KEYS).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("message", first).alias("example_log"), F.min_by("log_id", first).alias("example_id"), F.max(rank).alias("top_rank")
    )
    b = R.in_window(rows, *baseline).groupBy("service", *KEYS).agg(F.count("*").alias("total"), F.countDistinct(hour).alias("hours"))
    out = h.join(b, ["service", *KEYS], "left").withColumn("baseline_n", F.round(F.coalesce(F.try_divide("total", "hours"), F.lit(0.0))).cast("long"))
    hint = F.when(F.col("top_rank") >= 50, "critical").when(F.col("top_rank") >= 40, "high").when((F.col("top_rank") >= 30) | (F.col("n") >= 100), "medium").otherwise("low")
    key = T.stable_id("PATTERN-", F.col("service"), F.col("environment"), F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), *map(F.col, KEYS))
    out = out.withColumn("hint", hint).withColumn("pattern_id", key).withColumn("window_end", F.col("window_start") + F.expr("interval 1 hour"))
    return out.select("pattern_id", "service", "environment", "window_start", "window_end", *KEYS, "n", "baseline_n", "first_seen", "last_seen", "example_log", "example_id", "hint")


def interesting(patterns: DataFrame, limit: int) -> DataFrame:
    """Patterns with an error type, a high hint or a term of interest: the most severe, frequent and recent first."""
    t = F.lower("template")
    rows = patterns.where((F.col("error_type") != "none") | F.col("hint").isin("critical", "high") | T.any_of(t, ("rtmps", "connection reset", "youtube")))
    by_hint = F.expr("case hint when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end")
    return rows.orderBy(by_hint, F.expr("case when error_type = 'none' then 1 else 0 end"), F.desc("n"), F.desc("first_seen"), "pattern_id").limit(limit)


def representatives(logs: DataFrame, limit: int) -> DataFrame:
    """Of each service and pattern of interest the most severe, then latest log; the latest of these get ordinal ids."""
    rank = F.expr("case severity when 'EMERGENCY' then 70 when 'ALERT' then 60 when 'CRITICAL' then 50 when 'ERROR' then 40 when 'WARN' then 30 when 'WARNING' then 30 else 20 end")
    rows = logs.where((F.col("error_type") != "none") | F.col("severity").isin("WARN", "WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY") | T.any_of(F.lower("message"), ("connection reset", "rtmps")))
    rows = R.latest_by(rows, ["service", "error_type", "template"], F.desc(rank), F.desc("ts"), F.asc("log_id"))
    rows = rows.orderBy(F.desc("ts"), "log_id").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("ts"), "log_id"))  # over limit rows
    return rows.withColumn("evidence_id", F.concat(F.lit("LOG-"), F.lpad(place.cast("string"), 3, "0")))


def measured(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("m", F.lower("message"))
    counts = [F.count_if(F.expr(c)).cast("double").alias(k) for k, c in MEASURES.items()]
    return rows.agg(*counts, F.countDistinct("service").cast("double").alias("active_service_count"), F.countDistinct(F.date_trunc("HOUR", "ts")).cast("double").alias("active_hour_count"))


def metric_windows(logs: DataFrame, window: Sequence[str], baseline: Sequence[str]) -> DataFrame:
    """Metrics of a window against a day's mean of the baseline at the same hours of day, in long form; the change is a
    ratio, null where the baseline is 0."""
    spark, names = logs.sparkSession, [*MEASURES, "active_service_count", "active_hour_count"]
    now = R.in_window(logs, *window)
    hours = now.select(F.hour("ts").alias("h")).distinct()
    before = R.in_window(logs, *baseline).withColumn("h", F.hour("ts")).join(F.broadcast(hours), "h", "left_semi")  # 24 rows at most
    days = spark.range(1).select(F.greatest(F.datediff(F.lit(baseline[1]).cast("date"), F.lit(baseline[0]).cast("date")), F.lit(1)).alias("days"))
    a = measured(now).unpivot([], names, "metric_name", "current_value")
    b = measured(before).unpivot([], names, "metric_name", "total")
    out = a.join(b, "metric_name", "left").crossJoin(F.broadcast(days))  # one row
    out = out.withColumn("baseline_value", F.coalesce("total", F.lit(0.0)) / F.col("days")).withColumn("delta", F.col("current_value") - F.col("baseline_value"))
    hint = F.expr("""case when metric_name in ('stream_transport_count', 'active_stream_count', 'audio_energy_count', 'capture_freshness_count') and current_value = 0 and baseline_value > 0 then 'high'
      when metric_name in ('error_count', 'stream_transport_count', 'service_health_failure_count', 'connection_reset_count') and current_value > baseline_value then 'high'
      when current_value > 0 then 'medium' else 'low' end""")
    place = F.row_number().over(Window.orderBy("metric_name"))  # over 16 rows
    metric_id = F.concat(F.lit("METRIC-"), F.lpad(place.cast("string"), 3, "0"))
    return out.select(metric_id.alias("metric_id"), "metric_name", "baseline_value", "current_value", "delta", F.try_divide("delta", F.nullif("baseline_value", F.lit(0.0))).alias("delta_ratio"), hint.alias("hint"))


def local_metrics(now: DataFrame, before: DataFrame) -> DataFrame:
    """Six metrics of two windows in fixed order, with the change in percent (0 where the baseline is 0)."""
    def six(rows, name):
        d = rows.agg(
            F.count_if(F.col("severity_rank") >= 40).alias("error_count"), F.count_if(F.col("severity").isin("WARN", "WARNING")).alias("warn_count"), F.count_if(F.col("error_type") == "runtime_restart").alias("runtime_restart_count"),
            F.countDistinct("deploy_id").alias("deploy_id_count"), F.countDistinct("trace_id").alias("unique_trace_count"), F.count_if(F.col("error_type") == "http_5xx").alias("http_5xx_count"),
        )
        return d.unpivot([], d.columns, "metric_name", name)

    out = six(now, "c").join(six(before, "b"), "metric_name").select("metric_name", F.col("b").cast("double").alias("baseline_value"), F.col("c").cast("double").alias("current_value"))
    order = ("error_count", "warn_count", "runtime_restart_count", "deploy_id_count", "unique_trace_count", "http_5xx_count")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("metric_name"))
    rise = F.col("current_value") > F.col("baseline_value")
    hint = (
        F.when(F.col("metric_name") == "error_count", F.when(rise, "high").otherwise("low")).when(F.col("metric_name") == "warn_count", F.when(rise, "medium").otherwise("low"))
        .when(F.col("metric_name").isin("runtime_restart_count", "http_5xx_count"), F.when(F.col("current_value") > 0, "high").otherwise("low"))
        .when(F.col("metric_name") == "deploy_id_count", F.when(F.col("current_value") > 0, "medium").otherwise("low")).otherwise("medium")
    )
    delta = F.col("current_value") - F.col("baseline_value")
    pct = F.when(F.col("baseline_value") == 0, 0.0).otherwise(F.round(100 * delta / F.col("baseline_value"), 2))
    return out.select(F.concat(F.lit("METRIC-"), F.lpad(place.cast("string"), 3, "0")).alias("metric_id"), "metric_name", "baseline_value", "current_value", delta.alias("delta"), pct.alias("delta_pct"), hint.alias("hint"))


def interpretation(incident: Column, daily: Column) -> Column:
    return F.when((incident == 0) & (daily > 0), "zero_is_bad_or_evidence_gap").when((incident > 0) & (daily == 0), "new_incident_evidence").when(incident > 0, "evidence_available").otherwise("no_evidence_available")


def operational_evidence(logs: DataFrame, window: Sequence[str], baseline: Sequence[str], samples: int = 8, specs=SPECS) -> DataFrame:
    """Of each request, also those without a row: counts in both windows, the baseline's mean of a day, the latest samples.

    specs: id, need, subsystem, groups of terms. One pass over the logs: a log goes to all requests that it meets."""
    spark = logs.sparkSession
    text = search_text("message", "template", "error_type", "labels")
    def holds(groups):
        out = T.any_of(F.col("__t"), groups[0])
        for g in groups[1:]:
            out = out & T.any_of(F.col("__t"), g)
        return out

    hit = logs.withColumn("__t", text).withColumn("request_id", F.explode(F.array_compact(F.array(*[F.when(holds(g), F.lit(name)) for name, _, _, g in specs]))))
    inside = lambda w: (F.col("ts") >= F.lit(w[0]).cast("timestamp")) & (F.col("ts") < F.lit(w[1]).cast("timestamp"))
    counts = hit.where(inside(window) | inside(baseline)).groupBy("request_id").agg(F.count_if(inside(window)).alias("incident_count"), F.count_if(inside(baseline)).alias("baseline_count"))
    late = R.top_n(hit.where(inside(window)).select("request_id", "ts", "log_id"), ["request_id"], samples, F.desc("ts"), F.desc("log_id"))
    late = late.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "log_id"))), lambda x: x["log_id"]).alias("samples"))
    days = F.greatest(F.datediff(F.lit(baseline[1]).cast("date"), F.lit(baseline[0]).cast("date")), F.lit(1))
    names = spark.createDataFrame([(i + 1, s[0], s[1], s[2]) for i, s in enumerate(specs)], "place int, request_id string, need string, subsystem string")
    out = names.join(counts, "request_id", "left").join(late, "request_id", "left")
    out = out.withColumn("incident_count", F.coalesce("incident_count", F.lit(0))).withColumn("baseline_count", F.coalesce("baseline_count", F.lit(0)))
    daily = F.col("baseline_count") / days
    return out.select(
        F.concat(F.lit("OPS-"), F.lpad(F.col("place").cast("string"), 3, "0")).alias("evidence_id"), "request_id", "need", "subsystem", "incident_count", "baseline_count", F.round(daily, 4).alias("baseline_daily_average"),
        F.coalesce(F.array_join("samples", ","), F.lit("")).alias("samples"), interpretation(F.col("incident_count"), daily).alias("interpretation"),
    )


def coverage_class(n: Column, state: Column) -> Column:
    return F.when(n == 1, "singleton").when(n <= 3, "rare").when(state, "state_transition").otherwise("pattern")


#: Why a log is in its class (fixed values).
REASONS = {"pattern": "high_frequency_operational_pattern", "rare": "low_frequency_evidence_preserved", "singleton": "single_occurrence_preserved", "state_transition": "state_or_checkpoint_boundary", "unassigned": "evidence_item_boundary_assignment"}


def coverage_ledger(logs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every log with the id of its pattern, its class, facets and reason; logs of no pattern in the list are unassigned.

    patterns: pattern_id, template, error_type, n."""
    state = T.any_of(F.lower(F.concat_ws(" ", "error_type", "template")), T.STATE_TERMS)
    p = patterns.select("pattern_id", *KEYS, coverage_class(F.col("n"), state).alias("coverage_class"), state.alias("state"))
    out = logs.select("log_id", *KEYS).join(p, list(KEYS), "left")
    kind = F.coalesce("coverage_class", F.lit("unassigned"))
    facets = F.when(F.col("state") & (kind != "state_transition"), F.concat(kind, F.lit(",state_transition"))).otherwise(kind)
    reason = F.lit(None).cast("string")
    for k, v in REASONS.items():
        reason = F.when(kind == k, F.lit(v)).otherwise(reason)
    return out.select("log_id", F.coalesce("pattern_id", F.lit("")).alias("pattern_id"), kind.alias("coverage_class"), facets.alias("facets"), reason.alias("reason"))


def coverage_summary(ledger: DataFrame) -> DataFrame:
    """One row: covered and uncovered rows, their ratio, patterns of one and of up to three rows, and a histogram."""
    by = ledger.groupBy("pattern_id", "coverage_class").agg(F.count("*").alias("n"))
    some = F.col("pattern_id") != ""
    total = by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("covered"), F.count_if(some & (F.col("n") == 1)).alias("singletons"), F.count_if(some & (F.col("n") <= 3)).alias("low_frequency"), F.count_if(some).alias("patterns"),
    )
    kinds = by.groupBy("coverage_class").agg(F.sum("n").alias("n"))
    hist = kinds.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("coverage_class", "n"))), lambda x: F.concat(x["coverage_class"], F.lit("="), x["n"].cast("string"))), ",").alias("classes"))
    ratio = F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("covered") / F.col("total"), 6))
    return total.crossJoin(hist).select("total", "covered", (F.col("total") - F.col("covered")).alias("uncovered"), ratio.alias("coverage_ratio"), "patterns", "singletons", "low_frequency", "classes")


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row: a hash of all rows that does not depend on their order. Row hashes are added up in 16 parts, so that
    nothing is gathered: n and the sums' hash."""
    row = F.sha2(F.concat_ws("|", *columns), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{k}") for k in range(8)]
    out = df.agg(F.count("*").alias("n"), *parts)
    return out.select("n", F.sha2(F.concat_ws("-", *[f"p{k}" for k in range(8)]), 256).alias("digest"))


def deployments(now: DataFrame, before: DataFrame) -> DataFrame:
    """Deployments seen in either window: times, events, and in which windows."""
    rows = now.withColumn("w", F.lit("incident")).unionByName(before.withColumn("w", F.lit("lookback"))).where("deploy_id is not null and deploy_id <> ''")
    out = rows.groupBy("deploy_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("w")), ",").alias("windows"))
    return out.withColumn("deploy_sha256", F.sha2("deploy_id", 256))


#: Error types of which logs are samples whatever their severity (fixed values).
SAMPLED = ("deployment_event", "runtime_restart", "stream_transport", "youtube_health", "service_health_failure")


def sample_candidates(logs: DataFrame, otherwise: int = 100) -> DataFrame:
    """Logs from WARN on or of listed error types; if there is none, the first ones by time."""
    some = logs.where((F.col("severity_rank") >= 30) | F.col("error_type").isin(*SAMPLED))
    none = some.limit(1).agg((F.count("*") == 0).alias("__none"))
    first = logs.orderBy("ts", "log_id").limit(otherwise).join(F.broadcast(none), F.col("__none")).drop("__none")
    return some.unionByName(first)


def labels(*keys: str) -> Column:
    """The first label of these keys, in a nested object of labels if there is one; else null."""
    nested = F.get_json_object("labels", "$.labels")
    source = F.coalesce(nested, F.col("labels"))
    return F.coalesce(*[F.nullif(F.get_json_object(source, f"$.{k}"), F.lit("")) for k in keys])


def spec_matches(logs: DataFrame, metric_names: Sequence[str], source_names: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Logs whose metric or source is listed, or whose text has one of the terms."""
    source = F.coalesce(labels("source_name"), F.col("resource_type"))
    return logs.where(F.coalesce(labels("metric_name").isin(*metric_names), F.lit(False)) | F.coalesce(source.isin(*source_names), F.lit(False)) | T.any_of(search_text("message", "template", "error_type", "resource_type", "labels"), terms))


#: What a metric's zero means (fixed values): its kind, zero, subsystem and target.
METRIC_SEMANTICS = (
    ("error_count", "error", "healthy", "generic_runtime", "error_spike"),
    ("warn_count", "warning", "healthy", "generic_runtime", "warning_spike"),
    ("warning_count", "warning", "healthy", "generic_runtime", "warning_spike"),
    ("runtime_restart_count", "restart", "healthy", "runtime_recovery", "restart_loop"),
    ("connection_reset_count", "network_error", "healthy", "network_transport", "network_error_signal"),
    ("heartbeat_count", "heartbeat", "suspicious", "service_liveness", "heartbeat_missing"),
    ("throughput_count", "throughput", "suspicious", "traffic", "throughput_disappearance"),
    ("request_count", "throughput", "suspicious", "traffic", "throughput_disappearance"),
    ("latency_p95", "latency", "neutral", "user_experience", "latency_regression"),
    ("resource_pressure_count", "resource", "healthy", "resource_pressure", "resource_saturation"),
    ("job_configuration_mismatch_count", "configuration_contract", "healthy", "job_configuration", "job_configuration_mismatch"),
    ("service_start_failure_count", "supervisor_state", "healthy", "runtime_recovery", "service_start_failure"),
)


def semantics(rows: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """rows with semantic_type, zero_behavior, subsystem and core_target_type of metric_name: the profile's, else the
    generic ones, else unknown. profile: metric_name and these columns."""
    names = ["semantic_type", "zero_behavior", "subsystem", "core_target_type"]
    generic = rows.sparkSession.createDataFrame(METRIC_SEMANTICS, ", ".join(f"{x} string" for x in ["metric_name", *[f"g_{n}" for n in names]]))
    out = rows.join(F.broadcast(generic), "metric_name", "left")
    if profile is not None:
        out = out.join(F.broadcast(profile.select("metric_name", F.lit(True).alias("__own"), *[F.col(n).alias(f"p_{n}") for n in names])), "metric_name", "left")
    else:
        out = out.withColumn("__own", F.lit(False)).withColumns({f"p_{n}": F.lit(None).cast("string") for n in names})
    unknown = {"semantic_type": "unknown", "zero_behavior": "unknown", "subsystem": "general", "core_target_type": ""}
    for n in names:
        out = out.withColumn(n, F.when(F.col("__own"), F.coalesce(f"p_{n}", F.lit(""))).otherwise(F.coalesce(f"g_{n}", F.lit(unknown[n]))))
    return out.drop("__own", *[f"{x}_{n}" for n in names for x in "gp"])


def metric_assessment(name: Column, value: Column, zero: Column) -> Column:
    up = name.rlike("(_ok|_connected|_active|_available|_present|_up)$")
    return (
        F.when(value.isNull(), "observed").when((zero == "suspicious") & (value == 0), "suspicious_zero_or_gap").when((zero == "healthy") & (value == 0), "healthy_zero")
        .when(up, F.when(value >= 1, "healthy").otherwise("suspicious_zero_or_gap")).when(name.isin("current_fail", "notify_active_incidents"), F.when(value == 0, "healthy_zero").otherwise("active_failure"))
        .when(name.rlike("(fail_count|fault_count|warning_count|critical_count)$"), F.when(value == 0, "healthy_zero").otherwise("nonzero_count")).otherwise("observed")
    )


def latest_observations(logs: DataFrame) -> DataFrame:
    """The last observation of each metric that logs carry in their labels."""
    rows = logs.select(labels("metric_name").alias("metric_name"), labels("metric_value").alias("text"), "ts", "log_id").where("metric_name is not null")
    return rows.groupBy("metric_name").agg(F.max_by(F.struct("text", "ts", "log_id"), F.struct("ts", "log_id")).alias("x")).select("metric_name", F.col("x.text").alias("text"), F.col("x.ts").alias("ts"), F.col("x.log_id").alias("log_id"))


def subsystem_filter(name: str) -> Column:
    """Logs of a subsystem: by terms of the message or by error type; all logs for an unknown subsystem."""
    terms, kinds = SUBSYSTEM_TERMS.get(name, ()), SUBSYSTEM_ERRORS.get(name, ())
    if not terms and not kinds:
        return F.lit(True)
    own = F.lower("error_type").isin(*kinds) if kinds else F.lit(False)
    return (T.any_of(F.lower("message"), terms) | own) if terms else own


#: Terms and error types of subsystems for requests of more data (fixed values).
SUBSYSTEM_TERMS = {
    "youtube_health": ("youtube", "watchdog", "watchdog_ok", "stream_service_substate", "watch url"),
    "rtmps_ffmpeg": ("rtmps", "ffmpeg", "stream-engine", "send-path", "encoder"),
    "chromium_capture": ("chromium", "chrome", "renderer", "zygote", "gpu", "crashpad", "capture"),
    "audio_energy": ("audio", "pulseaudio", "d-bus", "dbus", "x11", "energy"),
    "runtime_recovery": ("restart", "recovery", "systemd", "substate", "runtime"),
    "network_transport": ("connection reset", "network", "tcp", "peer", "notsent", "unacked"),
    "database_connection_pool": ("connection pool", "connection_pool", "too many connections", "pool saturation"),
    "database_timeout": ("database", "timeout", "db timeout"),
    "downstream_dependency": ("payment-gateway", "dependency_timeout", "downstream", "dependency"),
    "deployment_regression": ("deploy", "release", "rollout", "deployment"),
    "auth_config": ("auth", "permission", "authorization"),
    "resource_pressure": ("cpu", "memory", "oom", "timeout", "load", "pressure", "peak"),
    "observability_contract": ("healthy", "critical", "warn", "adequacy", "metric", "prometheus", "alert"),
    "background_processing": ("background_processing", "background processing", "scheduled job", "queue processing", "worker loop"),
    "job_configuration": ("can't open file", "no such file or directory", "execstart", "configured command missing"),
    "generic_runtime": ("application process", "worker", "runtime host", "generic_runtime"),
    "service_liveness": ("heartbeat", "liveness", "readiness", "ready", "watch renew", "watch_renew", "watchdog", "polling"),
    "traffic": ("throughput", "request_count", "request count", "notification_forward", "business-event", "output counter"),
    "user_experience": ("latency", "p95", "p99", "user experience", "user_experience"),
}
SUBSYSTEM_ERRORS = {
    "youtube_health": ("youtube_health",),
    "rtmps_ffmpeg": ("stream_transport",),
    "chromium_capture": ("browser_capture",),
    "audio_energy": ("audio_pipeline",),
    "runtime_recovery": ("runtime_restart", "service_health_failure"),
    "network_transport": ("network",),
    "database_connection_pool": ("database_connection_pool", "connection_pool_exhausted"),
    "database_timeout": ("database_timeout",),
    "downstream_dependency": ("dependency_timeout", "downstream_dependency"),
    "auth_config": ("auth_failure",),
    "resource_pressure": ("resource_pressure",),
    "job_configuration": ("job_configuration_mismatch", "service_start_failure"),
    "generic_runtime": ("generic_runtime",),
    "service_liveness": ("heartbeat_missing",),
    "traffic": ("throughput_disappearance",),
    "user_experience": ("latency_regression",),
}


def analysis_windows(end: str | Column, minutes: int | Column, lookback_hours: int | Column, baseline_days: int | Column, raw_start: str | Column) -> dict[str, Column]:
    """Start and end of the incident, lookback and baseline windows, all anchored on the incident's end: values, or columns
    such as the last and first time of each source."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    last = c(end).cast("timestamp")
    start = last - F.make_dt_interval(mins=c(minutes))
    return {
        "incident_start": start, "incident_end": last, "lookback_start": start - F.make_dt_interval(hours=c(lookback_hours)),
        "baseline_start": F.greatest(c(raw_start).cast("timestamp"), start - F.make_dt_interval(days=c(baseline_days))), "baseline_end": start,
    }


def duration_minutes(start: Column, end: Column) -> Column:
    return F.greatest(F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60), F.lit(1)).cast("long")


def lookback_label(minutes: Column) -> Column:
    return F.when(minutes % 1440 == 0, F.concat((minutes / 1440).cast("long").cast("string"), F.lit("d"))).when(minutes % 60 == 0, F.concat((minutes / 60).cast("long").cast("string"), F.lit("h"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def checked_window(start: str, end: str, min_hours: int = 24) -> tuple[str, str]:
    """The window, or an error if it is shorter than min_hours."""
    from datetime import datetime

    seconds = (datetime.fromisoformat(end) - datetime.fromisoformat(start)).total_seconds()
    if seconds < min_hours * 3600:
        raise ValueError(f"a window must cover at least {min_hours} hours: {start} to {end} covers {seconds / 3600:.2f}")
    return start, end
