"""Queries over logs: fetches, patterns against a baseline, metrics, coverage, deployments. Twins are written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators import documents as D
from emberlog.operators import logs as L
from emberlog.operators import relational as R
from emberlog.operators import text as T

from .facts import BASELINE, INCIDENT, LOGS, base, cur, logs

KEYS = list(L.KEYS)
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def fetch_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs of one service and window from WARN on, deduplicated to the latest of each id."""
    return L.fetch(logs(spark, d), "svc-1", "prod", *INCIDENT, min_severity="WARN").select("log_id", "ts", "service", "severity", "message")


def fetch_logs_any_service(spark: SparkSession, d: str) -> DataFrame:
    return L.fetch(logs(spark, d), "*", "stage", *BASELINE).select("log_id", "ts", "service", "severity")


def severity_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d).groupBy("severity", "severity_rank").agg(F.count("*").alias("n"))
    return rows.select("severity", "severity_rank", T.severity_label(F.col("severity_rank")).alias("label"), "n")


def redacted_templates(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).select("event_id", "message", "template", "error_type", "stack_hash")


def _event(e: DataFrame, component, system, message) -> DataFrame:
    at = F.date_format("ts", ISO)
    label = lambda *k: F.coalesce(*[F.nullif(F.get_json_object("labels", f"$.{x}"), F.lit("")) for x in k])
    kind = F.coalesce(F.nullif("error_type", F.lit("")), label("event_type"), F.lit("log_event"))
    return e.select(
        T.stable_id("EV-", at, system, F.col("service"), component, F.col("severity"), kind, F.col("template"), message, F.coalesce("trace_id", F.lit("")), F.coalesce("deploy_id", F.lit(""))).alias("event_key"), at.alias("seen_at"), system.alias("source_system"),
        component.alias("component"), kind.alias("kind"), F.coalesce(label("host", "node"), F.lit("")).alias("host"), T.truncated(message, 40).alias("summary"),
    )


def normalized_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of logs: the component is a label, else the kind, else the resource."""
    component = F.coalesce(F.nullif(F.get_json_object("labels", "$.component"), F.lit("")), F.nullif(F.get_json_object("labels", "$.kind"), F.lit("")), F.nullif("resource_type", F.lit("")), F.lit("unknown"))
    return _event(logs(spark, d), component, F.col("environment"), F.col("message"))


def stored_events(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stored row: the component falls back to the subsystem of the text."""
    e = logs(spark, d).withColumn("subsystem", T.subsystem(F.concat_ws(" ", "error_type", "template", "message")))
    component = F.coalesce(F.nullif(F.get_json_object("labels", "$.component"), F.lit("")), F.nullif(F.get_json_object("labels", "$.kind"), F.lit("")), F.col("subsystem"))
    return _event(e, component, F.lit("warehouse"), F.col("message"))


def subsystems(spark: SparkSession, d: str) -> DataFrame:
    e = logs(spark, d).withColumn("subsystem", T.subsystem(F.concat_ws(" ", "error_type", "template", "message")))
    return e.groupBy("subsystem", *KEYS).agg(F.count("*").alias("n"))


def subsystem_logs(spark: SparkSession, d: str) -> DataFrame:
    """How many logs of a window the request predicates of some subsystems meet."""
    rows = R.in_window(logs(spark, d), *INCIDENT)
    return rows.agg(*[F.count_if(L.subsystem_filter(s)).alias(s) for s in ("youtube_health", "rtmps_ffmpeg", "runtime_recovery", "auth_config", "database_connection_pool", "deployment_regression", "no_such_subsystem")])


def pattern_summary(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent templates of a window against the previous one, with a hint and an ordinal id."""
    rows = L.pattern_summaries(logs(spark, d), "*", "prod", INCIDENT, BASELINE, 200)
    place = F.row_number().over(Window.orderBy(F.desc("n"), *KEYS))  # over limit rows
    hint = L.severity_hint(F.col("n"), F.col("baseline_n"), F.col("top_rank"))
    return rows.select(
        F.concat(F.lit("PATTERN-"), F.lpad(place.cast("string"), 3, "0")).alias("pattern_id"), *KEYS, "n", "baseline_n", F.date_format("first_seen", ISO).alias("first_seen"), F.date_format("last_seen", ISO).alias("last_seen"),
        T.severity_label(F.col("top_rank")).alias("max_severity"), "example_id", hint.alias("hint"),
    )


def first_row_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of one service by their first row: the example is the earliest log."""
    rows = R.in_window(logs(spark, d), *INCIDENT).where("service = 'svc-2'")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min_by("message", F.struct("ts", "log_id")).alias("example_log"), F.max_by("severity", F.struct("severity_rank", "severity")).alias("max_severity"))


def hourly_patterns(spark: SparkSession, d: str) -> DataFrame:
    return L.hourly_patterns(logs(spark, d), "prod", INCIDENT, BASELINE)


def interesting_patterns(spark: SparkSession, d: str) -> DataFrame:
    p = L.interesting(L.hourly_patterns(logs(spark, d), "prod", INCIDENT, BASELINE), 60)
    return p.select("pattern_id", T.truncated(F.col("template"), 30).alias("template"), T.truncated(F.col("example_log"), 50).alias("example_log"), "error_type", "n", "hint", T.subsystem(F.concat_ws(" ", "error_type", "template", "example_log")).alias("subsystem"))


def hourly_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Patterns by service against their mean of active baseline hours."""
    rows = logs(spark, d)
    now = R.in_window(rows, *INCIDENT).groupBy("service", *KEYS).agg(F.count("*").alias("n"))
    b = R.in_window(rows, *BASELINE).groupBy("service", *KEYS).agg(F.count("*").alias("bn"), F.countDistinct(F.date_trunc("HOUR", "ts")).alias("active_hours"))
    out = now.join(b, ["service", *KEYS], "left")
    return out.select("service", *KEYS, "n", F.coalesce("active_hours", F.lit(0)).alias("active_hours"), F.coalesce(F.round(F.try_divide("bn", "active_hours"), 3), F.lit(0.0)).alias("baseline_per_hour"))


def representative_logs(spark: SparkSession, d: str) -> DataFrame:
    rows = R.in_window(logs(spark, d), *INCIDENT).where("environment = 'prod'")
    return L.representatives(rows, 120).select("evidence_id", "service", T.truncated(F.col("template"), 30).alias("template"), T.truncated(F.col("message"), 50).alias("message"), "error_type", "log_id", "ts")


def metric_windows(spark: SparkSession, d: str) -> DataFrame:
    m = L.metric_windows(logs(spark, d), INCIDENT, BASELINE)
    return m.select("metric_id", "metric_name", *[F.round(c, 6).alias(c) for c in ("baseline_value", "current_value", "delta", "delta_ratio")], "hint")


def local_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    return L.local_metrics(R.in_window(rows, *INCIDENT), R.in_window(rows, *BASELINE))


def operational_evidence(spark: SparkSession, d: str) -> DataFrame:
    return L.operational_evidence(logs(spark, d), INCIDENT, BASELINE, 3)


def labelled_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Logs that a request names by metric, by source or by term."""
    hit = L.spec_matches(R.in_window(logs(spark, d), *INCIDENT), ["ingest_connected", "mbps"], ["src-1", "systemd"], ["latency", "custom"])
    return hit.groupBy("service").agg(F.count("*").alias("n"), F.max(F.struct("ts", "log_id"))["log_id"].alias("last_id"))


def _listed(spark, d):
    """The 40 most frequent patterns of the incident: others are not covered."""
    p = R.in_window(logs(spark, d), *INCIDENT).groupBy(*KEYS).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *KEYS).limit(40)
    place = F.row_number().over(Window.orderBy(F.desc("n"), *KEYS))  # over 40 rows
    return p.withColumn("pattern_id", F.concat(F.lit("PATTERN-"), F.lpad(place.cast("string"), 3, "0")))


def coverage_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every incident log with its pattern and class."""
    return L.coverage_ledger(R.in_window(logs(spark, d), *INCIDENT), _listed(spark, d))


def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.coverage_summary(coverage_ledger(spark, d))


def coverage_digest(spark: SparkSession, d: str) -> DataFrame:
    return L.digest(coverage_ledger(spark, d), "log_id", "pattern_id", "coverage_class", "facets")


def deployments(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d)
    return L.deployments(R.in_window(rows, *INCIDENT), R.in_window(rows, *BASELINE))


def sample_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Samples of two windows, the second one without a log that is a candidate."""
    rows = logs(spark, d)
    one = L.sample_candidates(R.in_window(rows, *INCIDENT).where("service = 'svc-0'")).withColumn("w", F.lit("incident"))
    quiet = rows.where("severity_rank < 30 and error_type in ('none', 'http_5xx')")
    return one.unionByName(L.sample_candidates(R.in_window(quiet, *BASELINE)).withColumn("w", F.lit("quiet"))).select("w", "log_id", "severity", "error_type")


def evidence_items(spark: SparkSession, d: str) -> DataFrame:
    """Patterns, metrics and operational evidence as items of one table."""
    p = _listed(spark, d).select(F.col("pattern_id").alias("evidence_id"), F.lit("log_pattern").alias("kind"), F.col("template").alias("summary"), F.col("n").cast("double").alias("value"))
    m = local_metrics(spark, d).select(F.col("metric_id").alias("evidence_id"), F.lit("metric_window").alias("kind"), F.col("metric_name").alias("summary"), F.col("current_value").alias("value"))
    o = operational_evidence(spark, d).select("evidence_id", F.lit("operational_evidence").alias("kind"), F.col("request_id").alias("summary"), F.col("incident_count").cast("double").alias("value"), "interpretation")
    return p.unionByName(m).unionByName(o, allowMissingColumns=True)


def metric_observations(spark: SparkSession, d: str) -> DataFrame:
    """The last observation of each metric in labels, as a scalar, and what it says."""
    o = L.semantics(L.latest_observations(logs(spark, d)), _profile(spark))
    value = F.expr("try_cast(text as double)")
    return o.select("metric_name", "text", "log_id", "zero_behavior", L.metric_assessment(F.col("metric_name"), value, F.col("zero_behavior")).alias("assessment"), T.scalar_kind(F.col("text")).alias("kind"))


def _profile(spark):
    """A profile that overrides the generic semantics."""
    rows = [("mbps", "throughput", "suspicious", "traffic", "throughput_disappearance"), ("fail_count", "error", "healthy", "generic_runtime", "error_spike"), ("warn_count", "warning", "neutral", "observability_contract", "")]
    return spark.createDataFrame(rows, "metric_name string, semantic_type string, zero_behavior string, subsystem string, core_target_type string")


def metric_semantics(spark: SparkSession, d: str) -> DataFrame:
    """The meaning of each metric of both windows: the profile's, else the generic one, else unknown."""
    return L.semantics(metric_windows(spark, d).select("metric_name"), _profile(spark))


def message_fields(spark: SparkSession, d: str) -> DataFrame:
    """key=value pairs of messages by key: what kinds of scalars they are, the sum of the numbers and how many are true."""
    kv = logs(spark, d).select(F.explode(T.key_values(F.col("message"))).alias("key", "value"))
    kv = kv.select("key", T.coerced(F.regexp_replace("value", "[,;]+$", "")).alias("c"))
    return kv.groupBy("key", F.col("c.kind").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("c.number"), 3).alias("total"), F.count_if("c.flag").alias("truths"))


def time_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows anchored on the last log of each service, their length and label, and whether they are long enough to
    analyse; no baseline begins before the service's first log."""
    ends = logs(spark, d).groupBy("service").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    cases = spark.createDataFrame([(0, 90, 24, 7), (1, 1440, 6, 3), (2, 2880, 36, 90)], "place int, minutes int, hours int, days int")
    e = ends.crossJoin(F.broadcast(cases))  # three windows for each service
    out = e.select("service", "place", "hours", *[c.alias(k) for k, c in L.analysis_windows(F.col("last"), F.col("minutes"), F.col("hours"), F.col("days"), F.col("first")).items()])
    minutes = L.duration_minutes(F.col("incident_start"), F.col("incident_end"))
    days = F.greatest((F.unix_timestamp("baseline_end") - F.unix_timestamp("baseline_start")) / 86400, F.lit(1.0))
    return out.select("service", "place", "incident_start", "lookback_start", "baseline_start", minutes.alias("minutes"), L.lookback_label(F.col("hours") * 60).alias("label"), F.round(days, 4).alias("baseline_days"), (minutes >= 1440).alias("long_enough"))


def texts_and_severity(spark: SparkSession, d: str) -> DataFrame:
    """Severity of words, non-negated terms, and names of events made uniform."""
    e = logs(spark, d)
    return e.select("event_id", T.severity_of_text(F.col("message")).alias("by_text"), T.not_negated(F.col("message"), ("timeout", "error", "http 500")).alias("signal"), D.semantic_name(F.col("template")).alias("name"))


def event_severities(spark: SparkSession, d: str) -> DataFrame:
    """Severity and message of JSON events that have status, flags, kinds of failure or judgments in place of a severity."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_id is not null").selectExpr("event_id", _ATTRIBUTES)
    get = lambda k: F.try_element_at("a", F.lit(k))
    return e.select("event_id", T.severity_of_event(get).alias("severity"), T.with_context(F.coalesce(get("message"), get("kind"), F.lit("event")), get).alias("message"))


_ATTRIBUTES = """map('message', case when event_id % 3 = 0 then 'said' end, 'level', case when event_id % 11 = 0 then 'notice' end, 'status', case event_id % 7 when 0 then 'fatal' when 1 then 'Degraded' when 2 then 'unhealthy' when 3 then '' end,
  'healthy', case when event_id % 5 = 0 then 'false' end, 'failure_kind', case event_id % 8 when 0 then 'none' when 1 then 'stall' end, 'judgment', case event_id % 9 when 0 then 'warn' when 1 then 'failed' end,
  'kind', case event_id % 10 when 0 then 'crash_report' when 1 then 'restart' when 2 then 'tick' end, 'mbps', case when event_id % 4 = 0 then cast(user_id as string) end) a"""


def window_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of 2, 5 and 7 days up to the last log, closed at both ends; the chosen one is the longest of the fullest."""
    rows = logs(spark, d)
    end = rows.agg(F.max("ts").alias("end_ts"))
    ranges = spark.range(3).select(F.element_at(F.array(F.lit(2), F.lit(5), F.lit(7)), (F.col("id") + 1).cast("int")).alias("days"))
    bounds = ranges.join(F.broadcast(end)).withColumn("start_ts", F.expr("end_ts - make_dt_interval(days)"))  # 3 rows
    out = rows.join(F.broadcast(bounds), (F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= F.col("end_ts")))
    out = out.groupBy("days").agg(F.count("*").alias("n"), F.count_if(F.expr("severity_rank >= 40")).alias("errors"), F.countDistinct("service").alias("services"))
    return out.withColumn("choice", F.row_number().over(Window.orderBy(F.desc("days"), F.desc("n"))))


def top_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = logs(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("val")) for c in ("service", "severity", "error_type")])).alias("x")).select("x.*")
    counts = rows.groupBy("col", "val").agg(F.count("*").alias("n"))
    return R.top_n(counts, ["col"], 3, F.desc("n"), F.asc("val")).select("col", "val", "n", "rank")


def dominant_service(spark: SparkSession, d: str) -> DataFrame:
    return R.dominant(logs(spark, d), ["error_type"], "service")


def evidence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of the baseline by service that the incident's last two days lack."""
    rows = logs(spark, d).withColumn("hour_slot", F.hour("ts"))
    now = R.in_window(rows, "2024-01-27 00:00:00", INCIDENT[1]).select("service", "error_type", "hour_slot")
    return R.in_window(rows, *BASELINE).groupBy("service", "error_type", "hour_slot").agg(F.count("*").alias("n")).join(now, ["service", "error_type", "hour_slot"], "left_anti")


def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Nested JSON labels: count, distinct and least of a key by service."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.countDistinct("k").alias("kinds"), F.min("k").alias("least"), F.max("k").alias("most"))


def severity_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A histogram of each service's severities in the order of their names, as a list of pairs and as JSON."""
    counts = logs(spark, d).groupBy("service", "severity").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("severity", "n")))
    out = counts.groupBy("service").agg(pairs.alias("p"), F.sum("n").alias("n"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["severity"], F.lit(":"), x["n"].cast("string"))), ",")
    return out.select("service", text.alias("pairs"), F.to_json(F.struct("n", "service")).alias("json"))


QUERIES = {f.__name__: f for f in (fetch_logs, fetch_logs_any_service, severity_ladder, redacted_templates, normalized_events, stored_events, subsystems, subsystem_logs, pattern_summary, first_row_patterns, hourly_patterns, interesting_patterns, hourly_baseline, representative_logs, metric_windows, local_metrics, operational_evidence, labelled_evidence, coverage_ledger, coverage_summary, coverage_digest, deployments, sample_candidates, evidence_items, metric_observations, metric_semantics, message_fields, time_windows, texts_and_severity, event_severities, window_candidates, top_counts, dominant_service, evidence_gaps, label_histogram, severity_histogram)}


# ---- twins

def _short(x: str, n: int) -> str:
    t = f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
    return f"case when length({t}) > {n} then substr({t}, 1, {n}) || '...[truncated ' || (length({t}) - {n}) || ' chars]' else {t} end"


def _like(x: str, *terms: str) -> str:
    return "(" + " or ".join(f"contains({x}, '{t}')".replace("can't", "can''t") for t in terms) + ")"


_LABEL = "case when {r} >= 70 then 'EMERGENCY' when {r} >= 60 then 'ALERT' when {r} >= 50 then 'CRITICAL' when {r} >= 40 then 'ERROR' when {r} >= 30 then 'WARN' when {r} >= 25 then 'NOTICE' when {r} >= 20 then 'INFO' when {r} >= 10 then 'DEBUG' else 'INFO' end"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_EVENT = "select 'EV-' || substr(sha256(concat_ws('|', seen, system, service, component, severity, kind, template, message, coalesce(trace_id, ''), coalesce(deploy_id, ''))), 1, 16) event_key, seen seen_at, system source_system, component, kind, coalesce(nullif(json_extract_string(labels, '$.host'), ''), nullif(json_extract_string(labels, '$.node'), ''), '') as host, " + _short("message", 40) + " as summary from e"
SQL_SUBSYSTEM = f"""case
 when {_like('t', 'youtube', 'watch url', 'stream_service_substate')} and {_like('t', 'dead', 'healthy', 'watchdog_ok', 'health')} then 'youtube_health'
 when {_like('t', 'ffmpeg', 'rtmps', 'stream-engine', 'stream_transport', 'send-path', 'encoder', 'exit code 1')} then 'rtmps_ffmpeg'
 when {_like('t', 'chromium', 'chrome', 'renderer', 'zygote', 'gpu', 'crashpad', 'capture')} then 'chromium_capture'
 when {_like('t', 'audio', 'pulseaudio', 'pulse', 'dbus', 'd-bus', 'x11', 'energy')} then 'audio_energy'
 when {_like('t', 'restart', 'service_health_failure', 'recovery', 'systemd', 'substate', 'runtime')} then case when {_like('t', "can't open file", 'no such file or directory', 'execstart', 'configured command missing')} then 'job_configuration' else 'runtime_recovery' end
 when {_like('t', 'heartbeat', 'liveness', 'readiness', 'ready', 'watch renew', 'watch_renew', 'watchdog', 'polling')} then 'service_liveness'
 when {_like('t', 'background_processing', 'background processing', 'scheduled job', 'queue processing', 'worker loop')} then 'background_processing'
 when {_like('t', 'throughput', 'request_count', 'request count', 'notification_forward', 'business-event', 'output counter')} then 'traffic'
 when {_like('t', 'latency', 'p95', 'p99', 'user experience', 'user_experience')} then 'user_experience'
 when {_like('t', 'application process', 'worker', 'generic_runtime', 'runtime host')} then 'generic_runtime'
 when {_like('t', 'connection reset', 'connection_reset', 'network', 'tcp', 'peer', 'notsent', 'unacked', 'packet')} then 'network_transport'
 when {_like('t', 'connection pool', 'connection_pool', 'too many connections', 'pool saturation')} then 'database_connection_pool'
 when contains(t, 'database') and contains(t, 'timeout') then 'database_timeout'
 when {_like('t', 'payment-gateway', 'dependency_timeout', 'downstream', 'dependency')} then 'downstream_dependency'
 when {_like('t', 'deploy', 'release', 'rollout')} then 'deployment_regression'
 when {_like('t', 'auth', 'permission')} then 'auth_config'
 when {_like('t', 'cpu', 'memory', 'oom', 'timeout', 'load', 'pressure', 'peak', 'resource')} then 'resource_pressure'
 when {_like('t', 'healthy', 'critical', 'warn', 'error_count', 'total_log_count', 'active_hour_count', 'active_service_count', 'adequacy', 'metric', 'prometheus', 'alert', 'observability')} then 'observability_contract'
 when {_like('t', "can't open file", 'no such file or directory', 'execstart', 'configured command missing')} then 'job_configuration' else 'general' end"""
_SUM = f"""with {LOGS}, c as (select template, error_type, count(*) n, min(ts) first_seen, max(ts) last_seen, max(severity_rank) top_rank, min(log_id) example_id from logs where environment = 'prod' and {cur} group by all),
b as (select template, error_type, count(*) baseline_n from logs where environment = 'prod' and {base} group by all),
s as (select c.*, coalesce(b.baseline_n, 0) baseline_n from c left join b using (template, error_type) order by n desc, template, error_type limit 200)"""
_PLAIN_RANK = "case severity when 'EMERGENCY' then 70 when 'ALERT' then 60 when 'CRITICAL' then 50 when 'ERROR' then 40 when 'WARN' then 30 when 'WARNING' then 30 else 20 end"
_HOURLY = f"""with {LOGS}, h as (select service, environment, date_trunc('hour', ts)::timestamp window_start, template, error_type, count(*) n, min(ts) first_seen, max(ts) last_seen, first(message order by ts, log_id) example_log, first(log_id order by ts, log_id) example_id, max({_PLAIN_RANK}) top_rank from logs where environment = 'prod' and {cur} group by all),
b as (select service, template, error_type, count(*) total, count(distinct date_trunc('hour', ts)) nh from logs where environment = 'prod' and {base} group by all),
p as (select 'PATTERN-' || substr(sha256(concat_ws('|', service, environment, strftime(window_start, '%Y-%m-%d %H:%M:%S'), template, error_type)), 1, 16) pattern_id, service, environment, window_start, window_start + interval 1 hour as window_end, template, error_type, n,
  round(coalesce(total / nh, 0))::bigint baseline_n, first_seen, last_seen, example_log, example_id, case when top_rank >= 50 then 'critical' when top_rank >= 40 then 'high' when top_rank >= 30 or n >= 100 then 'medium' else 'low' end hint from h left join b using (service, template, error_type))"""
_M = """count(*)::double total_log_count, count(*) filter (where severity in ('WARN', 'WARNING'))::double warn_count, count(*) filter (where severity in ('ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY'))::double error_count,
 count(*) filter (where error_type = 'stream_transport')::double stream_transport_count, count(*) filter (where l like '%active stream%' or l like '%stream active%')::double active_stream_count, count(*) filter (where error_type = 'youtube_health')::double youtube_health_count,
 count(*) filter (where l like '%youtube%' and (l like '%ingest%' or l like '%watch url%' or l like '%watchdog%'))::double youtube_ingest_count, count(*) filter (where error_type = 'service_health_failure')::double service_health_failure_count,
 count(*) filter (where error_type = 'runtime_restart')::double runtime_restart_count, count(*) filter (where l like '%connection reset%')::double connection_reset_count,
 count(*) filter (where l like '%rtmps%' and (l like '%connect%' or l like '%send-path%'))::double rtmps_reconnect_count,
 count(*) filter (where l like '%ffmpeg%' and (l like '%exit%' or l like '%rc=%' or l like '%process%' or l like '%track finished%'))::double ffmpeg_process_state_count,
 count(*) filter (where contains(l, 'audio_energy') or l like '%audio energy%' or l like '%silence%')::double audio_energy_count,
 count(*) filter (where contains(l, 'capture_freshness') or l like '%capture freshness%' or l like '%chromium%' or l like '%renderer%' or l like '%crashpad%')::double capture_freshness_count,
 count(distinct service)::double active_service_count, count(distinct date_trunc('hour', ts))::double active_hour_count"""
_METRICS = f"""with {LOGS}, x as (select *, lower(message) l from logs), a as (unpivot (select {_M} from x where {cur}) on columns(*) into name metric_name value current_value),
b as (unpivot (select {_M} from x where {base} and hour(ts) in (select hour(ts) from x where {cur})) on columns(*) into name metric_name value total),
m as (select metric_name, total / 7 baseline_value, current_value from a join b using (metric_name))"""
_SIX = "count(*) filter (where severity_rank >= 40) error_count, count(*) filter (where severity in ('WARN', 'WARNING')) warn_count, count(*) filter (where error_type = 'runtime_restart') runtime_restart_count, count(distinct deploy_id) deploy_id_count, count(distinct trace_id) unique_trace_count, count(*) filter (where error_type = 'http_5xx') http_5xx_count"
_LOCAL = f"""a as (unpivot (select {_SIX} from logs where {cur}) on columns(*) into name metric_name value c), b as (unpivot (select {_SIX} from logs where {base}) on columns(*) into name metric_name value b),
local as (select 'METRIC-00' || list_position(['error_count', 'warn_count', 'runtime_restart_count', 'deploy_id_count', 'unique_trace_count', 'http_5xx_count'], metric_name) metric_id, metric_name, b.b::double baseline_value, a.c::double current_value, (a.c - b.b)::double as delta,
 case when b.b = 0 then 0.0 else round(100.0 * (a.c - b.b) / b.b, 2) end::double delta_pct, case metric_name when 'error_count' then case when a.c > b.b then 'high' else 'low' end when 'warn_count' then case when a.c > b.b then 'medium' else 'low' end
 when 'deploy_id_count' then case when a.c > 0 then 'medium' else 'low' end when 'unique_trace_count' then 'medium' else case when a.c > 0 then 'high' else 'low' end end hint from a join b using (metric_name))"""
_T = "lower(message || ' ' || template || ' ' || error_type || ' ' || labels)"
_OPS = [
    ("process_state_query", "process_state", "rtmps_ffmpeg", "s like '%ffmpeg%' and (s like '%exit%' or s like '%rc=%' or s like '%process%' or s like '%track finished%' or s like '%systemd%')"),
    ("throughput_signal_query", "throughput_signal", "rtmps_ffmpeg", "(s like '%rtmps%' or contains(s, 'stream_transport') or s like '%stream transport%') and (s like '%connect%' or s like '%send-path%' or s like '%tcp send%')"),
    ("external_dependency_status_query", "external_dependency_status", "youtube_health", "s like '%youtube%' or s like '%watchdog%' or s like '%watch url%'"),
    ("user_impact_signal_query", "user_impact_signal", "audio_energy", "contains(s, 'audio_energy') or s like '%audio energy%' or s like '%silence%' or s like '%pulseaudio%'"),
    ("freshness_signal_query", "freshness_signal", "chromium_capture", "contains(s, 'capture_freshness') or s like '%capture freshness%' or s like '%chromium%' or s like '%renderer%' or s like '%crashpad%'"),
    ("network_path_query", "network_path", "network_transport", "s like '%connection reset%' or s like '%notsent%' or s like '%unacked%' or s like '%packet%' or s like '%retransmit%'"),
    ("state_transition_query", "state_transition", "runtime_recovery", "contains(s, 'watchdog_ok') or s like '%substate%' or s like '%systemd%' or s like '%service state%'"),
]
_OPS_UNION = " union all ".join(f"select {i + 1} place, '{a}' request_id, '{b}' need, '{c}' subsystem, (select count(*) from x where {cur} and ({p})) incident_count, (select count(*) from x where {base} and ({p})) baseline_count, coalesce((select string_agg(log_id, ',' order by ts desc, log_id desc) from (select log_id, ts from x where {cur} and ({p}) order by ts desc, log_id desc limit 3)), '') samples" for i, (a, b, c, p) in enumerate(_OPS))
_EVIDENCE = f"x as (select *, {_T} s from logs), o as ({_OPS_UNION}), ops as (select 'OPS-00' || place evidence_id, request_id, need, subsystem, incident_count, baseline_count, round(baseline_count / 7, 4) baseline_daily_average, samples, case when incident_count = 0 and baseline_count > 0 then 'zero_is_bad_or_evidence_gap' when incident_count > 0 and baseline_count = 0 then 'new_incident_evidence' when incident_count > 0 then 'evidence_available' else 'no_evidence_available' end interpretation from o)"
_STATE = _like("lower(error_type || ' ' || template)", "checkpoint", "frontier", "state_transition", "deploy", "runtime_restart", "service_start", "watchdog", "systemd")
_COVER = f"""with {LOGS}, now as (select * from logs where {cur}), p0 as (select template, error_type, count(*) n from now group by all order by n desc, template, error_type limit 40),
listed as (select *, 'PATTERN-' || lpad((row_number() over (order by n desc, template, error_type))::varchar, 3, '0') pattern_id, {_STATE} state from p0),
p as (select *, case when n = 1 then 'singleton' when n <= 3 then 'rare' when state then 'state_transition' else 'pattern' end k from listed),
v as (select log_id, coalesce(pattern_id, '') pattern_id, coalesce(k, 'unassigned') coverage_class, coalesce(k, 'unassigned') || case when state and k <> 'state_transition' then ',state_transition' else '' end facets,
 case coalesce(k, '') when 'pattern' then 'high_frequency_operational_pattern' when 'rare' then 'low_frequency_evidence_preserved' when 'singleton' then 'single_occurrence_preserved' when 'state_transition' then 'state_or_checkpoint_boundary' else 'evidence_item_boundary_assignment' end reason from now left join p using (template, error_type))"""
_CAND = "(severity_rank >= 30 or error_type in ('deployment_event', 'runtime_restart', 'stream_transport', 'youtube_health', 'service_health_failure'))"
_SEM = """sem(metric_name, semantic_type, zero_behavior, subsystem, core_target_type) as (values ('mbps', 'throughput', 'suspicious', 'traffic', 'throughput_disappearance'), ('fail_count', 'error', 'healthy', 'generic_runtime', 'error_spike'), ('warn_count', 'warning', 'neutral', 'observability_contract', ''),
 ('error_count', 'error', 'healthy', 'generic_runtime', 'error_spike'), ('runtime_restart_count', 'restart', 'healthy', 'runtime_recovery', 'restart_loop'), ('connection_reset_count', 'network_error', 'healthy', 'network_transport', 'network_error_signal'))"""
_NEST = "coalesce(nullif(json_extract_string(labels, '$.labels.{0}'), ''), nullif(json_extract_string(labels, '$.{0}'), ''))"
_KV = r"regexp_extract_all(message, '([A-Za-z_][A-Za-z0-9_.]*)=(\S+)', {})"
_LEVEL = "case when {0} like '%critical%' or {0} like '%fatal%' or {0} like '%panic%' or {0} like '%crash%' then 'CRITICAL' when {0} like '%error%' or {0} like '%failed%' or {0} like '%failure%' or {0} like '%exception%' or {0} like '%traceback%' then 'ERROR' when {0} like '%warn%' or {0} like '%degraded%' or {0} like '%restart%' or {0} like '%recover%' or {0} like '%timeout%' then 'WARN' else 'INFO' end"
ORACLES = {
    "fetch_logs": f"with {LOGS} select log_id, ts, service, severity, message from logs where {cur} and environment = 'prod' and service = 'svc-1' and severity_rank >= 30 qualify row_number() over (partition by log_id order by ts desc) = 1",
    "fetch_logs_any_service": f"with {LOGS} select log_id, ts, service, severity from logs where {base} and environment = 'stage' qualify row_number() over (partition by log_id order by ts desc) = 1",
    "severity_ladder": f"with {LOGS} select severity, severity_rank, {_LABEL.format(r='severity_rank')} as label, count(*) n from logs group by all",
    "redacted_templates": f"with {LOGS} select event_id, message, template, error_type, stack_hash from logs",
    "normalized_events": f"with {LOGS}, e as (select *, {_ISO.format('ts')} as seen, environment as system, coalesce(nullif(error_type, ''), json_extract_string(labels, '$.event_type'), 'log_event') kind, coalesce(nullif(json_extract_string(labels, '$.component'), ''), nullif(json_extract_string(labels, '$.kind'), ''), nullif(resource_type, ''), 'unknown') component from logs) {_EVENT}",
    "stored_events": f"with {LOGS}, y as (select *, lower(error_type || ' ' || template || ' ' || message) t from logs), e as (select *, {_ISO.format('ts')} as seen, 'warehouse' as system, coalesce(nullif(error_type, ''), 'log_event') kind, coalesce(nullif(json_extract_string(labels, '$.component'), ''), nullif(json_extract_string(labels, '$.kind'), ''), {SQL_SUBSYSTEM}) component from y) {_EVENT}",
    "subsystems": f"with {LOGS}, y as (select *, lower(error_type || ' ' || template || ' ' || message) t from logs) select {SQL_SUBSYSTEM} subsystem, template, error_type, count(*) n from y group by all",
    "subsystem_logs": f"""with {LOGS}, y as (select *, lower(message) l from logs where {cur}) select count(*) filter (where l like '%youtube%' or l like '%watchdog%' or contains(l, 'stream_service_substate') or l like '%watch url%' or error_type = 'youtube_health') youtube_health,
 count(*) filter (where l like '%rtmps%' or l like '%ffmpeg%' or l like '%stream-engine%' or l like '%send-path%' or l like '%encoder%' or error_type = 'stream_transport') rtmps_ffmpeg,
 count(*) filter (where l like '%restart%' or l like '%recovery%' or l like '%systemd%' or l like '%substate%' or l like '%runtime%' or error_type in ('runtime_restart', 'service_health_failure')) runtime_recovery,
 count(*) filter (where l like '%auth%' or l like '%permission%' or error_type = 'auth_failure') auth_config, count(*) filter (where l like '%connection pool%' or contains(l, 'connection_pool') or l like '%too many connections%' or l like '%pool saturation%' or error_type in ('database_connection_pool', 'connection_pool_exhausted')) database_connection_pool,
 count(*) filter (where l like '%deploy%' or l like '%release%' or l like '%rollout%') deployment_regression, count(*) no_such_subsystem from y""",
    "pattern_summary": f"{_SUM} select 'PATTERN-' || lpad((row_number() over (order by n desc, template, error_type))::varchar, 3, '0') pattern_id, template, error_type, n, baseline_n, {_ISO.format('first_seen')} first_seen, {_ISO.format('last_seen')} last_seen, {_LABEL.format(r='top_rank')} max_severity, example_id, case when top_rank >= 50 or (n >= 5 and baseline_n = 0) then 'critical' when n - baseline_n >= 4 or top_rank >= 40 then 'high' when n - baseline_n >= 2 then 'medium' else 'low' end hint from s",
    "first_row_patterns": f"with {LOGS} select template, error_type, count(*) n, first(message order by ts, log_id) example_log, last(severity order by severity_rank, severity) max_severity from logs where {cur} and service = 'svc-2' group by 1, 2",
    "hourly_patterns": f"{_HOURLY} select * from p",
    "interesting_patterns": f"{_HOURLY}, i as (select * from p where error_type <> 'none' or hint in ('critical', 'high') or lower(template) like '%rtmps%' or lower(template) like '%connection reset%' or lower(template) like '%youtube%' order by case hint when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, case when error_type = 'none' then 1 else 0 end, n desc, first_seen desc, pattern_id limit 60), y as (select *, lower(error_type || ' ' || template || ' ' || example_log) t from i) select pattern_id, {_short('template', 30)} as template, {_short('example_log', 50)} as example_log, error_type, n, hint, {SQL_SUBSYSTEM} subsystem from y",
    "hourly_baseline": f"with {LOGS}, c as (select service, template, error_type, count(*) n from logs where {cur} group by all), b as (select service, template, error_type, count(*) bn, count(distinct date_trunc('hour', ts)) h from logs where {base} group by all) select service, template, error_type, n, coalesce(h, 0) active_hours, coalesce(round(bn / h, 3), 0.0) baseline_per_hour from c left join b using (service, template, error_type)",
    "representative_logs": f"with {LOGS}, r as (select * from logs where environment = 'prod' and {cur} and (error_type <> 'none' or severity in ('WARN', 'WARNING', 'ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY') or lower(message) like '%connection reset%' or lower(message) like '%rtmps%') qualify row_number() over (partition by service, error_type, template order by {_PLAIN_RANK} desc, ts desc, log_id) = 1 order by ts desc, log_id limit 120) select 'LOG-' || lpad((row_number() over (order by ts desc, log_id))::varchar, 3, '0') evidence_id, service, {_short('template', 30)} as template, {_short('message', 50)} as message, error_type, log_id, ts from r",
    "metric_windows": f"{_METRICS} select 'METRIC-' || lpad((row_number() over (order by metric_name))::varchar, 3, '0') metric_id, metric_name, round(baseline_value, 6) baseline_value, round(current_value, 6) current_value, round(current_value - baseline_value, 6) as delta, round((current_value - baseline_value) / nullif(baseline_value, 0), 6) delta_ratio, case when metric_name in ('stream_transport_count', 'active_stream_count', 'audio_energy_count', 'capture_freshness_count') and current_value = 0 and baseline_value > 0 then 'high' when metric_name in ('error_count', 'stream_transport_count', 'service_health_failure_count', 'connection_reset_count') and current_value > baseline_value then 'high' when current_value > 0 then 'medium' else 'low' end hint from m",
    "local_metrics": f"with {LOGS}, {_LOCAL} select * from local",
    "operational_evidence": f"with {LOGS}, {_EVIDENCE} select * from ops",
    "labelled_evidence": f"with {LOGS}, y as (select *, {_NEST.format('metric_name')} mn, coalesce({_NEST.format('source_name')}, resource_type) sn, lower(message || ' ' || template || ' ' || error_type || ' ' || resource_type || ' ' || labels) s from logs where {cur}) select service, count(*) n, last(log_id order by ts, log_id) last_id from y where mn in ('ingest_connected', 'mbps') or sn in ('src-1', 'systemd') or s like '%latency%' or s like '%custom%' group by 1",
    "coverage_ledger": f"{_COVER} select * from v",
    "coverage_summary": f"{_COVER}, g as (select pattern_id, coverage_class, count(*) n from v group by all), k as (select coverage_class, sum(n)::bigint n from g group by 1) select sum(n)::bigint total, sum(n) filter (where pattern_id <> '')::bigint covered, sum(n) filter (where pattern_id = '')::bigint uncovered, round(sum(n) filter (where pattern_id <> '') / sum(n), 6) coverage_ratio, count(*) filter (where pattern_id <> '') patterns, count(*) filter (where pattern_id <> '' and n = 1) singletons, count(*) filter (where pattern_id <> '' and n <= 3) low_frequency, (select string_agg(coverage_class || '=' || n, ',' order by coverage_class) from k) classes from g",
    "coverage_digest": f"{_COVER}, h as (select sha256(concat_ws('|', log_id, pattern_id, coverage_class, facets)) x from v) select count(*) n, sha256(concat_ws('-', " + ", ".join(f"sum(cast('0x' || substr(x, {1 + 8 * k}, 8) as ubigint))::hugeint::varchar" for k in range(8)) + ")) as digest from h",
    "deployments": f"with {LOGS}, x as (select *, case when {cur} then 'incident' else 'lookback' end w from logs where deploy_id is not null and (({cur}) or ({base}))) select deploy_id, min(ts) first_seen, max(ts) last_seen, count(*) n, string_agg(distinct w, ',' order by w) windows, sha256(deploy_id) deploy_sha256 from x group by 1",
    "sample_candidates": f"with {LOGS}, a as (select 'incident' w, log_id, severity, error_type from logs where {cur} and service = 'svc-0' and {_CAND}), q as (select * from logs where {base} and severity_rank < 30 and error_type in ('none', 'http_5xx') order by ts, log_id limit 100) select * from a union all select 'quiet', log_id, severity, error_type from q",
    "evidence_items": f"{_COVER}, {_LOCAL}, {_EVIDENCE} select pattern_id evidence_id, 'log_pattern' kind, template summary, n::double as value, null::varchar interpretation from listed union all select metric_id, 'metric_window', metric_name, current_value, null from local union all select evidence_id, 'operational_evidence', request_id, incident_count::double, interpretation from ops",
    "metric_observations": f"with {LOGS}, {_SEM}, y as (select {_NEST.format('metric_name')} metric_name, {_NEST.format('metric_value')} as text, ts, log_id from logs), z as (select metric_name, last(text order by ts, log_id) as text, last(log_id order by ts, log_id) log_id from y where metric_name is not null group by 1), w as (select z.*, coalesce(zero_behavior, 'unknown') zero_behavior, try_cast(text as double) x from z left join sem using (metric_name)) select metric_name, text, log_id, zero_behavior, case when x is null then 'observed' when zero_behavior = 'suspicious' and x = 0 then 'suspicious_zero_or_gap' when zero_behavior = 'healthy' and x = 0 then 'healthy_zero' when regexp_matches(metric_name, '_(ok|connected|active|available|present|up)$') then case when x >= 1 then 'healthy' else 'suspicious_zero_or_gap' end when metric_name like '%fail_count' then case when x = 0 then 'healthy_zero' else 'nonzero_count' end else 'observed' end assessment, 'int' as kind from w",
    "metric_semantics": f"{_METRICS}, {_SEM} select metric_name, coalesce(semantic_type, 'unknown') semantic_type, coalesce(zero_behavior, 'unknown') zero_behavior, coalesce(subsystem, 'general') subsystem, coalesce(core_target_type, '') core_target_type from m left join sem using (metric_name)",
    "message_fields": f"with {LOGS}, y as (select log_id, unnest({_KV.format(1)}) as key, unnest({_KV.format(2)}) as value from logs), z as (select key, regexp_replace(value, '[,;]+$', '') x from y) select key, case when lower(x) in ('true', 'false') then 'bool' when lower(x) in ('none', 'null') then 'null' when regexp_full_match(x, '[+-]?[0-9]+') then 'int' when regexp_full_match(x, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?') then 'float' else 'text' end as kind, count(*) n, round(sum(case when regexp_full_match(x, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(x as double) end), 3) total, count(*) filter (lower(x) = 'true') truths from z group by all",
    "time_windows": f"""with {LOGS}, ends as (select service, min(ts) f, max(ts) l from logs group by 1), cs(place, m, h, dd, label) as (values (0, 90, 24, 7, '1d'), (1, 1440, 6, 3, '6h'), (2, 2880, 36, 90, '36h')),
x as (select *, l - m * interval 1 minute as s from ends, cs), y as (select *, greatest(f, s - dd * interval 1 day) as b from x) select service, place, s as incident_start, s - h * interval 1 hour as lookback_start, b as baseline_start, m::bigint as minutes, label, round(greatest(date_diff('second', b, s) / 86400.0::double, 1.0::double), 4) as baseline_days, m >= 1440 as long_enough from y""",
    "texts_and_severity": f"with {LOGS}, y as (select *, lower(message) l from logs), z as (select *, string_split_regex(l, '[.;!?]') parts from y) select event_id, {_LEVEL.format('l')} by_text, " + " or ".join(rf"len(list_filter(parts, lambda s: regexp_matches(s, '\b{w}\b') and not regexp_matches(s, '\b(no|without)\b.{{0,90}}\b{w}\b') and not regexp_matches(s, '\b{w}\b.{{0,50}}\b(not observed|not present|absent)\b'))) > 0" for w in ("timeout", "error", "http 500")) + r" as signal, substr(trim(regexp_replace(lower(template), '[^\p{L}\p{N}]+', '_', 'g'), '_'), 1, 120) as name from z",
    "event_severities": """with a as (select event_id, case when event_id % 3 = 0 then 'said' end message, case when event_id % 11 = 0 then 'notice' end as level, case event_id % 7 when 0 then 'fatal' when 1 then 'Degraded' when 2 then 'unhealthy' when 3 then '' end status, case when event_id % 5 = 0 then 'false' end healthy,
 case event_id % 8 when 0 then 'none' when 1 then 'stall' end fk, case event_id % 9 when 0 then 'warn' when 1 then 'failed' end j, case event_id % 10 when 0 then 'crash_report' when 1 then 'restart' when 2 then 'tick' end kind, case when event_id % 4 = 0 then user_id::varchar end mbps from events where event_id is not null)
 select event_id, case when level is not null then 'NOTICE' when status = 'fatal' then 'CRITICAL' when status = 'unhealthy' then 'ERROR' when status = 'Degraded' then 'WARN' when healthy = 'false' then 'ERROR' when fk = 'stall' then 'ERROR' when j = 'warn' then 'WARN' when j = 'failed' then 'ERROR' when kind = 'crash_report' then 'ERROR' when kind = 'restart' then 'WARN' else 'INFO' end severity,
 concat_ws(' ', coalesce(message, kind, 'event'), 'kind=' || kind, 'status=' || nullif(status, ''), 'healthy=' || healthy, 'failure_kind=' || fk, 'judgment=' || j, 'mbps=' || mbps) message from a""",
    "window_candidates": f"with {LOGS}, e as (select max(ts) end_ts from logs), r as (select unnest([2, 5, 7])::int as days), o as (select days, count(*) n, count(*) filter (where severity_rank >= 40) errors, count(distinct service) services from logs, e, r where ts >= end_ts - to_days(days) and ts <= end_ts group by 1) select *, row_number() over (order by days desc, n desc)::int as choice from o",
    "top_counts": f"with {LOGS}, x as (select 'service' as col, service as val from logs union all select 'severity', severity from logs union all select 'error_type', error_type from logs) select col, val, count(*) n, row_number() over (partition by col order by count(*) desc, val)::int as rank from x group by col, val qualify rank <= 3",
    "dominant_service": f"with {LOGS} select error_type, service, count(*) n from logs group by 1, 2 qualify row_number() over (partition by error_type order by n desc, service) = 1",
    "evidence_gaps": f"with {LOGS}, x as (select *, hour(ts)::int hour_slot from logs) select service, error_type, hour_slot, count(*) n from x b where {base} and not exists (select 1 from x c where c.ts >= timestamp '2024-01-27 00:00:00' and c.ts < timestamp '{INCIDENT[1]}' and c.service = b.service and c.error_type = b.error_type and c.hour_slot = b.hour_slot) group by all",
    "label_histogram": "with x as (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) k from events) select event_type, count(k) n, count(distinct k) kinds, min(k) least, max(k) most from x group by 1",
    "severity_histogram": f"with {LOGS}, c as (select service, severity, count(*) n from logs group by all) select service, string_agg(severity || ':' || n, ',' order by severity) pairs, '{{\"n\":' || sum(n) || ',\"service\":\"' || service || '\"}}' as json from c group by 1",
}
