"""Queries over the signals of a bundle and its candidate targets. Twins are written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import logs as L
from emberlog.operators import relational as R
from emberlog.operators import signals as S

from . import patterns as P
from .facts import BASELINE, INCIDENT, logs, stored


def _metrics(spark, d):
    return stored(spark, d, "signal-metrics", lambda: _metrics_of(spark, d))


def _metrics_of(spark, d):
    """The incident's metrics with their semantics, and two of the profile that report zero."""
    m = P.metric_windows(spark, d).select("metric_id", "metric_name", "baseline_value", "current_value")
    more = spark.createDataFrame([("METRIC-101", "request_count", 12.0, 0.0), ("METRIC-102", "ffmpeg_process_count", 3.0, 0.0), ("METRIC-103", "connection_reset_count", 0.0, 0.0), ("METRIC-104", "runtime_restart_count", 1.0, 9.0), ("METRIC-105", "mbps", 2.5, 0.0)], m.schema)
    return L.semantics(m.unionByName(more), P._profile(spark))


def _patterns(spark, d):
    return stored(spark, d, "signal-patterns", lambda: _patterns_of(spark, d))


def _patterns_of(spark, d):
    p = L.pattern_summaries(logs(spark, d), "*", "prod", INCIDENT, BASELINE, 200)
    hint = L.severity_hint(F.col("n"), F.col("baseline_n"), F.col("top_rank"))
    return p.select(F.concat(F.lit("P-"), F.substring(F.sha2(F.concat_ws("|", "template", "error_type"), 256), 1, 8)).alias("pattern_id"), "template", F.lit("").alias("example_log"), "error_type", hint.alias("hint"))


def _operational(spark, d):
    return stored(spark, d, "signal-operational", lambda: _operational_of(spark, d))


def _operational_of(spark, d):
    """The incident's operational evidence, and two requests that only the baseline answers."""
    o = L.operational_evidence(logs(spark, d), INCIDENT, BASELINE, 3).select("evidence_id", "request_id", "need", "subsystem", "incident_count", "baseline_count")
    gaps = spark.createDataFrame([("OPS-101", "throughput_query", "throughput_signal", "traffic", 0, 9), ("OPS-102", "scheduler_query", "scheduler_history", "background_processing", 0, 2), ("OPS-103", "silent_query", "resource_pressure", "resource_pressure", 0, 0)], o.schema)
    return o.unionByName(gaps)


def _flat(s: DataFrame) -> DataFrame:
    return s.withColumn("evidence", F.array_join("evidence", ","))


def metric_signals(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.metric_signals(_metrics(spark, d)))


def pattern_signals(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.pattern_signals(_patterns(spark, d)))


def gap_signals(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.gap_signals(_operational(spark, d)))


def conflict_signals(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.conflict_signals(_operational(spark, d), _metrics(spark, d)))


def all_signals(spark: SparkSession, d: str) -> DataFrame:
    m, o = _metrics(spark, d), _operational(spark, d)
    every = S.metric_signals(m).unionByName(S.pattern_signals(_patterns(spark, d))).unionByName(S.gap_signals(o)).unionByName(S.conflict_signals(o, m))
    return S.deduplicated(every)


def _targets(spark, d):
    return stored(spark, d, "targets", lambda: S.candidate_targets(all_signals(spark, d)))


def signal_list(spark: SparkSession, d: str) -> DataFrame:
    return _flat(all_signals(spark, d)).drop("ids")


def candidate_targets(spark: SparkSession, d: str) -> DataFrame:
    t = _targets(spark, d)
    return t.select("target_id", "target", "subsystem", "route", F.array_join("signal_ids", ",").alias("signal_ids"), F.array_join("refs", ",").alias("refs"), "score", "mode", "reasons", "action", "parent")


def review_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.graph_counts(_targets(spark, d))


def evidence_requests(spark: SparkSession, d: str) -> DataFrame:
    return S.evidence_requests(_targets(spark, d))


def text_targets(spark: SparkSession, d: str) -> DataFrame:
    """The target that each template's text names."""
    p = R.in_window(logs(spark, d), *INCIDENT).groupBy("template", "error_type").agg(F.count("*").alias("n"))
    return p.select("template", "error_type", S.target_of_text(F.concat_ws(" ", "template", "error_type")).alias("target"))


QUERIES = {f.__name__: f for f in (metric_signals, pattern_signals, gap_signals, conflict_signals, signal_list, candidate_targets, review_graph, evidence_requests, text_targets)}


# ---- twins

_BODY = P._METRICS.removeprefix("with ")
_SQL_METRICS = f"""mm as (select 'METRIC-' || lpad((row_number() over (order by metric_name))::varchar, 3, '0') metric_id, metric_name, round(baseline_value, 6) bv, round(current_value, 6) cv from m union all select * from (values ('METRIC-101', 'request_count', 12.0::double, 0.0::double), ('METRIC-102', 'ffmpeg_process_count', 3.0, 0.0), ('METRIC-103', 'connection_reset_count', 0.0, 0.0), ('METRIC-104', 'runtime_restart_count', 1.0, 9.0), ('METRIC-105', 'mbps', 2.5, 0.0)) t),
{P._SEM.replace("('error_count',", "('request_count', 'throughput', 'suspicious', 'traffic', 'throughput_disappearance'), ('error_count',")},
mt as (select metric_id, metric_name, bv, cv, coalesce(semantic_type, 'unknown') st, coalesce(zero_behavior, 'unknown') z, coalesce(subsystem, 'general') sub, coalesce(core_target_type, '') tt from mm left join sem using (metric_name)),
ms as (select 'zero_is_bad_drop' signal_type, case when tt = '' then 'throughput_disappearance' else tt end target, 'primary_candidate' route, sub subsystem, metric_id evidence, metric_name, 'high' severity, 0.92::double score from mt where z = 'suspicious' and bv > 0 and cv = 0
 union all select 'zero_is_good_stable', case when tt = '' then 'monitoring_gap' else tt end, 'monitor_only', sub, metric_id, metric_name, 'low', 0.25 from mt where z = 'healthy' and cv = 0 and bv >= 0
 union all select 'metric_spike', tt, case when tt = 'restart_loop' and cv >= 5 then 'primary_candidate' else 'validation_target' end, sub, metric_id, metric_name, case when tt = 'restart_loop' and cv >= 5 then 'high' else 'medium' end, case when tt = 'restart_loop' and cv >= 5 then 0.82 else 0.72 end from mt where tt <> '' and st in ('error', 'warning', 'restart', 'resource') and cv > bv and cv > 0 and not (z = 'healthy' and cv = 0))"""
_GOOD = "regexp_matches(t, 'status=ok|healthy=true|watchdog_ok|runtime_status=running|status=running|last_health_ok=true|judgment=ok|ok=true')"
_BAD = "regexp_matches(t, 'failed|failure|timed out|timeout|connection reset|crashloop|exited with code|exit code|restarting in|unhealthy|healthy=false|local_ok=false|public_ok=false|api_ok=false|oauth_ok=false|ingest_connected=false|stream_active=false|degraded|network_down|tcp_stall|no such file|not found|missing')"
_TARGET = """case when regexp_matches(t, 'can.t open file|no such file or directory|configured command missing|configured job command|job configuration mismatch') then 'job_configuration_mismatch' when regexp_matches(t, 'failed to start|main process exited|service start failure') then 'service_start_failure' when regexp_matches(t, '(throughput|traffic|request count) dropped to zero') then 'throughput_disappearance' when regexp_matches(t, 'heartbeat missing|liveness missing') then 'heartbeat_missing' when regexp_matches(t, 'error spike|errors increased|5xx') then 'error_spike' when regexp_matches(t, 'warning spike|warnings increased') then 'warning_spike'
 when regexp_matches(t, 'restart loop|runtime restart|crashloop') then 'restart_loop' when regexp_matches(t, 'state mismatch|healthy but dead|contradicts') then 'state_mismatch' when regexp_matches(t, 'external dependency|dependency failure|dependency timeout') then 'external_dependency_failure' when regexp_matches(t, 'connection reset|packet loss|reconnect') then 'network_error_signal' when regexp_matches(t, 'freshness gap|stale data|timestamp drift') then 'freshness_signal_gap' when regexp_matches(t, 'user impact|success rate|experience signal') then 'user_impact_signal_gap'
 when regexp_matches(t, 'resource saturation|cpu pressure|memory pressure|oom') then 'resource_saturation' when regexp_matches(t, 'deploy|release|rollout') then 'deployment_correlation' when regexp_matches(t, 'missing evidence|observability gap|log gap|metric gap') then 'monitoring_gap' else '' end"""
_SQL_PATTERNS = f"""pc as (select template, error_type, count(*) n, max(severity_rank) top_rank from logs where environment = 'prod' and ts >= timestamp '{INCIDENT[0]}' and ts < timestamp '{INCIDENT[1]}' group by all), pb as (select template, error_type, count(*) bn from logs where environment = 'prod' and ts >= timestamp '{BASELINE[0]}' and ts < timestamp '{BASELINE[1]}' group by all),
p0 as (select template, error_type, n, top_rank, coalesce(bn, 0) bn from pc left join pb using (template, error_type) order by n desc, template, error_type limit 200),
p1 as (select 'P-' || substr(sha256(template || '|' || error_type), 1, 8) id, error_type, case when top_rank >= 50 or (n >= 5 and bn = 0) then 'critical' when n - bn >= 4 or top_rank >= 40 then 'high' when n - bn >= 2 then 'medium' else 'low' end hint, lower(template || '  ' || error_type) t from p0),
p2 as (select *, {_GOOD} and not {_BAD} well, {_BAD} bad, {_TARGET} tg, error_type = 'job_configuration_mismatch' lost, error_type = 'service_start_failure' or t like '%failed to start%' unst from p1),
p3 as (select *, not lost and not unst and tg <> '' and not well and (hint in ('high', 'critical') or error_type in ('dependency_timeout', 'service_health_failure') or (error_type = 'runtime_restart' and bad) or bad) named, {P.SQL_SUBSYSTEM} tsub from p2),
ps as (select 'missing_command' signal_type, 'job_configuration_mismatch' target, 'primary_candidate' route, 'job_configuration' subsystem, id evidence, '' metric_name, 'high' severity, 0.90::double score from p3 where lost
 union all select 'repeated_failure', 'service_start_failure', 'validation_target', 'runtime_recovery', id, '', 'medium', 0.68 from p3 where not lost and unst
 union all select 'profile_log_pattern', tg, 'validation_target', case tg when 'error_spike' then 'generic_runtime' when 'restart_loop' then 'runtime_recovery' when 'network_error_signal' then 'network_transport' when 'resource_saturation' then 'resource_pressure' else tsub end, id, '', case when hint in ('high', 'critical') then 'high' else 'medium' end, 0.62 from p3 where named
 union all select 'restart_loop', 'restart_loop', 'validation_target', 'runtime_recovery', id, '', 'medium', 0.66 from p3 where not named and not well and (regexp_matches(t, 'crashloop|restart loop|runtime restart|exited with code|restarting in') or (error_type = 'runtime_restart' and bad))
 union all select 'network_or_external_error', case when regexp_matches(t, 'connection reset|reconnect') then 'network_error_signal' else 'external_dependency_failure' end, 'validation_target', case when regexp_matches(t, 'connection reset|reconnect') then 'network_transport' else 'downstream_dependency' end, id, '', 'medium', 0.62 from p3 where not named and not well and not (regexp_matches(t, 'crashloop|restart loop|runtime restart|exited with code|restarting in') or (error_type = 'runtime_restart' and bad)) and regexp_matches(t, 'connection reset|reconnect|timeout|timed out'))"""
_SQL_OPS = f"{P._EVIDENCE.replace('x as (', 'ox as (').replace(' from x ', ' from ox ')}, oe as (select evidence_id, request_id, need, subsystem, incident_count, baseline_count from ops union all select * from (values ('OPS-101', 'throughput_query', 'throughput_signal', 'traffic', 0, 9), ('OPS-102', 'scheduler_query', 'scheduler_history', 'background_processing', 0, 2), ('OPS-103', 'silent_query', 'resource_pressure', 'resource_pressure', 0, 0)) t), gs as (select 'evidence_gap' signal_type, case need when 'throughput_signal' then 'throughput_disappearance' when 'process_state' then 'service_start_failure' when 'external_dependency_status' then 'external_dependency_failure' when 'network_path' then 'network_error_signal' when 'freshness_signal' then 'freshness_signal_gap' when 'user_impact_signal' then 'user_impact_signal_gap' when 'state_transition' then 'state_mismatch' else 'monitoring_gap' end target, case when need = 'throughput_signal' then 'primary_candidate' else 'validation_target' end route, subsystem, evidence_id evidence, '' metric_name, case when need = 'throughput_signal' then 'high' else 'medium' end severity, case when need = 'throughput_signal' then 0.84 else 0.58 end::double score from oe where incident_count = 0 and baseline_count > 0)"
_WORDS = "list_sort(list_distinct(list_filter(regexp_extract_all({}, '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in ('count', 'query', 'signal', 'metric', 'metrics', 'stream', 'ops', 'evidence', 'status', 'state', 'path'))))"
_CONFLICT = f"cw as (select *, {_WORDS.format(chr(34) + 'request_id' + chr(34) + ' || chr(32) || need')} ow from oe where incident_count > 0), mw as (select *, {_WORDS.format('metric_name')} w from mt where cv = 0 and z <> 'suspicious'), cs as (select 'log_metric_conflict' signal_type, 'instrumentation_mismatch' target, 'validation_target' route, subsystem, evidence_id || ',' || metric_id evidence, metric_name, 'medium' severity, 0.62::double score from cw join mw on len(ow) > 0 and len(w) > 0 and (list_has_any(ow, w) or len(list_filter(w, lambda q: contains(array_to_string(ow, ' '), q))) > 0 or len(list_filter(ow, lambda q: contains(array_to_string(w, ' '), q))) > 0))"
_ALL = f"with {_BODY}, {_SQL_METRICS}, {_SQL_PATTERNS}, {_SQL_OPS}, {_CONFLICT}, u as (select * from ms union all select * from ps union all select * from gs union all select * from cs), sg as (select *, 'SIG-' || substr(sha256(concat_ws('|', signal_type, target, subsystem, evidence, metric_name, route)), 1, 12) signal_id from u qualify row_number() over (partition by signal_type, target, subsystem, evidence, metric_name order by score desc, route, severity) = 1)"
_TARGETS = f"""{_ALL}, tg0 as (select target, subsystem, route, list_sort(list_distinct(list(signal_id))) sids, list_sort(list_distinct(flatten(list(string_split(evidence, ','))))) refs, round(max(score), 4) score, list_sort(list_distinct(list(signal_type))) kinds from sg group by 1, 2, 3),
tg1 as (select *, case when route = 'monitor_only' then 'monitor_only' when route = 'primary_candidate' and target in ('throughput_disappearance', 'heartbeat_missing', 'job_configuration_mismatch') then 'incident_candidate' else 'validation_target' end as mode, 'CT-' || substr(sha256(concat_ws('|', target, subsystem, route, array_to_string(sids, ','))), 1, 10) target_id from tg0),
pr as (select target_id prim from tg1 where mode = 'incident_candidate' order by score desc, target_id limit 1),
tgs as (select target_id, target, subsystem, route, array_to_string(sids, ',') signal_ids, array_to_string(refs, ',') refs, score, mode, array_to_string(list_concat(list_transform(kinds, lambda x: x || ' detected'), [case mode when 'incident_candidate' then 'strong signal routed as primary candidate' when 'validation_target' then 'routed as validation target' else 'routed as monitor-only' end]), ';') reasons, case when mode = 'incident_candidate' then 'review_evidence' when target = 'instrumentation_mismatch' then 'compare_sources' else 'collect_more_data' end as action, case when mode = 'validation_target' then coalesce((select prim from pr), '') else '' end parent from tg1)"""
ORACLES = {
    "metric_signals": f"with {_BODY}, {_SQL_METRICS} select * from ms",
    "pattern_signals": f"with {_BODY}, {_SQL_PATTERNS} select * from ps",
    "gap_signals": f"with {_BODY}, {_SQL_OPS} select * from gs",
    "conflict_signals": f"with {_BODY}, {_SQL_METRICS}, {_SQL_OPS}, {_CONFLICT} select * from cs",
    "signal_list": f"{_ALL} select * from sg",
    "candidate_targets": f"{_TARGETS} select * from tgs",
    "review_graph": f"{_TARGETS} select count(*) filter (where mode = 'incident_candidate') incident_candidate, count(*) filter (where mode = 'validation_target') validation_target, count(*) filter (where mode = 'monitor_only') monitor_only, count(distinct target) targets from tgs",
    "evidence_requests": f"""{_TARGETS}, rq(target, request_id) as (values ('throughput_disappearance', 'throughput_signal_query'), ('throughput_disappearance', 'process_state_query'), ('job_configuration_mismatch', 'job_definition_query'), ('job_configuration_mismatch', 'installed_artifact_query'), ('job_configuration_mismatch', 'scheduler_history_query'), ('network_error_signal', 'network_path_query'), ('external_dependency_failure', 'external_dependency_status_query'), ('service_start_failure', 'process_state_query'), ('restart_loop', 'process_state_query'), ('restart_loop', 'state_transition_query'),
 ('instrumentation_mismatch', 'instrumentation_consistency_query'), ('monitoring_gap', 'log_completeness_query'), ('error_spike', 'error_sample_query'), ('user_impact_signal_gap', 'user_impact_signal_query'), ('freshness_signal_gap', 'freshness_signal_query'), ('state_mismatch', 'state_transition_query'), ('deployment_correlation', 'deployment_correlation_query'), ('resource_saturation', 'resource_state_query')) select request_id, count(*) asked_by, max(score) score from tgs join rq using (target) where mode <> 'monitor_only' group by 1""",
    "text_targets": f"with {P.LOGS}, g as (select template, error_type, lower(template || ' ' || error_type) t from logs where ts >= timestamp '{INCIDENT[0]}' and ts < timestamp '{INCIDENT[1]}' group by all) select template, error_type, {_TARGET} target from g",
}
