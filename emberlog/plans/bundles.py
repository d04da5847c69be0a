"""Queries over evidence bundles, one for each service and hour: local claims, absence claims, relations. Twins by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import bundles as B
from emberlog.operators import logs as L
from emberlog.operators import relational as R
from emberlog.operators import signatures as S

from . import patterns as P
from . import reviews as V
from . import signals as G
from .facts import INCIDENT, LOGS, cur, logs, stored


def _bundled(spark, d):
    hour = F.date_format("ts", "yyyy-MM-dd HH")
    return logs(spark, d).withColumn("bundle_id", F.concat_ws("/", "service", hour))


def _items(spark, d):
    """The items of all bundles: patterns, the most frequent first, then metrics that are over zero, then deployments."""
    def build():
        rows = _bundled(spark, d)
        p = rows.groupBy("bundle_id", "template", "error_type").agg(F.count("*").alias("n"))
        ref = F.concat(F.lit("P-"), F.substring(F.sha2(F.concat_ws("|", "template", "error_type"), 256), 1, 8))
        p = p.select("bundle_id", ref.alias("ref"), (1_000_000_000 - F.col("n")).alias("place"), F.col("error_type").alias("event_type"), F.concat_ws(" ", F.lit("pattern"), ref, "template", "error_type").alias("text"))
        kinds = {"error_count": "severity_rank >= 40", "http_5xx_count": "error_type = 'http_5xx'", "checkout_500_count": "event_type = 'purchase' and error_type = 'http_5xx'", "db_pool_exhausted_count": "error_type = 'connection_pool_exhausted'", "runtime_restart_count": "error_type = 'runtime_restart'"}
        m = rows.groupBy("bundle_id").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in kinds.items()], F.count_distinct("trace_id").alias("unique_trace_count"))
        m = m.unpivot("bundle_id", [*kinds, "unique_trace_count"], "metric_name", "metric_value").where("metric_value > 0")
        m = m.select("bundle_id", F.concat(F.lit("M-"), "metric_name").alias("ref"), F.lit(2_000_000_000).cast("long").alias("place"), F.lit("metric").alias("event_type"), F.concat_ws(" ", F.lit("metric metric_name"), "metric_name").alias("text"), "metric_name", F.col("metric_value").cast("double").alias("metric_value"))
        c = rows.where("deploy_id is not null").select("bundle_id", "deploy_id").distinct()
        c = c.select("bundle_id", F.concat(F.lit("D-"), "deploy_id").alias("ref"), F.lit(3_000_000_000).cast("long").alias("place"), F.lit("deployment_event").alias("event_type"), F.concat_ws(" ", F.lit("deployment deploy_id"), "deploy_id").alias("text"))
        every = p.unionByName(m, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
        return B.with_terms(every.withColumn("text", F.lower("text")))

    return stored(spark, d, "bundle-items", build)


def _causes(spark, d):
    return B.bundle_causes(_items(spark, d), B.rule_table(spark, B.CAUSE_RULES), B.rule_table(spark, B.CONTRAST_RULES))


def _claims(spark, d):
    def build():
        who = _bundled(spark, d).groupBy("bundle_id", "service").agg(F.min("environment").alias("environment"), F.min("ts").alias("window_start"), F.max("ts").alias("window_end"), F.count_distinct("deploy_id").alias("deployments"))
        return B.local_claims(_causes(spark, d), B.first_refs(_items(spark, d), B.REF_SETS), who)

    return stored(spark, d, "local-claims", build)


def bundle_causes(spark: SparkSession, d: str) -> DataFrame:
    """Each bundle's cause and other explanation, and the places of the rules that gave them."""
    return _causes(spark, d).drop("bits")


def cited_items(spark: SparkSession, d: str) -> DataFrame:
    """The first items that each role's terms meet in each bundle."""
    return B.first_refs(_items(spark, d), B.REF_SETS).select("bundle_id", "cites", F.array_join("refs", ",").alias("refs"))


def local_claims(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    return c.select("claim_id", "bundle_id", "role", "place", "claim_type", "claim_text", "cause", F.array_join("refs", ",").alias("refs"), F.array_join("missing", "|").alias("missing"), "temporary_action", "permanent_action", "authority")


# ---- claims of absence

#: The test data's statements of reviewers on every bundle: what they say is absent, and what they ask for.
ABSENCES = (
    "No direct evidence of HTTP 500s is in the bundle.", "No checkout failures were seen.", "No evidence of pool exhaustion is in the corpus.", "Only successful calls are logged; no error patterns.", "No database metrics are available.",
    "No correlated error logs or timeouts were found.", "No error signals are cited in this chunk.", "Absence of error signals in the logs.", "Restarts were not observed.", "The bundle does not include a timeout.", "A timeout is likely.",
    "checkout_500_count is missing.", "The db_pool_exhausted_count series was not provided.", "Deployment logs are missing.", "  Restarts were not observed. ", "",
)
REQUESTS = (
    "HTTP 500 error logs or metrics", "HTTP 5xx error logs", "http 500 error log metric", "Checkout failure logs", "Pool exhaustion logs", "Pool exhaustion logs and metrics", "Restart events", "Application error logs", "Application error logs of today",
    "HTTP 500 metric counts", "db_pool_exhausted_count metrics", "db_pool_exhausted_count of last week", "Runtime error logs (HTTP 500s, stack traces)", "Restart or watchdog behavior logs", "Deployment event logs", "Deployment manifest diff", "Database server logs",
    "HTTP 5xx time-series metrics tied to this review unit.", " Database server logs ",
)


def bundle_facts(spark: SparkSession, d: str) -> DataFrame:
    """What the items of each bundle show, by name."""
    f = B.bundle_facts(_items(spark, d))
    names = F.array_compact(F.array(*[F.when(F.col("facts").bitwiseAND(F.lit(1 << k)) > 0, F.lit(n)) for k, n in enumerate(B.FACTS)]))
    return f.select("bundle_id", F.array_join(names, ",").alias("facts"))


def _reconciled(spark, d):
    said = _items(spark, d).select("bundle_id").distinct().withColumns({"absences": F.array(*map(F.lit, ABSENCES)), "missing": F.array(*map(F.lit, REQUESTS))})
    return B.reconciled(said, B.bundle_facts(_items(spark, d)), "absences", "missing")


def contradicted_absences(spark: SparkSession, d: str) -> DataFrame:
    """What reviewers call absent though the bundle shows it, and what of their statements stays."""
    return _reconciled(spark, d).select("bundle_id", F.array_join("contradicted", "|").alias("contradicted"), F.array_join("absences", "|").alias("kept"))


def reconciled_missing(spark: SparkSession, d: str) -> DataFrame:
    """What reviewers still need once the bundle's facts are taken off."""
    return _reconciled(spark, d).select("bundle_id", F.array_join("missing", "|").alias("missing"))


# ---- signatures

#: Who answers for a role: a provider and its model.
MODELS = {"hypothesis_generator": ("rules-a", "hypothesis-1"), "evidence_verifier": ("rules-a", "verifier-1"), "contrast_agent": ("rules-b", "contrast-1")}


def _meant(spark, d):
    """Items with the meaning of their metrics."""
    return L.semantics(_items(spark, d).withColumn("metric_name", F.coalesce("metric_name", F.lit(""))), P._profile(spark))


def _signed(spark, d):
    def build():
        c = _claims(spark, d).withColumn("text", F.concat_ws(" ", "claim_text", F.array_join("missing", " "), "temporary_action", "permanent_action"))
        target, sub = S.claim_target(F.lit(""), F.col("claim_text")), S.claim_subsystem(F.lit(""), F.col("claim_text"))
        c = c.withColumns({"own_target": target, "own_subsystem": sub, "subsystem": sub["value"]})
        named = (F.col("role") == "contrast_agent") & (F.col("own_target.step") != "default")
        c = c.withColumn("identity", F.when(named, F.array("own_target.value")).otherwise(F.array().cast("array<string>")))
        profile = P._profile(spark).withColumn("place", F.when(F.col("metric_name") == "mbps", 0).when(F.col("metric_name") == "fail_count", 1).otherwise(2))
        c = S.with_cited(c, _meant(spark, d)).join(F.broadcast(S.subsystem_targets(profile)), "subsystem", "left")  # a row for each subsystem of a profile
        return S.with_review_target(S.with_signature(c))

    return stored(spark, d, "signed-claims", build)


def claim_signatures(spark: SparkSession, d: str) -> DataFrame:
    """What each local claim is of, its type of target, and the steps that decided."""
    c = _signed(spark, d)
    chains = [F.col(f"{x}.{f}").alias(n) for x, n, f in (("own_target", "own_target", "value"), ("own_target", "target_step", "step"), ("own_subsystem", "subsystem", "value"), ("own_subsystem", "subsystem_step", "step"), ("signature", "signature", "value"), ("signature", "signature_step", "step"), ("review_target", "review_target", "value"), ("review_target", "review_step", "step"))]
    return c.select("claim_id", *chains)


def metric_zeros(spark: SparkSession, d: str) -> DataFrame:
    """What zero means for the metrics that claims cite."""
    return S.zero_semantics(_claims(spark, d), _meant(spark, d)).groupBy("metric_name", "meaning", "semantic_type", "core_target_type").agg(F.count("*").alias("claims"))


def _clusters(spark, d):
    def build():
        c = _signed(spark, d)
        kind, role = F.col("claim_type"), F.col("role")
        pair = F.create_map(*[x for r, (a, b) in MODELS.items() for x in (F.lit(r), F.struct(F.lit(a).alias("provider"), F.lit(b).alias("model")))])[role]
        level = F.when(kind.isin("counter_evidence", "validation_target"), "high").when((kind == "support") | (F.col("permanent_action") != ""), "medium").otherwise("low")
        c = c.withColumns({"provider": pair["provider"], "model": pair["model"], "priority": level, "counter": kind == "counter_evidence", "actions": (F.col("temporary_action") != "") | (F.col("permanent_action") != "")})
        c = c.withColumns({"signature": F.col("signature.value"), "review_target": F.col("review_target.value"), "score": F.when(level == "high", 1.0).when(level == "medium", 0.65).otherwise(0.35), "mode": F.when(kind == "support", "incident_candidate").otherwise("validation_target")})
        return S.signature_clusters(c)

    return stored(spark, d, "signature-clusters", build)


def signature_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Claims of several models united by signature, with the bundle's best incident as the parent of what validates it."""
    c = _clusters(spark, d)
    return c.select("cluster_id", "bundle_id", "subsystem", "signature", "members", "representative", "score", F.array_join("providers", ",").alias("providers"), F.array_join("models", ",").alias("models"), "refs", "wants", "parent")


def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    b = S.score_breakdown(_clusters(spark, d), len({p for p, _ in MODELS.values()}))
    return b.select("cluster_id", "review_target", "evidence_strength", "actionability", "user_impact_risk", "agreement", "diversity", "missing_penalty", "duplicate_penalty")


# ---- relations between items


def _related(spark, d):
    """Items of reviews.py with their texts: those of pools say so, the dependency timeouts of one service are a gateway's."""
    t = F.expr("case when error_type = 'connection_pool_exhausted' then 'pool exhausted' when service = 'svc-1' and error_type = 'dependency_timeout' then 'Payment gateway is slow' else '' end")
    return V._items(spark, d).select(F.col("item").alias("item_id"), F.col("error_type").alias("event_type"), t.alias("text")).distinct()


def _deployments_before(spark, d):
    # the test data's deployments are those of a day
    dep = R.in_window(logs(spark, d), *INCIDENT).where("deploy_id is not null").groupBy(F.concat_ws("/", "deploy_id", F.date_format("ts", "dd")).alias("deploy_id")).agg(F.max("ts").alias("last_seen")).withColumn("k", F.lit(1))
    seen = V._items(spark, d).groupBy("item").agg(F.min("ts").alias("first_seen"), F.max("severity_rank").alias("top")).where("top >= 40").withColumn("k", F.lit(1))
    before = R.range_join(dep, seen, ["k"], "last_seen", "first_seen", 1800)
    return before.select(F.concat(F.lit("deployment/"), "deploy_id").alias("left_id"), F.col("item").alias("right_id"), "gap_s")


def _edges(spark, d):
    def build():
        pair = [F.col("a").alias("left_id"), F.col("b").alias("right_id")]
        return B.relation_edges(V.shared_traces(spark, d).select(*pair, "shared"), V.overlapping_items(spark, d).select(*pair), _deployments_before(spark, d))

    return stored(spark, d, "relation-edges", build)


def relation_edges(spark: SparkSession, d: str) -> DataFrame:
    """All relations between items as one typed table of edges."""
    return _edges(spark, d)


def _suggested(edges, items):
    c = B.relationship_candidates(edges, items)
    return c.withColumns({"refs": F.array_join("refs", ","), "missing": F.array_join("missing", "|")})


def high_signal_candidates(spark, d):
    """The candidates of relation_edges, of which candidate_inputs is made."""
    return _suggested(_edges(spark, d), _related(spark, d))


def relationship_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What the relations of all items from WARN on suggest."""
    items = stored(spark, d, "signal-items", lambda: V._signal_items(spark, d).withColumnRenamed("item", "item_id").join(_related(spark, d), "item_id"))
    traces, overlaps = B.suggesting_pairs(V._items(spark, d).select(F.col("item").alias("item_id"), "trace_id"), items.select("item_id", "s", "e"), items)
    return _suggested(B.relation_edges(traces, overlaps, _deployments_before(spark, d)), items)


QUERIES = {f.__name__: f for f in (bundle_causes, cited_items, local_claims, bundle_facts, contradicted_absences, reconciled_missing, relation_edges, relationship_candidates, claim_signatures, metric_zeros, signature_clusters, score_breakdown)}


# ---- twins


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _has(*terms: str) -> str:
    return "(" + " or ".join(f"contains(text, {_q(t)})" for t in terms) + ")"


def _any(*terms: str) -> str:
    return f"bool_or{_has(*terms)}"


_BI = f"""with {LOGS}, bl as (select *, service || '/' || strftime(ts, '%Y-%m-%d %H') as bundle_id from logs),
bp as (select bundle_id, template, error_type, count(*) n from bl group by all),
bm as (select bundle_id, unnest([{{'m': 'error_count', 'v': count(*) filter (severity_rank >= 40)}}, {{'m': 'http_5xx_count', 'v': count(*) filter (error_type = 'http_5xx')}}, {{'m': 'checkout_500_count', 'v': count(*) filter (event_type = 'purchase' and error_type = 'http_5xx')}},
 {{'m': 'db_pool_exhausted_count', 'v': count(*) filter (error_type = 'connection_pool_exhausted')}}, {{'m': 'runtime_restart_count', 'v': count(*) filter (error_type = 'runtime_restart')}}, {{'m': 'unique_trace_count', 'v': count(distinct trace_id)}}]) as x from bl group by bundle_id),
bi0 as (select bundle_id, 'P-' || substr(sha256(template || '|' || error_type), 1, 8) as ref, 1 as sec, -n as o, error_type as event_type, 'pattern P-' || substr(sha256(template || '|' || error_type), 1, 8) || ' ' || template || ' ' || error_type as text, '' as metric_name from bp
 union all select bundle_id, 'M-' || x.m, 2, 0, 'metric', 'metric metric_name ' || x.m, x.m from bm where x.v > 0
 union all select distinct bundle_id, 'D-' || deploy_id, 3, 0, 'deployment_event', 'deployment deploy_id ' || deploy_id, '' from bl where deploy_id is not null),
bi as materialized (select * replace (lower(text) as text) from bi0)"""
_BC = f"""{_BI}, bt as (select bundle_id, case when {_any("can't open file", "no such file or directory", "job_configuration_mismatch")} then 0 when {_any("failed to start")} and {_any(".service")} then 1 when {_any("stream_transport", "ffmpeg tcp send sample", "rtmps")} then 2
 when {_any("youtube_health")} or ({_any("youtube")} and {_any("watchdog")}) then 3 when {_any("service_health_failure", "healthy=false", "subsystems_status")} then 4 when {_any("connection_pool_exhausted", "too many connections", "connection pool")} then 5 when {_any("database_timeout")} then 6
 when bool_or(metric_name = 'http_5xx_count') or {_any("http 500")} then 7 when {_any("dependency_timeout")} then 8 when {_any("runtime_restart", "crashloop")} then 9 when {_any("auth_failure")} then 10 else 11 end as cause_rule,
 case when {_any("stream_transport")} and {_any("youtube_health")} then 0 when {_any("payment-gateway", "dependency_timeout")} then 1 else 2 end as contrast_rule from bi group by 1),
bc as materialized (select bundle_id, ['job_definition', 'service_start', 'transport', 'live_health', 'service_health', 'connection_pool', 'database_timeout', 'http_errors', 'dependency_timeout', 'restart_loop', 'authorization', 'unknown'][cause_rule + 1] as cause, cause_rule::int as cause_rule, ['live_service', 'dependency', 'none'][contrast_rule + 1] as contrast, contrast_rule::int as contrast_rule from bt)"""


def _cites(name: str, where: str) -> str:
    return f"select bundle_id, '{name}' as cites, (list(ref order by sec, o, ref))[1:4] as refs from bi where {where} group by 1"


_SETS = " union all ".join((
    _cites("hypothesis", _has("connection", "database", "rtmps", "ffmpeg", "youtube", "error_count", "pattern")), _cites("deploy", _has("deploy", "version")), _cites("verifier", _has("metric", "error_count", "unique_trace_count", "rtmps", "youtube", "ffmpeg")),
    _cites("contrast", _has("timeout", "http", "5xx", "dependency", "youtube", "rtmps", "ffmpeg")), _cites("any", "true"),
))
_BR = f"{_BC}, br as materialized ({_SETS})"
_KINDS = "case when cause in ('job_definition', 'service_start') then 'job' when cause = 'transport' then 'transport' when cause = 'live_health' then 'live' when cause = 'service_health' then 'health' else 'database' end"
_LABEL = """case cause when 'job_definition' then 'a configured job has no command or script' when 'service_start' then 'a supervised service does not start' when 'transport' then 'the stream''s transport or sender is unstable' when 'live_health' then 'health checks of the live service are unstable'
 when 'service_health' then 'a service is unhealthy or does not recover' when 'connection_pool' then 'the database''s connection pool is exhausted' when 'database_timeout' then 'database calls time out' when 'http_errors' then 'requests fail with server errors' when 'dependency_timeout' then 'a downstream dependency times out'
 when 'restart_loop' then 'the runtime restarts in a loop' when 'authorization' then 'authorization is configured wrongly' else 'an unknown driver' end"""
_GAPS = """case kind when 'job' then 'unit file and whether its target exists|install step of the script|timer history and last good run' when 'transport' then 'socket retransmits and unsent bytes|sender''s error output in the window|ingest health over time'
 when 'live' then 'results of the page probe|transitions in the platform''s API|age of the resolver''s cache' when 'health' then 'restarts by the supervisor|snapshots of subsystem health|log of recovery actions' else 'pool metrics and saturation of dependencies' end"""
_LAST = "case kind when 'job' then 'check unit paths when deploying' when 'transport' then 'collect transport counters and sender output' when 'live' then 'store probe, watchdog and API evidence' when 'health' then 'collect health snapshots and recovery actions' else 'alert on pool saturation and guard deployments' end"
_CL = f"""{_BR}, bw as (select bundle_id, any_value(service) service, min(environment) environment, strftime(min(ts), '%Y-%m-%d %H:%M:%S') ws, strftime(max(ts), '%Y-%m-%d %H:%M:%S') we, count(distinct deploy_id) dn from bl group by 1),
b1 as (select *, {_KINDS} as kind, {_LABEL} as label from bc join bw using (bundle_id)), b2 as (select *, {_GAPS} as gaps, {_LAST} as lasting from b1),
b3 as (select b2.*, h.refs h, dp.refs dp, v.refs v, c.refs c, a.refs a from b2 left join (from br where cites = 'hypothesis') h using (bundle_id) left join (from br where cites = 'deploy') dp using (bundle_id) left join (from br where cites = 'verifier') v using (bundle_id) left join (from br where cites = 'contrast') c using (bundle_id) join (from br where cites = 'any') a using (bundle_id)),
b4 as (select bundle_id, cause, 'hypothesis_generator' as role, 1 as place, 'support' as claim_type, 'leading hypothesis: ' || label || '; ' || service || ' in ' || environment || ' from ' || ws || ' to ' || we || case when dn > 0 then ', deployments in it: ' || dn else '' end as claim_text, coalesce(h, a) as r, gaps as missing, 'keep mitigations reversible' as temporary_action, lasting as permanent_action, 'service owner' as authority from b3
 union all select bundle_id, cause, 'hypothesis_generator', 2, 'validation_target', 'did the latest deployment change pools, timeouts or retries?', coalesce(dp, a)[1:3], 'diff of the deployment and of its configuration', '', '', 'release owner' from b3 where dn > 0
 union all select bundle_id, cause, 'evidence_verifier', 1, 'caveat', 'the bundle supports looking first at this: ' || label || ', but lacks telemetry', coalesce(v, a), gaps, '', lasting, 'platform owner' from b3
 union all select bundle_id, cause, 'evidence_verifier', 2, 'next_data_needed', 'collect telemetry before this is closed: ' || label, coalesce(v, a)[1:2], gaps, '', '', 'incident commander' from b3
 union all select bundle_id, cause, 'contrast_agent', 1, case when contrast = 'none' then 'caveat' else 'counter_evidence' end, case contrast when 'live_service' then 'health of the live service may explain the symptoms without the transport' when 'dependency' then 'a slow downstream dependency may amplify the incident' else 'the logs hold no strong alternative to this: ' || label end,
  coalesce(c, a), 'latency and error budget of dependencies', 'check dependencies before changes that cannot be undone', 'make health of dependencies an input', 'engineer on call' from b3),
lc as materialized (select 'lc-' || substr(sha256(concat_ws('|', bundle_id, role, place)), 1, 16) as claim_id, bundle_id, role, place, claim_type, claim_text, cause, array_to_string(r, ',') as refs, missing, temporary_action, permanent_action, authority from b4)"""
_BF = f"""{_BI}, bf as materialized (select bundle_id, bool_or(event_type in ('http_5xx', 'http5xx') or regexp_matches(text, '\\bhttp\\s*(500|5\\d\\d|5xx)\\b')) http_error, {_any('checkout fail')} checkout_failure, {_any('pool exhaust')} pool_exhaustion, {_any('timeout')} timeout,
 bool_or(regexp_matches(text, '\\brestart(ed|ing|s)?\\b')) restart, bool_or(event_type in ('http_5xx', 'http5xx', 'error', 'fatal', 'exception') or regexp_matches(text, '\\bhttp\\s*(500|5\\d\\d|5xx)\\b|checkout fail|\\b(failed|failure|exception)\\b')) runtime_error,
 {_any('checkout_500_count')} checkout_500_signal, {_any('db_pool_exhausted_count')} db_pool_exhausted_signal, bool_or(event_type = 'deployment_event' or contains(text, 'deploy rollout') or contains(text, 'deployment')) deployment, false successful_checkout from bi group by 1)"""
_FACT_NAMES = ("http_error", "checkout_failure", "pool_exhaustion", "timeout", "restart", "runtime_error", "checkout_500_signal", "db_pool_exhausted_signal", "deployment", "successful_checkout")
#: Which facts contradict each statement, or answer each request, read off by hand.
_AGAINST = {0: "http_error", 1: "checkout_failure", 2: "pool_exhaustion", 3: "runtime_error", 7: "runtime_error", 8: "restart", 9: "timeout", 11: "checkout_500_signal", 12: "db_pool_exhausted_signal", 13: "deployment", 14: "restart"}
_ANSWER = {1: "http_error", 3: "http_error", 4: "pool_exhaustion", 6: "restart", 7: "runtime_error", 9: "checkout_500_signal", 10: "db_pool_exhausted_signal", 12: "runtime_error", 13: "restart", 14: "deployment"}


def _list(parts: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x is not null), '|')"


_SAID = [(k, _q(x.strip())) for k, x in enumerate(ABSENCES) if x.strip()]
_TOLD = _list([f"case when {_AGAINST[k]} then {x} end" for k, x in _SAID if k in _AGAINST])
_KEPT = _list([f"case when not {_AGAINST[k]} then {x} end" if k in _AGAINST else x for k, x in _SAID if k != 14])
# the first request becomes the last but one where the fact is there
_LEFT = _list(
    ["case when http_error then 'HTTP 5xx time-series metrics tied to this review unit.' else 'HTTP 500 error logs or metrics' end"]
    + [f"case when not {_ANSWER[k]} then {_q(x)} end" if k in _ANSWER else f"case when not http_error then {_q(x)} end" if k == 17 else _q(x) for k, x in enumerate(REQUESTS) if 0 < k < 18]
)
_RELATED = lambda items: f"""{items}, el as (select item, list(trace_id) t from m group by 1), ei as (select top.*, t from top join el using (item)), ed as (select deploy_id || '/' || strftime(ts, '%d') as deploy_id, max(ts) last_seen from logs where {cur} and deploy_id is not null group by 1), es as (select item, min(ts) first_seen from i0 group by 1 having max(severity_rank) >= 40),
edges as materialized (select 'shared_trace' as relationship_type, a.item as left_id, b.item as right_id, count(*) as shared, 0::bigint as gap_s from m a join m b on a.trace_id = b.trace_id and a.item < b.item group by 2, 3
 union all select 'overlapping_window_no_shared_trace', a.item, b.item, 0, 0 from ei a join ei b on a.item < b.item and greatest(a.s, b.s) <= least(a.e, b.e) and not list_has_any(a.t, b.t)
 union all select 'deployment_precedes_signal', 'deployment/' || deploy_id, item, 0, date_diff('second', last_seen, first_seen) from ed join es on date_diff('second', last_seen, first_seen) between 0 and 1800)"""  # noqa: E731
_EDGES = _RELATED(V._ITEMS)
#: An item's id says what it is of: svc-N/error_type/day.
_END = lambda side, what: {"gateway": f"{side}_id like 'svc-1/dependency_timeout/%'"}[what]
_SUGGESTED = lambda edges: f"""{edges}, ex as (select *, case when {_END('left', 'gateway')} then left_id when {_END('right', 'gateway')} then right_id end as g, case when left_id like '%/http_5xx/%' then left_id when right_id like '%/http_5xx/%' then right_id end as u, case when contains(left_id, '/connection_pool_exhausted/') then left_id when contains(right_id, '/connection_pool_exhausted/') then right_id end as p from edges),
ey as (select *, case when relationship_type = 'deployment_precedes_signal' then 'd' when relationship_type = 'overlapping_window_no_shared_trace' then case when g <> u then 'g' end when p <> u then 'p' end as k from ex)
select case k when 'd' then 'rel-deploy-' when 'g' then 'rel-payment-gateway-' else 'rel-db-pool-' end || substr(sha256(concat_ws('|', relationship_type, left_id, right_id, shared, gap_s)), 1, 16) as target_id, 'evidence_relationship' as source, 'validation_target' as original_class,
 case k when 'd' then 'deployment_regression' when 'g' then 'external_dependency_health' else 'database_connection_pool_exhaustion' end as target, case k when 'd' then 'deployment_regression' when 'g' then 'payment_gateway' else 'database_connection_pool' end as subsystem, case k when 'd' then 'deployment_regression' when 'g' then 'payment_gateway' else 'database_connection_pool' end as component,
 case k when 'd' then 0.58 when 'g' then 0.72 else 0.93 end::double as score, case k when 'd' then 'evidence_relationship_deployment' when 'g' then 'evidence_relationship_payment_gateway' else 'evidence_relationship_database_pool' end as group_id, case k when 'd' then left_id || ',' || right_id when 'g' then g || ',' || u else p || ',' || u end as refs,
 case k when 'd' then 'diff of code and configuration since the last healthy revision' when 'g' then 'request ids, latency and errors on the gateway''s side' else 'query latency and hold times of connections|pool configuration and deployment diff' end as missing, relationship_type, shared, gap_s from ey where k is not null"""  # noqa: E731
_HIGH_REL, _REL = _SUGGESTED(_EDGES), _SUGGESTED(_RELATED(V._EVERY_ITEM))
_CHAIN = lambda *steps: "coalesce(" + ", ".join(f"case when coalesce({v}, '') <> '' then {{'value': {v}, 'step': '{n}'}} end" for n, v in steps) + ")"
#: Signals' terms of targets, which their own twin spells out.
_OF = lambda x: f"(select {G._TARGET} from (select {x} as t))"
_ONE = lambda x: f"case when len({x}) = 1 then {x}[1] end"
_SG = f"""{_CL}, s0 as (select *, lower(claim_text) as q, lower(concat_ws(' ', claim_text, replace(missing, '|', ' '), temporary_action, permanent_action)) as full_text from lc),
s1 as (select *, {_CHAIN(('job', "case when contains(q, 'configured job') or contains(q, 'supervisor') then 'job_configuration_mismatch' end"), ('restart', "case when contains(q, 'restart') then 'restart_loop' end"), ('dependency', "case when contains(q, 'dependency') or contains(q, 'downstream') then 'external_dependency_failure' end"), ('deployment', "case when contains(q, 'deploy') then 'deployment_correlation' end"), ('default', "'general_review'"))} as tg,
 {_CHAIN(('recovery', "case when contains(q, 'restart') or contains(q, 'supervisor') then 'runtime_recovery' end"), ('default', "'general'"))} as sb from s0),
s2 as (select *, case when role = 'contrast_agent' and tg.step <> 'default' then [tg.value] else [] end as ident, case when sb.value = 'runtime_recovery' then 'restart_loop' end as st from s1),
sr as (select claim_id, bundle_id, unnest(string_split(refs, ',')) as ref, generate_subscripts(string_split(refs, ','), 1) as pos from s2 where refs <> ''),
sc0 as (select sr.*, bi.text, bi.metric_name as m, case bi.metric_name when 'error_count' then 'error_spike' when 'runtime_restart_count' then 'restart_loop' else '' end as core from sr join bi using (bundle_id, ref)),
sc1 as (select claim_id, coalesce(list_sort(list_distinct(list(core) filter (core <> ''))), []) ev, coalesce(list_sort(list_distinct(list(m) filter (m <> ''))), []) ms, list(core order by m) filter (core <> '') mt, string_agg(text, ' ' order by pos) et from sc0 group by 1),
s3 as (select s2.*, coalesce(ev, []) ev, coalesce(ms, []) ms, mt[1] as mt1, coalesce(et, '') et from s2 left join sc1 using (claim_id)),
s4 as (select *, {_OF('et')} as ett, {_OF('full_text')} as ftt, {_OF("full_text || ' ' || et")} as btt from s3),
s5 as (select *, {_CHAIN(('identity', _ONE('ident')), ('evidence', _ONE('ev')), ('metric', 'mt1'), ('evidence_text', 'ett'), ('subsystem', "case when len(ms) = 0 then st end"), ('restarts', "case when sb.value = 'runtime_recovery' and list_contains(ms, 'runtime_restart_count') then 'restart_loop' end"), ('text', 'ftt'), ('metric_names', "case when len(ms) > 0 then 'metric:' || array_to_string(ms, ',') end"), ('words', "'text:' || array_to_string(regexp_extract_all(full_text, '[a-z0-9_]{4,}')[1:8], '-')"))} as sg from s4),
signed as materialized (select *, {_CHAIN(('identity', _ONE('ident')), ('evidence', _ONE('ev')), ('metric', 'mt1'), ('subsystem', "case when refs = '' then st end"), ('signature', "case when sg.step in ('identity', 'evidence', 'metric', 'evidence_text', 'subsystem', 'restarts', 'text') then sg.value end"), ('text', 'btt'), ('any_signature', 'sg.value'))} as rt from s5)"""
_SC = f"""{_SG}, c0 as (select *, 'sc-' || substr(sha256(concat_ws('|', bundle_id, sb.value, sg.value)), 1, 16) as cluster_id, case when role = 'contrast_agent' then 'rules-b' else 'rules-a' end as provider, case role when 'contrast_agent' then 'contrast-1' when 'evidence_verifier' then 'verifier-1' else 'hypothesis-1' end as model,
 case when claim_type in ('counter_evidence', 'validation_target') then 'high' when claim_type = 'support' or permanent_action <> '' then 'medium' else 'low' end as priority, case when claim_type in ('counter_evidence', 'validation_target') then 1.0 when claim_type = 'support' or permanent_action <> '' then 0.65 else 0.35 end::double as score,
 case when claim_type = 'support' then 'incident_candidate' else 'validation_target' end as mode from signed),
c1 as (select cluster_id, any_value(bundle_id) bundle_id, any_value(sb.value) subsystem, any_value(sg.value) signature, count(*) members, first(claim_id order by score desc, claim_id) representative, max(score) score, first(mode order by score desc, claim_id) as mode, first(priority order by score desc, claim_id) priority, first(rt.value order by score desc, claim_id) review_target,
 first(temporary_action <> '' or permanent_action <> '' order by score desc, claim_id) acts, list_sort(list_distinct(list(provider))) providers, string_agg(distinct model, ',' order by model) models, len(list_distinct(flatten(list(string_split(refs, ','))))) refs, len(list_distinct(flatten(list(string_split(refs, ',')) filter (claim_type <> 'counter_evidence')))) sr, len(list_distinct(flatten(list(string_split(refs, ',')) filter (claim_type = 'counter_evidence')))) cr,
 len(list_distinct(flatten(list(string_split(missing, '|'))))) wants, len(list_distinct(flatten(list(ms)))) nm from c0 group by 1),
ct as (select bundle_id, first(cluster_id order by score desc, cluster_id) top from c1 where mode = 'incident_candidate' or signature = 'throughput_disappearance' group by 1),
sclu as (select c1.*, case when cluster_id <> top and (mode = 'validation_target' or signature in ('external_dependency_failure', 'network_error_signal', 'user_impact_signal_gap', 'freshness_signal_gap', 'state_mismatch', 'monitoring_gap', 'instrumentation_mismatch', 'observability_contract_mismatch')) then top else '' end as parent from c1 left join ct using (bundle_id))"""
ORACLES = {
    "claim_signatures": f"{_SG} select claim_id, tg.value as own_target, tg.step as target_step, sb.value as subsystem, sb.step as subsystem_step, sg.value as signature, sg.step as signature_step, rt.value as review_target, rt.step as review_step from signed",
    "metric_zeros": f"{_SG} select m as metric_name, case when core <> '' then 'zero_is_good' else 'unknown' end as meaning, case m when 'error_count' then 'error' when 'runtime_restart_count' then 'restart' else 'unknown' end as semantic_type, core as core_target_type, count(*) as claims from sc0 where m <> '' group by all",
    "signature_clusters": f"{_SC} select cluster_id, bundle_id, subsystem, signature, members, representative, score, array_to_string(providers, ',') as providers, models, refs, wants, parent from sclu",
    "score_breakdown": f"""{_SC} select cluster_id, review_target, round(least(1.0::double, (coalesce(sr, 0) + 0.5::double * coalesce(cr, 0)) / 3.0::double), 4) as evidence_strength, case when wants > 0 or acts then 0.85 else 0.35 end::double as actionability,
 case when review_target in ('throughput_disappearance', 'external_dependency_failure', 'user_impact_signal_gap', 'freshness_signal_gap') then 0.82 when review_target in ('restart_loop', 'state_mismatch', 'observability_contract_mismatch') then 0.72 when priority = 'high' then 0.78 when priority = 'medium' then 0.55 else 0.35 end::double as user_impact_risk,
 len(providers) / 2.0::double as agreement, least(1.0::double, case when nm > 0 then nm else refs end / 2.0::double) as diversity, round(least(0.3::double, wants * 0.025::double), 4) as missing_penalty, round(least(0.2::double, (members - 1) * 0.04::double), 4) as duplicate_penalty from sclu""",
    "bundle_causes": f"{_BC} select * from bc",
    "cited_items": f"{_BR} select bundle_id, cites, array_to_string(refs, ',') as refs from br",
    "local_claims": f"{_CL} select * from lc",
    "bundle_facts": f"{_BF} select bundle_id, array_to_string(list_filter([{', '.join(f'case when {n} then {_q(n)} end' for n in _FACT_NAMES)}], lambda x: x is not null), ',') as facts from bf",
    "contradicted_absences": f"{_BF} select bundle_id, {_TOLD} as contradicted, {_KEPT} as kept from bf",
    "relation_edges": f"{_EDGES} select * from edges",
    "relationship_candidates": _REL,
    "reconciled_missing": f"{_BF} select bundle_id, {_LEFT} as missing from bf",
}
