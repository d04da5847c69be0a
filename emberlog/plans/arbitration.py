"""Queries that arbitrate candidates, read reviewers' output, request more data and choose evidence. Twins are by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import arbitration as A
from emberlog.operators import claims as C
from emberlog.operators import packing as K
from emberlog.operators import relational as R
from emberlog.operators import semantics as M

from . import bundles as U
from . import reviews as V
from . import semantics as E
from .facts import INCIDENT, LOGS, logs, stored

BY = ["target", "subsystem", "component", "refs"]


def _groups(spark, d):
    """Claim groups with their providers as lists, texts of their claims and whether these speak of users."""
    def build():
        c = V.claims(spark, d).withColumn("stance", C.effective_stance(F.col("claim_type"), F.col("finding_status")))
        c = c.withColumn("every", F.sort_array(F.array_distinct(F.array_union("refs", "counter_refs")))).withColumn("key", F.array_join("every", ","))
        by = ["evidence", "target", "subsystem", "component", "key"]
        of = lambda *s: F.sort_array(F.collect_set(F.when(F.col("stance").isin(*s), F.col("provider"))))
        g = c.groupBy(*by).agg(
            F.sort_array(F.collect_set("provider")).alias("providers"), of("support").alias("supporting"), of("counter_evidence").alias("countering"), F.first("every").alias("all_refs"), F.count_if((F.col("stance") == "support") & (F.size("refs") == 0)).alias("bare"),
            F.max(F.size("lost")).alias("n_lost"), F.count_if(F.col("stance") != "support").alias("n_other"), F.count_if(F.size("missing") > 0).alias("n_missing"), F.max("temporary_action").alias("text"),
        )
        unsupported = (F.col("n_lost") > 0) | (F.col("bare") > 0)
        differ = (F.col("n_other") > 0) | (F.col("n_missing") > 0) | (F.size("providers") == 1)
        g = g.withColumns({"agreement": ~unsupported & (F.size("supporting") >= 2), "disagreement": ~unsupported & differ, "supporters": F.size("supporting")})
        return g.withColumn("target_id", F.concat(F.lit("cg-"), F.substring(F.sha2(F.concat_ws("|", *by), 256), 1, 16))).drop("bare", "n_lost")

    return stored(spark, d, "groups", build)


def _candidates(spark, d):
    """Groups that agree, groups that differ, propositions of the queue, and what relations suggest, each target once."""
    g = _groups(spark, d)
    kind = F.when(F.col("disagreement"), "validation_target").otherwise("primary_candidate")
    cols = lambda k, s: ["target_id", "evidence", "target", "subsystem", "component", F.lit(k).alias("source"), s.alias("original_class"), F.when(s == "primary_candidate", 0.75).otherwise(0.62).alias("score"), "providers", "supporting", F.col("all_refs").alias("refs"), F.when(F.size("supporting") > 0, F.col("all_refs")).otherwise(F.array().cast("array<string>")).alias("support_refs"), "text", (F.col("n_missing") > 0).alias("missing")]
    agree, differ = g.where("agreement").select(*cols("claims", kind)), g.where("disagreement").select(*cols("claims", F.lit("validation_target")))
    q = V._shaped(spark, d).where("visibility = 'review'")
    legacy = q.select("proposition_id", "evidence", "target", "subsystem", "effective", "mode", "providers", "support").select(
        F.col("proposition_id").alias("target_id"), "evidence", "target", "subsystem", F.lit("").alias("component"), F.lit("queue").alias("source"), F.when(F.col("mode") == "incident_candidate", "primary_candidate").otherwise("validation_target").alias("original_class"), F.col("effective").alias("score"),
        "providers", F.array().cast("array<string>").alias("supporting"), F.col("support").alias("refs"), F.col("support").alias("support_refs"), F.lit("").alias("text"), F.lit(False).alias("missing"),
    )
    none = F.array().cast("array<string>")
    related = U.high_signal_candidates(spark, d).select(
        "target_id", F.lit("incident").alias("evidence"), "target", "subsystem", "component", F.lit("relations").alias("source"), "original_class", "score", none.alias("providers"), none.alias("supporting"),
        F.split("refs", ",").alias("refs"), F.split("refs", ",").alias("support_refs"), F.lit("").alias("text"), F.lit(True).alias("missing"),
    )
    return stored(spark, d, "candidates", lambda: A.first_wins([agree, differ, legacy, related], "target_id", "evidence"))


def candidate_inputs(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("target_id", "evidence", "target", "subsystem", "component", "source", "original_class", "score", F.array_join("providers", ",").alias("providers"), F.array_join("refs", ",").alias("refs"))


def _item_texts(spark, d):
    """Benchmark items as evidence, of which some speak of a payment gateway."""
    b = V._table(spark, d, "benchmark")
    note = F.expr("case when item_id % 7 = 3 then ' Payment gateway is slow' else '' end")
    pool = F.expr("case when item_id % 14 = 3 then ' pool exhausted' else '' end")
    return b.select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("item_id"), F.concat(note, pool).alias("text"))


def identified_candidates(spark: SparkSession, d: str) -> DataFrame:
    return A.with_evidence_identity(_candidates(spark, d), _item_texts(spark, d)).groupBy("subsystem", "component").agg(F.count("*").alias("n"), F.min("target_id").alias("least"))


def _keyed(spark, d):
    # stored: the joins of the observations would push tests of the key down to here, and spell it out four times
    return stored(spark, d, "keyed", lambda: A.with_canonical_key(A.with_evidence_identity(_candidates(spark, d), _item_texts(spark, d))))


def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).select("target_id", "canonical_target", "unit", "family", "canonical_key")


def text_categories(spark: SparkSession, d: str) -> DataFrame:
    """Canonical targets of templates that name none."""
    p = R.in_window(logs(spark, d), *INCIDENT).select("template").distinct()
    return p.select("template", A.canonical_target(F.lit(""), F.col("template")).alias("target"))


def _observations(spark, d):
    return stored(spark, d, "observations", lambda: A.observations(_keyed(spark, d)))


def merged_observations(spark: SparkSession, d: str) -> DataFrame:
    return _observations(spark, d)


def review_convergence(spark: SparkSession, d: str) -> DataFrame:
    return A.convergence(_observations(spark, d)).select("unit", "representative", "sources", "n_supporting", "n_refs", "support_score", "convergence")


def _dimensions(spark, d):
    g = _groups(spark, d).withColumn("refs", F.col("key")).withColumn("impact", F.col("target").isin("throughput_disappearance", "latency_regression"))
    total = V.claims(spark, d).agg(F.countDistinct("provider").alias("all_providers"))
    return A.agreement_dimensions(g.crossJoin(F.broadcast(total)))  # one row


def agreement_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return _dimensions(spark, d)


def arbitrated_targets(spark: SparkSession, d: str) -> DataFrame:
    """Observations with reasons, capped scores and final classes, the primary ones first."""
    o = _observations(spark, d).selectExpr("*", "unit <> 'traffic' or n_refs > 0 as runtime", "canonical_target in ('transport_path_failure', 'latency_regression') as impact", "sources % 7 = 6 as severity_only", "sources % 5 = 4 as caveat", "false as missing")
    a = A.arbitrated(o, _dimensions(spark, d))
    place = F.expr("case final_class when 'primary_candidate' then 0 when 'validation_target' then 1 when 'monitor_only' then 2 else 3 end")
    return a.orderBy(place, F.desc("final_score"), "canonical_key").limit(40).select("canonical_key", "unit", "final_class", "final_score", F.array_join("reasons", ",").alias("reasons"))


def provider_stances(spark: SparkSession, d: str) -> DataFrame:
    """Each provider's stance on each target: support, counter, both, a caveat, or silence."""
    c = V.claims(spark, d)
    every = F.broadcast(c.select("provider").distinct())  # reviewers are few
    s = c.groupBy("evidence", "target", "provider").agg(F.max((F.col("claim_type") == "support").cast("int")).alias("s"), F.max((F.col("claim_type") == "counter_evidence").cast("int")).alias("k"))
    t = c.select("evidence", "target").distinct().crossJoin(every).join(s, ["evidence", "target", "provider"], "left")
    stance = F.when((F.col("s") == 1) & (F.col("k") == 1), "support_and_counter").when(F.col("s") == 1, "support").when(F.col("k") == 1, "counter").when(F.col("s") == 0, "caveat_or_validation").otherwise("silent")
    return t.select("evidence", "target", "provider", stance.alias("stance"))


#: The test data's raw outputs of reviewers, as an expression that both dialects read.
OUTPUTS = """select conv_id * 100 + turn as output_id, concat(case conv_id % 5 when 0 then concat('```json', chr(10)) when 1 then 'Here it is: ' else '' end,
 case turn % 4 when 0 then '{"schema_version": "v1", "summary": "s", "claims": [{"claim_type": "support", "claim_text": "a"}, {"claim_type": "guess", "claim_text": "b"}]}' when 1 then '{"schema_version": "v1", "summary": "", "claims": [], "ok": True, "x": None}' when 2 then '{"summary": "t", "claims": [{"claim_type": "caveat"}]}' else '{"summary": "broken' end,
 case conv_id % 5 when 0 then concat(chr(10), '```') when 1 then ' That is all.' else '' end) as raw from CONVERSATIONS where conv_id is not null and turn is not null"""


def reviewer_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs as JSON, repaired where that needs syntax only, and what their schema lacks."""
    V._table(spark, d, "conversations").createOrReplaceTempView("__emberlog_outputs")
    o = spark.sql(OUTPUTS.replace("CONVERSATIONS", "__emberlog_outputs")).withColumn("r", A.repaired_json(F.col("raw")))
    o = o.withColumn("status", A.parse_status(F.col("raw"), F.col("r")))
    good = F.col("status").isin("parsed_original", "parsed_repaired")
    return o.select("output_id", "status", F.col("r.rules").alias("rules"), F.col("r.text").alias("text"), F.when(good, A.schema_errors(F.col("r.text"))).otherwise("").alias("errors"))


def extracted_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths, missing paths, units, states and commands that the incident's messages name."""
    rows = R.in_window(logs(spark, d), *INCIDENT).select(F.concat("message", F.expr("case when event_id % 26 = 5 then concat(chr(10), 'No such file or directory: /opt/run', user_id % 3, '.sh, inactive (dead)') else '' end")).alias("text"))
    e = rows.select(*A.extracted(F.col("text")))
    names = ("paths", "missing_paths", "units", "states", "commands")
    return e.select(*[F.array_join(c, ",").alias(c) for c in names]).groupBy(*names).agg(F.count("*").alias("n"))


#: The test data's words and labels that name units and paths, as expressions that both dialects read.
NAMED = """concat(message, case event_id % 26 when 4 then concat(chr(10), 'No such file or directory: /opt//app/./run', user_id % 3, '.sh') when 5 then concat(' of app', user_id % 3, '@a.timer in /srv/x', user_id % 4, '/ and /etc/passwd, /opt/../y') else '' end)"""
UNITS = """case event_id % 5 when 0 then concat('{"systemd_unit":"top-', user_id % 2, '.service"}') when 1 then concat('{"labels":{"systemd_unit":"in-', user_id % 2, '.socket"},"x":[1]}') when 2 then '{"systemd_unit":"not a unit"}' else 'broken' end"""


def collector_targets(spark: SparkSession, d: str) -> DataFrame:
    """Units and paths to look at for two requests over the incident's failures."""
    kind = F.expr("case error_type when 'service_start_failure' then 'process_state' else 'installed_artifact' end")
    rows = R.in_window(logs(spark, d), *INCIDENT).where("event_id % 26 in (4, 5)")
    return A.collector_targets(rows.select(F.concat(kind, F.lit("_query")).alias("request_id"), kind.alias("request_type"), F.expr(NAMED).alias("text"), F.expr(UNITS).alias("labels")))


def requested_rows(spark: SparkSession, d: str) -> DataFrame:
    """The latest rows of three requests for more data from the baseline's start to the incident's end."""
    r = spark.createDataFrame([("stream_query", ["rtmps", "ffmpeg"]), ("login_query", ["unauthorized"]), ("any_query", [])], "request_id string, terms array<string>")
    rows = A.request_rows(R.in_window(logs(spark, d), "2024-01-15 00:00:00", INCIDENT[1]), r, 5)
    return rows.select("request_id", "place", "log_id", "ts", "error_type")


def matched_paths(spark: SparkSession, d: str) -> DataFrame:
    """Missing files of jobs among those that definitions name: here by their names only, as no path is the same."""
    rows = logs(spark, d)
    lost = rows.where("error_type = 'job_configuration_mismatch'").select(F.concat(F.lit("/srv/"), F.regexp_extract("message", r"(run\d+\.py)", 1)).alias("path")).distinct()
    wanted = spark.createDataFrame([("/etc/jobs/run1.py",), ("/etc/jobs/run3.py",), ("/etc/jobs/walk.py",)], "path string")
    return A.matched_paths(wanted, lost)


#: Terms of interest by group, the first weighs most (fixed values).
INTEREST = (("failure", "failed", "error", "exception", "retry", "alert", "critical"), ("token", "auth", "ready", "checkpoint"), ("run_result", "run_once", "processed", "matched", "notified", "non_target"), ("systemd", "watchdog", "service", "deactivated", "heartbeat"), ("pubsub", "streamingpull", "idle"))


def _top(spark, d):
    i = E._items(spark, d)
    text = F.lower(F.concat_ws(" ", "event_name", "template", "example", "component"))
    score = F.lit(0)
    for k, terms in enumerate(INTEREST, 1):
        score = score + F.when(A.any_of(text, terms), 10 - k).otherwise(0)
    rank = F.expr("case severity when 'emergency' then 70 when 'alert' then 60 when 'critical' then 50 when 'error' then 40 when 'warn' then 30 when 'warning' then 30 when 'notice' then 25 when 'info' then 20 when 'debug' then 10 else 0 end")
    i = i.withColumn("interest", score).withColumn("rank", rank).withColumn("item_id", F.substring(F.sha2(F.concat_ws("|", *M.ITEM_KEY), 256), 1, 16))
    return i, i.orderBy(F.desc("rank"), F.desc("n"), F.desc("interest"), "first_seen", "item_id").limit(140)


def top_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)[1].select("item_id", "event_name", "severity", "n", "interest")


def top_logs(spark: SparkSession, d: str) -> DataFrame:
    return R.in_window(logs(spark, d), *INCIDENT).orderBy(F.desc("severity_rank"), "ts", "log_id").limit(60).select("log_id", "severity", "ts")


def sample_coverage(spark: SparkSession, d: str) -> DataFrame:
    """One row: how much of all occurrences the chosen items cover."""
    every, top = _top(spark, d)
    a, b = every.agg(F.count("*").alias("items"), F.sum("n").alias("rows")), top.agg(F.count("*").alias("chosen"), F.sum("n").alias("chosen_rows"))
    return a.crossJoin(b).select("items", "chosen", (F.col("items") - F.col("chosen")).alias("omitted"), "rows", "chosen_rows", F.round(F.col("chosen_rows") / F.col("rows"), 6).alias("coverage_ratio"))  # one row each


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Items by semantic key: class of coverage, subsystem, family and name, and the template of events without a name."""
    i = E._items(spark, d)
    kind = F.when(F.col("n") <= 3, "rare_singleton").otherwise("pattern")
    bucket = F.concat_ws(":", kind, "component", "event_family", "event_name")
    weak = F.col("event_name").isin(*M.WEAK)
    i = i.select(bucket.alias("bucket"), F.when(weak, F.concat_ws(":", bucket, "template_fingerprint")).otherwise(bucket).alias("key"), "n")
    return i.groupBy("bucket").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("items"), F.sum("n").alias("rows"))


def merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring chunks of a role merged while they fit twice the budget."""
    m = V.chunk_manifest(spark, d).select("bucket", F.col("chunk").alias("old"), "tokens", "items")
    g = K.pack_by_budget(m, "bucket", ["old"], "tokens", 2 * V.BUDGET).groupBy(F.col("bucket").alias("role"), "chunk")
    return g.agg(F.count("*").alias("merged"), F.sum("tokens").alias("tokens"), F.sum("items").alias("items"))


def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Failed chunks packed again: with the floor of the library their halves, with a lower one parts of half the budget."""
    c = V.chunked(spark, d).withColumn("whole", F.concat_ws("/", "bucket", "chunk")).drop("chunk")
    bad = c.join(V.chunk_manifest(spark, d).where("first_conv % 11 = 0").select(F.concat_ws("/", "bucket", "chunk").alias("whole")), "whole", "left_semi")
    out = None
    for floor in (8_000, 100):
        s = K.split_failed(bad, "whole", ["conv_id", "turn"], "tokens", V.BUDGET, floor).withColumn("floor", F.lit(floor))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("floor", "whole", "part").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


def merged_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of all chunks, those with the same content once: the first by claim."""
    c = V.claims(spark, d).withColumn("content", F.sha2(F.concat_ws("|", "evidence", "provider", "claim_type", "target", "subsystem", F.array_join("refs", ","), "temporary_action"), 256))
    c = R.latest_by(c, ["content"], F.asc("claim_id"))
    return c.groupBy("evidence", "provider").agg(F.count("*").alias("n"), F.min("claim_id").alias("first_claim"))


def run_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of the reviewers' tokens by rates per million; reviewers without a rate cost nothing and are not priced."""
    rates = spark.createDataFrame([("user-0", 2.5, 10.0), ("assistant-1", 1.25, 5.0)], "provider string, rate_in double, rate_out double")
    t = V.claims(spark, d).groupBy("provider").agg(F.sum(F.length("claim_text")).alias("tokens_in"), F.sum(F.length("temporary_action")).alias("tokens_out"))
    t = t.join(F.broadcast(rates), "provider", "left")
    cost = F.col("tokens_in") / 1e6 * F.coalesce("rate_in", F.lit(0.0)) + F.col("tokens_out") / 1e6 * F.coalesce("rate_out", F.lit(0.0))
    return t.select("provider", "tokens_in", "tokens_out", F.round(cost, 8).alias("cost"), F.col("rate_in").isNotNull().alias("priced"))


QUERIES = {f.__name__: f for f in (candidate_inputs, identified_candidates, canonical_keys, text_categories, merged_observations, review_convergence, agreement_dimensions, arbitrated_targets, provider_stances, reviewer_outputs, extracted_paths, collector_targets, requested_rows, matched_paths, top_evidence, top_logs, sample_coverage, semantic_chunks, merged_chunks, split_chunks, merged_claims, run_costs)}


# ---- twins

_G = f"""{V._SHAPED}, g0 as (select evidence, target, subsystem, component, array_to_string(all_refs, ',') as key, all_refs, list_sort(list_distinct(list(provider))) providers, coalesce(list_sort(list_distinct(list(provider) filter (where stance = 'support'))), []) supporting, count(*) filter (where stance = 'support' and len(claims.refs) = 0) bare, max(len(lost)) nl, count(*) filter (where stance <> 'support') no, count(*) filter (where len(missing) > 0) nm, max(temporary_action) as text from claims group by 1, 2, 3, 4, 5, 6),
grp as (select *, nl = 0 and bare = 0 and len(supporting) >= 2 agreement, nl = 0 and bare = 0 and (no > 0 or nm > 0 or len(providers) = 1) disagreement, 'cg-' || substr(sha256(concat_ws('|', evidence, target, subsystem, component, key)), 1, 16) target_id from g0),
cand as (select target_id, evidence, target, subsystem, component, 'claims' source, case when disagreement then 'validation_target' else 'primary_candidate' end original_class, case when disagreement then 0.62 else 0.75 end::double score, providers, supporting, all_refs refs, case when len(supporting) > 0 then all_refs else [] end support_refs, text from grp where agreement or disagreement
 union all select proposition_id, evidence, target, subsystem, '', 'queue', case when mode = 'incident_candidate' then 'primary_candidate' else 'validation_target' end, effective, provs, [], support, support, '' from shaped where visibility = 'review'
 union all select target_id, 'incident', target, subsystem, component, 'relations', original_class, score, [], [], string_split(refs, ','), string_split(refs, ','), '' from ({U._HIGH_REL}))"""
_ID = f"""{_G}, it as (select 'item-' || item_id item_id, item_id % 7 = 3 pay, item_id % 14 = 3 pool from benchmark), tl as (select target_id, bool_or(pay) pay, bool_or(pool) pool from (select target_id, unnest(refs) item_id from cand) join it using (item_id) group by 1),
idc as (select cand.* replace (case when coalesce(pay and not pool, false) then 'payment_gateway' else subsystem end as subsystem, case when coalesce(pay and not pool, false) then 'payment_gateway' else component end as component) from cand left join tl using (target_id))"""
_TR = "('database_connection_pool', 'database_dependency', 'deployment_regression', 'job_configuration', 'observability_contract', 'payment_gateway', 'resource_pressure', 'runtime_recovery', 'service_liveness', 'traffic', 'user_experience')"
_KEYED = f"""{_ID}, k0 as (select *, case target when 'restart_loop' then 'process_restart_loop' when 'throughput_disappearance' then 'transport_path_failure' when 'freshness_signal_gap' then 'capture_freshness_gap' else target end canonical_target,
 case when component in {_TR} then component when component not in ('', 'general') then component when subsystem in {_TR} then subsystem when subsystem <> 'general' then subsystem else 'general' end unit from idc),
k1 as (select *, case when subsystem <> 'general' or unit <> 'general' then '' else canonical_target end as family from k0), keyed as (select *, substr(sha256(concat_ws('|', evidence, unit, family)), 1, 24) canonical_key from k1)"""
_OBS = f"""{_KEYED}, o0 as (select canonical_key, first(target_id order by score desc, case when original_class = 'primary_candidate' then 0 else 1 end, target_id) representative, first(canonical_target order by score desc, case when original_class = 'primary_candidate' then 0 else 1 end, target_id) canonical_target, any_value(unit) unit, any_value(family) as family, first(subsystem order by score desc, case when original_class = 'primary_candidate' then 0 else 1 end, target_id) subsystem,
 first(original_class order by score desc, case when original_class = 'primary_candidate' then 0 else 1 end, target_id) oc, bool_or(original_class = 'primary_candidate') ap, max(score) score, count(*) sources, count(*) filter (where len(supporting) > 0) support_sources, count(distinct canonical_target) target_types, string_agg(distinct target_id, ',' order by target_id) source_ids, len(list_distinct(flatten(list(providers)))) n_providers, len(flatten(list(supporting))) ns_all, len(list_distinct(flatten(list(supporting)))) n_supporting, len(list_distinct(flatten(list(support_refs)))) n_refs, len(list_distinct(list_transform(flatten(list(support_refs)), lambda x: upper(string_split(x, '-')[1])))) n_families from keyed group by 1),
obs as (select canonical_key, representative, canonical_target, unit, family, subsystem, case when ap then 'primary_candidate' else oc end original_class, score, sources, support_sources, n_providers, n_supporting, n_refs, n_families, target_types, source_ids,
 round(greatest(0, least(0.18, case when n_supporting >= 3 then 0.10 when n_supporting = 2 then 0.06 else 0 end + least(0.06, greatest(n_families - 1, 0) * 0.03 + greatest(n_refs - 1, 0) * 0.005) + least(0.04, greatest(support_sources - 1, 0) * 0.01) + least(0.02, (ns_all - n_supporting) * 0.005) - least(0.06, greatest(target_types - 1, 0) * 0.03)))::double, 4) bonus,
 case when n_supporting > 0 then round(least(1.0, 0.25 + least(n_supporting, 3) * 0.15 + least(n_families, 3) * 0.10 + least(support_sources, 4) * 0.05 + least(n_refs, 6) * 0.025)::double, 4) else 0 end::double support_score, case when n_supporting >= 2 and support_sources >= 2 then round(least(1.0, n_supporting / greatest(support_sources, n_supporting)), 4) else 0 end::double provider_ratio from o0)"""
_DIM = "dm as (select (select count(distinct provider) from claims) total, count(*) filter (where agreement) agreements, count(*) filter (where disagreement) disagreements, max(case when agreement then len(supporting) end) most, count(*) filter (where agreement and key <> '') nc, count(*) filter (where agreement and target in ('throughput_disappearance', 'latency_regression')) ni from grp), dim as (select total, agreements, disagreements, case when agreements > 0 and coalesce(most, 0) >= greatest(total, 1) and nc > 0 then 'strong' when nc > 0 then 'partial' else 'weak' end evidence, case when agreements = 0 then 'none' when disagreements > 0 then 'partial' else 'strong' end as cause, case when ni = 0 then 'none' when coalesce(most, 0) >= greatest(total, 1) and disagreements = 0 then 'strong' else 'partial' end impact, agreements > 0 and coalesce(most, 0) >= greatest(total, 1) and nc > 0 technical_baseline from dm), dims as (select *, cause <> 'none' and evidence <> 'weak' and impact <> 'none' incident_baseline from dim)"""
_FOLD = "with recursive " + V._CHUNKS.removeprefix("with recursive ")
_TEXT = "lower(event_name || ' ' || template || ' ' || example || ' ' || component)"
_TOPS = f"{E._ITEMS}, sc as (select *, {_TEXT} tt, case severity when 'emergency' then 70 when 'alert' then 60 when 'critical' then 50 when 'error' then 40 when 'warn' then 30 when 'warning' then 30 when 'notice' then 25 when 'info' then 20 when 'debug' then 10 else 0 end rk, substr(sha256(concat_ws('|', {', '.join(M.ITEM_KEY)})), 1, 16) item_id from i), si as (select *, case when regexp_matches(tt, 'failure|failed|error|exception|retry|alert|critical') then 9 else 0 end + case when regexp_matches(tt, 'token|auth|ready|checkpoint') then 8 else 0 end + case when regexp_matches(tt, 'run_result|run_once|processed|matched|notified|non_target') then 7 else 0 end + case when regexp_matches(tt, 'systemd|watchdog|service|deactivated|heartbeat') then 6 else 0 end + case when regexp_matches(tt, 'pubsub|streamingpull|idle') then 5 else 0 end interest from sc), tops as (select * from si order by rk desc, n desc, interest desc, first_seen, item_id limit 140)"
_P = r"(/[A-Za-z0-9._~+@%=-][A-Za-z0-9._~+@%=/:-]*|(?:deployment|systemd|scripts|src|app|ops|bin|lib)/[A-Za-z0-9._~+@%=/:-]+)"
ORACLES = {
    "candidate_inputs": f"{_G} select target_id, evidence, target, subsystem, component, source, original_class, score, array_to_string(providers, ',') providers, array_to_string(refs, ',') refs from cand",
    "identified_candidates": f"{_ID} select subsystem, component, count(*) n, min(target_id) least from idc group by 1, 2",
    "canonical_keys": f"{_KEYED} select target_id, canonical_target, unit, family, canonical_key from keyed",
    "text_categories": f"with {LOGS}, g as (select distinct template, lower(template) t from logs where ts >= timestamp '{INCIDENT[0]}' and ts < timestamp '{INCIDENT[1]}') select template, case when regexp_matches(t, 'connection pool|connection_pool|db_pool|checkout-db') then 'database_connection_pool_exhaustion' when t like '%database%' and regexp_matches(t, 'timeout|timed out|latency|slow query') then 'database_timeout' when regexp_matches(t, 'payment.gateway') then 'external_dependency_timeout' when regexp_matches(t, 'restart|crash|exit code|process state|loop') then 'process_restart_loop' when regexp_matches(t, 'memory|oom|resource pressure') then 'resource_pressure' when regexp_matches(t, 'traceback|exception occurred|unhandled exception|request processing') then 'runtime_exception' when regexp_matches(t, 'transport|connection reset|io error|i/o error|throughput|send-path|send path|rtmps|packet loss|timeout|timed out|cloudflare|tcp anchor') then 'transport_path_failure' when regexp_matches(t, 'youtube|external dependency|watch url|ingest health') then 'external_dependency_health' when regexp_matches(t, 'freshness|capture|chromium|timestamp drift') then 'capture_freshness_gap' when regexp_matches(t, 'audio|viewer|watch|user impact|customer impact') then 'user_impact_signal_gap' when regexp_matches(t, 'observability|contract|instrumentation') then 'observability_contract_mismatch' else 'general_review' end target from g",
    "merged_observations": f"{_OBS} select * from obs",
    "review_convergence": f"{_OBS} select unit, representative, sources, n_supporting, n_refs, support_score, case when n_supporting >= 2 and n_refs >= 2 and target_types <= 1 and support_score >= 0.65 then case when support_score >= 0.8 then 'strong' else 'partial' end else 'duplicate' end convergence from obs where sources > 1 order by support_score desc, score desc, unit, canonical_key limit 5",
    "agreement_dimensions": f"{_G}, {_DIM} select * from dims",
    "arbitrated_targets": f"""{_OBS}, {_DIM}, a0 as (select obs.*, d.cause, d.impact ia, d.incident_baseline ib, unit <> 'traffic' or n_refs > 0 rt, canonical_target in ('transport_path_failure', 'latency_regression') im, sources % 7 = 6 sev, sources % 5 = 4 cav from obs, dims d),
a1 as (select *, list_filter([case when cause = 'none' and not ib then 'no_baseline_agreement_or_causal_alignment' end, case when not rt then 'support_is_context_not_runtime_evidence' end, case when n_refs = 0 then 'support_without_evidence_id' end, case when n_refs <= 1 and not im then 'single_metric_only' end, case when sev then 'severity_only_signal' end, case when not im then 'user_impact_unverified' end, case when cav then 'blocking_caveat_present' end, case when target_types > 1 then 'target_type_divergence' end, case when cause = 'none' and not ib then 'cause_disagreement' end, case when ia = 'none' and not im then 'impact_disagreement' end], lambda x: x is not null) rs,
 round(least(1.0, score + bonus, case when not rt then 0.50 else 1 end, case when n_refs = 0 then 0.55 else 1 end, case when n_refs <= 1 and not im then 0.70 else 1 end, case when sev then 0.45 else 1 end, case when not im then 0.72 else 1 end, case when cav then 0.65 else 1 end, case when target_types > 1 then 0.72 else 1 end), 4)::double final_score from a0),
a2 as (select *, case when n_refs = 0 and not rt then 'auto_archived' when len(list_filter(rs, lambda x: x <> 'support_without_evidence_id')) > 0 then 'validation_target' when original_class = 'primary_candidate' and rt and final_score >= 0.75 then 'primary_candidate' else 'validation_target' end final_class from a1)
select canonical_key, unit, final_class, final_score, array_to_string(rs, ',') reasons from a2 order by case final_class when 'primary_candidate' then 0 when 'validation_target' then 1 when 'monitor_only' then 2 else 3 end, final_score desc, canonical_key limit 40""",
    "provider_stances": f"{V._CLAIMS}, s as (select evidence, target, provider, bool_or(claim_type = 'support') s, bool_or(claim_type = 'counter_evidence') k from claims group by 1, 2, 3) select evidence, target, provider, case when s and k then 'support_and_counter' when s then 'support' when k then 'counter' when s is not null then 'caveat_or_validation' else 'silent' end stance from (select distinct evidence, target from claims) cross join (select distinct provider from claims) left join s using (evidence, target, provider)",
    "reviewer_outputs": f"""with o as (select *, output_id % 100 % 4 q, output_id // 100 % 5 w from ({OUTPUTS.replace('CONVERSATIONS', 'conversations')})) select output_id, case when q = 3 then case when w = 0 then 'invalid_after_repair' else 'invalid_json' end when w in (0, 1) or q = 1 then 'parsed_repaired' else 'parsed_original' end status,
 array_to_string(list_filter([case when w = 0 then 'strip_code_fence_wrapper' end, case when w = 1 and q <> 3 then 'extract_json_window' end, case when q = 1 then 'python_literal_to_json_literal' end], lambda x: x is not null), ',') rules,
 case q when 0 then '{{"schema_version": "v1", "summary": "s", "claims": [{{"claim_type": "support", "claim_text": "a"}}, {{"claim_type": "guess", "claim_text": "b"}}]}}' when 1 then '{{"schema_version": "v1", "summary": "", "claims": [], "ok": true, "x": null}}' when 2 then '{{"summary": "t", "claims": [{{"claim_type": "caveat"}}]}}' else case when w = 0 then '{{"summary": "broken' else raw end end as text, case q when 0 then 'claim_type_unknown' when 1 then 'summary_missing' when 2 then 'schema_version_missing,claim_text_missing' else '' end errors from o""",
    "collector_targets": f"""with {LOGS}, q as (select *, event_id % 26 = 5 as started, case when error_type = 'service_start_failure' then 'process_state_query' else 'installed_artifact_query' end as request_id from logs where ts >= timestamp '{INCIDENT[0]}' and ts < timestamp '{INCIDENT[1]}' and event_id % 26 in (4, 5))
select distinct request_id, 'path' as kind, case when started then '/srv/x' || (user_id % 4) else '/opt/app/run' || (user_id % 3) || '.sh' end as value from q where not started or request_id = 'process_state_query' union all
select distinct request_id, 'unit', v from (select request_id, unnest([case event_id % 5 when 0 then 'top-' || (user_id % 2) || '.service' when 1 then 'in-' || (user_id % 2) || '.socket' end, case when started then 'app' || (user_id % 3) || '@a.timer' end, case when started then 'worker' || (user_id % 7) || '.service' end]) v from q) where v is not null""",
    "extracted_paths": rf"with {LOGS}, r as (select message || case when event_id % 26 = 5 then chr(10) || 'No such file or directory: /opt/run' || (user_id % 3) || '.sh, inactive (dead)' else '' end t from logs where ts >= timestamp '{INCIDENT[0]}' and ts < timestamp '{INCIDENT[1]}'), e as (select list_transform(regexp_extract_all(t, '{_P}', 1), lambda x: regexp_replace(x, '[.,;:)]+$', '')) p, list_transform(flatten(list_transform(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(lower(s), 'no such file|can.t open file|cannot open file|missing|not found')), lambda s: regexp_extract_all(s, '{_P}', 1))), lambda x: regexp_replace(x, '[.,;:)]+$', '')) mp, regexp_extract_all(t, '\b[A-Za-z0-9_.@-]+\.(?:service|timer|path|socket)\b') u, list_filter(['failed', 'failure', 'exit-code', 'exited', 'restart', 'started', 'stopped', 'inactive', 'dead', 'running', 'activating', 'main process exited'], lambda w: contains(lower(t), w)) st, list_transform(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(lower(s), 'execstart|command=|cmd=|argv|can.t open file|cannot open file')), lambda s: substr(trim(s), 1, 240)) co from r) select array_to_string(p, ',') paths, array_to_string(mp, ',') missing_paths, array_to_string(u, ',') units, array_to_string(st, ',') states, array_to_string(co, ',') commands, count(*) n from e group by all",
    "requested_rows": f"with {LOGS}, x as (select *, lower(message || ' ' || template || ' ' || error_type || ' ' || labels) s from logs where ts >= timestamp '2024-01-15' and ts < timestamp '{INCIDENT[1]}'), h as (select 'stream_query' request_id, * from x where s like '%rtmps%' or s like '%ffmpeg%' union all select 'login_query', * from x where s like '%unauthorized%' union all select 'any_query', * from x) select request_id, row_number() over (partition by request_id order by ts desc, log_id desc)::int place, log_id, ts, error_type from h qualify place <= 20",
    "matched_paths": f"with {LOGS}, l as (select distinct '/srv/' || regexp_extract(message, '(run[0-9]+[.]py)', 1) path from logs where error_type = 'job_configuration_mismatch') select path, 'name' how from l where path in ('/srv/run1.py', '/srv/run3.py')",
    "top_evidence": f"{_TOPS} select item_id, event_name, severity, n, interest from tops",
    "top_logs": f"with {LOGS} select log_id, severity, ts from logs where ts >= timestamp '{INCIDENT[0]}' and ts < timestamp '{INCIDENT[1]}' order by severity_rank desc, ts, log_id limit 60",
    "sample_coverage": f"{_TOPS} select (select count(*) from si) as items, (select count(*) from tops) chosen, (select count(*) from si) - (select count(*) from tops) omitted, (select sum(n)::bigint from si) as rows, (select sum(n)::bigint from tops) chosen_rows, round((select sum(n) from tops) / (select sum(n) from si), 6) coverage_ratio",
    "semantic_chunks": f"{E._ITEMS}, b as (select case when n <= 3 then 'rare_singleton' else 'pattern' end || ':' || component || ':' || event_family || ':' || event_name bucket, case when event_name in ('event', 'info', 'warning', 'unknown') then template else '' end x, n from i) select bucket, count(distinct x) as keys, count(*) as items, sum(n)::bigint as rows from b group by 1",
    "merged_chunks": f"{_FOLD}, z as (select bucket as role, row_number() over (partition by bucket order by chunk) k, tokens, items from m), y as (select role, k, tokens, items, 1 as chunk, tokens as held from z where k = 1 union all select z.role, z.k, z.tokens, z.items, case when y.held + z.tokens > 2400 then y.chunk + 1 else y.chunk end, case when y.held + z.tokens > 2400 then z.tokens else y.held + z.tokens end from y join z on z.role = y.role and z.k = y.k + 1) select role, chunk, count(*) merged, sum(tokens)::bigint tokens, sum(items)::bigint as items from y group by 1, 2",
    "split_chunks": f"{_FOLD}, fl as (select bucket, chunk from m where first_conv % 11 = 0), z as (select f.bucket || '/' || f.chunk whole, f.k, f.tokens, row_number() over (partition by f.bucket, f.chunk order by f.k) j, (count(*) over (partition by f.bucket, f.chunk) + 1) // 2 most from f join fl using (bucket, chunk)), y as (select whole, j, tokens, most, 1 as part, tokens as held, 1 as n from z where j = 1 union all select z.whole, z.j, z.tokens, z.most, case when y.n >= y.most or y.held + z.tokens > 600 then y.part + 1 else y.part end, case when y.n >= y.most or y.held + z.tokens > 600 then z.tokens else y.held + z.tokens end, case when y.n >= y.most or y.held + z.tokens > 600 then 1 else y.n + 1 end from y join z on z.whole = y.whole and z.j = y.j + 1), u as (select 100 as floor, whole, part, tokens from y union all select 8000, whole, case when j <= most then 1 else 2 end, tokens from z) select floor, whole, part, count(*) as items, sum(tokens)::bigint tokens from u group by all",
    "merged_claims": f"{V._CLAIMS}, k as (select * from claims qualify row_number() over (partition by evidence, provider, claim_type, target, subsystem, array_to_string(refs, ','), temporary_action order by claim_id) = 1) select evidence, provider, count(*) n, min(claim_id) first_claim from k group by 1, 2",
    "run_costs": f"{V._CLAIMS}, t as (select provider, sum(length(claim_text))::bigint tokens_in, sum(length(temporary_action))::bigint tokens_out from claims group by 1), r(provider, ri, ro) as (values ('user-0', 2.5::double, 10.0::double), ('assistant-1', 1.25, 5.0)) select provider, tokens_in, tokens_out, round(tokens_in / 1e6 * coalesce(ri, 0) + tokens_out / 1e6 * coalesce(ro, 0), 8) as cost, ri is not null priced from t left join r using (provider)",
}
