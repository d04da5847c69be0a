"""Queries over records: redaction with hashes, stores of bundles and clusters, states of runs. Twins are by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators import records as K
from emberlog.operators import relational as R

from . import arbitration as A
from . import reviews as V
from . import semantics as E
from .facts import LOGS, dealt, logs, stored

#: The test data's raw messages with private data, as an expression that both dialects read.
PRIVATE = """select event_id, concat(case event_id % 12 when 0 then concat('mail Joe.', user_id % 5, '@Example.com and joe.', user_id % 5, '@example.com') when 1 then concat('from 10.0.0.', user_id % 200, ' to http://10.1.2.3:80/x/', user_id % 3) when 2 then concat('user_id=ab', user_id % 9, 'c and order-id: zz', user_id % 4)
 when 3 then concat('password=hunter', user_id % 7, ' token eyJab.cd', user_id % 3, '.ef') when 4 then concat('in /home/joe', user_id % 3, '/x and Authorization: Bearer abcdef', user_id % 3) when 6 then concat('key AIzaSyA1234567890abcdefghij', user_id % 7) when 7 then concat('oauth ya29.abc_d-', user_id % 7) when 8 then concat('pem -----BEGIN PRIVATE KEY-----MII', user_id, '-----END PRIVATE KEY----- end') when 9 then 'id_token=zz1 and order_id=''12 34'''
 when 10 then 'x-api-key: zzz to http://172.16.3.4/x' when 11 then 'v1.2.3.4 from 1.2.3.4 then user_id=abc then user_id=abcd' else 'nothing private, 3.5 s at 2024-01-01T00:00:00Z in /var/log/app.log' end, case when event_id % 5 = 0 then '  secret: s3' else '' end) as text from EVENTS where event_id is not null and user_id is not null"""


def _private(spark, d):
    dealt(spark.read.parquet(f"{d}/events.parquet"), "event_id").createOrReplaceTempView("__emberlog_private")
    return spark.sql(PRIVATE.replace("EVENTS", "__emberlog_private"))


def hashed_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Messages with hashes in place of private data, and how much of each kind there was."""
    r = K.redacted(_private(spark, d), "text", "clean")
    n = F.array_join(F.transform(F.array_sort(F.map_entries("clean_counts")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return r.select("event_id", "clean", n.alias("counts"))


def redaction_report(spark: SparkSession, d: str) -> DataFrame:
    r = K.redacted(_private(spark, d), "text", "clean").select(F.explode_outer("clean_counts").alias("kind", "n")).where("kind is not null")
    return r.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("messages"))


def fine_templates(spark: SparkSession, d: str) -> DataFrame:
    r = K.redacted(_private(spark, d), "text", "clean")
    return r.groupBy(K.fine_template(F.col("clean")).alias("template")).agg(F.count("*").alias("n"))


def redacted_labels(spark: SparkSession, d: str) -> DataFrame:
    """Attributes without secrets: by the names of their keys."""
    e = logs(spark, d).select(F.expr("map('access_token', concat('t', user_id % 3), 'order_id', concat('o', user_id % 5), 'region', environment, 'Cookie', 'c', 'user_id', '')").alias("m"), "event_id")
    e = e.withColumn("m", F.expr("map_filter(m, (k, v) -> not (event_id % 2 = 0 and k in ('access_token', 'Cookie')))"))
    return e.select(F.explode(K.redacted_map(F.col("m"))).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


def disagreement_themes(spark: SparkSession, d: str) -> DataFrame:
    g = A._groups(spark, d).where("disagreement").withColumn("theme", K.theme(F.concat_ws(" ", "target", "subsystem", "component", "text")))
    return g.groupBy("theme").agg(F.count("*").alias("groups"), F.min("target_id").alias("first_id"))


def chunk_failures(spark: SparkSession, d: str) -> DataFrame:
    """Runs of chunks by what became of them."""
    m = V.chunk_manifest(spark, d).selectExpr("bucket", "chunk", "first_conv % 12 as k", "tokens % 4 as a")
    text = F.expr("case k when 0 then 'Request blocked by filter' when 1 then 'maximum context of model' when 2 then 'HTTP 429' when 3 then 'timed out' when 4 then 'schema_invalid' when 5 then 'empty response' else '' end")
    status = F.expr("case when k in (6, 7) then 'ok' when k = 8 then 'skipped_not_configured' else 'failed' end")
    s = K.failure_status(status, F.col("k") == 6, text, F.expr("case when a = 1 then 'invalid_json' else 'parsed' end"), F.col("a"), F.lit(3))
    return m.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


def run_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why events of runs are no plain successes."""
    e = V._runs(spark, d).selectExpr("*", "case step when 0 then 'providers_completed' when 1 then 'child_bundle_created' when 2 then 'planner_answers_received' else 'claims_routed' end as step_key", "case when event_id % 13 = 0 then 'No-Claims' when event_id % 17 = 0 then 'other reason' end as said", "case event_id % 5 when 0 then 'skipped' when 1 then 'error' else '' end as of_meta", "case when event_id % 7 = 0 then 'Timeout here' else '' end as msg")
    return e.groupBy("step_key", "status", K.reason_code(F.col("step_key"), F.col("status"), F.col("said"), F.col("of_meta"), F.col("msg")).alias("reason")).agg(F.count("*").alias("n"))


def inferred_citations(spark: SparkSession, d: str) -> DataFrame:
    """Claims without citations get those that their text names."""
    c = V.claims(spark, d).withColumn("n", F.length("claim_text")).withColumn("claim_text", F.expr("concat('see item-', n % 70, ' and item-', n % 9, ', item-', n % 70)"))
    return K.inferred_refs(c, V.items(spark, d), r"item-\d+").select("claim_id", F.array_join("refs", ",").alias("refs"), "inferred")


#: The test data's bundles: several versions of each incident.
BUNDLES = "select concat('ev-', event_id % 3) as evidence, concat('svc-', event_id % 6) as service, event_id % 4 as incident, ts as created_at, event_id as bundle_id from EVENTS where event_id is not null and ts is not null"


def _bundles(spark, d):
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("__emberlog_bundles")
    return spark.sql(BUNDLES.replace("EVENTS", "__emberlog_bundles"))


def latest_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Bundles that are the latest of their evidence and of their incident. Each ranking keeps a row of each task only."""
    last = F.desc("created_at"), F.desc("bundle_id")
    b = R.latest_by(_bundles(spark, d), ["evidence"], *last)
    return b.join(R.latest_by(_bundles(spark, d), ["service", "incident"], *last).select("bundle_id"), "bundle_id", "left_semi").select("bundle_id", "evidence", "service", "incident")


def bundle_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Visible clusters of the latest bundles, the best first."""
    b = latest_bundles(spark, d).select("evidence", "bundle_id")
    s = V._shaped(spark, d).where("representative and visibility = 'review'")
    return s.join(b, "evidence").orderBy(F.desc("effective"), "cluster_id").limit(25).select("cluster_id", "bundle_id", "target", "effective")


def child_bundles(spark: SparkSession, d: str) -> DataFrame:
    """How many children the bundles have of which children exist, and the latest of these."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_id is not null").selectExpr("event_id as bundle_id", "ts as created_at", "case when event_id % 3 > 0 then event_id - event_id % 3 end as parent_id")
    kids = e.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"), F.max_by("bundle_id", F.struct("created_at", "bundle_id")).alias("latest_child"))
    return e.select("bundle_id").join(kids.withColumnRenamed("parent_id", "bundle_id"), "bundle_id").select("bundle_id", "children", "latest_child")


def provider_models(spark: SparkSession, d: str) -> DataFrame:
    """Propositions with the model of each provider's latest run."""
    last = R.latest_by(V._runs(spark, d).where("provider is not null"), ["provider"], F.desc("ts"), F.desc("event_id")).select("provider", F.concat(F.lit("model-"), (F.col("event_id") % 4).cast("string")).alias("model"))
    c = V.claims(spark, d).withColumn("provider", F.concat(F.lit("p-"), (F.length("claim_text") % 4).cast("string")))
    return c.join(F.broadcast(last), "provider", "left").groupBy("provider", F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count("*").alias("claims"))  # a row for each provider


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Observations of which a source is among the evidence of a chunk: by overlap of their sets of ids."""
    wanted = A._candidates(spark, d).where("source = 'claims'").select("target_id", "refs")
    chunk = spark.createDataFrame([("chunk-1", ["item-1", "item-2", "item-3"]), ("chunk-2", ["item-30", "item-35"])], "chunk_id string, ids array<string>")
    hit = wanted.select("target_id", F.explode("refs").alias("x")).join(F.broadcast(chunk.select("chunk_id", F.explode("ids").alias("x"))), "x")  # a chunk's ids are within its budget
    return hit.groupBy("chunk_id").agg(F.countDistinct("target_id").alias("rows"), F.min("target_id").alias("least"))


def target_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Of each target how many providers found it, of all that there are, and how diverse its evidence is."""
    c = V.claims(spark, d)
    total = c.agg(F.countDistinct("provider").alias("total"))
    t = c.groupBy("target").agg(F.countDistinct("provider").alias("detected"), F.countDistinct("claim_type").alias("kinds"), F.count_if(F.col("claim_type") == "counter_evidence").alias("disagreements"))
    refs = c.select("target", F.explode("refs").alias("x")).groupBy("target").agg(F.countDistinct("x").alias("n_refs"))
    t = t.join(refs, "target", "left").crossJoin(F.broadcast(total))  # one row
    return t.select("target", "detected", "total", F.round(F.col("detected") / F.col("total"), 4).alias("detection"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"), "kinds", "disagreements")


def public_targets(spark: SparkSession, d: str) -> DataFrame:
    """One public target of each unit: the one of the highest rank, with the others' evidence merged into it."""
    o = A._observations(spark, d).withColumn("unit_key", F.regexp_replace(F.lower("unit"), "[^a-z0-9]+", "_"))
    rank = [F.expr("case original_class when 'primary_candidate' then 3 when 'validation_target' then 2 else 1 end").desc(), F.desc("n_supporting"), F.desc("n_refs"), F.desc("score"), F.asc("unit"), F.asc("canonical_key")]
    w = Window.partitionBy("unit_key")
    o = o.withColumns({"place": F.row_number().over(w.orderBy(*rank)), "merged": F.count("*").over(w), "all_sources": F.sum("sources").over(w)})
    return o.where("place = 1").orderBy(F.desc("score"), "unit_key").select("unit_key", "canonical_key", "original_class", "score", "merged", F.col("all_sources").cast("long").alias("all_sources"))


def public_target_refs(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of public targets, with that of the duplicates that each stands for: a row for each reference, with how
    many of the observations cite it."""
    units = A._observations(spark, d).select("canonical_key", F.regexp_replace(F.lower("unit"), "[^a-z0-9]+", "_").alias("unit_key"))
    cited = A._keyed(spark, d).select("canonical_key", F.explode("support_refs").alias("ref")).distinct()
    return cited.join(units, "canonical_key").groupBy("unit_key", "ref").agg(F.count("*").alias("observations"))


def recorded_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on clusters, recorded on every member."""
    c = V._shaped(spark, d).select("cluster_id", "proposition_id", "evidence", "target", "subsystem")
    last = R.latest_by(V._decisions(spark, d), ["evidence", "target", "subsystem"], F.desc("decided_at"))
    return c.join(last, ["evidence", "target", "subsystem"]).groupBy("cluster_id", "decision").agg(F.count("*").alias("members"), F.min("proposition_id").alias("least"))


def graph_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of each run's graph that differ from the one before, and the latest of these."""
    s = V._runs(spark, d).where("status <> 'running'").withColumn("content", F.concat_ws("-", "status", (F.col("step") % 2).cast("string")))
    new = K.new_snapshots(s, ["run_id"], F.struct("ts", "event_id").asc())
    return new.groupBy("run_id").agg(F.count("*").alias("saved"), F.max_by("content", F.struct("ts", "event_id")).alias("latest"))


def input_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of each bundle's claims, and whether it is that of an earlier state without the last claims."""
    c = V.claims(spark, d)
    now, old = K.fingerprint(c, "evidence", "claim_id", "claim_type"), K.fingerprint(c.where("evidence <> 'ev-1' or claim_type <> 'caveat'"), "evidence", "claim_id", "claim_type")
    return now.join(old.withColumnRenamed("fingerprint", "old"), "evidence", "left").select("evidence", "fingerprint", F.when(F.col("old").isNull(), "computed").when(F.col("old") == F.col("fingerprint"), "persisted").otherwise("stale").alias("state"))


def inserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a stream of batches with their ids: a row that comes again is not inserted twice, and none is empty."""
    e = logs(spark, d)
    again = e.where("event_id % 10 = 0")
    rows = e.unionByName(again).select(F.concat_ws(":", "service", "log_id").alias("row_id"), F.to_json(F.struct("service", F.nullif("resource_type", F.lit("")).alias("resource_type"), "deploy_id"), {"ignoreNullFields": "true"}).alias("doc"))
    return rows.dropDuplicates(["row_id"]).groupBy("doc").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (hashed_redaction, redaction_report, fine_templates, redacted_labels, disagreement_themes, chunk_failures, run_reasons, inferred_citations, latest_bundles, bundle_clusters, child_bundles, provider_models, chunk_rows, target_rollup, public_targets, public_target_refs, recorded_decisions, graph_snapshots, input_fingerprints, inserted_rows)}


# ---- twins

_H = "substr(sha256({}), 1, 12)"
_PRIV = f"""p as (select e.event_id, e.user_id u, e.event_id % 12 k, e.event_id % 5 = 0 s, x.text from ({PRIVATE.replace('EVENTS', 'events')}) x join events e using (event_id)),
c as (select event_id, k, u, s, case k when 0 then 'mail <EMAIL_HASH:' || {_H.format("'joe.' || (u % 5) || '@example.com'")} || '> and <EMAIL_HASH:' || {_H.format("'joe.' || (u % 5) || '@example.com'")} || '>' when 1 then 'from <IP_HASH:' || {_H.format("'10.0.0.' || (u % 200)")} || '> to <URL_HASH:' || {_H.format("'http://10.1.2.3:80/x/' || (u % 3)")} || '>'
 when 2 then 'user_id=<ID_HASH:' || {_H.format("'ab' || (u % 9) || 'c'")} || '> and order-id=<ID_HASH:' || {_H.format("'zz' || (u % 4)")} || '>' when 3 then '<REDACTED_SECRET> token <REDACTED_SECRET>' when 4 then 'in <USER_HOME>/x and <REDACTED_SECRET>' when 6 then 'key <REDACTED_SECRET>' when 7 then 'oauth <REDACTED_SECRET>' when 8 then 'pem <REDACTED_SECRET> end' when 9 then '<REDACTED_SECRET> and order_id=<ID_HASH:' || {_H.format("'12 34'")} || '>' when 10 then '<REDACTED_SECRET> to <URL_HASH:' || {_H.format("'http://172.16.3.4/x'")} || '>'
 when 11 then 'v1.2.3.4 from <IP_HASH:' || {_H.format("'1.2.3.4'")} || '> then user_id=<ID_HASH:' || {_H.format("'abc'")} || '> then user_id=<ID_HASH:' || {_H.format("'abcd'")} || '>' else 'nothing private, 3.5 s at 2024-01-01T00:00:00Z in /var/log/app.log' end || case when s then ' <REDACTED_SECRET>' else '' end clean,
 list_filter([case when k = 4 then 'authorization_header=1' end, case when k in (6, 7) then 'cloud_credential=1' end, case when k = 0 then 'email=2' end, case when k in (2, 11) then 'id_like=2' when k = 9 then 'id_like=1' end, case when k in (1, 10) then 'internal_url=1' end, case when k in (1, 11) then 'ip_address=1' end,
 case when (case k when 3 then 2 when 6 then 1 when 8 then 1 when 9 then 1 when 10 then 1 else 0 end) + s::int > 0 then 'secret_like=' || ((case k when 3 then 2 when 6 then 1 when 8 then 1 when 9 then 1 when 10 then 1 else 0 end) + s::int) end, case when k in (3, 4, 7, 9) then 'token_like=1' end, case when k = 4 then 'user_home=1' end], lambda x: x is not null) counts from p)"""
_SUMMED = "sha256(concat_ws('-', count(*), " + ", ".join(f"sum(cast('0x' || substr(x, {1 + 8 * k}, 8) as ubigint))::hugeint::varchar" for k in range(8)) + "))"
_RUNS = f"with {V._RUN}"
_B = f"b as ({BUNDLES.replace('EVENTS', 'events')}), lb as (select * from (select *, row_number() over (partition by evidence order by created_at desc, bundle_id desc) evidence_rn, row_number() over (partition by service, incident order by created_at desc, bundle_id desc)::int incident_rn from b) where evidence_rn = 1 and incident_rn = 1)"
ORACLES = {
    "hashed_redaction": f"with {_PRIV} select event_id, clean, array_to_string(counts, ',') counts from c",
    "redaction_report": f"with {_PRIV}, x as (select event_id, unnest(counts) v from c) select split_part(v, '=', 1) as kind, sum(split_part(v, '=', 2)::int)::bigint n, count(*) messages from x group by 1",
    "fine_templates": f"with {_PRIV} select case k when 0 then 'mail <EMAIL> and <EMAIL>' when 1 then 'from <IP> to <URL>' when 2 then 'user_id=<ID> and order-id=<ID>' when 3 then '<SECRET> token <SECRET>' when 4 then 'in <PATH> and <SECRET>' when 6 then 'key <SECRET>' when 7 then 'oauth <SECRET>' when 8 then 'pem <SECRET> end' when 9 then '<SECRET> and order_id=<ID>' when 10 then '<SECRET> to <URL>' when 11 then 'v1.<NUM>.<NUM> from <IP> then user_id=<ID> then user_id=<ID>' else 'nothing private, <NUM> s at <TIMESTAMP> in <PATH>' end || case when s then ' <SECRET>' else '' end as template, count(*) n from c group by 1",
    "redacted_labels": f"with {LOGS} select 'order_id' as key, '<ID_HASH:' || {_H.format(chr(39) + 'o' + chr(39) + ' || (user_id % 5)')} || '>' as value, count(*) n from logs group by all union all select 'region', environment, count(*) from logs group by all union all select 'user_id', '', count(*) from logs union all select 'redacted_secret', '<REDACTED_SECRET>', count(*) from logs where event_id % 2 <> 0",
    "disagreement_themes": f"{A._G}, t as (select *, lower(concat_ws(' ', target, subsystem, component, text)) x from grp where disagreement) select case when regexp_matches(x, 'external|dependency|http_5xx|timeout') then 'external_dependency' when regexp_matches(x, 'user impact|delivery|ingest|watch|audio') then 'user_impact' when regexp_matches(x, 'freshness|stale|timestamp|drift') then 'freshness' when regexp_matches(x, 'metric|count|aggregation|mismatch') then 'instrumentation' when regexp_matches(x, 'deployment|config|version') then 'deployment' else 'general' end theme, count(*) groups, min(target_id) first_id from t group by 1",
    "chunk_failures": f"{V._CHUNKS}, x as (select first_conv % 12 k, tokens % 4 a from m) select case when k = 6 then 'ok' when k = 8 then 'skipped_not_configured' when k = 0 then 'safety_filter' when k = 1 then 'context_length' when k = 2 then 'rate_limited' when k = 3 then 'timeout' when k = 4 then 'schema_invalid' when k = 7 and a = 1 then 'deterministic_parse_failure' when k = 7 then 'schema_invalid' when k = 5 then 'empty_response' when a = 3 then 'retry_exhausted' else 'provider_error' end status, count(*) n from x group by 1",
    "run_reasons": f"{_RUNS}, x as (select *, case step when 0 then 'providers_completed' when 1 then 'child_bundle_created' when 2 then 'planner_answers_received' else 'claims_routed' end step_key, event_id % 5 q from r) select step_key, status, case when event_id % 13 = 0 then 'no_claims_extracted' when event_id % 17 = 0 then 'other_reason' when status = 'failed' and step = 1 then 'child_bundle_missing' when status = 'needs_input' then case when step = 2 then 'no_planner_answers' else 'human_input_required' end when event_id % 7 = 0 then 'provider_timeout' when q = 0 then 'provider_not_configured' when q = 1 and step = 0 then 'provider_failed' when status = 'failed' then step_key else '' end reason, count(*) n from x group by all",
    "inferred_citations": f"{V._CLAIMS}, x as (select claim_id, refs, length(claim_text) n from claims), y as (select *, list_filter(case when n % 70 = n % 9 then ['item-' || (n % 70)] else ['item-' || (n % 70), 'item-' || (n % 9)] end, lambda v: list_contains(k, v)) nm from x, known) select claim_id, array_to_string(case when len(refs) = 0 and len(nm) > 0 then nm else refs end, ',') refs, len(refs) = 0 and len(nm) > 0 inferred from y",
    "latest_bundles": f"with {_B} select bundle_id, evidence, service, incident from lb",
    "bundle_clusters": f"{V._SHAPED}, {_B} select cluster_id, bundle_id, target, effective from shaped join lb using (evidence) where representative and visibility = 'review' order by effective desc, cluster_id limit 25",
    "child_bundles": "with e as (select event_id bundle_id, ts created_at, case when event_id % 3 > 0 then event_id - event_id % 3 end parent_id from events where event_id is not null), k as (select parent_id, count(*) children, last(bundle_id order by created_at, bundle_id) latest_child from e where parent_id is not null group by 1) select e.bundle_id, children, latest_child from e join k on k.parent_id = e.bundle_id",
    "provider_models": f"{V._CLAIMS}, {V._RUN}, l as (select provider, 'model-' || (event_id % 4) model from r where provider is not null qualify row_number() over (partition by provider order by ts desc, event_id desc) = 1), c as (select 'p-' || (length(claim_text) % 4) provider from claims) select provider, coalesce(model, 'unknown') model, count(*) claims from c left join l using (provider) group by all",
    "chunk_rows": f"{A._G}, ch(chunk_id, ids) as (values ('chunk-1', ['item-1', 'item-2', 'item-3']), ('chunk-2', ['item-30', 'item-35'])) select chunk_id, count(*) as rows, min(target_id) least from cand join ch on list_has_any(refs, ids) where source = 'claims' group by 1",
    "target_rollup": f"{V._CLAIMS}, n as (select count(distinct provider) total from claims) select target, count(distinct provider) detected, any_value(total) total, round(count(distinct provider) / any_value(total), 4) detection, len(list_distinct(flatten(list(refs)))) n_refs, count(distinct claim_type) kinds, count(*) filter (where claim_type = 'counter_evidence') disagreements from claims, n group by 1",
    "public_target_refs": f"{A._OBS}, w as (select canonical_key, regexp_replace(lower(unit), '[^a-z0-9]+', '_', 'g') unit_key from obs), y as (select distinct canonical_key, unnest(support_refs) as ref from keyed) select unit_key, ref, count(*) observations from y join w using (canonical_key) group by all",
    "public_targets": f"{A._OBS}, w as (select *, regexp_replace(lower(unit), '[^a-z0-9]+', '_', 'g') unit_key from obs) select unit_key, canonical_key, original_class, score, count(*) over (partition by unit_key) merged, (sum(sources) over (partition by unit_key))::bigint all_sources from w qualify row_number() over (partition by unit_key order by case original_class when 'primary_candidate' then 3 when 'validation_target' then 2 else 1 end desc, n_supporting desc, n_refs desc, score desc, unit, canonical_key) = 1",
    "recorded_decisions": f"{V._SHAPED} select cluster_id, l.decision, count(*) members, min(proposition_id) least from shaped s join lastd l on l.evidence = s.evidence and l.target = s.target and l.subsystem = s.subsystem group by 1, 2",
    "graph_snapshots": f"{_RUNS}, s as (select *, status || '-' || (step % 2) content from r where status <> 'running'), n as (select *, lag(content) over (partition by run_id order by ts, event_id) b from s) select run_id, count(*) saved, last(content order by ts, event_id) latest from n where b is null or b <> content group by 1",
    "input_fingerprints": f"{V._CLAIMS}, h as (select evidence, claim_type, sha256(claim_id || '|' || claim_type) x from claims), a as (select evidence, {_SUMMED} fingerprint from h group by 1), b as (select evidence, {_SUMMED} o from h where evidence <> 'ev-1' or claim_type <> 'caveat' group by 1) select evidence, fingerprint, case when o is null then 'computed' when o = fingerprint then 'persisted' else 'stale' end state from a left join b using (evidence)",
    "inserted_rows": f"""with {LOGS}, r as (select distinct service || ':' || log_id row_id, '{{"service":"' || service || '"' || case when resource_type <> '' then ',"resource_type":"' || resource_type || '"' else '' end || case when deploy_id is not null then ',"deploy_id":"' || deploy_id || '"' else '' end || '}}' doc from logs) select doc, count(*) n from r group by 1""",
}
