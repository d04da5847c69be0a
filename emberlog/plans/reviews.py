"""Queries over relations between evidence items, reviewers' claims, tables with versions, work items and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators import claims as C
from emberlog.operators import documents as D
from emberlog.operators import packing as K
from emberlog.operators import relational as R
from emberlog.operators import text as T

from .facts import INCIDENT, LOGS, cur, logs, stored


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- relations between items


def _items(spark, d):
    """Logs of the incident with their evidence item: error type by service and day."""
    rows = R.in_window(logs(spark, d), *INCIDENT)
    return rows.withColumn("item", F.concat_ws("/", "service", "error_type", F.date_format("ts", "dd")))


def _signal_items(spark, d):
    """All items from WARN on: their highest severity, count and span."""
    i = _items(spark, d).groupBy("item").agg(F.max("severity_rank").alias("top_rank"), F.count("*").alias("n"), F.min("ts").alias("s"), F.max("ts").alias("e"))
    return i.where("top_rank >= 30")


def _high_signal(spark, d):
    """The 32 items of the highest severity and count, as the SQL of shared_traces, overlapping_items, relation_edges and
    candidate_inputs has them; relationship_candidates pairs all (_signal_items)."""
    return _signal_items(spark, d).orderBy(F.desc("top_rank"), F.desc("n"), "item").limit(32)


def shared_traces(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items with common traces, and the share of either's traces."""
    top = F.broadcast(_high_signal(spark, d).select("item"))  # 32 rows
    out = R.overlap_pairs(_items(spark, d).join(top, "item", "left_semi"), "item", "trace_id")
    return out.select("a", "b", "shared", F.round("coverage_a", 6).alias("coverage_a"), F.round("coverage_b", 6).alias("coverage_b"))


def overlapping_items(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items whose spans overlap in time without a shared trace, both with traces."""
    top = _high_signal(spark, d)
    traced = _items(spark, d).where("trace_id is not null").select("item", "trace_id").distinct().join(F.broadcast(top.select("item")), "item", "left_semi")
    spans = top.join(traced.select("item").distinct(), "item", "left_semi")
    a, b = (spans.select(F.col("item").alias(x), F.col("s").alias(f"s{x}"), F.col("e").alias(f"e{x}")) for x in "ab")
    pairs = a.join(F.broadcast(b), F.expr("a < b and greatest(sa, sb) <= least(ea, eb)"))  # 32 rows a side
    return pairs.select("a", "b").join(R.overlap_pairs(traced, "item", "trace_id").select("a", "b"), ["a", "b"], "left_anti")


def deployments_before_signals(spark: SparkSession, d: str) -> DataFrame:
    """Items of a signal that begin up to half an hour after a deployment was last seen on a service that day."""
    dep = logs(spark, d).where("deploy_id is not null").groupBy("deploy_id", F.col("service").alias("deployed_on"), "day").agg(F.max("ts").alias("last_seen"))
    return _signals_after(spark, d, dep, "deploy_id", "deployed_on")


def whole_deployments_before_signals(spark: SparkSession, d: str) -> DataFrame:
    """Items of a signal that begin up to half an hour after a deployment was last seen anywhere; the test data's deployments
    are those of a day."""
    name = F.concat_ws("/", "deploy_id", F.date_format("ts", "yyyy-MM-dd"))
    dep = logs(spark, d).where("deploy_id is not null").groupBy(name.alias("deployment")).agg(F.max("ts").alias("last_seen"))
    return _signals_after(spark, d, dep, "deployment")


def _signals_after(spark, d, dep, *names):
    sig = R.in_window(logs(spark, d), *INCIDENT).where("severity_rank >= 30").groupBy("service", "template", "day").agg(F.min("ts").alias("first_seen")).withColumn("k", F.lit(1))
    out = R.range_join(dep.withColumn("k", F.lit(1)), sig.drop("day"), ["k"], "last_seen", "first_seen", 1800)
    return out.select(*names, "service", "template", "first_seen", F.col("gap_s").cast("long").alias("gap_s"))


def _deployed_and_failed(spark, d):
    rows = logs(spark, d)
    dep = rows.where("deploy_id is not null").select("service", F.col("event_id").alias("deployed"), "ts")
    return dep, rows.where("severity_rank >= 40").select("service", F.col("event_id").alias("failed"), "ts")


def deployments_before_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every event of a deployment with each error of the same service up to half an hour after it."""
    dep, err = _deployed_and_failed(spark, d)
    pairs = R.range_join(dep.withColumnRenamed("ts", "deploy_ts"), err.withColumnRenamed("ts", "error_ts"), ["service"], "deploy_ts", "error_ts", 1800)
    return pairs.select("service", "deployed", "failed", F.col("gap_s").cast("long").alias("gap_s"))


def last_deployment_before_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors up to half an hour after events of a deployment of the same service: how many there were, and the last one."""
    return K.last_before(*_deployed_and_failed(spark, d), "service", "deployed", "failed", "ts", 1800)


# ---- claims: conversations are reviewers' statements, role and turn the reviewer, benchmark items the evidence

#: The test data's claims, as an expression that both dialects read: not an operator.
CLAIMS = """select concat('claim-', conv_id, '-', turn) as claim_id, concat('ev-', conv_id % 3) as evidence, conv_id as result_id, case when conv_id % 11 = 0 then 'rule-engine' else concat(role, '-', turn % 3) end as provider,
 case when conv_id % 13 = 0 then 'insufficient_evidence' when n % 7 = 3 then 'counter_evidence' when n % 7 = 4 then 'caveat' when n % 7 = 5 then 'validation_target' when n % 7 = 6 then 'next_data_needed' else 'support' end as claim_type,
 case n % 9 when 0 then 'Supported' when 1 then 'contradicted' when 2 then 'no_finding' else '' end as said, case when conv_id % 5 = 0 then 'contradicted' end as of_result, coalesce(text, '') as claim_text,
 case when n % 5 > 0 then concat('item-', n % 60, ',item-', (n * 7) % 60) else '' end as refs_csv, case when n % 4 = 0 then concat('item-', (n * 3) % 50) else '' end as counter_csv, case when n % 6 = 0 then concat('need-', n % 4) else '' end as missing_csv,
 case n % 8 when 0 then 'restart the worker' when 1 then 'Delete the queue' when 2 then 'purge the cache' else '' end as temporary_action, case n % 10 when 0 then 'validate alerts' when 1 then 'ignore alert' else '' end as permanent_action,
 case conv_id % 9 when 0 then 'throughput_disappearance' when 1 then 'heartbeat_missing' when 2 then 'job_configuration_mismatch' when 3 then 'network_error_signal' when 4 then 'freshness_signal_gap' when 5 then 'restart_loop' when 6 then 'monitoring_gap' when 7 then 'latency_regression' else 'state_mismatch' end as target,
 case n % 4 when 0 then 'traffic' when 1 then 'resource_pressure' when 2 then 'network_transport' else 'general' end as subsystem, concat('c', n % 2) as component
 from (select *, length(coalesce(text, '')) as n from CONVERSATIONS where conv_id is not null and turn is not null and role is not null) t"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "claims", lambda: _claims(spark, d))


def _claims(spark, d):
    _table(spark, d, "conversations").createOrReplaceTempView("__emberlog_conversations")
    c = spark.sql(CLAIMS.replace("CONVERSATIONS", "__emberlog_conversations"))
    listed = lambda x: F.filter(F.split(x, ","), lambda v: v != "")
    c = c.withColumns({"refs": listed("refs_csv"), "counter_refs": listed("counter_csv"), "missing": listed("missing_csv"), "finding_status": C.finding_status(F.col("claim_type"), F.col("said"), F.col("of_result"))})
    return C.with_valid_refs(c, items(spark, d))


def items(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("item_id"))


def claim_validity(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d)
    return c.select("claim_id", "provider", "valid", F.array_join("lost", ",").alias("lost"), "finding_status", C.effective_stance(F.col("claim_type"), F.col("finding_status")).alias("stance"))


def proposition_texts(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d)
    p = C.propositions(c).join(C.linked_claims(c), list(C.GROUP))
    return p.select("proposition_id", *C.GROUP, "n_claims", "linked", "support_summary", "counter_summary", F.array_join("next_data", "|").alias("next_data"), "priority", "cause")


def proposition_links(spark: SparkSession, d: str) -> DataFrame:
    """Which claims each proposition has."""
    return C.proposition_links(claims(spark, d))


def proposition_scores(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d)
    results = c.select("result_id").distinct().withColumn("schema_valid", F.col("result_id") % 4 > 0)
    return C.scores(C.propositions(c), c, results)


def claim_stance_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.claim_groups(claims(spark, d), items(spark, d))


def reviewer_comparison(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d)
    return C.compared(C.propositions(c), c, "user-0", "assistant-1")


def comparison_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.comparison_summary(reviewer_comparison(spark, d))


def structured_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = C.structured_evidence(claims(spark, d))
    hist = F.array_join(F.transform("statuses", lambda x: F.concat(x["finding_status"], F.lit("="), x["n"].cast("string"))), ",")
    return e.select(*C.GROUP, *[F.array_join(c, "|").alias(c) for c in ("support", "counter", "caveats", "next_data")], hist.alias("statuses"))


#: The test data's decisions on bundles and targets.
DECISIONS = """select doc_id as decided_at, concat('ev-', doc_id % 3) as evidence, case doc_id % 9 when 0 then 'throughput_disappearance' when 1 then 'heartbeat_missing' when 2 then 'job_configuration_mismatch' when 3 then 'network_error_signal' when 4 then 'freshness_signal_gap' when 5 then 'restart_loop' when 6 then 'monitoring_gap' when 7 then 'latency_regression' else 'state_mismatch' end as target,
 case doc_id % 4 when 0 then 'traffic' when 1 then 'resource_pressure' when 2 then 'network_transport' else 'general' end as subsystem, case when toxic = 1 then 'rejected' when quality = 1 and doc_id % 3 = 0 then 'accepted' when doc_id % 5 = 0 then 'needs_more_data' else 'viewed' end as decision,
 case when toxic = 1 and doc_id % 2 = 0 then 'low_value' when toxic = 1 then 'duplicate' when doc_id % 6 = 0 then 'watchlist' else '' end as detail from LABELS where doc_id is not null"""


def _decisions(spark, d):
    _table(spark, d, "labels").createOrReplaceTempView("__emberlog_labels")
    return spark.sql(DECISIONS.replace("LABELS", "__emberlog_labels"))


def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The latest decision on each proposition's target, and its status."""
    last = R.latest_by(_decisions(spark, d), list(C.GROUP), F.desc("decided_at"))
    return last.select(*C.GROUP, "decision", C.decision_status(F.col("decision"), F.col("detail")).alias("status"))


def _shaped(spark, d):
    return stored(spark, d, "shaped", lambda: _shape(spark, d))


def _shape(spark, d):
    c = claims(spark, d)
    results = c.select("result_id").distinct().withColumn("schema_valid", F.col("result_id") % 4 > 0)
    props = C.propositions(c)
    last = R.latest_by(_decisions(spark, d), list(C.GROUP), F.desc("decided_at")).select(*C.GROUP, "decision", "detail")
    by = list(C.GROUP)
    acts = c.groupBy(*by).agg(F.max(((F.col("temporary_action") != "") | (F.col("permanent_action") != "")).cast("int")).alias("acts"), F.sort_array(F.collect_set("provider")).alias("providers"))
    q = props.select("proposition_id", *by, "n_claims").join(C.scores(props, c, results).select("proposition_id", F.col("review_priority").alias("score")), "proposition_id")
    q = q.join(C.structured_evidence(c), by).join(acts, by).join(last, by, "left").withColumn("actionable", F.col("acts") == 1).withColumn("no_action", F.col("n_claims") % 5 == 0)
    return C.shaped_queue(q.withColumn("decision", F.coalesce("decision", F.lit(""))).withColumn("detail", F.coalesce("detail", F.lit(""))))


def shaped_propositions(spark: SparkSession, d: str) -> DataFrame:
    caps = F.array_join(F.transform("caps", lambda x: x["reason"]), ",")
    return _shaped(spark, d).select("proposition_id", F.round("score", 4).alias("score"), "effective", "visibility", "mode", "cluster_id", "representative", "duplicate_primary", caps.alias("caps"), F.col("history.effect").alias("history"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return C.queue(_shaped(spark, d), 30).select("proposition_id", *C.GROUP, "effective", "mode")


def proposition_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.clusters(_shaped(spark, d))


def review_targets(spark: SparkSession, d: str) -> DataFrame:
    """The five most urgent targets of the queue, and what the whole set holds."""
    q = _shaped(spark, d).where("visibility = 'review'")
    total = q.agg(F.count("*").alias("total"), F.count_if(F.col("mode") == "incident_candidate").alias("incidents"), F.count_if(F.col("mode") == "validation_target").alias("validations"), F.countDistinct("subsystem").alias("subsystems"), F.countDistinct("evidence").alias("bundles"))
    return q.orderBy(F.desc("effective"), "cluster_id", "proposition_id").limit(5).select("proposition_id", "target", "effective").crossJoin(F.broadcast(total))  # one row


#: Targets to rank: what reviewers say of each bundle and target.
def review_priorities(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d)
    by = ["evidence", "target"]
    t = c.groupBy(*by).agg(
        F.sort_array(F.collect_set("provider")).alias("providers"), F.sort_array(F.collect_set(F.when(F.col("claim_type") == "support", F.col("provider")))).alias("claimed"), F.countDistinct("subsystem").alias("n_families"), F.countDistinct("component").alias("n_sources"),
        F.min("temporary_action").alias("low"), F.max("temporary_action").alias("title"), F.count("*").alias("n"),
    )
    t = t.join(C.distinct_values(c, by, "refs", "refs"), by, "left").join(C.distinct_values(c, by, "missing", "missing"), by, "left")
    none = F.array().cast("array<string>")
    t = t.select(
        F.concat_ws("/", *by).alias("target_id"), F.when(F.col("target") == "monitoring_gap", "generic").otherwise(F.col("target")).alias("unit"), "title", F.when(F.col("n") % 3 == 0, "normal operation").when(F.col("n") % 3 == 1, "latency for viewers, user impact").otherwise("quiet").alias("text"),
        F.coalesce("missing", none).alias("missing"), F.when(F.col("n") % 2 == 0, F.array(F.lit("one"), F.lit("two"))).otherwise(none).alias("caveats"), (F.col("n") % 10 / 10.0).alias("prior"), "providers", "claimed", F.size(F.coalesce("refs", none)).alias("n_refs"), "n_families", "n_sources",
        F.when(F.col("target") == "heartbeat_missing", "primary_candidate").otherwise("validation").alias("target_class"),
    )
    weights = spark.createDataFrame([("rule-engine", 1.65, True)], "provider string, weight double, trusted boolean")
    return C.review_priority(t, weights)


def reviewer_totals(spark: SparkSession, d: str) -> DataFrame:
    """Statements, estimated tokens and a histogram of finding statuses by reviewer."""
    c = claims(spark, d)
    t = c.groupBy("provider").agg(F.count("*").alias("n"), F.sum(F.expr("(length(claim_text) + 1) div 2 + 32")).alias("tokens"), F.count_if("valid").alias("n_valid"))
    s = c.groupBy("provider", "finding_status").agg(F.count("*").alias("m")).groupBy("provider").agg(F.sort_array(F.collect_list(F.struct("finding_status", "m"))).alias("x"))
    return t.join(s, "provider").select("provider", "n", "tokens", "n_valid", F.array_join(F.transform("x", lambda v: F.concat(v["finding_status"], F.lit("="), v["m"].cast("string"))), ",").alias("statuses"))


#: Kinds of findings: what they are called, and terms of which a line must have one (fixed values).
KINDS = {
    "secret_like": ("secret_like", ("authorization", "bearer", "basic", "cookie", "password", "passwd", "secret", "private_key", "api_key", "access_token", "refresh_token", "session_id", "sk-", "aiza", "ya29.", "begin private key")),
    "email": ("raw_email", ("@",)), "ip_address": ("raw_ip", (".",)), "user_home": ("raw_home_path", ("/home/", "/users/", "\\users\\")), "internal_url": ("raw_internal_url", (".internal", "//internal")),
}


def line_findings(spark: SparkSession, d: str) -> DataFrame:
    """Safety scan: the kinds of sensitive text in each line of the documents."""
    lines = _table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", r"\n")).alias("line", "t"))
    lines = lines.withColumn("low", F.lower("t"))
    patterns = {kind: "|".join(f"(?:{p})" for k, p in D.VERIFY if k == kind) for kind in KINDS}
    kinds = F.array_compact(F.array(*[F.when(T.any_of(F.col("low"), terms) & F.col("t").rlike(patterns[kind]), F.lit(name)) for kind, (name, terms) in KINDS.items()]))
    return lines.select("doc_id", (F.col("line") + 1).alias("line"), F.explode(kinds).alias("kind"))


def document_findings(spark: SparkSession, d: str) -> DataFrame:
    """Of each source the lines with each kind of finding, and whether it passes: it does if there is none."""
    f = line_findings(spark, d).join(_table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "kind").agg(F.count("*").alias("n"))
    every = _table(spark, d, "documents").select("source").distinct()
    return every.join(f, "source", "left").select("source", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("passed"))


# ---- tables with versions


def latest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The newest document of each key: here the last order of each customer whole."""
    o = _table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("x")).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


def latest_orders(spark: SparkSession, d: str) -> DataFrame:
    """Latest-wins upsert: the last order of each customer, never replacing a finished one by an open one."""
    o = _table(spark, d, "orders")
    return R.latest_by(o, ["o_custkey"], F.expr("case when o_orderstatus = 'F' then 0 else 1 end"), F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


def two_rankings(spark: SparkSession, d: str) -> DataFrame:
    """The latest of each customer that is also the latest of its priority and status."""
    o = _table(spark, d, "orders")
    rank = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return o.withColumn("x", rank("o_custkey")).withColumn("y", rank("o_custkey", "o_orderpriority")).where("x <= 3 and y = 1").select("o_custkey", "o_orderkey", "o_orderpriority", "x")


def replace_range(spark: SparkSession, d: str) -> DataFrame:
    """Delete by half-open range and by key set, then insert: a window's rows are replaced by corrected ones."""
    e = _table(spark, d, "events").select("event_id", "ts", "event_type")
    gone = R.in_window(e, *INCIDENT).where("event_type = 'view'").select("event_id")
    new = e.join(gone, "event_id", "left_semi").withColumn("event_type", F.lit("viewed"))
    rest = e.join(gone, "event_id", "left_anti")
    return rest.unionByName(new).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def star_review(spark: SparkSession, d: str) -> DataFrame:
    """Star join: orders with customer and nation, line totals, and the latest order's status."""
    line = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    c = _table(spark, d, "customer").join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name")
    out = _table(spark, d, "orders").join(c, "o_custkey").join(line, "o_orderkey", "left")
    return out.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "c_name", "n_name", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"), "o_totalprice")


# ---- work items and the run's ledger: events are ledger entries of runs (users) and steps (types)


#: The test data's work items and run events, as an expression that both dialects read.
WORK = """select event_id as work_id, user_id as run_id, ts as updated_at, case event_id % 7 when 0 then 'ok' when 1 then 'skipped' when 2 then 'failed_final' when 3 then 'running' when 4 then 'cancelled' else 'retry' end as status,
 case when event_id % 3 > 0 then ts + interval 5 minutes end as next_retry_at, case when event_id % 4 = 0 then ts - interval 20 minutes when event_id % 4 = 1 then ts end as locked_at from EVENTS where event_id is not null and user_id is not null"""


def _work(spark, d):
    _table(spark, d, "events").createOrReplaceTempView("__emberlog_work")
    return spark.sql(WORK.replace("EVENTS", "__emberlog_work"))


def retryable_work(spark: SparkSession, d: str) -> DataFrame:
    """Work that may be tried again at a time: not finished, due, and not locked for less than 15 minutes."""
    now = F.lit(INCIDENT[1]).cast("timestamp")
    w = _work(spark, d).where(~F.col("status").isin("ok", "skipped", "failed_final", "cancelled"))
    w = w.where((F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)) & (F.col("locked_at").isNull() | (F.col("locked_at") < now - F.expr("interval 15 minutes"))))
    return w.orderBy(F.asc_nulls_first("next_retry_at"), "updated_at", "work_id").limit(50).select("work_id", "status", F.col("next_retry_at").isNull().alias("immediate"))


def guarded_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The row of each run's item: the last one, but one that is ok is never replaced by another."""
    w = _work(spark, d).withColumn("item", F.expr("work_id % 5"))
    return R.latest_by(w, ["run_id", "item"], F.expr("case when status = 'ok' then 0 else 1 end"), F.desc("updated_at"), F.desc("work_id")).select("run_id", "item", "work_id", "status")


#: Events of a run in order: states that end it, and those that override an end (fixed values).
ENDS, OVERRIDES = ("completed", "failed", "blocked", "needs_input"), ("failed", "blocked", "needs_input")
RUNS = """select event_id, user_id as run_id, ts, event_id % 4 as step, case event_type when 'error' then 'failed' when 'signup' then 'completed' when 'view' then 'needs_input' else 'running' end as status, value as count_now,
 case when event_id % 3 = 0 then concat('child-', event_id % 9) end as child, case when event_id % 2 = 0 then concat('p-', event_id % 3) end as provider from EVENTS where event_id is not null and user_id is not null"""


def _runs(spark, d):
    _table(spark, d, "events").createOrReplaceTempView("__emberlog_runs")
    return spark.sql(RUNS.replace("EVENTS", "__emberlog_runs"))


def run_status(spark: SparkSession, d: str) -> DataFrame:
    """Runs folded from their events: an ordinary event does not end an ended state, one that failed, blocks or needs input does."""
    e = _runs(spark, d)
    by = Window.partitionBy("run_id").orderBy("ts", "event_id")
    ended = F.max(F.when(F.col("status").isin(*ENDS), F.struct("ts", "event_id"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    # what counts: events of an ending state, and ordinary ones before any of these
    counts = F.when(F.col("status").isin(*OVERRIDES) | ended.isNull() | (F.col("status") == "completed"), F.struct("ts", "event_id", "status"))
    e = e.withColumn("counts", counts)
    return e.groupBy("run_id").agg(F.max("counts")["status"].alias("status"), F.max("step").alias("high_step"), F.max("count_now").alias("most"), F.count("*").alias("events"), F.countDistinct("child").alias("children"))


def run_steps(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each step of each run, also of steps that have none."""
    last = R.latest_by(_runs(spark, d), ["run_id", "step"], F.desc("ts"), F.desc("event_id")).select("run_id", "step", "status", "event_id")
    steps = spark.range(5).select(F.col("id").alias("step"))
    return last.select("run_id").distinct().crossJoin(F.broadcast(steps)).join(last, ["run_id", "step"], "left").select("run_id", "step", F.coalesce("status", F.lit("pending")).alias("status"), "event_id")  # 5 steps


def run_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Of each run the last event of each child (else provider), counted by status, and its most advanced counter."""
    e = _runs(spark, d).withColumn("key", F.coalesce("child", "provider")).where("key is not null")
    last = R.latest_by(e, ["run_id", "key"], F.desc("ts"), F.desc("event_id"))
    return last.groupBy("run_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("running", "completed", "failed", "needs_input")], F.max("count_now").alias("most"), F.countDistinct("child").alias("children"))


def run_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each state, step and provider of a run, in order."""
    e = _runs(spark, d).withColumn("provider", F.coalesce("provider", F.lit("")))
    first = R.latest_by(e, ["run_id", "status", "step", "provider"], F.asc("ts"), F.asc("event_id"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id"))
    return first.select("run_id", "status", "step", "provider", "event_id", place.alias("place")).where("place <= 20")


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The last run of each provider and step; of each provider the last run, and the three newest of these."""
    e = _runs(spark, d).where("provider is not null")
    pair = R.latest_by(e, ["provider", "step"], F.desc("ts"), F.desc("event_id")).select(F.lit("pair").alias("kind"), "provider", "step", "event_id")
    one = R.latest_by(e, ["provider"], F.desc("ts"), F.desc("event_id")).orderBy(F.desc("ts"), "provider").limit(3).select(F.lit("provider").alias("kind"), "provider", "step", "event_id")
    return pair.unionByName(one)


def generation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Runs since the latest bundle of their group: with a fallback to all runs where a group has no bundle, and without."""
    e = _runs(spark, d).withColumn("grp", F.expr("run_id % 6"))
    bundles = e.where("status = 'completed' and grp < 4").groupBy("grp").agg(F.max("ts").alias("gate"))
    soft = e.join(F.broadcast(bundles), "grp", "left").where(F.col("ts") >= F.coalesce("gate", F.lit("1970-01-01").cast("timestamp")))  # a row for each group
    hard = e.join(F.broadcast(bundles), "grp").where("ts >= gate")
    out = soft.groupBy("grp").agg(F.count("*").alias("with_fallback"))
    return out.join(hard.groupBy("grp").agg(F.count("*").alias("strict")), "grp", "left").select("grp", "with_fallback", F.coalesce("strict", F.lit(0)).alias("strict"))


BUDGET = 1200


def chunked(spark, d):
    """Conversations of each role in chunks of a token budget."""
    def build():
        c = _table(spark, d, "conversations").where("conv_id is not null and turn is not null and role is not null").select("conv_id", "turn", F.col("role").alias("bucket"), F.expr("(length(coalesce(text, '')) + 1) div 2 + 32").alias("tokens"))
        return K.pack_by_budget(c, "bucket", ["conv_id", "turn"], "tokens", BUDGET)

    return stored(spark, d, "chunked", build)


def chunk_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Conversations packed in order into chunks of a token budget, by role, and what each chunk holds."""
    return chunked(spark, d).groupBy("bucket", "chunk").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.min("conv_id").alias("first_conv"), F.max("conv_id").alias("last_conv"), F.count_if(F.col("turn") == 0).alias("openings"))


def chunk_runs(spark: SparkSession, d: str) -> DataFrame:
    """Status of a bucket's run from its chunks: all skipped, all ok, at least 80 percent ok, or failed."""
    m = chunk_manifest(spark, d).withColumn("status", F.expr("case when first_conv % 11 = 0 then 'failed' when first_conv % 7 = 0 then 'skipped' else 'ok' end"))
    g = m.groupBy("bucket").agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.sum("tokens").alias("tokens"))
    share = F.col("ok") / F.greatest(F.col("chunks") - F.col("skipped"), F.lit(1))
    state = F.when(F.col("skipped") == F.col("chunks"), "skipped").when(share == 1, "ok").when(share >= 0.8, "partial_ok").otherwise("failed")
    return g.select("bucket", "chunks", "ok", "skipped", "tokens", F.round(share, 4).alias("share"), state.alias("state"))


def corpus_coverage(spark: SparkSession, d: str) -> DataFrame:
    """One row: chunks, items and tokens of the whole corpus, and the share of items in chunks that are not failed."""
    m = chunk_manifest(spark, d).withColumn("bad", F.expr("first_conv % 11 = 0"))
    total = F.sum("items")
    return m.agg(F.count("*").alias("chunks"), total.alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"), F.round(F.sum(F.when(~F.col("bad"), F.col("items")).otherwise(0)) / total, 6).alias("covered"))


def keyword_index(spark: SparkSession, d: str) -> DataFrame:
    """The tokens that most benchmark items share."""
    t = _table(spark, d, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.countDistinct("item_id").alias("items")).orderBy(F.desc("items"), "token").limit(40)


QUERIES = {f.__name__: f for f in (shared_traces, overlapping_items, deployments_before_signals, whole_deployments_before_signals, deployments_before_errors, last_deployment_before_errors, claim_validity, proposition_texts, proposition_links, proposition_scores, claim_stance_groups, reviewer_comparison, comparison_summary, structured_evidence, review_decisions, shaped_propositions, review_queue, proposition_clusters, review_targets, review_priorities, reviewer_totals, line_findings, document_findings, latest_documents, latest_orders, two_rankings, replace_range, star_review, retryable_work, guarded_upsert, run_status, run_steps, run_frontier, run_timeline, latest_runs, generation_gate, chunk_manifest, chunk_runs, corpus_coverage, keyword_index)}


# ---- twins, by hand

_PAIRED = lambda first: f"with {LOGS}, i0 as (select *, service || '/' || error_type || '/' || strftime(ts, '%d') as item from logs where {cur}), top as (select item, max(severity_rank) r, count(*) n, min(ts) s, max(ts) e from i0 group by 1 having max(severity_rank) >= 30{first}), m as (select distinct item, trace_id from i0 where item in (select item from top) and trace_id is not null)"
_ITEMS, _EVERY_ITEM = _PAIRED(" order by r desc, n desc, item limit 32"), _PAIRED("")

_CLAIMS = f"""with c0 as ({CLAIMS.replace('CONVERSATIONS', 'conversations')}), known as (select list('item-' || item_id) k from benchmark),
c1 as (select * exclude (refs_csv, counter_csv, missing_csv), list_filter(string_split(refs_csv, ','), lambda x: x <> '') refs, list_filter(string_split(counter_csv, ','), lambda x: x <> '') counter_refs, list_filter(string_split(missing_csv, ','), lambda x: x <> '') missing,
 case when claim_type = 'insufficient_evidence' then 'insufficient_evidence' when lower(coalesce(nullif(said, ''), of_result, '')) in ('supported', 'contradicted', 'insufficient_evidence', 'no_finding') then lower(coalesce(nullif(said, ''), of_result)) when claim_type = 'counter_evidence' then 'contradicted' else 'supported' end finding_status from c0),
c2 as (select c1.*, list_sort(list_distinct(list_concat(refs, counter_refs))) all_refs, list_filter(list_sort(list_distinct(list_concat(refs, counter_refs))), lambda r: not list_contains(k, r)) lost from c1, known),
claims as (select *, len(lost) = 0 valid, case when claim_type = 'insufficient_evidence' or finding_status in ('insufficient_evidence', 'no_finding') then 'insufficient_evidence' when finding_status = 'contradicted' and claim_type = 'support' then 'counter_evidence' else claim_type end stance, (temporary_action <> '' or permanent_action <> '')::int acts,
 regexp_matches(lower(temporary_action || ' ' || permanent_action), 'delete|drop table|purge|disable auth|ignore alert')::int risky from c2)"""
_PROPS = f"""{_CLAIMS}, g as (select evidence, target, subsystem, list(claim_id order by claim_id) linked, count(*) n_claims, count(*) filter (where not valid) bad, count(*) filter (where claim_type in ('validation_target', 'caveat') or len(missing) > 0) checks, sum(acts) acts,
  coalesce(substr(string_agg(claim_text, ' ' order by claim_id) filter (where claim_type = 'support'), 1, 1200), '') support_summary, coalesce(substr(string_agg(claim_text, ' ' order by claim_id) filter (where claim_type = 'counter_evidence'), 1, 1200), '') counter_summary,
  coalesce(list_sort(list_distinct(flatten(list(case when len(missing) > 0 then missing else [claim_text] end) filter (where claim_type = 'next_data_needed' or len(missing) > 0)))), []) next_data from claims group by 1, 2, 3),
props as (select *, 'prop-' || substr(sha256(evidence || '|' || target || '|' || subsystem), 1, 16) proposition_id, case when bad > 0 or counter_summary <> '' or checks >= 2 then 'high' when acts > 0 or support_summary <> '' then 'medium' else 'low' end priority from g)"""
_SCORES = f"""{_PROPS}, s0 as (select proposition_id, priority, round(avg(valid::int), 4) evidence_ref_score, round(avg((not valid or len(refs) = 0)::int), 4) unsupported, round(avg(c.acts), 4) actionability, round(count(distinct case when claim_type = 'support' then provider end) / count(distinct provider), 4) agreement,
  max((claim_type = 'support')::int) s, max((claim_type = 'counter_evidence')::int) c, max((claim_type in ('caveat', 'validation_target', 'next_data_needed'))::int) v, round(1 - avg(risky), 4) safety from props p join claims c using (evidence, target, subsystem) group by 1, 2),
schema as (select round(avg((result_id % 4 > 0)::int), 4) schema_score from (select distinct result_id from claims)),
s1 as (select *, case when s = 1 and c = 1 then 0.8 when s = 1 and v = 1 then 0.45 when c = 1 then 0.6 else 0.0 end::double contradiction from s0, schema),
scores as (select * exclude (s, c, v, priority), round(0.25::double * case priority when 'high' then 1.0 when 'medium' then 0.65 else 0.35 end + 0.2::double * evidence_ref_score + 0.15::double * actionability + 0.15::double * contradiction + 0.15::double * (1 - agreement) + 0.1::double * (1 - unsupported) + 1e-9, 4) review_priority from s1)"""
_GROUPS = f"""{_CLAIMS}, g as (select target, subsystem, component, array_to_string(all_refs, ',') refs, count(distinct provider) providers, count(distinct case when stance = 'support' then provider end) supporters, count(distinct case when stance = 'counter_evidence' then provider end) opponents, count(distinct case when stance = 'caveat' then provider end) doubters,
  count(distinct case when stance in ('validation_target', 'next_data_needed') then provider end) checkers, count(*) n_claims, count(*) filter (where stance = 'counter_evidence') nc, count(*) filter (where stance = 'caveat') nv, count(*) filter (where stance in ('validation_target', 'next_data_needed')) nk, count(*) filter (where stance = 'insufficient_evidence') nt,
  count(*) filter (where stance = 'support' and len(c2.refs) = 0) bare, count(*) filter (where len(missing) > 0) nm, max(len(lost)) nl from claims c2 group by 1, 2, 3, 4),
h as (select *, (select count(distinct provider) from claims) ap from g)"""
_COMPARE = _PROPS + ", " + ", ".join(f"{x} as (select evidence, target, subsystem, count(*) n_{x}, round(avg((len(refs) > 0)::int), 4) ref_{x}, round(avg(valid::int), 4) ok_{x}, round(avg(acts), 4) act_{x}, round(1 - avg(risky), 4) safe_{x}, list_distinct(list(claim_type)) types_{x}, list_sort(list_distinct(flatten(list(all_refs)))) refs_{x} from claims where provider = '{p}' group by 1, 2, 3)" for x, p in (("a", "user-0"), ("b", "assistant-1"))) + """,
j as (select proposition_id, coalesce(n_a, 0) n_a, coalesce(n_b, 0) n_b, coalesce(refs_a, []) ra, coalesce(refs_b, []) rb, coalesce(types_a, []) ta, coalesce(types_b, []) tb, coalesce(act_a, 0) aa, coalesce(act_b, 0) ab, coalesce(ref_a, 0) fa, coalesce(ref_b, 0) fb,
 coalesce(round(0.35::double * ref_a + 0.25::double * ok_a + 0.25::double * act_a + 0.15::double * safe_a + 1e-9, 4), 0) overall_a, coalesce(round(0.35::double * ref_b + 0.25::double * ok_b + 0.25::double * act_b + 0.15::double * safe_b + 1e-9, 4), 0) overall_b from props left join a using (evidence, target, subsystem) left join b using (evidence, target, subsystem)),
k as (select *, coalesce(round(len(list_intersect(ra, rb)) / nullif(len(list_distinct(list_concat(ra, rb))), 0), 4), 0) overlap, coalesce(len(list_intersect(ta, tb)) / nullif(len(list_distinct(list_concat(ta, tb))), 0), 0) tshare from j),
l as (select *, case when n_a > 0 and n_b > 0 then round(0.65::double * overlap + 0.35::double * tshare + 1e-9, 4) else 0 end agreement from k),
cmp as (select proposition_id, n_a, n_b, overlap, agreement, round(0.45::double * overlap + 0.25::double * agreement + 0.15::double * least(aa, ab) + 0.15::double * least(fa, fb) + 1e-9, 4) comparison_score, overall_a, overall_b, round(overall_b - overall_a, 4) difference, case when n_a > 0 and n_b > 0 then 'shared_target' when n_a > 0 then 'baseline_only' when n_b > 0 then 'candidate_only' else 'no_model_claims' end delta_type,
 array_to_string(list_sort(list_intersect(ra, rb)), ',') shared_refs, array_to_string(list_sort(list_filter(ra, lambda x: not list_contains(rb, x))), ',') baseline_only_refs, array_to_string(list_sort(list_filter(rb, lambda x: not list_contains(ra, x))), ',') candidate_only_refs from l)"""
_DEC = f"dec as ({DECISIONS.replace('LABELS', 'labels')}), lastd as (select * from dec qualify row_number() over (partition by evidence, target, subsystem order by decided_at desc) = 1)"
_STRUCT = "e0 as (select evidence, target, subsystem, coalesce(list_sort(list_distinct(flatten(list(refs) filter (where claim_type = 'support')))), []) support, coalesce(list_sort(list_distinct(flatten(list(case when claim_type = 'counter_evidence' then all_refs else counter_refs end)))), []) counter, coalesce(list_sort(list_distinct(list(claim_text) filter (where claim_type = 'caveat'))), []) caveats, list_sort(list_distinct(flatten(list(missing)))) needs, list_sort(list_distinct(list(provider))) provs, max(acts) acts, max((finding_status = 'no_finding')::int) nf, max((finding_status = 'insufficient_evidence')::int) ie from claims group by 1, 2, 3)"
_SHAPED = f"""{_SCORES}, {_STRUCT}, {_DEC},
q0 as (select p.proposition_id, p.evidence, p.target, p.subsystem, n_claims, review_priority score, support, counter, needs, provs, e.acts, nf, ie, coalesce(decision, '') decision, coalesce(detail, '') detail, len(support) ns, len(counter) nc, len(list_distinct(list_concat(support, counter))) ne, n_claims % 5 = 0 no_action from props p join scores s using (proposition_id) join e0 e on e.evidence = p.evidence and e.target = p.target and e.subsystem = p.subsystem left join lastd d on d.evidence = p.evidence and d.target = p.target and d.subsystem = p.subsystem),
q1 as (select *, nf = 1 and ns = 0 none, ie = 1 and ns = 0 thin, target in ('throughput_disappearance', 'heartbeat_missing', 'job_configuration_mismatch') prim, case target when 'throughput_disappearance' then 0.80 when 'heartbeat_missing' then 0.78 when 'job_configuration_mismatch' then 0.82 end flr,
 case target when 'throughput_disappearance' then 0.84 when 'heartbeat_missing' then 0.82 when 'network_error_signal' then 0.60 when 'freshness_signal_gap' then 0.56 when 'monitoring_gap' then 0.62 when 'state_mismatch' then 0.66 end vcap,
 case when decision = 'accepted' or detail in ('confirmed_candidate', 'known_issue', 'watchlist') then 'boost' when decision = 'needs_more_data' then 'needs_more_data' when decision = 'rejected' or detail in ('low_value', 'duplicate') then 'demote' else 'none' end effect from q0),
q2 as (select *, len(needs) > 0 and not no_action and score >= 0.58 and subsystem <> 'resource_pressure' and not none and not thin and vcap is not null val,
 list_filter([case when none then 'no_finding' end, case when thin and not none then 'insufficient_evidence' end, case when ne = 0 then 'evidence_id_missing' end, case when ns = 0 and nc = 0 then 'support_and_counter_empty' end, case when ns = 0 and nc > 0 then 'support_empty' end, case when no_action and not prim then 'no_immediate_action' end], lambda x: x is not null) caps from q1),
q3 as (select *, least(score, case when none then 0.25 else 1 end, case when thin and not none then 0.35 else 1 end, case when ne = 0 then 0.65 else 1 end, case when ns = 0 then 0.55 else 1 end, case when no_action and not prim then 0.40 else 1 end) x1, case when prim and ns > 0 then flr end fl from q2),
q4 as (select *, greatest(case when val then greatest(x1, least(score, vcap)) else x1 end, coalesce(fl, 0)) x2 from q3),
q5 as (select *, case effect when 'boost' then least(1.0, x2 + case when detail in ('known_issue', 'confirmed_candidate') then 0.10 else 0.06 end) when 'needs_more_data' then least(1.0, x2 + 0.03) when 'demote' then least(x2, case detail when 'duplicate' then 0.22 when 'low_value' then 0.32 else 0.25 end) else x2 end x3 from q4),
q6 as (select *, round(least(x3, case when none then 0.25 when thin then 0.35 else 1 end, case when ns = 0 then 0.55 else 1 end), 4)::double effective, case when prim then 'incident_candidate' when none or thin then 'insufficient_evidence' when val then 'validation_target' else 'monitor_or_archive' end as mode,
 case when none or thin then 'hidden' when ns = 0 and effect not in ('boost', 'needs_more_data') then 'hidden' when effect = 'demote' and detail = 'low_value' then 'monitor_only' when effect = 'demote' then 'hidden' when fl is not null or val then 'review' when no_action and not prim then 'monitor_only' when len(needs) = 0 and acts = 0 and effect <> 'boost' then 'hidden' else 'review' end v0,
 'cluster-' || substr(sha256(evidence || '|' || subsystem || '|' || target), 1, 16) cluster_id from q5),
q7 as (select *, row_number() over (partition by cluster_id order by effective desc, ne desc, ns desc, proposition_id) = 1 representative from q6),
q8 as (select *, case when representative then v0 else 'hidden' end v1 from q7),
q9 as (select *, v1 = 'review' and mode = 'incident_candidate' and prim rival from q8),
q10 as (select *, rival and row_number() over (partition by evidence, target, rival order by case when list_contains(provs, 'rule-engine') then 0 else 1 end, ns desc, effective desc, subsystem, proposition_id) > 1 duplicate_primary from q9),
shaped as (select *, case when duplicate_primary then 'hidden' else v1 end visibility from q10)"""
_PRIO = f"""{_CLAIMS}, t0 as (select evidence || '/' || target target_id, case when target = 'monitoring_gap' then 'generic' else target end unit, max(temporary_action) title, count(*) n, list_sort(list_distinct(flatten(list(missing)))) missing, list_distinct(list(provider)) provs, coalesce(list_sort(list_distinct(list(provider) filter (where claim_type = 'support'))), []) claimed, len(list_distinct(flatten(list(refs)))) n_refs, count(distinct subsystem) nf, count(distinct component) nsrc, target from claims group by evidence, target),
t1 as (select *, case n % 3 when 0 then 'normal operation' when 1 then 'latency for viewers, user impact' else 'quiet' end txt, case when n % 2 = 0 then 2 else 0 end ncav, (n % 10) / 10.0 prior, target = 'heartbeat_missing' prim, list_contains(provs, 'rule-engine') seen, list_contains(claimed, 'rule-engine') spoke from t0),
t2 as (select *, lower(unit || ' ' || title || ' ' || txt) a, lower(unit || ' ' || title || ' ' || txt || ' ' || array_to_string(missing, ' ')) b, (len(claimed) + case when spoke then 0.65 else 0 end) / (len(provs) + case when seen then 0.65 else 0 end) sup, unit = 'generic' gen, n % 3 = 0 well from t1),
t3 as (select *, least(1.0, greatest(0.0, 0.35 + case when regexp_matches(a, 'restart|recovery|watchdog|exit|exception|timeout|failure|failed|error|config|deployment|dependency|certificate|auth|delivery|notified') then 0.25 else 0 end + case when regexp_matches(a, 'user.impact|user_visible|viewer|customer|deliver|stream|youtube|audio|latency|error rate|http_5xx|outage') then 0.25 else 0 end + case when prim then 0.15 else 0 end - case when gen then 0.15 else 0 end - case when well then 0.25 else 0 end))::double act,
 (case when gen then 0.055 else 0 end + case when well then 0.09 else 0 end + least(0.07, 0.0125 * len(missing)) + case when contains(b, 'user impact') then 0.025 else 0 end + least(0.04, 0.0125 * ncav) + case when seen and not spoke then 0.035 else 0 end)::double pen, (('0x' || substr(sha256(unit || '|' || title || '|' || array_to_string(claimed, ',') || '|' || n_refs), 1, 6))::bigint % 17) / 10000.0 tie from t2),
t4 as (select *, 0.15::double * prior + 0.85::double * (0.28 + 0.31 * sup::double + case when spoke then 0.06 else 0 end + 0.08 * case when n_refs > 0 then least(1.0, ln(1 + n_refs::double) / ln(81.0::double)) else 0 end + 0.05 * case when nf > 0 then least(1.0, nf / 3.0) when n_refs > 0 then 0.35 else 0 end + 0.06 * least(1.0, ln(1 + nsrc::double) / ln(11.0::double)) + 0.13 * act + case when prim then 0.045 else 0 end - pen) + tie raw from t3)"""
_RUN = f"r as ({RUNS.replace('EVENTS', 'events')})"
_CHUNKS = """with recursive c as (select row_number() over (partition by role order by conv_id, turn) k, role bucket, conv_id, turn, (length(coalesce(text, '')) + 1) // 2 + 32 tokens from conversations where conv_id is not null and turn is not null and role is not null),
f as (select bucket, k, conv_id, turn, tokens, 1 as chunk, tokens as held from c where k = 1 union all select c.bucket, c.k, c.conv_id, c.turn, c.tokens, case when f.held + c.tokens > 1200 then f.chunk + 1 else f.chunk end, case when f.held + c.tokens > 1200 then c.tokens else f.held + c.tokens end from f join c on c.bucket = f.bucket and c.k = f.k + 1),
m as (select bucket, chunk::int as chunk, count(*) as items, sum(tokens)::bigint tokens, min(conv_id) first_conv, max(conv_id) last_conv, count(*) filter (turn = 0) openings from f group by all)"""
_FIND = r"""select doc_id, line, kind from (select doc_id, generate_subscripts(x, 1) as line, unnest(x) t from (select doc_id, string_split(text, chr(10)) x from documents where doc_id is not null and text is not null)), (values
 ('secret_like', '(?i)\b(authorization|(set-)?cookie)\s*:|\b(bearer|basic)\s|\b(password|passwd|secret)\s*=|\b(private_key|api_key|access_token|refresh_token|session_id)\b|\bsk-[a-z0-9_-]{8}|-----BEGIN (?-i:PRIVATE KEY)-----|(?-i)\bAIza[0-9A-Za-z_-]{10}|(?-i)\bya29\.[0-9A-Za-z_./-]'), ('raw_email', '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b'),
 ('raw_ip', '\b((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)\b'), ('raw_home_path', '(?i)/(home|users)/[^/\s:]+|[a-z]:\\users\\[^\\\s:]+'), ('raw_internal_url', '(?i)\bhttps?://internal|\b[a-z0-9_.-]+\.internal\b|https?://[^/\s''",}]*\.internal')) p(kind, re) where regexp_matches(t, re)"""
ORACLES = {
    "shared_traces": f"{_ITEMS}, z as (select item, count(*) n from m group by 1), p as (select a.item a, b.item b, count(*) shared from m a join m b on a.trace_id = b.trace_id and a.item < b.item group by 1, 2) select a, b, shared, round(shared / za.n, 6) coverage_a, round(shared / zb.n, 6) coverage_b from p join z za on za.item = a join z zb on zb.item = b",
    "overlapping_items": f"{_ITEMS}, l as (select item, list(trace_id) t from m group by 1), i as (select top.*, t from top join l using (item)) select a.item a, b.item b from i a join i b on a.item < b.item and greatest(a.s, b.s) <= least(a.e, b.e) and not list_has_any(a.t, b.t)",
    "deployments_before_signals": f"with {LOGS}, dep as (select deploy_id, service deployed_on, day, max(ts) last_seen from logs where deploy_id is not null group by all), sig as (select service, template, day, min(ts) first_seen from logs where {cur} and severity_rank >= 30 group by all) select deploy_id, deployed_on, service, template, first_seen, date_diff('second', last_seen, first_seen) gap_s from dep join sig on date_diff('second', last_seen, first_seen) between 0 and 1800",
    "whole_deployments_before_signals": f"with {LOGS}, dep as (select deploy_id || '/' || strftime(ts, '%Y-%m-%d') as deployment, max(ts) last_seen from logs where deploy_id is not null group by 1), sig as (select service, template, day, min(ts) first_seen from logs where {cur} and severity_rank >= 30 group by all) select deployment, service, template, first_seen, date_diff('second', last_seen, first_seen) gap_s from dep join sig on date_diff('second', last_seen, first_seen) between 0 and 1800",
    "deployments_before_errors": f"with {LOGS} select a.service, a.event_id deployed, b.event_id failed, date_diff('second', a.ts, b.ts) gap_s from logs a join logs b on a.service = b.service and a.deploy_id is not null and b.severity_rank >= 40 and date_diff('second', a.ts, b.ts) between 0 and 1800",
    "last_deployment_before_errors": f"with {LOGS} select a.service, b.event_id failed, count(*) n, last(a.event_id order by a.ts, a.event_id) deployed, min(date_diff('second', a.ts, b.ts)) gap_s from logs a join logs b on a.service = b.service and a.deploy_id is not null and b.severity_rank >= 40 and date_diff('second', a.ts, b.ts) between 0 and 1800 group by 1, 2",
    "claim_validity": f"{_CLAIMS} select claim_id, provider, valid, array_to_string(lost, ',') lost, finding_status, stance from claims",
    "proposition_texts": f"""{_PROPS}, y as (select *, lower(support_summary || ' ' || counter_summary) t from props) select proposition_id, evidence, target, subsystem, n_claims, array_to_string(linked, ',') linked, support_summary, counter_summary, array_to_string(next_data, '|') next_data, priority, case when regexp_matches(t, 'can.t open file|no such file or directory|configured command missing|job configuration mismatch') then 'job_configuration' when regexp_matches(t, 'rtmps|ffmpeg|send-path') then 'stream_transport' when regexp_matches(t, 'youtube|resolver') then 'youtube_live_health' when regexp_matches(t, 'watchdog|stream_v3|subsystems_status|pod restart|service health') then 'service_health' when regexp_matches(t, 'connection pool|too many connections') then 'database_connection_pool' when t like '%database%' and t like '%timeout%' then 'database_timeout' when regexp_matches(t, 'payment|downstream|dependency') then 'downstream_dependency' when regexp_matches(t, 'deploy|release|rollout') then 'deployment_regression' when regexp_matches(t, 'auth|permission') then 'auth_config' else 'general_incident_review' end as cause from y""",
    "proposition_links": f"{_PROPS} select proposition_id, unnest(linked) as claim_id from props",
    "proposition_scores": f"{_SCORES} select * from scores",
    "claim_stance_groups": f"""{_GROUPS} select 'cg-' || substr(sha256(concat_ws('|', target, subsystem, component, refs)), 1, 16) group_id, target, subsystem, component, refs, providers, supporters, opponents, doubters, checkers, n_claims, case when nl > 0 then 'invalid_evidence_reference' when bare > 0 then 'unsupported_support_without_evidence_id' else '' end unsupported_reason, nl > 0 or bare > 0 unsupported, nl = 0 and bare = 0 and supporters >= 2 agreement,
 nl = 0 and bare = 0 and (nc > 0 or nv > 0 or nk > 0 or nt > 0 or nm > 0 or (ap > 1 and providers = 1)) disagreement, array_to_string(list_filter([case when nc > 0 then 'counter_claim' end, case when nv > 0 then 'caveat_claim' end, case when nk > 0 then 'validation_claim' end, case when nt > 0 then 'insufficient_evidence' end, case when nm > 0 then 'missing_evidence' end, case when ap > 1 and providers = 1 then 'single_provider_detection' end], lambda x: x is not null), ',') reasons from h""",
    "reviewer_comparison": f"{_COMPARE} select * from cmp",
    "comparison_summary": f"{_COMPARE} select count(*) propositions, count(*) filter (where delta_type = 'shared_target') shared_target_count, count(*) filter (where delta_type = 'baseline_only') baseline_only_count, count(*) filter (where delta_type = 'candidate_only') candidate_only_count, round(avg(comparison_score), 4) comparison_score, round(avg(overlap), 4) as overlap, round(avg(difference), 4) difference from cmp",
    "structured_evidence": f"{_CLAIMS}, {_STRUCT}, st as (select evidence, target, subsystem, finding_status, count(*) n from claims group by all), h as (select evidence, target, subsystem, string_agg(finding_status || '=' || n, ',' order by finding_status) statuses from st group by 1, 2, 3) select evidence, target, subsystem, array_to_string(support, '|') support, array_to_string(counter, '|') counter, array_to_string(caveats, '|') caveats, array_to_string(needs, '|') next_data, statuses from e0 join h using (evidence, target, subsystem)",
    "review_decisions": f"with {_DEC} select evidence, target, subsystem, decision, case decision when 'accepted' then case when detail in ('known_issue', 'confirmed_candidate', 'watchlist') then detail else 'confirmed_candidate' end when 'rejected' then case when detail in ('low_value', 'duplicate') then detail else 'false_positive' end else decision end status from lastd",
    "shaped_propositions": f"{_SHAPED} select proposition_id, round(score, 4) score, effective, visibility, mode, cluster_id, representative, duplicate_primary, array_to_string(caps, ',') caps, effect history from shaped",
    "review_queue": f"{_SHAPED} select proposition_id, evidence, target, subsystem, effective, mode from shaped where visibility = 'review' order by effective desc, cluster_id, proposition_id limit 30",
    "proposition_clusters": f"{_SHAPED}, c as (select cluster_id, string_agg(proposition_id, ',' order by proposition_id) members, array_to_string(list_sort(list_distinct(flatten(list(provs)))), ',') providers from shaped group by 1), h as (select * from shaped where representative), p as (select cluster_id parent from h where mode = 'incident_candidate' or target = 'throughput_disappearance' order by effective desc, cluster_id limit 1) select cluster_id, proposition_id representative_id, subsystem, target, effective, members, providers, case when cluster_id <> parent and (mode = 'validation_target' or target in ('external_dependency_failure', 'network_error_signal', 'user_impact_signal_gap', 'freshness_signal_gap', 'state_mismatch', 'monitoring_gap', 'instrumentation_mismatch', 'observability_contract_mismatch')) then parent else '' end parent_cluster from h join c using (cluster_id), p",
    "review_targets": f"{_SHAPED}, v as (select * from shaped where visibility = 'review'), t as (select count(*) total, count(*) filter (where mode = 'incident_candidate') incidents, count(*) filter (where mode = 'validation_target') validations, count(distinct subsystem) subsystems, count(distinct evidence) bundles from v), f as (select proposition_id, target, effective from v order by effective desc, cluster_id, proposition_id limit 5) select * from f, t",
    "review_priorities": f"{_PRIO} select target_id, round(least(0.94, greatest(0.05, least(raw, least(case when well then 0.72 else 2.0 end, case when gen then 0.80 else 2.0 end, case when seen and not spoke and len(claimed) < greatest(3, len(provs)) then 0.78 else 2.0 end) + tie))), 4) score, round(pen, 4) penalty, round(act, 4) actionability, round(sup, 4) support from t4",
    "reviewer_totals": f"{_CLAIMS}, t as (select provider, count(*) n, sum((length(claim_text) + 1) // 2 + 32)::bigint tokens, count(*) filter (where valid) n_valid from claims group by 1), s as (select provider, finding_status, count(*) m from claims group by all), h as (select provider, string_agg(finding_status || '=' || m, ',' order by finding_status) statuses from s group by 1) select * from t join h using (provider)",
    "line_findings": _FIND,
    "document_findings": f"with f as ({_FIND}), g as (select source, kind, count(*) n from f join documents using (doc_id) group by all) select source, coalesce(kind, '') kind, coalesce(n, 0) n, n is null passed from (select distinct source from documents) left join g using (source)",
    "latest_documents": "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "latest_orders": "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by case when o_orderstatus = 'F' then 0 else 1 end, o_orderdate desc, o_orderkey desc) = 1",
    "two_rankings": "select o_custkey, o_orderkey, o_orderpriority, x::int as x from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) x, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) y from orders) where x <= 3 and y = 1",
    "replace_range": f"select case when {cur} and event_type = 'view' then 'viewed' else event_type end event_type, count(*) n, max(event_id) last_id from events group by 1",
    "star_review": "with l as (select l_orderkey, count(*) lines, round(sum(l_quantity), 2) quantity from lineitem group by 1) select o_orderkey, c_name, n_name, coalesce(lines, 0) as lines, coalesce(quantity, 0.0) quantity, o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join l on l_orderkey = o_orderkey order by o_totalprice desc, o_orderkey limit 100",
    "retryable_work": f"with w as ({WORK.replace('EVENTS', 'events')}) select work_id, status, next_retry_at is null immediate from w where status not in ('ok', 'skipped', 'failed_final', 'cancelled') and (next_retry_at is null or next_retry_at <= timestamp '{INCIDENT[1]}') and (locked_at is null or locked_at < timestamp '{INCIDENT[1]}' - interval 15 minutes) order by next_retry_at nulls first, updated_at, work_id limit 50",
    "guarded_upsert": f"with w as ({WORK.replace('EVENTS', 'events')}) select run_id, work_id % 5 item, work_id, status from w qualify row_number() over (partition by run_id, work_id % 5 order by case when status = 'ok' then 0 else 1 end, updated_at desc, work_id desc) = 1",
    "run_status": f"with {_RUN}, w as (select *, count(*) filter (where status <> 'running') over (partition by run_id order by ts, event_id rows between unbounded preceding and 1 preceding) before_ends from r), x as (select *, case when status <> 'running' or before_ends = 0 then 1 end ok from w) select run_id, last(status order by ts, event_id) filter (where ok = 1) status, max(step) high_step, max(count_now) most, count(*) events, count(distinct child) children from x group by 1",
    "run_steps": f"with {_RUN}, l as (select * from r qualify row_number() over (partition by run_id, step order by ts desc, event_id desc) = 1), s as (select unnest(range(5)) step) select run_id, step, coalesce(status, 'pending') status, event_id from (select distinct run_id from r) cross join s left join l using (run_id, step)",
    "run_frontier": f"with {_RUN}, l as (select *, coalesce(child, provider) k from r where coalesce(child, provider) is not null qualify row_number() over (partition by run_id, coalesce(child, provider) order by ts desc, event_id desc) = 1) select run_id, count(*) filter (where status = 'running') running, count(*) filter (where status = 'completed') completed, count(*) filter (where status = 'failed') failed, count(*) filter (where status = 'needs_input') needs_input, max(count_now) most, count(distinct child) children from l group by 1",
    "run_timeline": f"with {_RUN}, f as (select run_id, status, step, coalesce(provider, '') provider, event_id, ts from r qualify row_number() over (partition by run_id, status, step, coalesce(provider, '') order by ts, event_id) = 1) select run_id, status, step, provider, event_id, row_number() over (partition by run_id order by ts, event_id)::int place from f qualify place <= 20",
    "latest_runs": f"with {_RUN}, p as (select * from r where provider is not null), a as (select 'pair' as kind, provider, step, event_id from p qualify row_number() over (partition by provider, step order by ts desc, event_id desc) = 1), b as (select * from p qualify row_number() over (partition by provider order by ts desc, event_id desc) = 1) select * from a union all (select 'provider', provider, step, event_id from b order by ts desc, provider limit 3)",
    "generation_gate": f"with {_RUN}, e as (select *, run_id % 6 grp from r), g as (select grp, max(ts) gate from e where status = 'completed' and grp < 4 group by 1) select grp, count(*) with_fallback, count(*) filter (where gate is not null) strict from e left join g using (grp) where ts >= coalesce(gate, timestamp '1970-01-01') group by 1",
    "chunk_manifest": f"{_CHUNKS} select * from m",
    "chunk_runs": f"{_CHUNKS}, s as (select *, case when first_conv % 11 = 0 then 'failed' when first_conv % 7 = 0 then 'skipped' else 'ok' end status from m), g as (select bucket, count(*) chunks, count(*) filter (where status = 'ok') ok, count(*) filter (where status = 'skipped') skipped, sum(tokens)::bigint tokens from s group by 1), h as (select *, ok / greatest(chunks - skipped, 1) x from g) select bucket, chunks, ok, skipped, tokens, round(x, 4) as share, case when skipped = chunks then 'skipped' when x = 1 then 'ok' when x >= 0.8 then 'partial_ok' else 'failed' end state from h",
    "corpus_coverage": f"{_CHUNKS} select count(*) chunks, sum(items)::bigint as items, sum(tokens)::bigint tokens, max(tokens) largest, round(sum(case when first_conv % 11 = 0 then 0 else items end) / sum(items), 6) covered from m",
    "keyword_index": "with t as (select item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in ('the', 'and', 'for', 'with')))) token from benchmark) select token, count(distinct item_id) as items from t group by 1 order by items desc, token limit 40",
}
