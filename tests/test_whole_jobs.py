"""Queries give their whole rows again, and claims of the same id keep their own citations."""

from pyspark.sql import functions as F

from emberlog.operators import claims as C
from emberlog.plans import bundles, facts, reviews


def test_claims_of_one_id_are_judged_apart(spark):
    rows = [("c1", ["a"], []), ("c1", ["x"], ["a", "y"]), ("c2", [], [])]
    claims = spark.createDataFrame(rows, "claim_id string, refs array<string>, counter_refs array<string>")
    got = C.with_valid_refs(claims, spark.createDataFrame([("a",)], "item_id string")).collect()
    assert sorted((r.claim_id, r.refs, r.lost, r.valid) for r in got) == [("c1", ["a"], [], True), ("c1", ["x"], ["x", "y"], False), ("c2", [], [], True)]


def test_propositions_name_all_their_claims(spark, data):
    rows = reviews.proposition_texts(spark, data).collect()
    assert sorted(c for r in rows for c in r.linked.split(",")) == sorted(r.claim_id for r in reviews.claims(spark, data).collect())
    assert all(len(r.linked.split(",")) == r.n_claims for r in rows)


def test_deployments_are_those_of_each_service(spark, data):
    got = reviews.deployments_before_signals(spark, data)
    seen = facts.logs(spark, data).where("deploy_id is not null").select("deploy_id", F.col("service").alias("deployed_on")).distinct()
    assert got.join(seen, ["deploy_id", "deployed_on"], "left_anti").count() == 0 and got.select("deployed_on").distinct().count() > 1


def test_every_pair_of_a_deployment_and_an_error(spark, data):
    rows = facts.logs(spark, data).select("service", "event_id", F.unix_timestamp("ts").alias("t"), "deploy_id", "severity_rank").collect()
    want = {(a.service, a.event_id, b.event_id, b.t - a.t) for a in rows if a.deploy_id for b in rows if b.severity_rank >= 40 and a.service == b.service and 0 <= b.t - a.t <= 1800}
    got = reviews.deployments_before_errors(spark, data).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_one_row_group_is_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(facts, "TASK_ROWS", 50)
    rows = facts.dealt(spark.read.parquet(f"{tmp_path}/t"), "id")
    assert rows.rdd.getNumPartitions() == 20 and rows.count() == 1000


def test_relations_beyond_the_32_highest_items_suggest_candidates(spark, tmp_path):
    """Pairs of warnings behind more than 32 items of emergencies: a pool's with server errors by a trace, a gateway's with others by time."""
    at = lambda day, hour: f"2024-01-{day} {hour:02}:00:00"
    rows = [(26 * (k + j) + kind, at(22 + k // 12, 5), 2 + k % 3, "error", 35.0) for j in (0, 1000) for k in range(60) for kind in (2, 5, 6, 7)]
    rows += [(260_003, at(28, 9), 7, "purchase", 12.0), (260_026, at(28, 9), 7, "purchase", 12.0), (260_027, at(28, 1), 6, "purchase", 12.0), (260_053, at(28, 23), 6, "purchase", 12.0), (260_052, at(28, 20), 8, "purchase", 12.0)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = bundles.relationship_candidates(spark, str(tmp_path)).where("relationship_type <> 'deployment_precedes_signal'").collect()
    pool, hit, late, slow = "svc-2/connection_pool_exhausted/28", "svc-2/http_5xx/28", "svc-3/http_5xx/28", "svc-1/dependency_timeout/28"
    assert reviews._signal_items(spark, str(tmp_path)).where("top_rank > 30").count() > 32
    assert sorted((r.subsystem, r.refs, r.shared) for r in got) == [("database_connection_pool", f"{pool},{hit}", 1), ("payment_gateway", f"{slow},{hit}", 0), ("payment_gateway", f"{slow},{late}", 0)]
