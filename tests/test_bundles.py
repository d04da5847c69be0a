"""Local claims, absence claims, relations and signatures on small cases."""

import pytest
from pyspark.sql import functions as F

from emberlog.operators import bundles as B
from emberlog.operators import signatures as S

ITEM = "bundle_id string, ref string, place long, event_type string, text string, metric_name string, metric_value double"


def items(spark, rows):
    return B.with_terms(spark.createDataFrame([(b, r, p, k, t.lower() if t else t, m, v) for b, r, p, k, t, m, v in rows], ITEM))


def test_terms_of_a_text(spark):
    rows = [(1, "youtube_health watchdog http 5xx"), (2, ""), (3, None), (4, "connection pool exhausted by too many connections")]
    got = {r.k: r.bits for r in spark.createDataFrame(rows, "k int, text string").select("k", B.found_terms(F.col("text")).alias("bits")).collect()}
    for k, t in rows:
        assert got[k] == B.mask_of([x for x in B.TERMS if x in (t or "")])


def test_causes_first_rule_wins_and_terms_of_a_rule_may_be_in_different_items(spark):
    rows = [
        ("a", "P1", 1, "x", "failed to start worker", None, None), ("a", "P2", 2, "x", "unit app.service", None, None), ("a", "P3", 3, "x", "rtmps reconnect", None, None),
        ("b", "P1", 1, "x", "failed to start worker", None, None), ("c", "M1", 1, "metric", "metric", "http_5xx_count", 2.0), ("d", "M1", 1, "metric", "metric", "http_5xx_count", 0.0), ("e", "P1", 1, "x", None, None, None),
    ]
    got = B.bundle_causes(items(spark, rows), B.rule_table(spark, B.CAUSE_RULES), B.rule_table(spark, B.CONTRAST_RULES))
    assert {r.bundle_id: r.cause for r in got.collect()} == {"a": "service_start", "b": "unknown", "c": "http_errors", "d": "unknown", "e": "unknown"}


def test_first_refs_are_by_place_and_few(spark):
    rows = [("a", f"P{k:03}", 500 - k, "x", "database timeout" if k % 2 else "idle", None, None) for k in range(500)]
    got = {r.cites: r.refs for r in B.first_refs(items(spark, rows).repartition(7), B.REF_SETS).collect()}
    assert got["hypothesis"] == ["P499", "P497", "P495", "P493"] and got["any"] == ["P499", "P498", "P497", "P496"] and "deploy" not in got


def test_claims_fall_back_on_any_items(spark):
    i = items(spark, [("a", "P1", 1, "x", "idle", None, None), ("a", "P2", 2, "x", "quiet", None, None)])
    who = spark.createDataFrame([("a", "svc", "prod", 0)], "bundle_id string, service string, environment string, deployments long").withColumns({c: F.lit("2024-01-01").cast("timestamp") for c in ("window_start", "window_end")})
    c = B.local_claims(B.bundle_causes(i, B.rule_table(spark, B.CAUSE_RULES), B.rule_table(spark, B.CONTRAST_RULES)), B.first_refs(i, B.REF_SETS), who).collect()
    assert sorted((r.role, r.place, r.claim_type) for r in c) == [("contrast_agent", 1, "caveat"), ("evidence_verifier", 1, "caveat"), ("evidence_verifier", 2, "next_data_needed"), ("hypothesis_generator", 1, "support")]
    assert all(r.refs == ["P1", "P2"] for r in c)
    assert B.local_claims(B.bundle_causes(i.limit(0), B.rule_table(spark, B.CAUSE_RULES), B.rule_table(spark, B.CONTRAST_RULES)), B.first_refs(i.limit(0), B.REF_SETS), who).count() == 0


SHOWN = [("a", "http_5xx", "checkout failed HTTP 500 database timeout metric=checkout_500_count"), ("a", "unknown", "database connection pool exhausted metric=db_pool_exhausted_count"), ("a", "info", "service restarted after deployment"), ("b", "info", "checkout completed status=200"), ("b", None, None)]


def held(spark, absences, missing, bundle="a"):
    facts = B.bundle_facts(spark.createDataFrame(SHOWN, "bundle_id string, event_type string, text string"))
    r = B.reconciled(spark.createDataFrame([(bundle, absences, missing)], "bundle_id string, absences array<string>, missing array<string>"), facts, "absences", "missing").first()
    return r.contradicted, r.absences, r.missing


def test_facts_of_bundles(spark):
    got = {r.bundle_id: {f for k, f in enumerate(B.FACTS) if r.facts >> k & 1} for r in B.bundle_facts(spark.createDataFrame(SHOWN, "bundle_id string, event_type string, text string")).collect()}
    assert got["a"] == set(B.FACTS) - {"successful_checkout"} and got["b"] == {"successful_checkout"}


def test_absence_claims(spark):
    said = ["No HTTP 500s are present.", "No database-side metrics are available.", "No correlated error logs or restarts were seen.", "No error signals are cited in this chunk.", "Absence of error signals.", "Timeouts happen.", " ", None, "Timeouts happen."]
    contradicted, kept, _ = held(spark, said, [])
    assert contradicted == [said[0], said[4]] and kept == [said[1], said[2], said[3], said[5]]
    assert held(spark, said, [], "b")[0] == [] and held(spark, said, [], "unknown")[0] == [] and held(spark, None, None) == ([], [], [])


@pytest.mark.parametrize("asked,left", [
    ("HTTP 500 error logs or metrics", B.STILL_MISSING), ("HTTP 5xx error logs", None), ("http 500 error log of a metric", "http 500 error log of a metric"), ("Application error logs", None), ("Application error logs of today", "Application error logs of today"),
    ("db_pool_exhausted_count metrics", None), ("db_pool_exhausted_count of a week", "db_pool_exhausted_count of a week"), ("Deployment event logs", None), ("Deployment manifest diff", "Deployment manifest diff"),
])
def test_requests_that_facts_answer(spark, asked, left):
    assert held(spark, [], [asked, "", asked])[2] == ([left] if left else []) and held(spark, [], [asked], "b")[2] == [asked]


def test_relations(spark):
    known = spark.createDataFrame([("p", "x", "db pool exhausted"), ("h", "http_5xx", ""), ("g", "x", "Payment gateway timed out"), ("both", "http_5xx", "pool exhausted"), ("n", None, None)], "item_id string, event_type string, text string")
    edges = [("shared_trace", "p", "h", 3, 0), ("shared_trace", "both", "n", 3, 0), ("shared_trace", "p", "n", 3, 0), ("shared_trace", "p", "h", 0, 0), ("overlapping_window_no_shared_trace", "h", "g", 0, 0), ("overlapping_window_no_shared_trace", "h", "p", 0, 0), ("deployment_precedes_signal", "d", "n", 0, 60), ("shared_trace", "p", "gone", 3, 0)]
    got = B.relationship_candidates(spark.createDataFrame(edges, "relationship_type string, left_id string, right_id string, shared long, gap_s long"), known).collect()
    assert sorted((r.subsystem, *r.refs, r.score) for r in got) == [("database_connection_pool", "p", "h", 0.93), ("deployment_regression", "d", "n", 0.58), ("payment_gateway", "g", "h", 0.72)]
    assert len({r.target_id for r in got}) == 3


def test_pairs_that_suggest_a_candidate_are_all_there(spark):
    """Those of 60 items, some of several kinds: the candidates of all pairs, made one by one."""
    kinds = [("http_5xx", ""), ("x", "pool exhausted"), ("x", "payment gateway"), ("http_5xx", "payment gateway, pool exhausted"), ("none", ""), (None, None)]
    known = [(f"i{k:02}", *kinds[k % 6]) for k in range(60)]
    of = {i[0]: {f"t{k * j % 7}" for j in (1, 3)} if k % 4 else {f"u{k}"} if k % 8 else set() for k, i in enumerate(known)}
    span = {i[0]: (k * 7919 % 200_000, k * 7919 % 200_000 + k % 5 * 30_000) for k, i in enumerate(known)}
    edges = []
    for a in of:
        for b in of:
            shared, apart = len(of[a] & of[b]), max(span[a][0], span[b][0]) > min(span[a][1], span[b][1])
            if a < b and shared:
                edges.append(("shared_trace", a, b, shared, 0))
            elif a < b and of[a] and of[b] and not apart:
                edges.append(("overlapping_window_no_shared_trace", a, b, 0, 0))
    items = spark.createDataFrame(known, "item_id string, event_type string, text string")
    members = spark.createDataFrame([(i, x) for i in of for x in sorted(of[i])] * 2 + [("i00", None)], "item_id string, trace_id string")
    spans = spark.createDataFrame([(i, *x) for i, x in span.items()], "item_id string, s long, e long").withColumns({c: F.timestamp_seconds(c) for c in "se"})
    none = spark.createDataFrame([], "left_id string, right_id string, gap_s long")
    got = B.relationship_candidates(B.relation_edges(*B.suggesting_pairs(members, spans, items), none), items).collect()
    want = B.relationship_candidates(spark.createDataFrame(edges, "relationship_type string, left_id string, right_id string, shared long, gap_s long"), items).collect()
    assert sorted(got) == sorted(want) and {r.subsystem for r in want} == {"database_connection_pool", "payment_gateway"} and len(want) > 60


SIGNED = "claim_id string, identity array<string>, evidence_targets array<string>, metrics array<string>, metric_targets array<string>, evidence_text string, subsystem string, subsystem_target string, text string, refs array<string>"


@pytest.mark.parametrize("row,signature,target", [
    ((["restart_loop"], ["error_spike"], [], [], "", "", "", "x"), ("restart_loop", "identity"), ("restart_loop", "identity")),
    (([], ["error_spike"], ["a"], ["b"], "", "", "", "x"), ("error_spike", "evidence"), ("error_spike", "evidence")),
    (([], ["a", "b"], ["m"], ["a", "b"], "", "", "", "x"), ("a", "metric"), ("a", "metric")),
    (([], [], ["m"], [], "connection reset seen", "traffic", "z", "x"), ("network_error_signal", "evidence_text"), ("network_error_signal", "signature")),
    (([], [], [], [], "", "traffic", "throughput_disappearance", "x"), ("throughput_disappearance", "subsystem"), ("throughput_disappearance", "signature")),
    (([], [], ["runtime_restart_count"], [], "", "runtime_recovery", "z", "x"), ("restart_loop", "restarts"), ("restart_loop", "signature")),
    (([], [], ["total_log_count"], [], "", "", "", "x"), ("observability_volume_or_contract", "volume"), ("observability_volume_or_contract", "any_signature")),
    (([], [], [], [], "", "", "", "Stale data"), ("freshness_signal_gap", "text"), ("freshness_signal_gap", "signature")),
    (([], [], [], [], "", "", "", "service_health_failure_count"), ("restart_loop", "restart_text"), ("restart_loop", "signature")),
    (([], [], ["a", "b"], [], "", "", "", "x"), ("metric:a,b", "metric_names"), ("metric:a,b", "any_signature")),
    (([], [], [], [], "", "", "", "one four words here"), ("text:four-words-here", "words"), ("text:four-words-here", "any_signature")),
])
def test_chain_of_signatures(spark, row, signature, target):
    c = spark.createDataFrame([("c", *row, ["r"])], SIGNED)
    r = S.with_review_target(S.with_signature(c)).first()
    assert tuple(r.signature) == signature and tuple(r.review_target) == target


def test_subsystem_targets_of_a_profile_come_first(spark):
    profile = spark.createDataFrame([(0, "traffic", "a"), (1, "traffic", "b"), (2, "traffic", "b"), (3, "", "c")], "place int, subsystem string, core_target_type string")
    got = {r.subsystem: r.subsystem_target for r in S.subsystem_targets(profile).collect()}
    assert got["traffic"] == "b" and got["runtime_recovery"] in ("restart_loop", "service_start_failure") and "" not in got
