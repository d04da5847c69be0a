"""Claims of several reviewers: propositions, scores, comparison, cross-reviewer groups, and the review queue.

Claims: claim_id, evidence (the bundle), provider, claim_type, finding_status, claim_text, refs, counter_refs, missing
(arrays of text), temporary_action, permanent_action, subsystem, target, component.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import any_of, first_case

#: Terms of actions that are risky (fixed values).
RISKY = ("delete", "drop table", "purge", "disable auth", "ignore alert")
GROUP = ("evidence", "target", "subsystem")


def _empty() -> Column:
    return F.array().cast("array<string>")


def finding_status(claim_type: Column, said: Column, of_result: Column) -> Column:
    """The status of a finding: what the claim says, else its result, if that is a known status; else by the type."""
    kind, status = F.lower(F.trim(claim_type)), F.lower(F.trim(F.coalesce(F.nullif(said, F.lit("")), of_result, F.lit(""))))
    return F.when(kind == "insufficient_evidence", "insufficient_evidence").when(status.isin("supported", "contradicted", "insufficient_evidence", "no_finding"), status).when(kind == "counter_evidence", "contradicted").otherwise("supported")


def effective_stance(claim_type: Column, status: Column) -> Column:
    kind, status = F.lower(F.trim(claim_type)), F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when((kind == "insufficient_evidence") | status.isin("insufficient_evidence", "no_finding"), "insufficient_evidence").when((status == "contradicted") & (kind == "support"), "counter_evidence").otherwise(kind)


def cause_key(text: Column) -> Column:
    """The cause that a text names, by the first rule that holds."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return first_case([
        ("job_configuration", any_of(t, ("can't open file", "no such file or directory", "configured command missing", "job configuration mismatch"))), ("stream_transport", any_of(t, ("rtmps", "ffmpeg", "send-path"))),
        ("youtube_live_health", any_of(t, ("youtube", "resolver"))), ("service_health", any_of(t, ("watchdog", "stream_v3", "subsystems_status", "pod restart", "service health"))),
        ("database_connection_pool", any_of(t, ("connection pool", "too many connections"))), ("database_timeout", any_of(t, ("database",)) & any_of(t, ("timeout",))),
        ("downstream_dependency", any_of(t, ("payment", "downstream", "dependency"))), ("deployment_regression", any_of(t, ("deploy", "release", "rollout"))), ("auth_config", any_of(t, ("auth", "permission"))),
    ], F.lit("general_incident_review"))


def with_valid_refs(claims: DataFrame, items: DataFrame) -> DataFrame:
    """claims with valid: whether all cited items exist (none cited is valid, too), and lost: those that do not. Claims are
    judged by what they cite, so that those with the same id keep their own."""
    claims = claims.withColumn("__cited", F.array_union("refs", "counter_refs"))
    cited = claims.select("__cited").distinct().withColumn("item_id", F.explode("__cited"))
    lost = cited.join(items.select("item_id").distinct(), "item_id", "left_anti").groupBy("__cited").agg(F.sort_array(F.collect_set("item_id")).alias("lost"))
    return claims.join(lost, "__cited", "left").drop("__cited").withColumn("lost", F.coalesce("lost", _empty())).withColumn("valid", F.size("lost") == 0)


def distinct_values(df: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """Of each group the sorted different values of an array column: repeats go before anything is gathered."""
    return df.select(*by, F.explode(column).alias("__v")).groupBy(*by).agg(F.sort_array(F.collect_set("__v")).alias(name))


def joined_texts(claims: DataFrame, by: Sequence[str], size: int, name: str) -> DataFrame:
    """Of each group the texts in the order of claim_id, joined by a space and cut to size: only as many claims are
    gathered as fill it. A claim takes a character at least, so that a group's first size claims do, and the rest does not
    leave the tasks that have it."""
    w = Window.partitionBy(*by).orderBy("claim_id")
    rows = claims.select(*by, "claim_id", "claim_text").withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= size)
    before = F.coalesce(F.sum(F.length("claim_text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__before", before).where(F.col("__before") < size)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("claim_id", "claim_text"))), lambda x: x["claim_text"])
    return rows.groupBy(*by).agg(F.substring(F.array_join(parts, " "), 1, size).alias(name))


def propositions(claims: DataFrame) -> DataFrame:
    """Claims of one bundle, target and subsystem as one proposition: how many, the texts of each stance, priority. Which
    claims it has is a table of its own, see proposition_links."""
    by, of = list(GROUP), F.col("claim_type")
    checks = of.isin("validation_target", "caveat") | (F.size("missing") > 0)
    p = claims.groupBy(*by).agg(
        F.count("*").alias("n_claims"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(checks).alias("checks"),
        F.count_if((F.col("temporary_action") != "") | (F.col("permanent_action") != "")).alias("actions"),
    )
    for kind, name in (("support", "support_summary"), ("counter_evidence", "counter_summary")):
        p = p.join(joined_texts(claims.where(of == kind), by, 1200, name), by, "left").withColumn(name, F.coalesce(name, F.lit("")))
    wants = claims.where((of == "next_data_needed") | (F.size("missing") > 0)).withColumn("want", F.when(F.size("missing") > 0, F.col("missing")).otherwise(F.array("claim_text")))
    p = p.join(distinct_values(wants, by, "want", "next_data"), by, "left").withColumn("next_data", F.coalesce("next_data", _empty()))
    priority = F.when((F.col("invalid") > 0) | (F.col("counter_summary") != "") | (F.col("checks") >= 2), "high").when((F.col("actions") > 0) | (F.col("support_summary") != ""), "medium").otherwise("low")
    return p.withColumn("priority", priority).withColumn("cause", cause_key(F.concat_ws(" ", "support_summary", "counter_summary"))).withColumn("proposition_id", proposition_key()).drop("invalid", "checks", "actions")


def proposition_key() -> Column:
    return F.concat(F.lit("prop-"), F.substring(F.sha2(F.concat_ws("|", *GROUP), 256), 1, 16))


def proposition_links(claims: DataFrame) -> DataFrame:
    """proposition_id, claim_id: a row for each claim."""
    return claims.select(proposition_key().alias("proposition_id"), "claim_id")


def linked_claims(claims: DataFrame) -> DataFrame:
    """Of each proposition the ids of all its claims, sorted and joined by commas: the row holds them whole."""
    return claims.groupBy(*GROUP).agg(F.array_join(F.sort_array(F.collect_list("claim_id")), ",").alias("linked"))


def clamped(x: Column) -> Column:
    """Between 0 and 1, with four digits; a half goes up however its binary form is rounded."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) + 1e-9, 4)


def risky_share(n: Column) -> Column:
    risky = any_of(F.lower(F.concat_ws(" ", "temporary_action", "permanent_action")), RISKY)
    return clamped(1 - F.count_if(risky) / n)


def scores(props: DataFrame, claims: DataFrame, results: DataFrame) -> DataFrame:
    """Scores of propositions from the claims that they link to; results: result_id, schema_valid (their share counts)."""
    linked = claims.withColumn("proposition_id", proposition_key()).join(props.select("proposition_id"), "proposition_id", "left_semi")
    kind, n = F.col("claim_type"), F.count("*")
    has = lambda *kinds: F.max(kind.isin(*kinds).cast("int"))
    s = linked.groupBy("proposition_id").agg(
        clamped(F.count_if("valid") / n).alias("evidence_ref_score"), clamped(F.count_if(~F.col("valid") | (F.size("refs") == 0)) / n).alias("unsupported"),
        clamped(F.count_if((F.col("temporary_action") != "") | (F.col("permanent_action") != "")) / n).alias("actionability"),
        clamped(F.countDistinct(F.when(kind == "support", F.col("provider"))) / F.countDistinct("provider")).alias("agreement"),
        has("support").alias("s"), has("counter_evidence").alias("c"), has("caveat", "validation_target", "next_data_needed").alias("v"), risky_share(n).alias("safety"),
    )
    clash = F.when((F.col("s") == 1) & (F.col("c") == 1), 0.8).when((F.col("s") == 1) & (F.col("v") == 1), 0.45).when(F.col("c") == 1, 0.6).otherwise(0.0)
    schema = results.agg(clamped(F.coalesce(F.try_divide(F.count_if("schema_valid"), F.count("*")), F.lit(0.0))).alias("schema_score"))
    out = props.select("proposition_id", "priority").join(s, "proposition_id", "left").crossJoin(F.broadcast(schema))  # one row
    out = out.withColumn("contradiction", F.coalesce(clash, F.lit(0.0))).fillna({"evidence_ref_score": 0.0, "unsupported": 1.0, "actionability": 0.0, "agreement": 0.0, "safety": 0.0})
    label = F.when(F.col("priority") == "high", 1.0).when(F.col("priority") == "medium", 0.65).when(F.col("priority") == "low", 0.35).otherwise(0.5)
    total = 0.25 * label + 0.2 * F.col("evidence_ref_score") + 0.15 * F.col("actionability") + 0.15 * F.col("contradiction") + 0.15 * (1 - F.col("agreement")) + 0.1 * (1 - F.col("unsupported"))
    return out.withColumn("review_priority", clamped(total)).drop("s", "c", "v", "priority")


def claim_groups(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Claims of all reviewers about the same target, subsystem, component and evidence: providers of each stance, and
    whether they agree (two supporters at least), disagree (any other stance, missing evidence, one provider of several)
    or lack support; agreement and disagreement do not exclude each other."""
    every = F.sort_array(F.array_distinct(F.array_union("refs", "counter_refs")))
    rows = claims.withColumn("stance", effective_stance(F.col("claim_type"), F.col("finding_status"))).withColumn("all_refs", every)
    rows = rows.withColumn("group_id", F.concat(F.lit("cg-"), F.substring(F.sha2(F.concat_ws("|", "target", "subsystem", "component", F.array_join("all_refs", ",")), 256), 1, 16)))
    by = lambda *s: F.countDistinct(F.when(F.col("stance").isin(*s), F.col("provider")))
    n = lambda *s: F.count_if(F.col("stance").isin(*s))
    g = rows.groupBy("group_id", "target", "subsystem", "component", "all_refs").agg(
        F.countDistinct("provider").alias("providers"), by("support").alias("supporters"), by("counter_evidence").alias("opponents"), by("caveat").alias("doubters"), by("validation_target", "next_data_needed").alias("checkers"),
        F.count("*").alias("n_claims"), n("counter_evidence").alias("n_counter"), n("caveat").alias("n_caveat"), n("validation_target", "next_data_needed").alias("n_check"), n("insufficient_evidence").alias("n_thin"),
        F.count_if((F.col("stance") == "support") & (F.size("refs") == 0)).alias("n_bare"), F.count_if(F.size("missing") > 0).alias("n_missing"),
    )
    known = items.select("item_id").distinct()
    lost = g.select("group_id", F.explode("all_refs").alias("item_id")).join(known, "item_id", "left_anti").groupBy("group_id").agg(F.count("*").alias("n_lost"))
    total = claims.agg(F.countDistinct("provider").alias("all_providers"))
    g = g.join(lost, "group_id", "left").fillna({"n_lost": 0}).crossJoin(F.broadcast(total))  # one row
    why = F.array_compact(F.array(*[F.when(c, F.lit(x)) for x, c in (
        ("counter_claim", F.col("n_counter") > 0), ("caveat_claim", F.col("n_caveat") > 0), ("validation_claim", F.col("n_check") > 0), ("insufficient_evidence", F.col("n_thin") > 0),
        ("missing_evidence", F.col("n_missing") > 0), ("single_provider_detection", (F.col("all_providers") > 1) & (F.col("providers") == 1)),
    )]))
    unsupported = (F.col("n_lost") > 0) | (F.col("n_bare") > 0)
    reason = F.when(F.col("n_lost") > 0, "invalid_evidence_reference").when(F.col("n_bare") > 0, "unsupported_support_without_evidence_id").otherwise("")
    return g.select(
        "group_id", "target", "subsystem", "component", F.array_join("all_refs", ",").alias("refs"), "providers", "supporters", "opponents", "doubters", "checkers", "n_claims", reason.alias("unsupported_reason"), unsupported.alias("unsupported"),
        (~unsupported & (F.col("supporters") >= 2)).alias("agreement"), (~unsupported & (F.size(why) > 0)).alias("disagreement"), F.array_join(why, ",").alias("reasons"),
    )


def _side(claims: DataFrame, provider: str, x: str) -> DataFrame:
    own, by = claims.where(F.col("provider") == provider), ["evidence", "target", "subsystem"]
    n = F.count("*")
    out = own.groupBy(*by).agg(
        n.alias(f"n_{x}"), clamped(F.count_if(F.size("refs") > 0) / n).alias(f"ref_{x}"), clamped(F.count_if("valid") / n).alias(f"ok_{x}"), clamped(F.count_if((F.col("temporary_action") != "") | (F.col("permanent_action") != "")) / n).alias(f"act_{x}"),
        risky_share(n).alias(f"safe_{x}"), F.sort_array(F.collect_set("claim_type")).alias(f"types_{x}"),
    )
    out = out.withColumn(f"overall_{x}", clamped(0.35 * F.col(f"ref_{x}") + 0.25 * F.col(f"ok_{x}") + 0.25 * F.col(f"act_{x}") + 0.15 * F.col(f"safe_{x}")))
    refs = distinct_values(own.withColumn("every", F.array_union("refs", "counter_refs")), by, "every", f"refs_{x}")
    return out.join(refs, by, "left").withColumn(f"refs_{x}", F.coalesce(f"refs_{x}", _empty()))


def compared(props: DataFrame, claims: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Two reviewers by proposition: overlap of their evidence, agreement, scores, and which of them has claims."""
    by = ["evidence", "target", "subsystem"]
    j = props.select("proposition_id", *by).join(_side(claims, baseline, "a"), by, "left").join(_side(claims, candidate, "b"), by, "left")
    j = j.fillna(0, [f"{c}_{x}" for c in ("n", "ref", "ok", "act", "safe", "overall") for x in "ab"])
    for c in ("refs", "types"):
        for x in "ab":
            j = j.withColumn(f"{c}_{x}", F.coalesce(f"{c}_{x}", _empty()))
    share = lambda c: F.coalesce(F.try_divide(F.size(F.array_intersect(f"{c}_a", f"{c}_b")), F.size(F.array_union(f"{c}_a", f"{c}_b"))), F.lit(0.0))
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    j = j.withColumn("overlap", F.round(share("refs"), 4)).withColumn("agreement", F.when(both, clamped(0.65 * F.col("overlap") + 0.35 * share("types"))).otherwise(0.0))
    score = 0.45 * F.col("overlap") + 0.25 * F.col("agreement") + 0.15 * F.least("act_a", "act_b") + 0.15 * F.least("ref_a", "ref_b")
    kind = F.when(both, "shared_target").when(F.col("n_a") > 0, "baseline_only").when(F.col("n_b") > 0, "candidate_only").otherwise("no_model_claims")
    return j.select(
        "proposition_id", "n_a", "n_b", "overlap", "agreement", F.round(score + 1e-9, 4).alias("comparison_score"), "overall_a", "overall_b", F.round(F.col("overall_b") - F.col("overall_a"), 4).alias("difference"), kind.alias("delta_type"),
        F.array_join(F.array_intersect("refs_a", "refs_b"), ",").alias("shared_refs"), F.array_join(F.array_except("refs_a", "refs_b"), ",").alias("baseline_only_refs"), F.array_join(F.array_except("refs_b", "refs_a"), ",").alias("candidate_only_refs"),
    )


def comparison_summary(comparisons: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    kinds = [F.count_if(F.col("delta_type") == k).alias(f"{k}_count") for k in ("shared_target", "baseline_only", "candidate_only")]
    return comparisons.agg(F.count("*").alias("propositions"), *kinds, mean("comparison_score").alias("comparison_score"), mean("overlap").alias("overlap"), mean("difference").alias("difference"))


def structured_evidence(claims: DataFrame) -> DataFrame:
    """Of each proposition the different references by stance, caveats and missing evidence, and a histogram of statuses."""
    by = list(GROUP)
    out = claims.select(*by).distinct()
    kind = F.col("claim_type")
    for name, rows, column in (
        ("support", claims.where(kind == "support"), F.col("refs")), ("counter", claims.where((kind == "counter_evidence") | (F.size("counter_refs") > 0)), F.when(kind == "counter_evidence", F.array_union("refs", "counter_refs")).otherwise(F.col("counter_refs"))),
        ("caveats", claims.where(kind == "caveat"), F.array("claim_text")), ("next_data", claims, F.col("missing")),
    ):
        out = out.join(distinct_values(rows.withColumn("__a", column), by, "__a", name), by, "left").withColumn(name, F.coalesce(name, _empty()))
    status = claims.groupBy(*by, "finding_status").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("finding_status", "n"))).alias("statuses"))
    return out.join(status, by)


def review_history(decision: Column, detail: Column) -> Column:
    """What earlier decisions do to the score: struct of effect, change of score, its limit."""
    of = lambda e, d, m: F.struct(F.lit(e).alias("effect"), d.cast("double").alias("delta"), m.cast("double").alias("most"))
    one = F.lit(1.0)
    limit = F.when(detail == "false_positive", 0.20).when(detail == "duplicate", 0.22).when(detail == "unsupported", 0.25).when(detail == "not_actionable", 0.30).when(detail == "low_value", 0.32).otherwise(0.25)
    return (
        F.when((decision == "accepted") | detail.isin("confirmed_candidate", "known_issue", "watchlist"), of("boost", F.when(detail.isin("known_issue", "confirmed_candidate"), 0.10).otherwise(0.06), one))
        .when((decision == "needs_more_data") | (detail == "needs_more_data"), of("needs_more_data", F.lit(0.03), one))
        .when((decision == "rejected") | detail.isin("false_positive", "low_value", "duplicate", "not_actionable", "unsupported"), of("demote", F.lit(0.0), limit)).otherwise(of("none", F.lit(0.0), one))
    )


def decision_status(decision: Column, detail: Column) -> Column:
    """The status that a decision with its detail gives to what it was made on."""
    ok, no = detail.isin("known_issue", "confirmed_candidate", "watchlist"), detail.isin("false_positive", "low_value", "duplicate", "not_actionable", "unsupported")
    return F.when(decision == "accepted", F.when(ok, detail).otherwise("confirmed_candidate")).when(decision == "rejected", F.when(no, detail).otherwise("false_positive")).otherwise(decision)


#: Targets that are incidents of their own, with the least score of one that has support, and the most score that a target
#: for validation keeps (fixed values).
FLOORS = {"throughput_disappearance": 0.80, "heartbeat_missing": 0.78, "job_configuration_mismatch": 0.82}
VALIDATION_CAPS = {"throughput_disappearance": 0.84, "heartbeat_missing": 0.82, "network_error_signal": 0.60, "freshness_signal_gap": 0.56, "user_impact_signal_gap": 0.56, "instrumentation_mismatch": 0.62, "monitoring_gap": 0.62, "state_mismatch": 0.66, "observability_contract_mismatch": 0.66, "service_start_failure": 0.70}


def table_of(values: dict[str, float], key: Column, default: float | None) -> Column:
    out = F.lit(default).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def shaped_queue(props: DataFrame) -> DataFrame:
    """Propositions with caps, floors, visibility and duplicates settled.

    props: proposition_id, evidence, target (the claim's signature), subsystem, score, support and counter (arrays of
    references), next_data, statuses, actionable (whether a person can act), no_action (texts say that none is needed),
    providers, decision, detail. Caps and floors are kept as lists."""
    n_support, n_counter = F.size("support"), F.size("counter")
    none = F.exists("statuses", lambda x: x["finding_status"] == "no_finding") & (n_support == 0)
    thin = F.exists("statuses", lambda x: x["finding_status"] == "insufficient_evidence") & (n_support == 0)
    q = props.withColumns({"n_support": n_support, "n_counter": n_counter, "n_evidence": F.size(F.array_union("support", "counter")), "none": none, "thin": thin, "primary": F.col("target").isin(*FLOORS), "history": review_history(F.col("decision"), F.col("detail"))})
    checks = (F.size("next_data") > 0) & ~F.col("no_action") & (F.col("score") >= 0.58) & (F.col("subsystem") != "resource_pressure") & ~F.col("none") & ~F.col("thin")
    q = q.withColumn("validation", checks & F.col("target").isin(*VALIDATION_CAPS))
    cap = lambda c, x, why: F.when(c, F.struct(F.lit(x).alias("most"), F.lit(why).alias("reason")))
    q = q.withColumn("caps", F.array_compact(F.array(
        cap(F.col("none"), 0.25, "no_finding"), cap(F.col("thin") & ~F.col("none"), 0.35, "insufficient_evidence"), cap(F.col("n_evidence") == 0, 0.65, "evidence_id_missing"),
        cap((F.col("n_support") == 0) & (F.col("n_counter") == 0), 0.55, "support_and_counter_empty"), cap((F.col("n_support") == 0) & (F.col("n_counter") > 0), 0.55, "support_empty"), cap(F.col("no_action") & ~F.col("primary"), 0.40, "no_immediate_action"),
    )))
    capped = F.least("score", F.coalesce(F.array_min(F.transform("caps", lambda x: x["most"])), F.lit(1.0)))
    checked = F.when(F.col("validation"), F.greatest(capped, F.least("score", table_of(VALIDATION_CAPS, F.col("target"), 0.62)))).otherwise(capped)
    floor = F.when(F.col("primary") & (F.col("n_support") > 0), table_of(FLOORS, F.col("target"), None))
    floored = F.greatest(checked, F.coalesce(floor, F.lit(0.0)))
    effect = F.col("history.effect")
    moved = F.when(effect.isin("boost", "needs_more_data"), F.least(F.lit(1.0), floored + F.col("history.delta"))).when(effect == "demote", F.least(floored, F.col("history.most"))).otherwise(floored)
    last = F.when(F.col("none"), F.least(moved, F.lit(0.25))).when(F.col("thin"), F.least(moved, F.lit(0.35))).otherwise(moved)
    last = F.when(F.col("n_support") == 0, F.least(last, F.lit(0.55))).otherwise(last)
    seen = (
        F.when(F.col("none") | F.col("thin"), "hidden").when((F.col("n_support") == 0) & ~effect.isin("boost", "needs_more_data"), "hidden").when((effect == "demote") & F.col("detail").isin("low_value", "not_actionable"), "monitor_only").when(effect == "demote", "hidden")
        .when(floor.isNotNull() | F.col("validation"), "review").when(F.col("no_action") & ~F.col("primary"), "monitor_only").when((F.size("next_data") == 0) & ~F.col("actionable") & (effect != "boost"), "hidden").otherwise("review")
    )
    mode = F.when(F.col("primary"), "incident_candidate").when(F.col("none") | F.col("thin"), "insufficient_evidence").when(F.col("validation"), "validation_target").otherwise("monitor_or_archive")
    cluster = F.concat(F.lit("cluster-"), F.substring(F.sha2(F.concat_ws("|", "evidence", "subsystem", "target"), 256), 1, 16))
    q = q.withColumns({"effective": F.round(last, 4), "visibility": seen, "mode": mode, "cluster_id": cluster})
    # of a cluster one is seen; of incidents of one target in several subsystems, one
    best = Window.partitionBy("cluster_id").orderBy(F.desc("effective"), F.desc("n_evidence"), F.desc("n_support"), "proposition_id")
    q = q.withColumn("representative", F.row_number().over(best) == 1).withColumn("visibility", F.when(F.col("representative"), F.col("visibility")).otherwise("hidden"))
    rival = (F.col("visibility") == "review") & (F.col("mode") == "incident_candidate") & F.col("primary")
    across = Window.partitionBy("evidence", "target", rival).orderBy(F.when(F.array_contains("providers", "rule-engine"), 0).otherwise(1), F.desc("n_support"), F.desc("effective"), "subsystem", "proposition_id")
    twice = rival & (F.row_number().over(across) > 1)
    q = q.withColumn("duplicate_primary", twice).withColumn("visibility", F.when(F.col("duplicate_primary"), "hidden").otherwise(F.col("visibility")))
    return q


def queue(shaped: DataFrame, limit: int, include_hidden: bool = False) -> DataFrame:
    rows = shaped if include_hidden else shaped.where("visibility = 'review'")
    return rows.orderBy(F.desc("effective"), "cluster_id", "proposition_id").limit(limit)


#: Targets that validate a primary incident (fixed values).
CHILD_TARGETS = ("external_dependency_failure", "network_error_signal", "user_impact_signal_gap", "freshness_signal_gap", "state_mismatch", "monitoring_gap", "instrumentation_mismatch", "observability_contract_mismatch")


def clusters(shaped: DataFrame) -> DataFrame:
    """Clusters with members and providers, the score of the representative, and the primary cluster as the parent of
    those that validate it."""
    c = shaped.groupBy("cluster_id").agg(F.sort_array(F.collect_set("proposition_id")).alias("members"))
    c = c.join(distinct_values(shaped, ["cluster_id"], "providers", "all_providers"), "cluster_id", "left")
    head = shaped.where("representative").select("cluster_id", "evidence", "subsystem", "target", "effective", "mode", F.col("proposition_id").alias("representative_id"))
    c = c.join(head, "cluster_id")
    top = c.where((F.col("mode") == "incident_candidate") | (F.col("target") == "throughput_disappearance")).agg(F.min_by("cluster_id", F.struct(-F.col("effective"), "cluster_id")).alias("parent"))
    c = c.crossJoin(F.broadcast(top))  # one row
    child = (F.col("cluster_id") != F.col("parent")) & ((F.col("mode") == "validation_target") | F.col("target").isin(*CHILD_TARGETS))
    return c.select("cluster_id", "representative_id", "subsystem", "target", "effective", F.array_join("members", ",").alias("members"), F.array_join("all_providers", ",").alias("providers"), F.when(F.coalesce(child, F.lit(False)), F.col("parent")).otherwise("").alias("parent_cluster"))


#: Terms of the priority score (fixed values).
USER_IMPACT = ("user impact", "user-impact", "user_visible", "viewer", "customer", "delivery", "delivered", "notification_not_delivered", "stream", "youtube", "audio", "latency", "error rate", "http_5xx", "outage")
ACTIONABLE = ("restart", "recovery", "watchdog", "exit", "exception", "timeout", "failure", "failed", "error", "config", "deployment", "dependency", "certificate", "auth", "delivery", "notified")
HEALTHY = (
    "none identified", "healthy and idle", "healthy state", "likely healthy", "normal operation", "no issue detected", "no observed failure", "no evidence of service failure", "none, service is healthy", "status confirmation", "not an incident",
    "baseline health", "successful runs", "successful operation", "logs show successful operation", "entirely consistent with normal operation", "not impacting notification delivery", "not experiencing the suspected failure modes",
)
GENERIC_UNITS = ("", "general", "general_review", "generic", "generic_runtime", "unknown", "none", "null")


def review_priority(targets: DataFrame, weights: DataFrame) -> DataFrame:
    """targets with score: how urgent a review is, from 0.05 to 0.94.

    targets: target_id, unit, title, text, missing, caveats (arrays), prior, providers (all that looked) and claimed
    (arrays), n_refs, n_families, n_sources, target_class. weights: provider, weight, trusted (whether its silence
    counts); other providers weigh 1."""
    each = targets.select("target_id", F.explode("providers").alias("provider"), "claimed").join(F.broadcast(weights), "provider", "left")
    w, own = F.coalesce("weight", F.lit(1.0)), F.array_contains("claimed", F.col("provider"))
    share = each.groupBy("target_id").agg(F.sum(w).alias("all_w"), F.sum(F.when(own, w).otherwise(0.0)).alias("own_w"), F.max(F.coalesce("trusted", F.lit(False))).alias("seen"), F.max(own & F.coalesce("trusted", F.lit(False))).alias("spoke"))
    t = targets.join(share, "target_id", "left").fillna({"all_w": 0.0, "own_w": 0.0, "seen": False, "spoke": False})
    text = F.lower(F.concat_ws(" ", "unit", "title", "text"))
    every = F.lower(F.concat_ws(" ", "unit", "title", "text", F.array_join("missing", " "), F.array_join("caveats", " ")))
    generic = F.regexp_replace(F.regexp_replace(F.lower("unit"), "[^a-z0-9]+", "_"), "^_+|_+$", "").isin(*GENERIC_UNITS)
    is_primary = F.lower("target_class") == "primary_candidate"
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    volume = lambda c, n: F.when(F.col(c) > 0, unit(F.log1p(F.col(c).cast("double")) / F.log1p(F.lit(float(n))))).otherwise(0.0)
    act = unit(0.35 + F.when(any_of(text, ACTIONABLE), 0.25).otherwise(0.0) + F.when(any_of(text, USER_IMPACT), 0.25).otherwise(0.0) + F.when(is_primary, 0.15).otherwise(0.0) - F.when(generic, 0.15).otherwise(0.0) - F.when(any_of(text, HEALTHY), 0.25).otherwise(0.0))
    well = any_of(every, HEALTHY)
    quiet = F.col("seen") & ~F.col("spoke")
    block = F.when(any_of(every, ("user_impact_unverified", "user impact")), 0.025).otherwise(0.0) + F.when(any_of(every, ("support_without_evidence_id", "context_only")), 0.05).otherwise(0.0) + F.when(any_of(every, ("severity_only",)), 0.05).otherwise(0.0)
    penalty = F.when(generic, 0.055).otherwise(0.0) + F.when(well, 0.09).otherwise(0.0) + F.least(F.lit(0.07), 0.0125 * F.size("missing")) + block + F.least(F.lit(0.04), 0.0125 * F.size("caveats")) + F.when(quiet, 0.035).otherwise(0.0)
    families = F.when(F.col("n_families") > 0, F.least(F.lit(1.0), F.col("n_families") / 3.0)).when(F.col("n_refs") > 0, 0.35).otherwise(0.0)
    support = F.coalesce(unit(F.try_divide("own_w", "all_w")), F.lit(0.0))
    tie = (F.conv(F.substring(F.sha2(F.concat_ws("|", "unit", "title", F.array_join(F.sort_array("claimed"), ","), F.col("n_refs").cast("string")), 256), 1, 6), 16, 10).cast("long") % 17) / 10000.0
    computed = 0.28 + 0.31 * support + F.when(F.col("spoke"), 0.06).otherwise(0.0) + 0.08 * volume("n_refs", 80) + 0.05 * families + 0.06 * volume("n_sources", 10) + 0.13 * act + F.when(is_primary, 0.045).otherwise(0.0) - penalty
    t = t.withColumn("tie", tie).withColumn("raw", 0.15 * unit(F.col("prior")) + 0.85 * computed + F.col("tie"))
    limit = F.least(F.when(well, 0.72).otherwise(2.0), F.when(generic, 0.80).otherwise(2.0), F.when(quiet & (F.size("claimed") < F.greatest(F.lit(3), F.size("providers"))), 0.78).otherwise(2.0))
    return t.select("target_id", F.round(F.least(F.lit(0.94), F.greatest(F.lit(0.05), F.least("raw", limit + F.col("tie")))), 4).alias("score"), F.round(penalty, 4).alias("penalty"), F.round(act, 4).alias("actionability"), F.round(support, 4).alias("support"))
