"""What a claim is about: chains of fallbacks that keep which step decided, clusters by signature, breakdown of scores.

A chain is a struct (value, step): the first step that gives a value, and its name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logs import METRIC_SEMANTICS
from .signals import TARGET_TERMS, target_of_text
from .text import any_of

# ---- fixed values

RESTART_METRICS = ("runtime_restart_count", "service_health_failure_count")
VOLUME_METRICS = ("active_service_count", "total_log_count")
DIRECT_IMPACT = ("throughput_disappearance", "external_dependency_failure", "user_impact_signal_gap", "freshness_signal_gap")
RUNTIME_IMPACT = ("restart_loop", "state_mismatch", "observability_contract_mismatch")
PRIORITY_RISK = {"high": 0.78, "medium": 0.55, "low": 0.35}
VALIDATING = ("external_dependency_failure", "network_error_signal", "user_impact_signal_gap", "freshness_signal_gap", "state_mismatch", "monitoring_gap", "instrumentation_mismatch", "observability_contract_mismatch")


def chain(*steps: tuple[str, Column]) -> Column:
    """struct (value, step) of the first step whose value is neither null nor empty; null if there is none."""
    given = [F.when(F.nullif(v, F.lit("")).isNotNull(), F.struct(v.alias("value"), F.lit(name).alias("step"))) for name, v in steps]
    return F.coalesce(*given)


def only_one(values: Column) -> Column:
    """The value of an array of a single one, else null."""
    return F.when(F.size(values) == 1, F.get(values, 0))


def claim_target(given: Column, text: Column) -> Column:
    """The target that a claim gives, or that its text speaks of."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return chain(
        ("given", F.trim(F.coalesce(given, F.lit("")))), ("job", F.when(any_of(t, ("configured job", "supervisor", "no such file")), "job_configuration_mismatch")), ("restart", F.when(any_of(t, ("restart", "crashloop")), "restart_loop")),
        ("transport", F.when(any_of(t, ("rtmps", "ffmpeg", "send-path")), "throughput_disappearance")), ("dependency", F.when(any_of(t, ("dependency", "downstream")), "external_dependency_failure")),
        ("deployment", F.when(F.contains(t, F.lit("deploy")), "deployment_correlation")), ("default", F.lit("general_review")),
    )


def claim_subsystem(given: Column, text: Column) -> Column:
    """The subsystem that a claim gives, or that its text speaks of."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return chain(
        ("given", F.trim(F.coalesce(given, F.lit("")))), ("transport", F.when(any_of(t, ("rtmps", "ffmpeg")), "rtmps_ffmpeg")), ("live", F.when(F.contains(t, F.lit("youtube")), "youtube_live")),
        ("recovery", F.when(any_of(t, ("restart", "supervisor")), "runtime_recovery")), ("default", F.lit("general")),
    )


def subsystem_targets(semantics: DataFrame) -> DataFrame:
    """subsystem, subsystem_target: the most frequent target of a subsystem's metrics in the profile, or else in the generic
    semantics; then the first listed. semantics: place, subsystem, core_target_type, in the profile's order."""
    names = "metric_name string, semantic_type string, zero_behavior string, subsystem string, core_target_type string"
    generic = semantics.sparkSession.createDataFrame([(k, *row) for k, row in enumerate(METRIC_SEMANTICS)], f"place int, {names}")
    rows = semantics.select(F.lit(0).alias("layer"), "place", "subsystem", "core_target_type").unionByName(generic.select(F.lit(1).alias("layer"), "place", "subsystem", "core_target_type"))
    counted = rows.where("core_target_type <> '' and subsystem <> ''").groupBy("layer", "subsystem", "core_target_type").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    return counted.groupBy("subsystem").agg(F.min_by("core_target_type", F.struct("layer", -F.col("n"), "first", "core_target_type")).alias("subsystem_target"))


def with_cited(claims: DataFrame, items: DataFrame) -> DataFrame:
    """claims (claim_id, bundle_id, refs) with what the items say that they cite: evidence_targets, metrics (sorted),
    metric_targets (metrics that have one, in the order of their names), evidence_text. items: also metric_name and
    core_target_type. A claim cites a few items."""
    cited = claims.select("claim_id", "bundle_id", F.posexplode("refs").alias("at", "ref")).join(items.select("bundle_id", "ref", "text", F.coalesce("metric_name", F.lit("")).alias("metric_name"), F.coalesce("core_target_type", F.lit("")).alias("core_target_type")), ["bundle_id", "ref"])
    some = lambda c: F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    named = F.sort_array(F.collect_set(F.when((F.col("metric_name") != "") & (F.col("core_target_type") != ""), F.struct("metric_name", "core_target_type"))))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    per = cited.groupBy("claim_id").agg(some("core_target_type").alias("evidence_targets"), some("metric_name").alias("metrics"), F.transform(named, lambda x: x["core_target_type"]).alias("metric_targets"), F.array_join(texts, " ").alias("evidence_text"))
    none = F.array().cast("array<string>")
    out = claims.join(per, "claim_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("evidence_targets", "metrics", "metric_targets")} | {"evidence_text": F.coalesce("evidence_text", F.lit(""))})


def with_signature(claims: DataFrame) -> DataFrame:
    """claims with signature: what a claim is of, by ten steps from the surest to the words of its text.

    claims: identity (array of targets), evidence_targets, metrics, metric_targets, evidence_text, subsystem,
    subsystem_target, text."""
    t, sub = F.lower("text"), F.col("subsystem")
    speaks = lambda names: any_of(t, names) | F.arrays_overlap("metrics", F.array(*map(F.lit, names)))
    words = F.slice(F.regexp_extract_all(t, F.lit("[a-z0-9_]{4,}"), F.lit(0)), 1, 8)
    return claims.withColumn("signature", chain(
        ("identity", only_one(F.col("identity"))), ("evidence", only_one(F.col("evidence_targets"))), ("metric", F.get("metric_targets", 0)), ("evidence_text", target_of_text(F.col("evidence_text"))),
        ("subsystem", F.when(F.size("metrics") == 0, F.col("subsystem_target"))), ("restarts", F.when((sub == "runtime_recovery") & speaks(RESTART_METRICS), "restart_loop")), ("volume", F.when(speaks(VOLUME_METRICS), "observability_volume_or_contract")),
        ("text", target_of_text(t)), ("restart_text", F.when(any_of(t, RESTART_METRICS), "restart_loop")), ("metric_names", F.when(F.size("metrics") > 0, F.concat(F.lit("metric:"), F.array_join("metrics", ",")))),
        ("words", F.concat(F.lit("text:"), F.array_join(words, "-"))),
    ))


def with_review_target(claims: DataFrame) -> DataFrame:
    """claims with signature: review_target, the type of target that a queue shows, by its own chain."""
    known = F.col("signature.value").isin(*[t for t, _ in TARGET_TERMS])
    bare = F.size("refs") == 0
    text = F.lower(F.concat_ws(" ", "text", "evidence_text"))
    return claims.withColumn("review_target", chain(
        ("identity", only_one(F.col("identity"))), ("evidence", only_one(F.col("evidence_targets"))), ("metric", F.get("metric_targets", 0)), ("subsystem", F.when(bare, F.col("subsystem_target"))), ("signature", F.when(known, F.col("signature.value"))),
        ("text", target_of_text(text)), ("any_signature", F.col("signature.value")), ("default", F.lit("monitoring_gap")),
    ))


def zero_semantics(claims: DataFrame, items: DataFrame) -> DataFrame:
    """claim_id, metric_name, meaning, semantic_type, core_target_type: what zero means for each metric that a claim cites.
    items: bundle_id, ref, metric_name and its semantics."""
    cited = claims.select("claim_id", "bundle_id", F.explode("refs").alias("ref")).join(items.where("metric_name <> ''"), ["bundle_id", "ref"])
    z = F.col("zero_behavior")
    return cited.select("claim_id", "metric_name", F.when(z == "suspicious", "zero_is_bad").when(z == "healthy", "zero_is_good").otherwise(z).alias("meaning"), "semantic_type", "core_target_type")


def signature_clusters(claims: DataFrame, by: Sequence[str] = ("bundle_id", "subsystem", "signature")) -> DataFrame:
    """Claims of one bundle, subsystem and signature as a cluster: cluster_id, members (their number), representative,
    providers, models, support_refs and counter_refs (numbers), wants (number of different gaps), parent.

    The representative has the highest score, then the smallest id. The best incident of a bundle is the parent of the
    clusters that validate it. claims: claim_id, provider, model, score, mode, refs, missing, counter (boolean), signature
    as text. Providers and models are few; what grows is counted, not gathered."""
    key = F.concat(F.lit("sc-"), F.substring(F.sha2(F.concat_ws("|", *by), 256), 1, 16))
    c = claims.withColumn("cluster_id", key)
    best = F.struct(-F.col("score"), F.col("claim_id"))
    g = c.groupBy("cluster_id", *by).agg(
        F.count("*").alias("members"), F.min_by("claim_id", best).alias("representative"), F.max("score").alias("score"), F.min_by("mode", best).alias("mode"), F.min_by("priority", best).alias("priority"), F.min_by("review_target", best).alias("review_target"), F.min_by("actions", best).alias("actions"),
        F.sort_array(F.collect_set("provider")).alias("providers"), F.sort_array(F.collect_set("model")).alias("models"),
    )
    refs = c.select("cluster_id", "counter", F.explode("refs").alias("ref")).groupBy("cluster_id").agg(*[F.count_distinct(F.when(x, F.col("ref"))).alias(n) for n, x in (("support_refs", ~F.col("counter")), ("counter_refs", F.col("counter")), ("refs", F.lit(True)))])
    gaps = c.select("cluster_id", F.explode("missing").alias("gap")).groupBy("cluster_id").agg(F.count_distinct("gap").alias("wants"))
    metrics = c.select("cluster_id", F.explode("metrics").alias("m")).groupBy("cluster_id").agg(F.count_distinct("m").alias("n_metrics"))
    for part in (refs, gaps, metrics):
        g = g.join(part, "cluster_id", "left")
    g = g.fillna(0, ["support_refs", "counter_refs", "refs", "wants", "n_metrics"])
    incident = (F.col("mode") == "incident_candidate") | (F.col("signature") == "throughput_disappearance")
    top = g.where(incident).groupBy("bundle_id").agg(F.min_by("cluster_id", F.struct(-F.col("score"), "cluster_id")).alias("top"))
    child = (F.col("cluster_id") != F.col("top")) & ((F.col("mode") == "validation_target") | F.col("signature").isin(*VALIDATING))
    return g.join(top, "bundle_id", "left").withColumn("parent", F.when(F.coalesce(child, F.lit(False)), F.col("top")).otherwise("")).drop("top")


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def score_breakdown(clusters: DataFrame, all_providers: int) -> DataFrame:
    """clusters with the parts of their score: evidence_strength, actionability, user_impact_risk, agreement, diversity,
    missing_penalty, duplicate_penalty. actions: whether its representative suggests any."""
    total = F.greatest(F.lit(all_providers), F.size("providers"), F.lit(1))
    t = F.col("review_target")
    risk = F.when(t.isin(*DIRECT_IMPACT), 0.82).when(t.isin(*RUNTIME_IMPACT), 0.72)
    for name, value in PRIORITY_RISK.items():
        risk = risk.when(F.col("priority") == name, value)
    parts = {
        "evidence_strength": _unit((F.col("support_refs") + 0.5 * F.col("counter_refs")) / 3.0), "actionability": F.when((F.col("wants") > 0) | F.col("actions"), 0.85).otherwise(0.35), "user_impact_risk": risk.otherwise(0.5),
        "agreement": _unit(F.size("providers") / total), "diversity": _unit(F.when(F.col("n_metrics") > 0, F.col("n_metrics")).otherwise(F.col("refs")) / total),
        "missing_penalty": F.least(F.lit(0.3), F.col("wants") * 0.025), "duplicate_penalty": F.least(F.lit(0.2), (F.col("members") - 1) * 0.04),
    }
    return clusters.withColumns({k: F.round(v, 4) for k, v in parts.items()})
