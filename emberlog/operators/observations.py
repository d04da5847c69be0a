"""What the texts of a target say: that nothing is wrong, that evidence is bounded, that it is too thin to be public; and
which proposals are still open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import latest_by
from .text import any_of

# ---- fixed values

NO_ISSUE = (
    "none identified", "no issue", "no observed failure", "no observed failures", "no evidence of service failure", "no evidence of service start failures", "no evidence of failure", "no logs indicate service start failures",
    "no logs indicate failure", "no failure evidence", "service appears healthy", "likely healthy", "currently stable", "may have remained healthy", "may have remained stable", "appears to have remained healthy",
    "appears to have remained stable", "no confirmed outage", "no confirmed degradation", "no degradation observed", "was not observed", "were not observed", "negative finding", "rules out", "normal operation", "successful operation",
    "logs show successful operation", "baseline observation of healthy activity", "baseline observation of normal operation", "baseline operational observation", "confirms operational status", "confirms normal", "functioning as expected",
    "message ingestion is functional", "entirely consistent with normal operation", "normal operation rather than an incident", "not impacting notification delivery", "not experiencing the suspected failure modes",
)
NOTHING = ("none", "n a", "na", "no finding", "no findings")
PROBLEMS = (
    "potential", "anomaly", "spike", "surge", "increase", "decrease", "failure", "failed", "error", "timeout", "restart loop", "expired", "missed", "disappearance", "mismatch", "missing", "not delivered", "zero notifications", "upstream change",
    "configuration issue", "unknown operational state", "invalid argument", "invalid arguments", "root cause", "unexpected", "outage", "degradation", "instability",
)
#: What is no problem although it holds the word of one.
NO_PROBLEM = ("missing evidence", "missing-evidence")
BOUNDED = (
    "structural caveat", "structural limitation", "standard caveat", "version anchoring is missing", "version anchoring is unconfirmed", "deployed_version_confirmed field is false", "source context may not match",
    "source code context and runtime environment", "source code context and deployed runtime", "source code/config and the actual deployed version", "source code/config and the actual running version",
)
NO_INCIDENT = ("rather than a functional finding", "not a specific incident finding", "not a root cause", "not identifying a failure", "standard caveat for all findings")
THIN = (
    "no specific failure signals", "no explicit failure signal", "no error logs", "no metric spikes", "no audio energy", "not confirmed", "cannot confirm", "insufficient evidence", "evidence is thin", "missing evidence", "core_missing_evidence",
    "user_impact_unverified", "specific error logs", "metric time-series", "status logs", "measurement logs", "operational outcome evidence",
)
NO_FINDING_TYPES, CAVEAT_TYPES = ("insufficient_evidence", "no_finding"), ("caveat", "support", "insufficient_evidence", "no_finding")
LEAST_REFS = 3
OPEN = ("pending", "needs_more_data")


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def no_issue(text: Column) -> Column:
    """Whether a text says that nothing is wrong, in a phrase or as a whole."""
    t = _low(text)
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")).isin(*NOTHING) | any_of(t, NO_ISSUE)


def problem(text: Column) -> Column:
    """Whether a text speaks of a problem, apart from the phrases that deny one: those are taken out first, in their order."""
    t = _low(text)
    for phrase in (*NO_ISSUE, *NO_PROBLEM):
        t = F.replace(t, F.lit(phrase), F.lit(" "))
    return any_of(t, PROBLEMS)


def _only(types: Column, allowed: Sequence[str]) -> Column:
    return (F.size(types) > 0) & F.forall(types, lambda x: F.lower(F.trim(x)).isin(*allowed))


def normal_observation(issue: Column, context: Column, types: Column) -> Column:
    """Whether a target is no finding: its issue says so; or its context does, and the issue names no problem or reviewers
    give caveats and no findings only; or reviewers give no findings only, and any text says so without a problem.

    types: the kinds of claims of its reviewers."""
    quiet, bad = no_issue(context), problem(issue)
    return no_issue(issue) | (quiet & ~bad) | (quiet & _only(types, (*NO_FINDING_TYPES, "caveat"))) | (_only(types, NO_FINDING_TYPES) & no_issue(F.concat_ws(" ", issue, context)) & ~bad)


def structural_caveat(text: Column, types: Column) -> Column:
    """Whether a target is a bound of its evidence, and no incident; text: its issue and context."""
    t = _low(text)
    return any_of(t, BOUNDED) & ((F.size(types) == 0) | _only(types, CAVEAT_TYPES)) & (any_of(t, NO_INCIDENT) | no_issue(text))


def public_class(original: Column, issue: Column, context: Column, types: Column, evidence: Column, refs: Column, families: Column, sources: Column) -> Column:
    """struct (final_class, adjustment): what a target is shown as. Normal observations and structural caveats are monitored;
    a primary candidate whose evidence is thin by numbers or by its own words (evidence) is validated; others stay."""
    thin = (refs < LEAST_REFS) | (families < 2) | ((sources <= 1) & (refs <= LEAST_REFS)) | any_of(_low(evidence), THIN)
    of = lambda kind, why: F.struct(kind.alias("final_class"), F.lit(why).alias("adjustment"))
    watched = F.lit("monitor_only")
    return (
        F.when(normal_observation(issue, context, types), of(watched, "normal_operation_observation")).when(structural_caveat(F.concat_ws(" ", issue, context), types), of(watched, "non_incident_structural_caveat"))
        .when((original == "primary_candidate") & thin, of(F.lit("validation_target"), "demoted_primary_candidate_evidence_thin")).otherwise(of(original, ""))
    )


def open_proposals(proposals: DataFrame, reviews: DataFrame, keys: Sequence[str], *order: Column, include_hidden: bool = False) -> DataFrame:
    """Proposals (review_status, visibility) of which the status is open: that of the latest review, or their own if there is
    none. reviews: keys, status. Hidden ones only if asked for."""
    last = latest_by(reviews, keys, *order).select(*keys, F.col("status").alias("__status"))
    p = proposals.join(last, list(keys), "left").withColumn("status", F.coalesce("__status", "review_status")).drop("__status").where(F.col("status").isin(*OPEN))
    return p if include_hidden else p.where("visibility <> 'hidden'")
