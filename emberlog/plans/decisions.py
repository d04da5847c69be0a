"""Queries over what targets are shown as, open proposals, and outputs that need not be asked for again. Twins by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import claims as C
from emberlog.operators import ledger as D
from emberlog.operators import observations as O

from . import arbitration as A
from . import reviews as V

#: The test data's words on targets: issue, context, kinds of claims; each target is seen with each.
SAID = (
    ("No issue was found", "", "support"), ("None.", "", ""), ("A timeout of calls", "The service appears healthy", "support"), ("A timeout of calls", "The service appears healthy", "caveat,no_finding"), ("Load is flat", "The service appears healthy", "support"),
    ("A failure", "", "no_finding"), ("Quiet; missing evidence", "It was not observed", "support"), ("no failure evidence and a failure", "", ""), ("A note", "This is a standard caveat, not a root cause", "caveat"), ("A spike", "A structural caveat, not a root cause", "counter_evidence"),
    ("A spike", "A structural limitation of error logs", "caveat"), ("Errors rise", "Evidence is thin", "support"), ("Errors rise", "Many errors", "support"), ("", "", ""), ("Errors rise", "Metric time-series are wanted", ""),
)


def _said(spark, d):
    words = spark.createDataFrame([(k, *x) for k, x in enumerate(SAID)], "case int, issue string, context string, kinds string")
    words = words.withColumn("types", F.filter(F.split("kinds", ","), lambda x: x != ""))
    return A._observations(spark, d).crossJoin(F.broadcast(words))  # a few cases for each target


def normal_observations(spark: SparkSession, d: str) -> DataFrame:
    """Which words make a target a normal observation, or a structural caveat."""
    s = _said(spark, d)
    issue, context, types = F.col("issue"), F.col("context"), F.col("types")
    return s.select("canonical_key", "case", O.normal_observation(issue, context, types).alias("normal"), O.structural_caveat(F.concat_ws(" ", issue, context), types).alias("structural"), O.problem(issue).alias("problem"))


def public_classes(spark: SparkSession, d: str) -> DataFrame:
    """What each target is shown as under each of these words."""
    s = _said(spark, d)
    issue, context = F.col("issue"), F.col("context")
    kind = O.public_class(F.col("original_class"), issue, context, F.col("types"), F.concat_ws(" ", issue, context), F.col("n_refs"), F.col("n_families"), F.col("sources"))
    return s.select("canonical_key", "case", "original_class", kind.alias("k")).select("canonical_key", "case", "original_class", "k.*")


def pending_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Propositions that are still open: by the latest decision, or else by their own status; with and without hidden ones."""
    p = V._shaped(spark, d).select("proposition_id", *C.GROUP, "visibility", F.expr("case when subsystem = 'traffic' then 'archived' else 'pending' end").alias("review_status"))
    r = V._decisions(spark, d).withColumn("status", C.decision_status(F.col("decision"), F.col("detail")))
    out = None
    for hidden in (False, True):
        x = O.open_proposals(p, r, list(C.GROUP), F.desc("decided_at"), include_hidden=hidden).select(F.lit(hidden).alias("with_hidden"), "proposition_id", "status", "visibility")
        out = x if out is None else out.unionByName(x)
    return out


#: The test data's recorded outputs, as an expression that both dialects read.
OUTPUTS = """select conv_id * 100 + turn as record_id, role as provider, concat('c', conv_id % 40) as contract, case when conv_id % 9 = 0 then 'execution-contract/v0' else 'execution-contract/v1' end as version, case when length(coalesce(text, '')) % 3 = 0 then 'failed' when length(coalesce(text, '')) % 7 = 0 then '' else 'ok' end as status,
 length(coalesce(text, '')) % 5 > 0 as schema_valid, coalesce(text, '') as payload, conv_id as at_time from CONVERSATIONS where conv_id is not null and turn is not null and role is not null"""


def reusable_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs whose output is recorded already: the latest success, or the latest failure where that will do."""
    V._table(spark, d, "conversations").createOrReplaceTempView("__emberlog_outputs")
    r = spark.sql(OUTPUTS.replace("CONVERSATIONS", "__emberlog_outputs")).withColumnRenamed("at_time", "at")
    wanted = r.select("provider", "contract").distinct().unionByName(spark.createDataFrame([("nobody", "c1")], "provider string, contract string"))
    both = [D.reusable(r, wanted, f).withColumn("failed_too", F.lit(f)) for f in (False, True)]
    return both[0].unionByName(both[1])


QUERIES = {f.__name__: f for f in (normal_observations, public_classes, pending_proposals, reusable_outputs)}


# ---- twins

#: Cases of SAID by number: normal, structural, of a problem, thin by words.
_NORMAL, _STRUCTURAL, _PROBLEM, _THIN = "(0, 1, 3, 4, 6, 7)", "(8)", "(2, 3, 5, 7, 9, 10, 11, 12, 14)", "(6, 11, 14)"
_CASES = f"{A._OBS}, ca as (select obs.*, x.case::int as kase from obs, (select unnest(range({len(SAID)})) as case) x)"
ORACLES = {
    "normal_observations": f"{_CASES} select canonical_key, kase as \"case\", kase in {_NORMAL} as normal, kase in {_STRUCTURAL} as structural, kase in {_PROBLEM} as problem from ca",
    "public_classes": f"""{_CASES}, cb as (select *, case when kase in {_NORMAL} then 'normal_operation_observation' when kase in {_STRUCTURAL} then 'non_incident_structural_caveat' when original_class = 'primary_candidate' and (n_refs < 3 or n_families < 2 or (sources <= 1 and n_refs <= 3) or kase in {_THIN}) then 'demoted_primary_candidate_evidence_thin' else '' end as adjustment from ca)
select canonical_key, kase as "case", original_class, case when adjustment like 'demoted%' then 'validation_target' when adjustment <> '' then 'monitor_only' else original_class end as final_class, adjustment from cb""",
    "pending_proposals": f"""{V._SHAPED}, pe as (select proposition_id, visibility, coalesce(case when ld.decision = 'accepted' then case when ld.detail in ('known_issue', 'confirmed_candidate', 'watchlist') then ld.detail else 'confirmed_candidate' end when ld.decision = 'rejected' then case when ld.detail in ('false_positive', 'low_value', 'duplicate', 'not_actionable', 'unsupported') then ld.detail else 'false_positive' end else ld.decision end, case when subsystem = 'traffic' then 'archived' else 'pending' end) as status from shaped left join lastd ld using (evidence, target, subsystem))
select h as with_hidden, proposition_id, status, visibility from pe, (values (false), (true)) v(h) where status in ('pending', 'needs_more_data') and (h or visibility <> 'hidden')""",
    "reusable_outputs": f"""with ro as ({OUTPUTS.replace('CONVERSATIONS', 'conversations')}), wa as (select distinct provider, contract from ro union all select 'nobody', 'c1'), rg as (select *, status = 'ok' and schema_valid as good from ro where version = 'execution-contract/v1' and payload <> '' and status <> ''),
b as (select provider, contract, max_by(record_id, at_time * 1000000 + record_id) filter (good) as s, max_by(record_id, at_time * 1000000 + record_id) as l from rg group by all)
select provider, contract, case when f then coalesce(s, l) else s end as record_id, case when s is not null then 'success' when f and l is not null then 'failed' else 'none' end as reused, f as failed_too from wa left join b using (provider, contract), (values (false), (true)) v(f)""",
}
