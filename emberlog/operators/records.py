"""Records of reviews and runs: redaction with hashes, themes, stances, snapshots, fingerprints, states of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import documents as D
from .text import any_of, first_case

SENSITIVE_KEY = r"api[_-]?key|token|session(?:[_-]?id)?|password|passwd|secret|private[_-]?key|credential|client[_-]?secret|authorization|cookie|gmail|pubsub"
ID_KEY = r"(?:^|[_-])(user|order|tracking|track|customer|account)[_-]?id$"


def redacted(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the column redacted: homes and secrets go, URLs, ids, addresses become hashes; and out_counts, a map of
    how many there were of each kind."""
    r = df.withColumn("__r", D.redacted(F.col(column)))
    return r.withColumn(out, F.col("__r.text")).withColumn(f"{out}_counts", F.col("__r.counts")).drop("__r")


def redacted_map(attributes: Column) -> Column:
    """A map without secrets: values of sensitive keys go under one name, values of id keys become hashes."""
    key = lambda k: F.lower(k)
    kept = F.map_filter(attributes, lambda k, _: ~key(k).rlike(SENSITIVE_KEY))
    kept = F.transform_values(kept, lambda k, v: F.when(key(k).rlike(ID_KEY) & (v != ""), F.concat(F.lit("<ID_HASH:"), F.substring(F.sha2(v, 256), 1, 12), F.lit(">"))).otherwise(v))
    some = F.exists(F.map_keys(attributes), lambda k: key(k).rlike(SENSITIVE_KEY))
    return F.when(some, F.map_concat(kept, F.create_map(F.lit("redacted_secret"), F.lit("<REDACTED_SECRET>")))).otherwise(kept)


def fine_template(text: Column) -> Column:
    """A template with times, paths, hashes and decimals replaced as well."""
    for pattern, to in (
        (r"<(EMAIL|IP|ID|URL)_HASH:[0-9a-f]{12}>", "<$1>"), ("<REDACTED_SECRET>", "<SECRET>"), (D.INTERNAL_URL, "<URL>"), (D.EMAIL, "<EMAIL>"), (D.IP, "<IP>"), (r"\b\d{4}-\d{2}-\d{2}[T ][0-2]\d:[0-5]\d:[0-5]\d(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<TIMESTAMP>"),
        (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"), (r"(?i)\b(?:sha256:)?[0-9a-f]{32,128}\b", "<HASH>"), (r"(?i)\b[A-Z]:\\(?:[^\\\s:]+\\)+[^\\\s:]*", "<PATH>"),
        (r"(?<![A-Za-z0-9_])(?:<USER_HOME>/|/)(?:[A-Za-z0-9._@%+\-]+/)*[A-Za-z0-9._@%+\-]+", "<PATH>"), (r"\b\d+(?:\.\d+)?\b", "<NUM>"), (r"\s+", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def theme(text: Column) -> Column:
    """What reviewers disagree about, by the first theme of which a word occurs."""
    t = F.lower(text)
    return first_case([
        ("external_dependency", any_of(t, ("external", "dependency", "http_5xx", "timeout"))), ("user_impact", any_of(t, ("user impact", "delivery", "ingest", "watch", "audio"))), ("freshness", any_of(t, ("freshness", "stale", "timestamp", "drift"))),
        ("instrumentation", any_of(t, ("metric", "count", "aggregation", "mismatch"))), ("deployment", any_of(t, ("deployment", "config", "version"))),
    ], F.lit("general"))


def failure_status(status: Column, schema_valid: Column, text: Column, parse: Column, attempts: Column, limit: Column) -> Column:
    """What became of a chunk's run: ok, or the kind of its failure."""
    t = F.lower(text)
    has = lambda *terms: any_of(t, terms)
    return (
        F.when((status == "ok") & schema_valid, "ok").when(status == "skipped_not_configured", "skipped_not_configured").when((status == "blocked_by_safety_preflight") | has("safety", "filter", "blocked"), "safety_filter")
        .when(has("context length", "context_length", "maximum context", "max context", "token limit"), "context_length").when(has("429", "rate limit", "rate_limit", "quota", "resource exhausted", "throttle"), "rate_limited").when((status == "timeout") | has("timeout", "timed out", "deadline"), "timeout")
        .when(has("schema invalid", "schema_invalid", "schema validation", "schema_validation"), "schema_invalid").when((status == "ok") & parse.isin("invalid_json", "invalid_after_repair"), "deterministic_parse_failure").when(status == "ok", "schema_invalid")
        .when(has("empty response", "empty_response", "no response"), "empty_response").when((attempts > 0) & (limit > 0) & (attempts >= limit), "retry_exhausted").otherwise("provider_error")
    )


REASON_ALIASES = {"schema_validation_failed": "schema_invalid", "schema_validation_error": "schema_invalid", "safety_preflight_failed": "blocked_by_safety_preflight", "safety_preflight_blocked": "blocked_by_safety_preflight", "not_configured": "provider_not_configured", "skipped_not_configured": "provider_not_configured", "timeout": "provider_timeout", "missing_child_bundle": "child_bundle_missing", "no_claims": "no_claims_extracted"}


def reason_code(step: Column, status: Column, said: Column, of: Column, message: Column) -> Column:
    """Why an event of a run is not a plain success; empty if it is."""
    t = F.regexp_replace(F.lower(F.trim(said)), "[- ]", "_")
    alias = t
    for k, v in REASON_ALIASES.items():
        alias = F.when(t == k, F.lit(v)).otherwise(alias)
    m, failed = F.lower(message), status.isin("failed", "timeout", "blocked")
    return (
        F.when(F.coalesce(said, F.lit("")) != "", alias).when(failed & (step == "child_bundle_created"), "child_bundle_missing").when(status == "needs_input", F.when(step == "planner_answers_received", "no_planner_answers").otherwise("human_input_required"))
        .when((status == "timeout") | (of == "timeout") | F.contains(m, F.lit("timeout")), "provider_timeout").when(of.isin("skipped", "skipped_not_configured", "not_configured"), "provider_not_configured").when(of.isin("failed", "error") & F.contains(step, F.lit("provider")), "provider_failed")
        .when((status == "blocked") & F.contains(m, F.lit("safety")), "blocked_by_safety_preflight").when(failed, step).otherwise("")
    )


def inferred_refs(claims: DataFrame, items: DataFrame, pattern: str) -> DataFrame:
    """Claims that cite nothing get the known ids that their text names, in the order of the text; others stay."""
    found = claims.where(F.size("refs") == 0).select("claim_id", F.posexplode(F.array_distinct(F.regexp_extract_all("claim_text", F.lit(pattern), F.lit(0)))).alias("place", "item_id"))
    known = found.join(items.select("item_id").distinct(), "item_id", "left_semi").groupBy("claim_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "item_id"))), lambda x: x["item_id"]).alias("named"))
    out = claims.join(known, "claim_id", "left")
    return out.withColumn("inferred", F.col("named").isNotNull()).withColumn("refs", F.coalesce("named", "refs")).drop("named")


def new_snapshots(snapshots: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """Snapshots of which the content is not that of the one before: saved only if new."""
    w = Window.partitionBy(*key).orderBy(order)
    return snapshots.withColumn("__before", F.lag("content").over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col("content"))).drop("__before")


def fingerprint(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, fingerprint): a hash over each key's input rows, whatever their order: of their number and of eight sums over
    parts of the rows' hashes, so that a key of any size is nine numbers."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), 256)
    part = lambda k: F.conv(F.substring("__h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(part(k)).alias(f"s{k}") for k in range(8)]
    out = rows.select(key, row.alias("__h")).groupBy(key).agg(F.count("*").alias("n"), *sums)
    return out.select(key, F.sha2(F.concat_ws("-", "n", *[F.col(f"s{k}").cast("string") for k in range(8)]), 256).alias("fingerprint"))
