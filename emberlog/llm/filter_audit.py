"""Filter interaction audit: what each filter of a chain removes in every order, and its Shapley value, from the multilinear
extension of the number of removed documents."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
#: All orders of the filters are rows of the result.
MOST_FILTERS = 6


def document_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails: for each document the filters that it fails, as bits (A is bit 0).

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * `[A-Z]` characters > 5 * code points; D: holds any
    of `#$%&*|`; E: its text is the text of a smaller doc_id, whatever becomes of that one. Null texts are empty, null
    sources are the part of the empty name. Repeated rows count each, and do not fail E for each other; a document
    without an id is no smaller than others, nor are others smaller than it. Texts are equal if their SHA-256 is.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    own = [n < 50, distinct * 100 < n * 65, F.regexp_count("text", F.lit("[A-Z]")).cast("long") * 100 > F.length("text").cast("long") * 5, F.col("text").rlike(r"[#$%&*|]")]
    fails = sum((c.cast("int") * (1 << k) for k, c in enumerate(own)), F.lit(0))
    slim = saved(words.select("doc_id", "part", fails.alias("own"), F.sha2("text", 256).alias("digest")), "audit-documents")
    # only texts of several ids are looked up: a group of copies is one row here, and the join splits where it is hot,
    # which it can as both sides are plain tables
    copied = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copied = saved(copied, "audit-copies")
    again = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).cast("int") * 16
    return slim.join(copied, "digest", "left").select("doc_id", "part", (F.col("own") + again).alias("fails"))


def labelled(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """failures with good and toxic: whether any label of the doc_id says quality = 1, toxic = 1."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).where("good + toxic > 0")
    rows = failures.select("doc_id", "part", "fails").join(known, "doc_id", "left")
    return rows.select("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def removal_polynomials(rows: DataFrame) -> DataFrame:
    """part, total, terms: for each part the number of removed documents as a polynomial in the filters' probabilities to
    be there, x_f, each filter by itself.

    A document that fails the set m is removed with probability 1 - prod of (1 - x_f) over m; summed over the counts of the
    masks and multiplied out, the term of each set t that is not empty is (-1)^(|t| + 1) times the documents whose mask
    holds t. terms has one entry (t, n, good, toxic) for each t with any such document.
    """
    masks = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    subsets = F.filter(F.sequence(F.lit(0), F.col("fails")), lambda t: t.bitwiseAND(F.col("fails")) == t)
    terms = masks.withColumn("t", F.explode(subsets))
    sign = F.when(F.bit_count("t") % 2 == 1, 1).otherwise(-1)
    terms = terms.groupBy("part", "t").agg(*[F.sum(F.col(c) * sign).alias(c) for c in MEASURES])
    total = F.sum(F.when(F.col("t") == 0, -F.col("n")).otherwise(0))  # the empty set is in every mask
    each = F.sort_array(F.collect_list(F.when(F.col("t") > 0, F.struct("t", *MEASURES))))  # one entry for each set of filters at most
    return terms.groupBy("part").agg(total.alias("total"), each.alias("terms"))


def _corners(sets: Column, measure: str) -> Column:
    """The polynomial where the filters of a set are there and the others are not, for each of the sets: only terms within a
    set count."""

    def at(corner: Column) -> Column:
        return F.aggregate("terms", F.lit(0).cast("long"), lambda s, x: s + F.when(x["t"].bitwiseAND(corner) == x["t"], x[measure]).otherwise(0))

    return F.transform(sets, at)


def _shapley(k: int, filters: int) -> Column:
    """The integral over 0..1 of the derivative by filter k where all probabilities are equal, times filters!.

    The derivative of a term of size s that holds k is its coefficient times x^(s - 1), whose integral is the coefficient
    over s; filters! is a multiple of every s, so that the sum is a whole number."""
    parts = F.array(*[F.lit(factorial(filters) // size) for size in range(1, filters + 1)])
    own = F.filter("terms", lambda x: x["t"].bitwiseAND(F.lit(1 << k)) > 0)
    return F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x["n"] * F.element_at(parts, F.bit_count(x["t"])))


def order_steps(names: Sequence[str]) -> list[dict]:
    """Every order of the filters and each of its steps: the filter, and the sets of filters before and after the step."""
    out = []
    for order in permutations(range(len(names))):
        before = 0
        for step, k in enumerate(order):
            out.append({"filter_order": "".join(names[i] for i in order), "step": step + 1, "k": k, "before": before, "after": before | 1 << k})
            before |= 1 << k
    return out


def audit_orders(rows: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    rows: part, fails (bits in the order of names), good and toxic (0 or 1) of each document. Counts are differences of the
    removal polynomial's corners; shapley is the filter's Shapley value times the number of orders, a whole number.
    Parts are rows, and a part's polynomial has at most a term for each set of filters. No rows give no rows.
    """
    n = len(names)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be audited")
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    # the corners of all sets of filters, once for each part
    corners = [_corners(every, c).alias(f"at_{c}") for c in MEASURES]
    parts = removal_polynomials(rows).select("part", "total", *corners, F.array(*[_shapley(k, n) for k in range(n)]).alias("values"))
    steps = F.from_json(F.lit(json.dumps(order_steps(names))), "array<struct<filter_order: string, step: int, k: int, before: int, after: int>>")
    out = parts.select("*", F.explode(steps).alias("s"))
    at = lambda measure, corner: F.col(f"at_{measure}")[corner]
    bit, full = F.expr("shiftleft(1, s.k)"), (1 << n) - 1
    lost = lambda measure: at(measure, F.col("s.after")) - at(measure, F.col("s.before"))
    return out.select(
        "part", "s.filter_order", "s.step",
        (F.col("total") - at("n", F.col("s.after"))).alias("kept"),
        lost("n").alias("removed"),
        (at("n", bit) - lost("n")).alias("redundant"),
        (at("n", F.lit(full)) - at("n", F.lit(full) - bit)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.col("values")[F.col("s.k")].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of document_failures over docs, by source. See there and audit_orders; other columns
    are ignored, labels of unknown documents too."""
    return audit_orders(labelled(document_failures(docs), labels))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
#: Counts every order and step by itself, from the documents' flags.
ORACLES = {
    "op12_filter_audit": r"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
known as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
flags as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, {
    'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(min(doc_id) over (partition by text) < doc_id, false)} as f
  from words left join known using (doc_id)),
counted as (
  select part, f.A as fa, f.B as fb, f.C as fc, f.D as fd, f.E as fe, count(*) as n, sum(good) as good, sum(toxic) as toxic from flags group by all),
masks as (select part, [fa, fb, fc, fd, fe] as f, n, good, toxic from counted),
l as (select unnest(range(1, 6)) as i),
orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o from l a, l b, l c, l d, l e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (select o, l.i as step, o[l.i] as k, o[1:l.i - 1] as before from orders, l),
each as (
  select part, o, step, k, n, good, toxic, f[k] as fails, len(list_filter(before, lambda b: f[b])) > 0 as gone,
    len(list_filter(f, lambda x: x)) = 1 as once from masks, steps),
counts as (
  select part, o, step, k, sum(n) filter (not gone and not fails) as kept, sum(n) filter (not gone and fails) as removed,
    sum(n) filter (gone and fails) as redundant, sum(n) filter (fails and once) as unique_fails,
    sum(good) filter (not gone and fails) as good_lost, sum(toxic) filter (not gone and fails) as toxic_lost
  from each group by all)
select part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') as filter_order, step::int as step,
  coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  sum(coalesce(removed, 0)) over (partition by part, k)::bigint as shapley
from counts"""
}
