"""Relational operators: windows in time, latest versions, patterns, metrics, relations, packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import pack_by_budget  # noqa: F401 - with the other relational operators


def in_window(df: DataFrame, start: str, end: str, ts: str = "ts", closed: bool = False) -> DataFrame:
    """Rows of [start, end), or of [start, end] where closed."""
    upper = F.col(ts) <= F.lit(end).cast("timestamp") if closed else F.col(ts) < F.lit(end).cast("timestamp")
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & upper)


def latest_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first by order: latest versions, upserts, representatives. Ranks are cut before the
    shuffle, so a hot key sends a row of each task."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def patterns(logs: DataFrame) -> DataFrame:
    """One row for each template and error type: counts, times, severity, an example."""
    return logs.groupBy("template", "error_type").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("severity_rank").alias("top_rank"), F.min("log_id").alias("example_id")
    )


def with_baseline(current: DataFrame, baseline: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """current with baseline_n of the same keys; 0 where there is none."""
    base = baseline.groupBy(*keys).agg(F.count("*").alias("baseline_n"))
    return current.join(base, list(keys), "left").withColumn("baseline_n", F.coalesce("baseline_n", F.lit(0)))


def dominant(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key; of equals the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return latest_by(counts, keys, F.desc("n"), F.asc(value))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Pairs whose right time is 0 to seconds after the left one. Both sides meet in buckets of that length, of which a
    right row visits its own and the one before, so no pair of rows further apart is made."""
    bucket = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    a = left.withColumn("__b", bucket(left_ts))
    b = right.withColumn("__b", F.explode(F.array(bucket(right_ts), bucket(right_ts) - 1)))
    gap = F.unix_timestamp(right_ts) - F.unix_timestamp(left_ts)
    return a.join(b, [*keys, "__b"]).where(gap.between(0, seconds)).withColumn("gap_s", gap).drop("__b")


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, seconds: int) -> DataFrame:
    """Pairs of a row of left and a row of right whose spans [start, end] have a moment in common, each once. Both sides meet in
    all buckets of that length that their spans touch; a pair is of the first that both touch, that of the later start. start
    and end are left's columns; right has the same ones with r_ before their names."""
    bucket = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    touched = lambda s, e: F.explode(F.sequence(bucket(s), bucket(e)))
    a = left.withColumn("__b", touched(start, end))
    b = right.withColumn("__b", touched(f"r_{start}", f"r_{end}"))
    later, sooner = F.greatest(start, f"r_{start}"), F.least(end, f"r_{end}")
    return a.join(b, "__b").where((later <= sooner) & (F.col("__b") == bucket(later))).drop("__b")


def overlap_pairs(items: DataFrame, item: str, member: str) -> DataFrame:
    """Pairs of items with common members: shared, and its share of either's members."""
    m = items.select(item, member).distinct()
    size = m.groupBy(item).agg(F.count("*").alias("size"))
    a, b = (m.select(F.col(item).alias(x), member) for x in ("a", "b"))
    pairs = a.join(b, member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    for x in "ab":
        pairs = pairs.join(size.select(F.col(item).alias(x), F.col("size").alias(f"size_{x}")), x)
    return pairs.select("a", "b", "shared", (F.col("shared") / F.col("size_a")).alias("coverage_a"), (F.col("shared") / F.col("size_b")).alias("coverage_b"))
