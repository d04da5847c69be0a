"""Mixing sources to target weights: hash-random keys, range sort within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Ranges of a block; a source's blocks are a row for each million of documents.
BLOCK = 1_000
WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """df with before_<name> and total_<name> for each column of sums: the sum over the rows before in this order, which
    must be one without ties, and over all rows. Ranges of the order are summed apart: no task has all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = saved(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "mix-order")
    parts = parted.groupBy("__part").agg(*[F.sum(c).alias(f"part_{c}") for c in sums])  # a row for each partition
    up = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("__part", *[F.coalesce(F.sum(f"part_{c}").over(up), F.lit(0)).alias(f"start_{c}") for c in sums], *[F.sum(f"part_{c}").over(Window.partitionBy()).alias(f"total_{c}") for c in sums])
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parted.join(F.broadcast(starts), "__part")
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"start_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)))
    return out.drop("__part", *[f"start_{c}" for c in sums])


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """One row per source (known, source, source_size, target) from (known, source, size).

    Sources by code point, nulls last, weigh weights in turn and share the sum of all sizes. No target exceeds
    max_epochs times its source: with the sources in the order of cap per weight, those before the level where the rest
    fits are at their cap, the others share what is left by weight. Sums along these orders are distributed.
    """
    per = sizes.groupBy("known", "source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one"))
    name = F.desc("known"), F.col("source").cast("binary")
    per = running(per, name, ["one"]).drop("total_one")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", share).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    per = running(per, [F.col("cap") / F.col("weight"), *name], ["source_size", "cap", "weight"])
    level = (F.col("total_source_size") - F.col("before_cap")) / (F.col("total_weight") - F.col("before_weight"))
    per = per.withColumn("level", level)
    # the level is constant from the first source that is below its cap on; sources before it are at their cap
    first = per.where(F.col("level") * F.col("weight") < F.col("cap")).agg(F.min_by("level", F.struct(F.col("cap") / F.col("weight"), ~F.col("known"), F.col("source").cast("binary"))).alias("open_level"))
    per = per.crossJoin(F.broadcast(first))  # one row
    return per.select("known", "source", "source_size", F.least("cap", F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 11, rows_per_range: int = 1_000) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted).

    Each document gets a key at random from its identity. Every source is cut into ranges of keys in proportion to its
    rows, ranges are summed, prefix sums over the range totals give each range its start, and a running sum within
    each range gives each document its place. A source takes whole epochs as often as they fit in its target and then
    the documents from the start of its order up to the exact rest; the document at the cut gives part of its words.
    A hot source only has more ranges. Null texts have size 0, a null source is a source of its own (the last one),
    repeated rows count each. An empty table gives no rows. Other columns are ignored.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("source"), size.alias("size"), key.alias("key"))
    slim = saved(slim, "mix-sizes")
    counts = slim.groupBy("known", "source").agg(F.count("*").alias("rows"))
    ranges = counts.select("known", "source", F.ceil(F.col("rows") / rows_per_range).cast("long").alias("ranges"))
    targets = source_targets(slim, weights, max_epochs).join(ranges, ["known", "source"])
    # the key as a fraction of all keys picks the range: ranges are in key order and hold equal shares of it
    part = F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("ranges"))
    placed = slim.join(F.broadcast(targets) if _few(targets) else targets, ["known", "source"]).withColumn("range", F.least(part, F.col("ranges") - 1))
    totals = placed.groupBy("known", "source", "range").agg(F.sum("size").alias("total"))
    # prefix sums of ranges in two steps, first within blocks of ranges: a large source's ranges are in many tasks
    totals = totals.withColumn("block", F.floor(F.col("range") / BLOCK))
    blocks = totals.groupBy("known", "source", "block").agg(F.sum("total").alias("all"))
    before = F.sum("all").over(Window.partitionBy("known", "source").orderBy("block")) - F.col("all")
    within = F.sum("total").over(Window.partitionBy("known", "source", "block").orderBy("range")) - F.col("total")
    starts = totals.withColumn("within", within).join(blocks.select("known", "source", "block", before.alias("before")), ["known", "source", "block"])
    starts = starts.select("known", "source", "range", (F.col("before") + F.col("within")).alias("range_start"))
    placed = placed.join(starts, ["known", "source", "range"])
    run = Window.partitionBy("known", "source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("range_start") + F.sum("size").over(run) - F.col("size")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.greatest(rest - start, F.lit(0)), F.col("size"))
    return placed.select("doc_id", F.when(F.col("known"), F.col("source")).alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


#: Sources are names; their table is broadcast up to this many rows, and joined by shuffle beyond it.
FEW_SOURCES = 10_000


def _few(targets: DataFrame) -> bool:
    return targets.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_source_mixing": op10_source_mixing}
