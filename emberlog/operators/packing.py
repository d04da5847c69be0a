"""Order within groups that no task holds whole: running sums, numbering, packing into chunks of a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.storage import written


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: Sequence[str] = ()) -> DataFrame:
    """df with place (from 0 within its group) and before_<name> for each of sums: the sum over the rows before it.

    order is one without ties. Rows are cut into ranges of (group, order), ranges are summed apart, and each range starts
    from the sums of those before it: a hot group is in many tasks, and only a row for each range comes together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = list(by)
    parted = written(df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()), "running")
    per = parted.groupBy(*by, "__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{c}") for c in sums])
    up = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0))
    starts = per.select(*by, "__part", start("__n").alias("__at"), *[start(f"__{c}").alias(f"__at_{c}") for c in sums])
    own = Window.partitionBy(*by, "__part").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    out = parted.join(starts, [*by, "__part"])
    out = out.withColumns({"place": F.col("__at") + F.row_number().over(own) - 1} | {f"before_{c}": F.col(f"__at_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})
    return out.drop("__part", "__at", *[f"__at_{c}" for c in sums])


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with place, from 1, over all rows in an order without ties: no task has all rows."""
    out = running(df.withColumn("__all", F.lit(0)), ["__all"], order)
    return out.withColumn("place", F.col("place") + 1).drop("__all")


def last_before(left: DataFrame, right: DataFrame, by: str, left_id: str, right_id: str, ts: str, seconds: int) -> DataFrame:
    """by, right_id, n, left_id, gap_s of the right rows that have left rows of their group up to seconds before them: how
    many, and the last one (of equal times the largest id). Both: by, id, ts; times count in whole seconds.

    An as-of join without pairs: both sides are sorted together, and left rows are counted up to each right row's time and up
    to seconds before it; the count names the last one's place."""
    at = F.unix_timestamp(ts)
    own = written(running(left.select(by, F.col(left_id).alias("__id"), at.alias("__v")), [by], ["__v", "__id"]), "asof-left")
    ends = right.select(by, F.col(right_id).alias("__id"), at.alias("__v"))
    marks = own.select(by, "__id", "__v", F.lit(0).alias("__side"), F.lit(1).alias("__one"))
    probes = [ends.select(by, "__id", (F.col("__v") - back).alias("__v"), F.lit(side).alias("__side"), F.lit(0).alias("__one")) for side, back in ((1, 0), (2, seconds + 1))]
    met = running(marks.unionByName(probes[0]).unionByName(probes[1]), [by], ["__v", "__side", "__id"], ["__one"]).where("__side > 0")
    both = met.groupBy(by, "__id").agg(F.max(F.when(F.col("__side") == 1, F.struct("before___one", "__v"))).alias("now"), F.max(F.when(F.col("__side") == 2, F.col("before___one"))).alias("old"))
    hit = both.select(by, F.col("__id").alias(right_id), (F.col("now.before___one") - F.col("old")).alias("n"), (F.col("now.before___one") - 1).alias("place"), F.col("now.__v").alias("__at")).where("n > 0")
    out = hit.join(own.select(by, "place", F.col("__id").alias(left_id), "__v"), [by, "place"])
    return out.select(by, right_id, "n", left_id, (F.col("__at") - F.col("__v")).alias("gap_s"))


def pack_by_budget(items: DataFrame, bucket: str, order: Sequence[str], tokens: str, budget: int, max_items: str | None = None) -> DataFrame:
    """items with chunk: the number of its chunk within its bucket, from 1. A chunk takes items in order while their tokens
    fit the budget (and, where max_items names a column of the bucket's largest number of items, it has so many at most); a
    larger item is a chunk of its own. order is one without ties, tokens are not negative.

    With sums of tokens along each bucket, every item's next chunk start, if it were one itself, is the number of items
    that end within its budget: ends and limits are sorted together and counted. From the first item on, the starts are
    followed by doubling: in round t the first 2^t starts jump 2^t ahead. No bucket is held in a task, and rounds grow
    with the logarithm of a bucket's chunks."""
    slim = items.select(bucket, *order, F.col(tokens).cast("long").alias("__t"), *[F.col(c).cast("long").alias("__most") for c in [max_items] if c])
    placed = written(running(slim, [bucket], order, ["__t"]).withColumnRenamed("place", "__k"), "pack-placed")
    ends = placed.select(bucket, (F.col("before___t") + F.col("__t")).alias("__v"), F.lit(0).alias("__probe"), F.lit(1).alias("__item"), "__k")
    limits = placed.select(bucket, (F.col("before___t") + budget).alias("__v"), F.lit(1).alias("__probe"), F.lit(0).alias("__item"), "__k", *[c for c in placed.columns if c == "__most"])
    met = running(ends.unionByName(limits, allowMissingColumns=True), [bucket], ["__v", "__probe", "__k"], ["__item"]).where("__probe = 1")
    furthest = F.greatest(F.col("before___item"), F.col("__k") + 1)
    jump = met.select(bucket, "__k", (F.least(furthest, F.col("__k") + F.greatest("__most", F.lit(1))) if max_items else furthest).alias("__next"))
    size = placed.groupBy(bucket).agg(F.count("*").alias("__size"))
    jump = written(jump.join(size, bucket).where("__next < __size").drop("__size"), "pack-jump")
    starts = written(placed.where("__k = 0").select(bucket, "__k", F.lit(1).cast("long").alias("chunk")), "pack-starts")
    step = 1
    while not jump.isEmpty():
        ahead = starts.join(jump, [bucket, "__k"]).select(bucket, F.col("__next").alias("__k"), (F.col("chunk") + step).alias("chunk"))
        starts = starts.unionByName(written(ahead, "pack-starts"))
        twice = jump.select(bucket, F.col("__next").alias("__k"), F.col("__k").alias("__from")).join(jump, [bucket, "__k"])
        jump, step = written(twice.select(bucket, F.col("__from").alias("__k"), "__next"), "pack-jump"), 2 * step
    flagged = placed.join(starts.select(bucket, "__k", F.lit(1).alias("__first")), [bucket, "__k"], "left").select(bucket, *order, F.coalesce("__first", F.lit(0)).alias("__first"))
    chunks = running(flagged, [bucket], order, ["__first"])
    chunks = chunks.select(bucket, *order, (F.col("before___first") + F.col("__first")).cast("int").alias("chunk"))
    return items.join(chunks, [bucket, *order])


def split_failed(items: DataFrame, chunk: str, order: Sequence[str], tokens: str, budget: int, floor: int = 8_000) -> DataFrame:
    """items of chunks that failed, with part: packed again at half the budget, but not below floor, and with at most half of
    a chunk's items, rounded up, in a part. So a chunk of several items never stays whole: where the budget would let it, it is
    cut in the middle."""
    most = items.groupBy(chunk).agg(F.ceil(F.count("*") / 2).alias("__half"))
    return pack_by_budget(items.join(most, chunk), chunk, order, tokens, max(floor, budget // 2), "__half").withColumnRenamed("chunk", "part").drop("__half")
