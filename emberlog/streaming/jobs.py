"""Streaming forms of the aggregates: the same columns as their batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need times with a zone: those without one are taken in the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def hourly_counts(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Tumbling hours with a watermark: counts and first id of each key; state goes as the watermark passes."""
    return _timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), *keys).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select(F.col("w.start").alias("hour"), *keys, "n", "first_id")


def deduplicated(events: DataFrame, key: str, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each key once, as long as its copies are within the watermark."""
    return _timed(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def latest_state(ledger: DataFrame, key: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """The last entry of each key: a ledger folded to its current state, in update or complete mode. With late, the state
    of a key's day goes as the watermark passes its end, so that only live days are held; without, all keys are held."""
    last = F.max_by("event_type", F.struct(ts, "event_id")).alias("state"), F.count("*").alias("entries")
    if late is None:
        return ledger.groupBy(key).agg(*last)
    days = _timed(ledger, ts).withWatermark(ts, late).groupBy(key, F.window(ts, "1 day").alias("w"))
    return days.agg(*last).select(key, F.col("w.start").alias("day"), "state", "entries")


def running_items(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Evidence items by their key and day, as events come: counts, times, the earliest example, how many traces about."""
    first = F.struct(ts, "event_id")
    days = _timed(events, ts).withWatermark(ts, late).groupBy(*keys, F.window(ts, "1 day").alias("w"))
    out = days.agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.min_by("message", first).alias("example"), F.approx_count_distinct("trace_id").alias("traces"))
    return out.select(*keys, F.col("w.start").alias("day"), "n", "first_seen", "last_seen", "example", "traces")


def items_with_traces(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Evidence items by their key and day with the exact number of traces, in append mode: a day's items come once its end is
    behind the watermark. Rows of a trace are summed first, then an item's traces: both steps hold live days only."""
    w = F.window(ts, "1 day")
    traces = _timed(events, ts).withWatermark(ts, late).groupBy(*keys, "trace_id", w.alias("w"))
    per = traces.agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.min_by("message", F.struct(ts, "event_id")).alias("example"), F.min(F.struct(ts, "event_id")).alias("first"))
    days = per.groupBy(*keys, F.window("w", "1 day").alias("w"))
    out = days.agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("example", "first").alias("example"), F.count("trace_id").alias("traces"))
    return out.select(*keys, F.col("w.start").alias("day"), "n", "first_seen", "last_seen", "example", "traces")


def run_states(entries: DataFrame, overrides: tuple[str, ...] = ("reopened",), terminal: tuple[str, ...] = ("ok", "failed", "cancelled")) -> DataFrame:
    """run_id, state, changes, at: the state of each run as its entries (run_id, status, at) come, in update mode. A terminal
    state stays whatever comes after it, until an entry that overrides; entries count in the order of at, those older than
    the last one do not. A run's state is three values."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        import pandas as pd

        now, changes, at = state.get if state.exists else ("", 0, -1)
        rows = sorted(r for f in frames for r in zip(f["at"].tolist(), f["status"].tolist()))
        for t, status in rows:
            if t < at:
                continue
            at = t
            if status != now and (now not in terminal or status in overrides):
                now, changes = status, changes + 1
        state.update((now, changes, at))
        yield pd.DataFrame({"run_id": [key[0]], "state": [now], "changes": [changes], "at": [at]})

    out = "run_id string, state string, changes long, at long"
    return entries.select("run_id", "status", F.col("at").cast("long")).groupBy("run_id").applyInPandasWithState(step, out, "state string, changes long, at long", "update", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a rerun goes on from the checkpoint."""
    df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
