"""An append-only ledger of reviewers' outputs as a folder of batches: written exactly once, compacted, looked up again."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.storage import delete

SCHEMA_VERSION = "execution-contract/v1"


def _entries(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the whole batches and compactions in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "upto": []}
    for e in fs.listStatus(at) if fs.exists(at) else []:
        m = re.fullmatch(r"(batch|upto)=(\d+)", e.getPath().getName())
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(e.getPath(), "_SUCCESS")):
            found[m[1]].append(int(m[2]))
    return found


def append(records: DataFrame, batch: int, path: str) -> None:
    """Write a batch. A batch that is replayed takes its own place, so it is there once however often it is written; one that
    a compaction holds already is left alone."""
    if batch > max(_entries(records.sparkSession, path)["upto"], default=-1):
        records.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def sink(path: str):
    """For writeStream.foreachBatch."""
    return lambda records, batch: append(records, batch, path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """All records: of the last compaction and of the batches after it."""
    found = _entries(spark, path)
    last = max(found["upto"], default=-1)
    parts = [f"{path}/upto={last}"] * (last >= 0) + [f"{path}/batch={n}" for n in sorted(found["batch"]) if n > last]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema, files: int = 1) -> None:
    """Write all whole batches as one, then delete what it replaces. If it breaks off, readers go on with the old ones."""
    found = _entries(spark, path)
    last = max(found["batch"], default=-1)
    if last <= max(found["upto"], default=-1):
        return
    read(spark, path, schema).repartition(files).write.mode("overwrite").parquet(f"{path}/upto={last}")
    for kind in found:
        for n in found[kind]:
            if kind == "upto" or n <= last:
                delete(spark, f"{path}/{kind}={n}")


def reusable(records: DataFrame, contracts: DataFrame, reuse_failed: bool = False, version: str = SCHEMA_VERSION) -> DataFrame:
    """contracts (provider, contract, a fingerprint of the input) with record_id and reused: success, failed or none.

    A success is a record of the same provider, contract and version with status ok, a valid schema and a payload; the
    latest one counts. Where failed outputs may be used, a contract without a success gets its latest record with a status
    and a payload. records: record_id, provider, contract, version, status, schema_valid, payload, at."""
    r = records.where((F.col("version") == version) & (F.coalesce("payload", F.lit("")) != "") & (F.coalesce("status", F.lit("")) != ""))
    good = (F.col("status") == "ok") & F.coalesce("schema_valid", F.lit(False))
    r = r.withColumn("good", good)
    r = r if reuse_failed else r.where("good")
    first = F.row_number().over(Window.partitionBy("provider", "contract").orderBy(F.desc("good"), F.desc("at"), F.desc("record_id")))
    r = r.withColumn("__n", first).where("__n = 1").select("provider", "contract", "record_id", "good")
    out = contracts.join(r, ["provider", "contract"], "left")
    return out.withColumn("reused", F.when(F.col("good"), "success").when(F.col("record_id").isNotNull(), "failed").otherwise("none")).drop("good")
