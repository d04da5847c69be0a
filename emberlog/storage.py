"""Intermediate tables of an application, in a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; below the warehouse where that is unset and the master is a
    local one, as in tests. On a cluster the setting must be there."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return f"{top.rstrip('/')}/emberlog/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that was written once: what reads it sees the same rows each time, and an executor lost later costs a
    read only."""
    path = f"{shared_folder(df.sparkSession)}/work/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that read them must be written before."""
    delete(spark, f"{shared_folder(spark)}/work")
