"""Table operators over Parquet folders: append, upsert, range and key deletes, all as rewrites of what they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from .relational import latest_by


def append(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """old and new with one row for each key, the first by order."""
    return latest_by(old.unionByName(new, allowMissingColumns=True), keys, *order)


def without_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti")


def replace_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Overwrite only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
