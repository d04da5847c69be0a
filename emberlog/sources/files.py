"""Files of lines: listed first, so that files out of the window are never opened; lines with their number and file's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lines as L

FIELDS = "path string, modified timestamp, block long, at long, line string"


def listed(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, modified of every file under path, recursively: no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def chosen(files: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Files that hold lines, without those that the dates in their paths put outside [start, end]."""
    out = L.wanted_files(files)
    return L.prune_by_path_date(out, start, end) if start and end else out


def _placed(batches):
    """The place of each line within its block of its file: a task reads a block's lines in their order."""
    import pyarrow as pa

    now, at = None, 0
    for b in batches:
        places = []
        for key in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            now, at = (key, 0) if key != now else (now, at + 1)
            places.append(at)
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(places, pa.int64()), b.column(3)], names=["path", "modified", "block", "at", "line"])


def read_files(files: DataFrame) -> DataFrame:
    """path, modified, line_no (from 1), line of every line that is not blank of the files (path, length), which alone are
    opened, in the order of their paths.

    A large file is read in blocks by several tasks; the lines of its blocks are counted, and a block's numbers go on where
    those before it end. Files that are one block for sure are not read for that. Bytes that are no UTF-8 become
    replacement characters. The driver gets the files' names, as it does whenever Spark lists a folder."""
    spark = files.sparkSession
    known = sorted((r.path, r.length) for r in files.select("path", "length").collect())
    if not known:
        return spark.createDataFrame([], "path string, modified timestamp, line_no long, line string")

    def placed(paths: list[str]) -> DataFrame:
        meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "path"), ("file_modification_time", "modified"), ("file_block_start", "block"))]
        return spark.read.text(paths).select(*meta, F.col("value").alias("line")).mapInArrow(_placed, FIELDS)

    size = lambda c: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(c).removesuffix("b"))
    whole = min(size("spark.sql.files.maxPartitionBytes"), size("spark.sql.files.openCostInBytes"))
    rows, large = placed([p for p, _ in known]), [p for p, n in known if n > whole]
    if large:
        counts = placed(large).groupBy("path", "block").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.join(counts.select("path", "block", before.alias("before")), ["path", "block"], "left")
    else:
        rows = rows.withColumn("before", F.lit(0))
    return rows.where("trim(line) <> ''").select("path", "modified", (F.coalesce("before", F.lit(0)) + F.col("at") + 1).alias("line_no"), "line")
