"""The corpus pipeline: from raw documents to a mix of sources, in five stages written one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import saved
from emberlog.llm.decontaminate import decontaminate
from emberlog.llm.mixing import mix_sources
from emberlog.llm.quality import KEEP_TAIL, fit_quality, quality_grades, score_quality
from emberlog.llm.simhash import drop_near_duplicates
from emberlog.llm.suffix_dedup import drop_repeats
from emberlog.session import attach


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are of the best grade with enough probability. The classifier learns from labels of docs."""
    attach(spark)
    model = fit_quality(docs, quality_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score_quality(docs, model, "__grade", "__tails")
    return scored.where(F.col("__tails")[1] >= KEEP_TAIL).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    attach(spark)
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that documents with smaller ids hold; n_chars follows the text."""
    attach(spark)
    out = drop_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with other numbers and names neither, nor with some mentions of a name changed."""
    attach(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mixed_names=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's share of the mix of sources."""
    attach(spark)
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]
#: SQL cannot express the classifier; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id, source, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{k + 1}")
    return docs
