"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, chunks, word_hashes, words_of

U = np.uint64
#: Word features, and after them features of symbol runs, of capitals and of words that repeat the one before.
WORDS, SYMBOLS = 1 << 18, 1 << 8
SIZE = WORDS + SYMBOLS + 2
_bytes = np.arange(256)
_digit, _upper, _lower = (_bytes >= 48) & (_bytes < 58), (_bytes >= 65) & (_bytes < 91), (_bytes >= 97) & (_bytes < 123)
_ALNUM = _digit | _upper | _lower | (_bytes >= 128)
_SPACE = np.isin(_bytes, [9, 10, 11, 12, 13, 32])
_NOT_SYMBOL = _ALNUM | _SPACE


def features(column):
    """For each chunk of texts: first and end row, and (document, index, value) of its features in document order.

    A word that occurs has value 1 (words are runs of letters and digits, A-Z lower-cased). Every kind of symbol run,
    capital letters and repeats of the word before have their share of the words, times 8.
    """
    for row, end, offsets, data in chunks(column):
        rows = end - row
        low = LOWER[data]
        starts, ends, first = words_of(offsets, data, ~_ALNUM)
        n = np.diff(first)
        doc = np.repeat(np.arange(rows), n)
        h = word_hashes(low, starts, ends)
        seen = np.unique(doc * SIZE + (h & U(WORDS - 1)).astype(np.int64))
        again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=rows)
        s2, e2, f2 = words_of(offsets, data, _NOT_SYMBOL)
        doc2 = np.repeat(np.arange(rows), np.diff(f2))
        kinds, count = np.unique(doc2 * SIZE + WORDS + (word_hashes(data, s2, e2, 1) & U(SYMBOLS - 1)).astype(np.int64), return_counts=True)
        total = np.concatenate([[0], np.cumsum(_upper[data[: int(offsets[-1])]])])
        capitals = total[offsets[1:]] - total[offsets[:-1]]
        each = np.arange(rows) * SIZE + WORDS + SYMBOLS
        key = np.concatenate([seen, kinds, each, each + 1])
        per = 8.0 / np.maximum(n, 1)
        value = np.concatenate([np.ones(len(seen)), count * per[kinds // SIZE], capitals * per / 4, again * per])
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        keep = value > 0
        yield row, end, key[keep] // SIZE, key[keep] % SIZE, np.minimum(value[keep], 16.0)


@dataclass(frozen=True)
class OrdinalModel:
    """weights: of all features; thresholds: ascending. P(grade > k) = sigmoid(score - thresholds[k])."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """Columns P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit_ordinal(doc: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, l2: float = 10.0, least_seen: int = 5, steps: int = 120, rate: float = 0.1) -> OrdinalModel:
    """Maximum penalised likelihood of the proportional-odds model, by full-batch adaptive moment steps.

    Thresholds stay ordered as a first one and positive gaps. Deterministic: it starts at zero weights and at the
    thresholds of the grades' shares. Features of fewer documents than least_seen stay at 0. A grade that never occurs has a threshold next to its neighbour's.
    """
    often = np.bincount(index, minlength=SIZE)[index] >= least_seen
    doc, index, value = doc[often], index[often], value[often]
    used, local = np.unique(index, return_inverse=True)
    n = len(grade)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    base = np.maximum.accumulate(np.log(share / (1 - share)) + 0.01 * np.arange(grades - 1))
    gaps = np.maximum(np.diff(base), 0.01)
    x = np.concatenate([np.zeros(len(used)), [base[0]], np.log(gaps)])
    m, v = np.zeros_like(x), np.zeros_like(x)
    k = len(used)
    for step in range(1, steps + 1):
        cut = x[k] + np.concatenate([[0.0], np.cumsum(np.exp(x[k + 1 :]))])
        z = np.bincount(doc, weights=value * x[:k][local], minlength=n)
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = (1 / (1 + np.exp(-np.clip(edge[grade + i] - z, -60, 60))) for i in (1, 0))
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p  # of the log likelihood by the upper and the lower threshold
        g_cut = -np.bincount(grade, weights=dhi, minlength=grades)[:-1] + np.bincount(grade, weights=dlo, minlength=grades)[1:]
        g_gap = np.exp(x[k + 1 :]) * np.cumsum(g_cut[::-1])[::-1][1:]
        g = np.concatenate([np.bincount(local, weights=value * (dhi - dlo)[doc], minlength=k) + l2 * x[:k], [g_cut.sum()], g_gap])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
    weights = np.zeros(SIZE)
    weights[used] = x[:k]
    return OrdinalModel(weights, x[k] + np.concatenate([[0.0], np.cumsum(np.exp(x[k + 1 :]))]))


def graded_sample(docs: DataFrame, ratings: DataFrame, bound: int, seed: int = 5) -> DataFrame:
    """doc_id, text, grade of about bound rated documents at most, picked by a hash of the doc_id; ratings: doc_id, grade."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    if n > bound:
        rated = rated.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    return docs.select("doc_id", "text").join(rated, "doc_id").select("doc_id", "text", "grade")


def _collected(batches):
    import pyarrow as pa

    for b in batches:
        grade, keys = b.column(1).to_numpy(), b.column(2)
        for row, end, doc, index, value in features(b.column(0)):
            cuts = np.searchsorted(doc, np.arange(end - row + 1)).astype(np.int32)
            yield pa.record_batch([keys.slice(row, end - row), pa.array(grade[row:end].astype(np.int32)), pa.ListArray.from_arrays(cuts, index.astype(np.int32)), pa.ListArray.from_arrays(cuts, value.astype(np.float32))], names=["key", "grade", "index", "value"])


def fit_quality(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample_bound: int = 8_000, l2: float = 10.0) -> OrdinalModel:
    """The model from ratings (doc_id, grade from 0 to grades - 1). It is fitted on the driver on a sample of about
    sample_bound rated documents at most, whatever the size of the corpus. Without any rating all weights are 0 and
    every grade is as likely."""
    sample = graded_sample(docs, ratings.where(F.col("grade").between(0, grades - 1)), sample_bound)
    sample = sample.select("text", "grade", F.xxhash64("doc_id", "text", "grade").alias("key"))
    rows = sample.mapInArrow(_collected, "key long, grade int, index array<int>, value array<float>").toArrow()
    # the rows' order differs from run to run: a fixed order makes sums, and so the model, repeatable
    rows = rows.sort_by("key").combine_chunks()
    if not rows.num_rows:
        share = np.arange(1, grades) / grades
        return OrdinalModel(np.zeros(SIZE), np.log(share / (1 - share)))
    import pyarrow.compute as pc

    lists = rows.column("index").combine_chunks()
    doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    index = pc.list_flatten(lists).to_numpy().astype(np.int64)
    value = pc.list_flatten(rows.column("value").combine_chunks()).to_numpy().astype(np.float64)
    grade = rows.column("grade").to_numpy().astype(np.int64)
    return fit_ordinal(doc, index, value, grade, grades, l2)


def score_quality(docs: DataFrame, model: OrdinalModel, grade_col: str = "expected_grade", tails_col: str = "tails") -> DataFrame:
    """docs with two more columns: the expected grade, and tails (array: P(grade >= 1), P(grade >= 2), ...); a null text
    is scored as empty. Columns of these names in docs are replaced: give others to keep them."""
    docs = docs.drop(grade_col, tails_col)
    spark, fields = docs.sparkSession, docs.schema
    weights, thresholds = spark.sparkContext.broadcast(model.weights.astype(np.float32)), model.thresholds

    def run(batches):
        import pyarrow as pa

        scorer = OrdinalModel(weights.value, thresholds)
        for b in batches:
            z = np.zeros(b.num_rows)
            for row, end, doc, index, value in features(b.column(b.schema.get_field_index("text"))):
                z[row:end] = np.bincount(doc, weights=value * scorer.weights[index], minlength=end - row)
            tails = scorer.tails(np.round(z, 9))
            cuts = np.arange(b.num_rows + 1, dtype=np.int32) * tails.shape[1]
            extra = [pa.array(tails.sum(1)), pa.ListArray.from_arrays(cuts, tails.ravel())]
            yield pa.record_batch([*b.columns, *extra], names=[*b.schema.names, grade_col, tails_col])

    schema = T.StructType([*fields, T.StructField(grade_col, T.DoubleType()), T.StructField(tails_col, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


#: A document is kept if it is of the best grade with this probability at least.
KEEP_TAIL = 0.7


def quality_grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from two verdicts: 2 for good and not toxic, 1 for one fault, 0 for both."""
    return labels.select("doc_id", (F.col("quality") + F.lit(1) - F.col("toxic")).cast("int").alias("grade"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, quality_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    tails = F.col("tails")
    out = score_quality(docs, model).select("doc_id", "expected_grade", tails[0].alias("p_grade_1"), tails[1].alias("p_grade_2"))
    return out.withColumn("kept", F.col("p_grade_2") >= KEEP_TAIL)


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
