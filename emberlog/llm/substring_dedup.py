"""Substring dedup by difference-cover anchors: removes runs of words that repeat across documents."""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, chunks, mix, word_hashes, words_of
from .repeats import SETTLED, joined, rows_out, shared_spans, span_arrays, tagged, union

#: A perfect difference set modulo 31 (fixed values): each residue but 0 is the difference of exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
U = np.uint64


def _sequences(column):
    """For each chunk: its first row, the first word of each document, and two rolling hashes of its words."""
    for row, end, offsets, data in chunks(column):
        starts, ends, first = words_of(offsets, data)
        h = word_hashes(data, starts, ends)
        yield row, end, first, Rolling(h, BASES[0]), Rolling(mix(h ^ U(BASES[1])), BASES[1])


def _anchors(size: int):
    """Rows for every cover position: the hash of the size - PERIOD + 1 words from it, and the segment that passages of
    size words with this anchor can reach. Two equal passages at any offsets share a cover position modulo the period
    among their first PERIOD words, and so an anchor."""
    length, cover = size - PERIOD + 1, np.isin(np.arange(PERIOD), COVER)

    def run(batches):
        for b in batches:
            ids, tags, parts = b.column(0).to_numpy(), b.column(1).to_numpy(), []
            for row, end, first, near, far in _sequences(b.column(2)):
                n = np.diff(first)
                doc = np.repeat(np.arange(end - row), n)
                pos = np.arange(first[-1]) - first[:-1][doc]
                at = np.flatnonzero(cover[pos % PERIOD] & (pos + length <= n[doc]) & (n[doc] >= size))
                if not len(at):
                    continue
                d, p = doc[at], pos[at]
                lo, hi = np.maximum(p - PERIOD + 1, 0), np.minimum(p + size, n[d])
                seg = far.of(at - (p - lo), at + (hi - p)) ^ mix(((p - lo) * 4096 + hi - p).astype(U))
                parts.append((near.of(at, at + length), seg, ids[row + d], tags[row + d], lo, hi))
                if sum(len(x[0]) for x in parts) > SETTLED:
                    yield from rows_out(*joined(parts))
            if parts:
                yield from rows_out(*joined(parts))

    return run


def _passages(size: int):
    """Rows for every passage of size words inside a document's spans, with 128 bits of hash as anchor and seg."""

    def run(batches):
        for b in batches:
            ids, tags, spans, parts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3), []
            for row, end, first, near, far in _sequences(b.column(2)):
                for k in range(row, end):
                    begin, n = int(first[k - row]), int(first[k - row + 1] - first[k - row])
                    lo, hi = span_arrays(spans, k)
                    lo, hi = lo[hi - lo >= size], hi[hi - lo >= size]
                    starts = np.zeros(n + 1, np.int64)
                    np.add.at(starts, lo, 1)
                    np.add.at(starts, hi - size + 1, -1)
                    p = np.flatnonzero(np.cumsum(starts)[:n])
                    at = begin + p
                    parts.append((near.of(at, at + size), far.of(at, at + size), np.full(len(p), ids[k]), np.full(len(p), tags[k]), p, p + size))
                if sum(len(x[0]) for x in parts) > SETTLED:
                    yield from rows_out(*joined(parts))
            if parts:
                yield from rows_out(*joined(parts))

    return run


def _cut(batches):
    import pyarrow as pa

    for b in batches:
        n_words, n_removed, kept = [], [], []
        for k in range(b.num_rows):
            words = (b.column(1)[k].as_py() or "").encode().split()
            lo, hi = union(*span_arrays(b.column(2), k), len(words))
            n_words.append(len(words))
            n_removed.append(int((hi - lo).sum()))
            if len(lo):
                stay = np.ones(len(words), bool)
                for i, j in zip(lo.tolist(), hi.tolist()):
                    stay[i:j] = False
                words = compress(words, stay.tolist())
            kept.append(b" ".join(words).decode())
        yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row of docs.

    Words are runs of other characters than white space (space, tab to carriage return). A word goes if it is in a run
    of size consecutive words of its document that also starts in a document with a smaller doc_id, in the input. Null
    and empty texts have no words. Rows with a null doc_id have no order: they stay whole and remove nothing. Rows that
    repeat a doc_id are documents of their own, none of them smaller than the other. Other columns are ignored. size is
    at least PERIOD; shorter documents than size stay whole.
    """
    if size < PERIOD:
        raise ValueError(f"size must be at least {PERIOD}")
    docs = tagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = shared_spans(docs, _anchors(size), _passages(size), "substring")
    return docs.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
