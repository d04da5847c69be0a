"""Katz backoff scoring: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

Texts are kept as chunks of some megabytes. What a chunk needs of the model, the counts of its different n-grams and
the weights of some contexts, it asks of tables that are partitioned by n-gram hash: each hash bucket gathers the
chunks' lists, adds the training counts up and answers every chunk. So the model is never held in one place, and a
very frequent n-gram is one entry of each chunk, not a row of each token.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, mix, release, saved, word_hashes, words_of

U = np.uint64
#: Bytes of text in a chunk, and n-grams that a bucket gathers from chunks, about.
CHUNK_BYTES, BUCKET_GRAMS = 4 << 20, 2_000_000
#: Rounds in which chunks meet their answers.
ROUNDS = 3
START, END = U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47)
#: Counts up to this one are discounted by Good-Turing.
TRUSTED = 5


def pack(values: np.ndarray) -> bytes:
    """The values byte plane by byte plane, compressed: high bytes are mostly zero."""
    import pyarrow as pa

    raw = np.ascontiguousarray(values)
    raw = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes() if len(raw) else b""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, kind=np.int64) -> np.ndarray:
    import pyarrow as pa

    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, U), dtype=U)


def held_out(doc_id) -> bool:
    """Whether a document takes no part in training."""
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


# ---- chunks

CHUNKS = "chunk long, ids array<long>, held array<boolean>, cuts binary, body binary"


def _chunked(batches):
    import pyarrow as pa
    from pyspark import TaskContext

    part, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def row():
        body = b"".join(texts)
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary())
        values = ((part << 32) + k, ids, [held_out(i) for i in ids], pack(cuts), pack(np.frombuffer(body, np.uint8)))
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], names=["chunk", "ids", "held", "cuts", "body"])

    for b in batches:
        at, data = buffers(b.column(1))
        for i, doc in enumerate(b.column(0).to_pylist()):
            texts.append(data[at[i] : at[i + 1]].tobytes() if b.column(1)[i].is_valid else b"")
            ids.append(doc)
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield row()
                k, ids, texts, size = k + 1, [], [], 0
    if ids:
        yield row()


class Grams:
    """The n-grams of one chunk: for each order the different hashes (sorted), the place of each position's hash among
    them, one position of each, how often each occurs in training documents, and whether in a held-out one. only: the
    single order for which they are wanted."""

    def __init__(self, row: dict, order: int, only: int | None = None):
        cuts, body = unpack(row["cuts"]), unpack(row["body"], np.uint8)
        data = LOWER[np.concatenate([body, np.zeros(64, np.uint8)])]
        starts, ends, first = words_of(cuts, data)
        docs, n = len(cuts) - 1, np.diff(first)
        self.begin = first[:-1] + 2 * np.arange(docs)
        self.doc = np.repeat(np.arange(docs), n + 2)
        h = np.empty(len(starts) + 2 * docs, U)
        h[np.arange(len(starts)) + 2 * np.repeat(np.arange(docs), n) + 1] = word_hashes(data, starts, ends)
        h[self.begin], h[self.begin + n + 1] = START, END
        self.place = np.arange(len(h)) - self.begin[self.doc]
        self.n_tokens = n + 1
        train = ~np.asarray(row["held"], bool)[self.doc]
        self.hashes, self.index, self.sample, self.trained, self.tested = [], [], [], [], []
        own = h
        for o in range(1, order + 1):
            if o > 1:
                own = np.concatenate([np.zeros(1, U), mix(own[:-1] * U(0xC2B2AE3D27D4EB4F) + h[1:] * U(0x9E3779B97F4A7C15) + U(o))])
            if only not in (None, o):
                continue
            at = np.flatnonzero(self.place >= o - 1)
            u, rep, inverse = np.unique(own[at], return_index=True, return_inverse=True)
            index = np.full(len(h), -1)
            index[at] = inverse
            self.hashes.append(u)
            self.index.append(index)
            self.sample.append(at[rep])
            self.trained.append(np.bincount(inverse[train[at]], minlength=len(u)))
            tested = np.zeros(len(u), bool)
            tested[inverse[~train[at]]] = True
            self.tested.append(tested)


def bucket_cuts(hashes: np.ndarray, buckets: int):
    """(bucket, from, to) of the sorted hashes of each bucket that has any."""
    b = ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    edge = np.flatnonzero(np.diff(b, prepend=-1))
    return zip(b[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(b)])


ASKED = "order int, bucket long, chunk long, hashes binary, trained binary, tested binary"


def _ask(order: int, buckets: int):
    """What each chunk has of n-grams of this order, in a row for each bucket."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                grams = Grams(row, order, order)
                h, t, tested = grams.hashes[0], grams.trained[0], grams.tested[0]
                out = [(order, k, row["chunk"], pack_sorted(h[i:j]), pack(t[i:j]), pack(tested[i:j])) for k, i, j in bucket_cuts(h, buckets)]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in ASKED.split(", ")])

    return run


#: answers: chunk, counts, marks (OWN: the chunk that a trained n-gram's share of the weights comes from; OPEN: the
#: n-gram occurs in a held-out document somewhere, so that its weight as a context may be needed: texts of training
#: never back off). chunk null: the bucket's numbers of n-grams by count (1 to TRUSTED + 1), of all n-grams and of all
#: tokens.
COUNTED = "order int, bucket long, chunk long, counts binary, marks binary"
OWN, OPEN = 1, 2


def _counted(key, table):
    import pyarrow as pa

    rows = table.to_pylist()
    lists, trained = [unpack_sorted(r["hashes"]) for r in rows], [unpack(r["trained"]) for r in rows]
    u, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    each = np.concatenate(trained)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, inverse, each)
    seen = np.flatnonzero(each > 0)
    open_ = np.zeros(len(u), bool)
    open_[inverse[np.concatenate([unpack(r["tested"], bool) for r in rows])]] = True
    marks = np.where(open_, OPEN, 0).astype(np.uint8)[inverse]
    marks[seen[np.unique(inverse[seen], return_index=True)[1]]] |= OWN
    ends = np.cumsum([len(x) for x in lists])
    out = [(r["chunk"], pack(total[inverse[e - len(x) : e]]), pack(marks[e - len(x) : e])) for r, x, e in zip(rows, lists, ends)]
    real = total[(total > 0) & (u != START)] if key[0].as_py() == 1 else total[total > 0]
    sums = [int((real == c).sum()) for c in range(1, TRUSTED + 2)] + [len(real), int(real.sum())]
    out.append((None, pack(np.array(sums)), b""))
    head = [pa.array([key[i].as_py()] * len(out), t) for i, t in ((0, pa.int32()), (1, pa.int64()))]
    return pa.table([*head, *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary())))], names=["order", "bucket", "chunk", "counts", "marks"])


def _power(n: list[int]) -> float:
    """The slope of a line through log r and log n[r - 1], as in simple Good-Turing: a number is first spread over the
    zeros on both sides of it. 0 if fewer than two numbers are positive."""
    at = [r for r, x in enumerate(n, 1) if x]
    if len(at) < 2:
        return 0.0
    spread = [2 * n[r - 1] / (after - before) for before, r, after in zip([0, *at], at, [*at[1:], 2 * at[-1] - at[-2]])]
    return float(np.polyfit(np.log(at), np.log(spread), 1)[0])


@dataclass(frozen=True)
class Discounts:
    """What remains of a count: ratio[c] of a count c up to TRUSTED, c - less of a larger one."""

    ratio: tuple[float, ...]
    less: float

    @staticmethod
    def of(n: list[int]) -> Discounts:
        """From n[r - 1] = the number of n-grams that occur r times, r from 1 to TRUSTED + 1, by Good-Turing as Katz
        has it. Where that gives a ratio outside 0 to 1 (groups of copies raise single numbers), the numbers are
        smoothed first by a log-linear fit. Only where that falls no faster than 1 / r, or there is nothing to fit
        (a few words), each count loses the same amount. So do counts over TRUSTED, which leaves every context some
        mass."""
        less = min(max(n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5, 0.05), 0.95)
        k, ratio = TRUSTED, [0.0]
        for r in range(1, k + 1):
            d = 0.0
            if n[0] and n[r - 1] and n[k] and (k + 1) * n[k] != n[0]:
                cut = (k + 1) * n[k] / n[0]
                d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut)
            ratio.append(d)
        if not all(0 < d < 1 for d in ratio[1:]) and (power := _power(n)) < -1:
            # of n[r - 1] = c * r ** power; all ratios are between 0 and 1
            cut = (k + 1) ** (power + 1)
            ratio = [0.0] + [(((r + 1) / r) ** (power + 1) - cut) / (1 - cut) for r in range(1, k + 1)]
        if not all(0 < d < 1 for d in ratio[1:]):
            ratio = [0.0] + [1 - less / r for r in range(1, k + 1)]
        return Discounts(tuple(ratio), less)

    def apply(self, counts: np.ndarray) -> np.ndarray:
        small = np.array(self.ratio)[np.minimum(counts, TRUSTED)] * counts
        return np.where(counts <= TRUSTED, small, counts - self.less)


@dataclass(frozen=True)
class Model:
    """The model's few numbers: tokens and different tokens of training, discounts by order, mass of unknown words."""

    tokens: int
    types: int
    discounts: tuple[Discounts, ...]
    unknown: float


def _model(counted: DataFrame, order: int) -> Model:
    import pyarrow as pa

    def added(batches):
        for b in batches:
            rows = [(o, *unpack(c).tolist()) for o, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * (TRUSTED + 4), names=names)

    names = ["order", *(f"n{i}" for i in range(TRUSTED + 3))]
    sums = counted.where("chunk is null").select("order", "counts").mapInArrow(added, ", ".join(f"{x} long" for x in names))
    n = {r["order"]: list(r)[1:] for r in sums.groupBy("order").agg(*[F.sum(x).alias(x) for x in names[1:]]).collect()}  # a row for each order
    by = [n.get(o, [0] * (TRUSTED + 3)) for o in range(1, order + 1)]
    discounts = tuple(Discounts.of(x[: TRUSTED + 1]) for x in by)
    types, tokens = by[0][TRUSTED + 1], by[0][TRUSTED + 2]
    small = sum(c * x * (1 - discounts[0].ratio[c]) for c, x in zip(range(1, TRUSTED + 1), by[0]))
    large = discounts[0].less * (types - sum(by[0][:TRUSTED]))
    return Model(tokens, types, discounts, (small + large) / tokens if tokens else 1.0)


# ---- evaluation

#: order null: a chunk's documents, and the numbers of tokens of each that await the weight of a context (its place among
#: those that the chunk wants); else a bucket's sums for contexts of order - 1.
DOCS = "array<struct<id: long, held: boolean, n_tokens: long, n_known: long, base: double, score: double>>"
WAITS = "array<struct<order: int, doc: int, context: int, n: int>>"
SCORED = f"order int, bucket long, chunk long, hashes binary, total binary, mass binary, lower binary, wanted binary, docs {DOCS}, waits {WAITS}"


def _struct_list(names: list[str], columns: list):
    """One row: the list of structs with these fields."""
    import pyarrow as pa

    cells = pa.StructArray.from_arrays([pa.array(c) for c in columns], names)
    return pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), cells)


def _fields(cell) -> list[np.ndarray]:
    """The fields of a list of structs, as arrays."""
    items = cell.values
    return [items.field(i).to_numpy(zero_copy_only=False) for i in range(items.type.num_fields)]


def _evaluate(model: Model, order: int, buckets: int):
    def run(key, chunk, answers):
        import pyarrow as pa

        row = chunk.to_pylist()[0]
        grams = Grams(row, order)
        count = [np.zeros(len(h), np.int64) for h in grams.hashes]
        marks = [np.zeros(len(h), np.uint8) for h in grams.hashes]
        replies = {(r["order"], r["bucket"]): r for r in answers.to_pylist()}
        for o in range(1, order + 1):
            for k, i, j in bucket_cuts(grams.hashes[o - 1], buckets):
                r = replies[o, k]
                count[o - 1][i:j], marks[o - 1][i:j] = unpack(r["counts"]), unpack(r["marks"], np.uint8)
        known = count[0] > 0
        prob = [np.where(known, model.discounts[0].apply(count[0]) / max(model.tokens, 1), model.unknown)]
        context, out = [None], []
        tokens = np.flatnonzero(grams.place > 0)
        doc, docs = grams.doc[tokens], len(row["ids"])
        c1 = count[0][grams.index[0][tokens]]
        base = np.bincount(doc, np.log10((c1 + 1) / (model.tokens + model.types + 1)), docs)
        score = np.zeros(docs)
        sums: list[tuple] = []
        for o in range(2, order + 1):
            at = grams.sample[o - 1]
            context.append(grams.index[o - 2][at - 1])
            total = count[o - 2][context[-1]]
            left = model.discounts[o - 1].apply(count[o - 1])
            prob.append(np.where(count[o - 1] > 0, left / np.maximum(total, 1), 0.0))
            mine = np.flatnonzero((marks[o - 1] & OWN > 0) & (marks[o - 2][context[-1]] & OPEN > 0))
            size = len(grams.hashes[o - 2])
            lower = prob[o - 2][grams.index[o - 2][at[mine]]]
            sums.append((np.bincount(context[-1][mine], left[mine], size), np.bincount(context[-1][mine], lower, size)))
        waiting, rest = [], tokens
        for o in range(order, 0, -1):
            index = grams.index[o - 1][rest]
            hit = index >= 0
            if o > 1:
                hit[hit] = count[o - 1][index[hit]] > 0
                back = np.flatnonzero(~hit & (index >= 0))  # a context that training has never seen has weight 1
                own_context = context[o - 1][index[back]]
                live = count[o - 2][own_context] > 0
                pairs, n = np.unique(grams.doc[rest[back[live]]] * (len(grams.hashes[o - 2]) + 1) + own_context[live], return_counts=True)
                waiting.append((o, pairs // (len(grams.hashes[o - 2]) + 1), pairs % (len(grams.hashes[o - 2]) + 1), n))
            score += np.bincount(grams.doc[rest[hit]], np.log10(prob[o - 1][index[hit]]), docs)
            rest = rest[~hit]
        waits = []
        for o, d, c, n in waiting:
            wanted = np.zeros(len(grams.hashes[o - 2]), bool)
            wanted[c] = True
            mass, lower = sums[o - 2]
            some = np.flatnonzero(wanted | (mass > 0))
            h, t = grams.hashes[o - 2][some], count[o - 2][some]
            for k, i, j in bucket_cuts(h, buckets):
                part = some[i:j]
                out.append((o, k, row["chunk"], pack_sorted(h[i:j]), pack(t[i:j]), pack(mass[part]), pack(lower[part]), pack(wanted[part])))
            waits.append([np.full(len(d), o), d, np.cumsum(wanted)[c] - 1, n])
        n_known = np.bincount(doc, c1 > 0, docs).astype(np.int64)
        out.append((None, None, row["chunk"], None, None, None, None, None))
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        ids, held = pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_())
        each = _struct_list(["id", "held", "n_tokens", "n_known", "base", "score"], [ids, held, grams.n_tokens, n_known, base, score])
        columns = [np.concatenate(c).astype(np.int32) for c in zip(*waits)] if waits else [np.zeros(0, np.int32)] * 4
        await_ = _struct_list(["order", "doc", "context", "n"], columns)
        last = [pa.chunked_array([pa.nulls(len(out) - 1, x.type), x]) for x in (each, await_)]
        return pa.table([*(pa.array(c, t) for c, t in zip(zip(*out), kinds)), *last], names=["order", "bucket", "chunk", "hashes", "total", "mass", "lower", "wanted", "docs", "waits"])

    return run


WEIGHTS = "order int, bucket long, chunk long, weights binary"


def _weights(key, table):
    """log10 of each wanted context's backoff weight: what its seen words leave of 1, over what they leave of the
    lower order's."""
    import pyarrow as pa

    rows = table.to_pylist()
    lists = [unpack_sorted(r["hashes"]) for r in rows]
    u, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    mass, lower = (np.bincount(inverse, np.concatenate([unpack(r[c], float) for r in rows]), len(u)) for c in ("mass", "lower"))
    total = np.zeros(len(u))
    total[inverse] = np.concatenate([unpack(r["total"]) for r in rows])
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.log10(np.maximum(1 - mass / total, 1e-12) / np.maximum(1 - lower, 1e-12))
    out, at = [], 0
    for r, x in zip(rows, lists):
        wanted = unpack(r["wanted"], bool)
        if wanted.any():
            out.append((r["chunk"], pack(weight[inverse[at : at + len(x)][wanted]])))
        at += len(x)
    head = [pa.array([key[i].as_py()] * len(out), t) for i, t in ((0, pa.int32()), (1, pa.int64()))]
    columns = [pa.array([x[i] for x in out], t) for i, t in ((0, pa.int64()), (1, pa.binary()))]
    return pa.table([*head, *columns], names=["order", "bucket", "chunk", "weights"])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(train_tokens: int):
    def run(key, scored, weights):
        import pyarrow as pa

        row = scored.slice(0, 1)
        items = row.column("docs")[0].values
        ids, held = items.field(0), items.field(1)
        n_tokens, n_known, base, score = _fields(row.column("docs")[0])[2:]
        orders, d, c, n = _fields(row.column("waits")[0])
        by: dict[int, list] = {}
        for r in sorted(weights.to_pylist(), key=lambda r: (r["order"], r["bucket"])):
            by.setdefault(r["order"], []).append(unpack(r["weights"], float))
        for o, lists in by.items():
            own = orders == o
            score = score + np.bincount(d[own], n[own] * np.concatenate(lists)[c[own]], len(ids))
        columns = (ids, held, n_tokens, n_known, np.full(len(ids), train_tokens, np.int64), base, score)
        return pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def katz_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    A model of n-grams up to order learns from the documents that are not held out (see held_out) and scores all. Tokens
    are A-Z lower-cased runs of other characters than white space, and one end for each text; the first token's context
    is the text's start. An n-gram seen in training has its discounted count over its context's; another one the
    context's backoff weight times the shorter n-gram's probability, recursively; an unknown word the mass that the
    discounts of single words leave. Weights are such that the probabilities after any context sum to 1 exactly.
    score is the log10 probability of the text, base_score that of add-one counts of single tokens.

    Null and empty texts have the end token only. A null doc_id counts as an empty one for the choice of training
    documents. Repeated rows count and are scored each. Without training documents all probabilities are 1. An empty
    table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = saved(docs.mapInArrow(_chunked, CHUNKS), "katz-chunks")
    buckets = max(12, math.ceil(chunks.count() * CHUNK_BYTES / 6 / BUCKET_GRAMS))
    # one order after the other: the lists of one take about as much room as the texts
    asked = [chunks.mapInArrow(_ask(o, buckets), ASKED).groupBy("order", "bucket").applyInArrow(_counted, COUNTED) for o in range(1, order + 1)]
    tables = [saved(df, "katz-counts") for df in asked]
    counted = reduce(DataFrame.unionByName, tables)
    model = _model(counted, order)
    answers = counted.where("chunk is not null")
    turn, parts = F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)), []
    for k in range(ROUNDS):  # a share of the chunks at a time: all of them with their answers would fill the disks
        own = chunks.where(turn == k).groupBy("chunk").cogroup(answers.where(turn == k).groupBy("chunk"))
        parts.append(saved(own.applyInArrow(_evaluate(model, order, buckets), SCORED), "katz-scored"))
    scored = reduce(DataFrame.unionByName, parts)
    release(chunks, *tables)
    sums = scored.where("order is not null").drop("docs", "waits")
    weights = saved(sums.groupBy("order", "bucket").applyInArrow(_weights, WEIGHTS), "katz-weights")
    waiting = scored.where("order is null").select("chunk", "docs", "waits")
    return waiting.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(_finish(model.tokens), RESULT)


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=3)


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
