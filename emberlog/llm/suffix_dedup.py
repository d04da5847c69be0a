"""Suffix-array dedup: two-stage suffix sorting finds byte strings that repeat across documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, eights, mix
from .repeats import REMOVED, SETTLED, certain, joined, rows_met, rows_out, shared_spans, shifts, span_arrays, tagged, union

#: Bytes of an anchor, and of the shorter strings of which the smallest by hash decides which anchor a passage picks.
GRAM, LEAST_GRAM = 28, 4
U = np.uint64


def _run_hash(at8: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the size bytes from each position of at on; size is the same for all."""
    h = np.full(len(at), seed ^ size, U)
    for k in range(0, size, 8):
        x = at8[at + min(k, size - 8)]  # the last step may overlap the one before
        h = (h ^ x) * U(0x9FB21C651E98DF25)
        h ^= h >> U(29)
    return mix(h)


def _picked(data: np.ndarray, n: int, size: int) -> np.ndarray:
    """Positions of the anchor that each size-byte window of data[:n] picks.

    With w anchors in a window, the place of the window's smallest short string by hash (the leftmost of equals), modulo
    w, is the anchor's place. A short string's length is that of an anchor modulo w, so neighbouring windows mostly pick
    the same anchor: there are fewer of them than if the smallest anchor were picked itself.
    """
    w = size - GRAM + 1
    short = LEAST_GRAM + (GRAM - LEAST_GRAM) % w
    m = n - short + 1
    at8 = eights(data)
    if short < 8:
        h = mix((at8[:m] & U((1 << (8 * short)) - 1)) * U(0x9E3779B97F4A7C15))
    else:
        h = _run_hash(at8, np.arange(m), short, 5)
    h &= U((1 << 64) - (1 << 24))
    h |= np.arange(m, dtype=U)  # stretches are far below 2^24 bytes
    wide, reach = size - short + 1, 1
    while 2 * reach <= wide:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    count = n - size + 1
    h = np.minimum(h[:count], h[wide - reach : wide - reach + count])
    start = np.arange(count)
    at = start + ((h & U((1 << 24) - 1)).astype(np.int64) - start) % w
    new = np.ones(count, bool)
    new[1:] = at[1:] != at[:-1]
    return at[new]


STRETCH = 1 << 22


def _anchors(size: int):
    left = size - GRAM

    def run(batches):
        for b in batches:
            ids, tags, parts = b.column(0).to_numpy(), b.column(1).to_numpy(), []
            for row, end, offsets, data in chunks(b.column(2)):
                n = int(offsets[-1])
                at8 = eights(data)
                # windows across documents pick anchors too, which do no harm; those that a document cuts go below
                got = [_picked(data[s:], min(n - s, STRETCH + size), size) + s for s in range(0, max(n - size + 1, 0), STRETCH)]
                if not got:
                    continue
                at = np.unique(np.concatenate(got)) if len(got) > 1 else got[0]
                d = np.searchsorted(offsets, at, "right") - 1
                begin, stop = offsets[d], offsets[d + 1]
                ok = (at + GRAM <= stop) & (stop - begin >= size)
                at, d, begin, stop = at[ok], d[ok], begin[ok], stop[ok]
                lo, hi = np.maximum(at - left, begin), np.minimum(at + size, stop)
                anchor, seg = _run_hash(at8, at, GRAM, 7), np.zeros(len(at), U)
                full = hi - lo == left + size
                seg[full] = _run_hash(at8, lo[full], left + size, 77)
                rest = np.flatnonzero(~full)
                shape = (at - lo)[rest] * 4096 + (hi - at)[rest]
                for s in np.unique(shape):
                    k = rest[shape == s]
                    seg[k] = _run_hash(at8, lo[k], int(hi[k[0]] - lo[k[0]]), 77) ^ mix(np.array([s], U))[0]
                parts.append((anchor, seg, ids[row + d], tags[row + d], (lo - begin).astype(np.int32), (hi - begin).astype(np.int32)))
                if sum(len(x[0]) for x in parts) > SETTLED:
                    yield from rows_out(*joined(parts))
            if parts:
                yield from rows_out(*joined(parts))

    return run


def _refine(size: int):
    """Rows for an anchor with half of what a passage has beside it: a passage holds the half to the left or the right. A
    document shorter than its segment stays whole."""
    half = (size - GRAM) // 2
    grown = GRAM + half

    def run(batches):
        for b in batches:
            at, raw = buffers(b.column(2))
            raw = np.concatenate([raw[: at[-1]], np.zeros(64, np.uint8)])
            at8, ids, tags, parts, whole, held = eights(raw), b.column(0).to_numpy(), b.column(1).to_numpy(), [], [], 0
            for k in range(b.num_rows):
                n = b.column(4)[k].as_py()
                lo, hi = span_arrays(b.column(3), k)
                begin = int(at[k]) + shifts(b.column(5)[k], b.column(6)[k], lo)
                a = np.where(hi < n, hi - size, lo + size - GRAM)
                unsure = (hi >= n) & (lo == 0)  # a short document: its segment stays whole
                left, right = np.flatnonzero(~unsure & (a - half >= lo)), np.flatnonzero(~unsure & (a + grown <= hi))
                h = [_run_hash(at8, begin[left] + a[left] - half, grown, 9), _run_hash(at8, begin[right] + a[right], grown, 11)]
                for rows, own, i, j in ((left, h[0], lo[left], a[left] - half + size), (right, h[1], a[right] - half, hi[right])):
                    parts.append((own, np.full(len(rows), ids[k]), np.full(len(rows), tags[k]), np.maximum(i, lo[rows]), np.minimum(j, hi[rows])))
                if unsure.any():
                    whole.append((ids[k : k + 1], tags[k : k + 1], np.zeros(1, np.int64), np.array([n])))
                held += len(lo)
                if held > SETTLED // 2:  # a segment gives two rows
                    yield from rows_met(*joined(parts))
                    held = 0
            if parts:
                yield from rows_met(*joined(parts))
            if whole:
                yield from certain(REMOVED, *joined(whole))

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text (small non-negative numbers) in the order of their suffixes, compared up to depth at least.

    Two stages. Suffixes smaller than their successors (type S) are sorted directly, by eight symbols at a time among
    those still tied. The others (type L) are induced: buckets are scanned in symbol order; a bucket's L suffixes come
    first, in the order in which the scan meets their successors, then its sorted S suffixes; each suffix met hands its
    predecessor, if of type L, to the end of that one's bucket. A whole bucket is handed on at once.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    t = text.astype(np.int64)
    after = np.append(t[1:], -1)
    # equal neighbours have the type of the next differing one: fill from the right
    sign = np.sign(after - t)
    index = np.where(sign != 0, np.arange(n), n - 1)
    nxt = np.minimum.accumulate(index[::-1])[::-1]
    small = sign[nxt] > 0
    s = np.flatnonzero(small)
    padded = np.zeros(n + depth + 8, np.uint16)
    padded[:n] = text
    rank = np.zeros(len(s), np.int64)
    tied = np.arange(len(s))
    for k in range(0, depth, 4):  # four 16-bit symbols to a key
        if not len(tied):
            break
        key = np.zeros(len(tied), U)
        for j in range(4):
            key = (key << U(16)) | padded[s[tied] + k + j].astype(U)
        order = np.lexsort((key, rank[tied]))
        r, q = rank[tied][order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (q[1:] != q[:-1])
        head = np.ones(len(order), bool)
        head[1:] = r[1:] != r[:-1]
        place = np.arange(len(order))
        inside = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        rank[tied[order]] = r + inside
        count = np.diff(np.append(np.flatnonzero(new), len(order)))
        tied = tied[order][np.repeat(count, count) > 1]
    s = s[np.argsort(rank, kind="stable")]
    top = int(t.max()) + 1
    bounds = np.searchsorted(t[s], np.arange(top + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(top)]
    waiting[t[n - 1]].append(np.array([n - 1]))  # the last suffix is above the end of text, so of type L
    out = []
    for c in range(top):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        mine = []
        while len(wave):
            mine.append(wave)
            p = wave[wave > 0] - 1
            wave = p[t[p] == c]
        mine.append(s[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(mine)
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[t[p] > c]
        sym = t[p]
        order = np.argsort(sym.astype(np.uint16), kind="stable")
        p, sym = p[order], sym[order]
        cuts = np.flatnonzero(np.append(True, sym[1:] != sym[:-1])) if len(sym) else np.zeros(0, np.int64)
        for i, j in zip(cuts, np.append(cuts[1:], len(sym))):
            waiting[sym[i]].append(p[i:j])
        waiting[c] = []
    return np.concatenate(out)


def _passages(size: int):
    """Rows for the size-byte strings inside a document's spans. Blocks of spans get a suffix array each; neighbours in
    it with size bytes in common are one string, of which the smallest document's goes on, with 128 bits of hash."""

    def block(pieces, owners, tags, begins):
        lengths = np.array([len(p) for p in pieces])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        text = np.zeros(int((lengths + 1).sum()) + 64, np.uint8)
        sep = np.ones(len(text), bool)
        for at, p in zip(starts.tolist(), pieces):
            text[at : at + len(p)] = p
            sep[at : at + len(p)] = False
        n = len(text) - 64
        order = suffix_order(np.where(sep[:n], 0, text[:n].astype(np.uint16) + 1), size)
        piece = np.searchsorted(starts, order, "right") - 1
        fits = order + size <= starts[piece] + lengths[piece]
        order, piece = order[fits], piece[fits]
        at8 = eights(text)
        same = np.ones(max(len(order) - 1, 0), bool)  # whether the common prefix with the neighbour reaches size bytes
        for k in [*range(0, size - 8, 8), size - 8]:
            x = at8[order + k]
            same &= x[1:] == x[:-1]
        group = np.cumsum(np.append(True, ~same)) - 1 if len(order) else np.zeros(0, np.int64)
        head = order[np.flatnonzero(np.append(True, ~same))] if len(order) else order
        p = order - starts[piece] + begins[piece]
        return _run_hash(at8, head, size, 3)[group], _run_hash(at8, head, size, 33)[group], owners[piece], tags[piece], p, p + size

    def run(batches):
        for b in batches:
            at, raw = buffers(b.column(2))
            ids, tags, parts = b.column(0).to_numpy(), b.column(1).to_numpy(), []
            pieces, owners, begins, held = [], [], [], 0
            for k in range(b.num_rows):
                lo, hi = union(*span_arrays(b.column(3), k), b.column(4)[k].as_py())
                begin = int(at[k]) + shifts(b.column(5)[k], b.column(6)[k], lo)
                for i, j, s in zip(lo.tolist(), hi.tolist(), begin.tolist()):
                    if j - i >= size:
                        pieces.append(raw[s + i : s + j])
                        owners.append(k)
                        begins.append(i)
                        held += j - i
                if held > (1 << 20) or (k == b.num_rows - 1 and pieces):
                    parts.append(block(pieces, ids[owners], tags[owners], np.array(begins)))
                    pieces, owners, begins, held = [], [], [], 0
                if sum(len(x[0]) for x in parts) > SETTLED:
                    yield from rows_out(*joined(parts))
            if parts:
                yield from rows_out(*joined(parts))

    return run


def _cut(whole_chars: bool):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for k in range(b.num_rows):
                raw = (b.column(1)[k].as_py() or "").encode()
                lo, hi = union(*span_arrays(b.column(2), k), len(raw))
                n_bytes.append(len(raw))
                n_removed.append(int((hi - lo).sum()))
                n_spans.append(len(lo))
                pieces, at = [], 0
                for i, j in zip(lo.tolist(), hi.tolist()):
                    if whole_chars:  # a character of which a byte stays, stays
                        while i < j and raw[i] & 0xC0 == 0x80:
                            i += 1
                        while j > i and j < len(raw) and raw[j] & 0xC0 == 0x80:
                            j -= 1
                    pieces.append(raw[at:i])
                    at = j
                kept.append(b"".join([*pieces, raw[at:]]))
            yield pa.record_batch([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def dedup_suffixes(docs: DataFrame, size: int = 50, whole_chars: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) of every row of docs.

    Texts are UTF-8 bytes. A byte goes if it is in a string of size bytes that also starts in a document with a smaller
    doc_id, in the input; strings never cross documents. Null and empty texts have no bytes. Rows with a null doc_id
    have no order: they stay whole and remove nothing. Rows that repeat a doc_id are documents of their own, none of them
    smaller than the other. whole_chars
    keeps characters of which some bytes stay, so that kept is UTF-8; counts are as without it. Other columns are
    ignored. size is at least 32.
    """
    if size < GRAM + 8:
        raise ValueError(f"size must be at least {GRAM + 8}")
    docs = tagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = shared_spans(docs, _anchors(size), _passages(size), "suffix", _refine(size))
    return docs.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(whole_chars), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _cut_texts(batches):
    import pyarrow as pa

    for b in batches:
        *columns, spans = b.columns
        k = b.schema.get_field_index("text")
        texts = pa.record_batch([pa.nulls(b.num_rows), b.column(k), spans], names=["doc_id", "text", "spans"])
        kept = next(_cut(True)([texts])).column(4).cast(pa.string())
        columns[k] = pa.array([t.as_py() if own.is_valid else None for own, t in zip(b.column(k), kept)], pa.string())
        yield pa.record_batch(columns, names=b.schema.names[:-1])


def drop_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """docs with what dedup_suffixes removes cut from text, in whole characters; all rows and other columns stay. A null
    text stays null."""
    own, tag = "__doc", "__tag"
    ids = tagged(docs.withColumn(own, F.col("doc_id").cast("long")), own, tag)
    spans = shared_spans(ids.select(F.col(own).alias("doc_id"), F.col(tag).alias("tag"), "text"), _anchors(size), _passages(size), "suffix", _refine(size))
    spans = spans.select(F.col("doc_id").alias(own), F.col("tag").alias(tag), F.col("spans").alias("__spans"))
    rows = ids.join(spans, [own, tag], "left").select(*docs.columns, "__spans")
    return rows.mapInArrow(_cut_texts, docs.schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
