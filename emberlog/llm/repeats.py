"""Repeated passages across documents: shared machinery of substring and suffix-array deduplication.

A passage is a run of `size` units (words or bytes) that also starts in a document with a smaller doc_id. Both
operators pick anchors so that two equal passages always share one, and then work on these rows:

    anchor        a hash of the anchor, 48 bits
    seg           a hash of the whole segment around it that passages with this anchor can reach, 64 bits; REMOVED if a
                  task found the segment in a smaller document of its own rows; OPEN if a task saw that the anchor has
                  several segments in several documents, so that its passages have to be compared
    doc_id, tag   the document; tag is 0, or a hash of the text where the table has several rows of that doc_id
    place         the segment in units of the document: its start, in the upper bits, and its length

Documents that share an anchor meet by its hash. A segment that equals one of a smaller document is removed whole; of
equal segments only the smallest document's goes on. If an anchor has several different segments, what they share is
less than a segment, and their passages are compared one by one. Anchor and segment are independent hashes; that two
anchors are taken for one does no harm, as segments are told apart by their own 64 bits.

An anchor that a common line makes hot is settled before the shuffle: of those with more rows in a task than HELD, and
several documents and segments, the rows that show this to others go on and all the rest are OPEN at once. So the
rows that meet at one anchor are a few for each million rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, release, saved

ROWS = "anchor long, seg long, doc_id long, tag long, place long"
LENGTH_BITS = 31
#: Rows that a task settles at a time, rows of a batch that it hands on, and rows of an anchor that meet as they are.
SETTLED, HANDED, HELD = 1_000_000, 100_000, 16
REMOVED, OPEN = 0, 1
#: Ids of which several rows exist are looked up from memory up to this number, and by a shuffle beyond it.
FEW_IDS = 1_000_000
U = np.uint64
_ANCHOR = U((1 << 48) - 1)


def batches_of(anchor, seg, doc, tag, lo, hi):
    """Record batches of ROWS, small ones: the JVM holds each whole. seg: 64-bit hashes, or a number for all rows."""
    import pyarrow as pa

    for i in range(0, len(anchor), HANDED):
        part = slice(i, i + HANDED)
        own = seg[part] | U(2) if isinstance(seg, np.ndarray) else np.full(len(doc[part]), seg, U)
        place = (lo[part].astype(np.int64) << LENGTH_BITS) + (hi[part] - lo[part])
        columns = ((anchor[part] & _ANCHOR).view(np.int64), own.view(np.int64), doc[part], tag[part], place)
        yield pa.record_batch([pa.array(c) for c in columns], names=["anchor", "seg", "doc_id", "tag", "place"])


def certain(state: int, doc, tag, lo, hi):
    """Record batches of ROWS of which the state is known, as maximal spans of each document, under anchors of their own."""
    doc, tag, lo, hi = merged(doc, tag, lo, hi)
    yield from batches_of(mix(doc.view(U) ^ tag.view(U)), state, doc, tag, lo, hi)


def joined(parts):
    """The concatenated columns of parts, which is emptied."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    parts.clear()
    return columns


def _groups(*keys):
    """Whether a row starts a group of equal keys, of rows in their order."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return new


def rows_out(anchor, seg, doc, tag, lo, hi):
    """Record batches of ROWS, after what is certain from these rows alone has been settled: rows that repeat a segment
    of a smaller document here are removed, and most rows of an anchor with many are open.

    That keeps groups of copies from being shuffled anchor by anchor: what they repeat becomes few merged spans.
    """
    if not len(anchor):
        return
    anchor, seg = anchor & _ANCHOR, seg | U(2)
    order = np.lexsort((doc, seg, anchor))
    anchor, seg, doc, tag, lo, hi = (c[order] for c in (anchor, seg, doc, tag, lo, hi))
    new = _groups(anchor, seg)
    keep = doc == doc[np.flatnonzero(new)][np.cumsum(new, dtype=np.int32) - 1]
    del order, new
    yield from certain(REMOVED, doc[~keep], tag[~keep], lo[~keep], hi[~keep])
    anchor, seg, doc, tag, lo, hi = (c[keep] for c in (anchor, seg, doc, tag, lo, hi))
    hot = crowded(anchor, seg, doc)
    if hot.any():
        apart = mix(doc[hot].view(U) + mix(lo[hot].astype(U)))
        yield from batches_of(apart, OPEN, doc[hot], tag[hot], lo[hot], hi[hot])
        anchor, seg, doc, tag, lo, hi = (c[~hot] for c in (anchor, seg, doc, tag, lo, hi))
    yield from batches_of(anchor, seg, doc, tag, lo, hi)


def crowded(anchor, seg, doc):
    """Which rows, in the order of (anchor, seg), are of an anchor with more than HELD rows, several segments and several
    documents, but for those with its first and last segment and its smallest and largest document."""
    head = np.flatnonzero(_groups(anchor))
    last = np.append(head[1:], len(anchor)) - 1
    low, high = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
    many = (last - head >= HELD) & (low < high) & (seg[head] != seg[last])
    if not many.any():
        return np.zeros(len(anchor), bool)
    hot = np.repeat(many, last - head + 1)
    hot[head] = hot[last] = False
    for k in np.flatnonzero(many).tolist():
        own = slice(head[k], last[k] + 1)
        hot[head[k] + doc[own].argmin()] = hot[head[k] + doc[own].argmax()] = False
    return hot


def rows_met(anchor, doc, tag, lo, hi):
    """Record batches of ROWS to find out which rows' anchors are in several documents: rows of which that is certain
    here are done, and of their anchors one row each goes on for others' sake."""
    anchor = anchor & _ANCHOR
    order = np.lexsort((doc, anchor))
    anchor, doc, tag, lo, hi = (c[order] for c in (anchor, doc, tag, lo, hi))
    head = np.flatnonzero(_groups(anchor)) if len(anchor) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(anchor)) - 1
    many = np.repeat(doc[head] < doc[last], last - head + 1)
    yield from certain(REMOVED, doc[many], tag[many], lo[many], hi[many])
    on = ~many
    on[head] = True
    yield from batches_of(anchor[on], OPEN, doc[on], tag[on], lo[on], hi[on])


def merged(doc, tag, lo, hi):
    """The union of spans by document, as maximal spans in order."""
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, hi = doc[order], tag[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    first = _groups(doc, tag)
    group = np.cumsum(first) - 1
    span = int(hi.max()) + 1 if len(hi) else 1
    reach = np.maximum.accumulate(hi + group * span) - group * span
    first[1:] |= lo[1:] > reach[:-1]
    at = np.flatnonzero(first)
    return doc[at], tag[at], lo[at], np.maximum.reduceat(reach, at) if len(at) else reach


def tagged(docs: DataFrame, key: str = "doc_id", tag: str = "tag") -> DataFrame:
    """docs with the column tag: 0, or where several rows have the row's key (long) a hash of its text."""
    ids = docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    n = ids.limit(FEW_IDS + 1).count()
    if not n:
        return docs.withColumn(tag, F.lit(0).cast("long"))
    ids = ids.withColumn("__several", F.lit(True))
    marked = docs.join(F.broadcast(ids) if n <= FEW_IDS else ids, key, "left")
    marked = marked.withColumn(tag, F.when(F.col("__several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    return marked.select(*docs.columns, tag)


def spans_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def shared_spans(docs: DataFrame, anchors, passages, name: str, refine=None) -> DataFrame:
    """The spans to remove of each document that has any: doc_id, tag, spans array<struct<lo, hi>>; they may overlap.

    docs: doc_id, text, tag. anchors(batches) and passages(batches) are for mapInArrow and give ROWS; passages gets
    doc_id, tag, text, spans and gives a row for each passage inside the spans. refine, if given, gives rows whose lo..hi
    hold all passages that can be in several documents, by longer anchors: spans whose anchors are not go. refine and
    then also passages get PIECES: of each text the bytes in open spans only, so that whole texts move once.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "tag", "text")
    rows = docs.mapInArrow(anchors, ROWS)
    by, removed, open_ = Window.partitionBy("anchor"), F.col("seg") == REMOVED, F.col("seg") == OPEN
    lo = F.shiftright("place", LENGTH_BITS).cast("int")
    span = lo.alias("lo"), (lo + F.col("place").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)).cast("int")).alias("hi")
    shared = F.col("least") < F.col("most")
    rows = rows.withColumn("least", F.min("doc_id").over(by)).withColumn("most", F.max("doc_id").over(by))
    rows = rows.withColumn("seg1", F.min("seg").over(by)).withColumn("seg2", F.max("seg").over(by)).where(removed | open_ | shared)
    rows = rows.withColumn("owner", F.min("doc_id").over(Window.partitionBy("anchor", "seg")))
    first = ~removed & (F.col("doc_id") == F.col("owner"))
    found = rows.where(removed | open_ | ~first | (F.col("seg1") < F.col("seg2"))).select("doc_id", "tag", *span, (open_ | first).alias("open"))
    found = saved(found, f"{name}-segments")

    spans = spans_of(found.where("open"))
    if refine:
        cut = docs.join(spans, ["doc_id", "tag"]).select("doc_id", "tag", F.col("text").cast("binary").alias("text"), "spans").mapInArrow(pieces, PIECES)
        cut = saved(cut, f"{name}-pieces")
        rows = cut.mapInArrow(refine, ROWS)
        rows = rows.withColumn("least", F.min("doc_id").over(by)).withColumn("most", F.max("doc_id").over(by)).where(removed | shared)
        near = saved(rows.select("doc_id", "tag", *span), f"{name}-refined")
        spans = spans_of(near)
        docs = cut.drop("spans")
    part = docs.join(spans, ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans", *[c for c in ("total", "starts", "cuts") if refine]).mapInArrow(passages, ROWS)
    part = part.withColumn("owner", F.min("doc_id").over(Window.partitionBy("anchor", "seg"))).where(removed | (F.col("doc_id") > F.col("owner")))
    every = found.where("not open").select("doc_id", "tag", "lo", "hi").unionByName(part.select("doc_id", "tag", *span))
    # a document's spans are at most as many as its units
    out = saved(spans_of(every), f"{name}-spans")
    release(found, *((cut, near) if refine else ()))
    return out


PIECES = "doc_id long, tag long, text binary, spans array<struct<lo: int, hi: int>>, total int, starts array<int>, cuts array<int>"


def pieces(batches):
    """Of each text the bytes that its spans cover, as one string; starts: of its runs in the text, cuts: in the string;
    total: bytes of the text."""
    import pyarrow as pa

    for b in batches:
        bodies, totals, starts, cuts = [], [], [], []
        for k in range(b.num_rows):
            raw = b.column(2)[k].as_py()
            lo, hi = union(*span_arrays(b.column(3), k), len(raw))
            bodies.append(b"".join([raw[i:j] for i, j in zip(lo.tolist(), hi.tolist())]))
            totals.append(len(raw))
            starts.append(lo.astype(np.int32))
            cuts.append((np.cumsum(hi - lo) - (hi - lo)).astype(np.int32))
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (starts, cuts)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(bodies, pa.binary()), b.column(3), pa.array(totals, pa.int32()), *lists], names=["doc_id", "tag", "text", "spans", "total", "starts", "cuts"])


def shifts(starts, cuts, lo: np.ndarray) -> np.ndarray:
    """What to add to the positions lo of a text to have them in its pieces; starts, cuts: a row's Arrow lists."""
    s, c = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, cuts))
    if not len(s):
        return np.zeros(len(lo), np.int64)
    return (c - s)[np.maximum(np.searchsorted(s, lo, "right") - 1, 0)]


def span_arrays(column, row: int):
    """lo and hi of one row of an Arrow column array<struct<lo, hi>>; empty where null."""
    if not column[row].is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    items = column[row].values
    return items.field("lo").to_numpy(zero_copy_only=False).astype(np.int64), items.field("hi").to_numpy(zero_copy_only=False).astype(np.int64)


def union(lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of the union, cut at n; spans that touch are one."""
    keep = lo < n
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    none = np.zeros(int(keep.sum()), np.int64)
    return merged(none, none, lo[keep], np.minimum(hi[keep], n))[2:]
