"""Benchmark decontamination by template canonicalisation: typed placeholders, template windows, slot consistency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, chunks, mix, saved, word_hashes

U = np.uint64
WINDOW = 8
#: A window counts if so many of its tokens are words and no placeholders.
LITERALS = 5
#: Items of fewer tokens than this would be found everywhere.
SHORTEST = 3
#: Units that may follow a number (fixed values).
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "lb", "lbs", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "degree", "degrees", "kmh", "mph", "w", "kw", "kwh", "v", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb")
#: Bits of the fixed-size filter that benchmark windows set; it only spares rows, the join decides.
FILTER_BITS = 1 << 22
_b = np.arange(256)
_DIGIT = (_b >= 48) & (_b < 58)
_UPPER = (_b >= 65) & (_b < 91)
_WORD = _DIGIT | _UPPER | ((_b >= 97) & (_b < 123)) | (_b >= 128)
_STOP = np.isin(_b, [ord(c) for c in ".!?:;\n\r\"|"])
_BLANK = np.isin(_b, [32, 9, 11, 12])
_SLOTS = {"number": U(0x1B873593CC9E2D51), "unit": U(0x38B34AE5A1E38B93), "name": U(0x52DCE729DA3ED6F1)}


def _unit_hashes() -> np.ndarray:
    own = [u.encode() for u in UNITS]
    data = np.frombuffer(b"".join(own) + bytes(16), np.uint8)
    ends = np.cumsum([len(u) for u in own])
    return np.sort(word_hashes(data, ends - [len(u) for u in own], ends))


_UNITS = _unit_hashes()


def canonical(offsets: np.ndarray, data: np.ndarray):
    """Tokens of a chunk: starts, ends, canonical hashes, whether a slot, hashes of the slots' values, first token of
    each document.

    Tokens are runs of letters and digits; a point or comma between digits belongs to a number. A token that starts with a
    digit is a number, a unit's name after a number a unit, a capitalised word that starts no sentence a name; words of
    one name are one token. Other tokens stand for themselves, A-Z lower-cased.
    """
    n = int(offsets[-1])
    d = data[:n]
    word = _WORD[d]
    digit = _DIGIT[d]
    joint = np.zeros(n, bool)
    joint[1:-1] = np.isin(d[1:-1], (44, 46)) & digit[:-2] & digit[2:]
    word |= joint
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        zero = np.zeros(0, np.int64)
        return zero, zero, zero.astype(U), zero.astype(bool), zero.astype(U), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    value = word_hashes(low, starts, ends)
    h = value.copy()
    number = _DIGIT[d[starts]]
    after = np.append(False, number[:-1])
    unit = after & ~number & (_UNITS[np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)] == value)
    # the last byte before a token that is no blank tells whether a sentence starts
    capital = _UPPER[d[starts]]
    at = np.flatnonzero(capital)
    solid = np.maximum.accumulate(np.where(_BLANK[d], -1, np.arange(n)))
    before = np.where(starts[at] > 0, solid[np.maximum(starts[at] - 1, 0)], -1)
    begin = offsets[np.searchsorted(offsets, starts[at], "right") - 1]
    opens = (before < begin) | _STOP[d[np.maximum(before, 0)]]
    name = np.zeros(len(starts), bool)
    name[at[~opens]] = True
    doc_first = np.zeros(len(starts) + 1, bool)
    doc_first[np.searchsorted(starts, offsets)] = True
    more = name & np.append(False, name[:-1]) & ~doc_first[:-1]
    for kind, where in (("number", number), ("unit", unit), ("name", name)):
        h[where] = _SLOTS[kind]
    slot = number | unit | name
    if more.any():  # a further word of a name goes into the slot of its first one
        keep = np.flatnonzero(~more)
        joined = np.add.reduceat(mix(value), keep)
        single = np.append(~more[1:], True)[keep]
        joined = np.where(single, value[keep], joined)
        last_of = np.append(keep[1:], len(starts)) - 1
        starts, ends, h, slot, value = starts[keep], ends[last_of], h[keep], slot[keep], joined
    return starts, ends, h, slot, value, np.searchsorted(starts, offsets)


#: A kind of windows: whether placeholders stand in them (else the values themselves), and the number of tokens.
Shape = tuple[bool, int]


def _shape_hashes(h: np.ndarray, value: np.ndarray, shapes: list[Shape]):
    """For each shape a function from the windows' first tokens to their hashes."""
    rolls = {t: Rolling(h if t else mix(value ^ U(0x94D049BB133111EB)), 0x9E3779B97F4A7C15) for t in {t for t, _ in shapes}}
    for templated, size in shapes:
        salt = mix(np.array([2 * size + templated], U))[0]
        yield templated, size, lambda at, r=rolls[templated], n=size, s=salt: mix(r.of(at, at + n) ^ s)


def _literals(slot: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(~slot)])


def _marked(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values whose last bit tells names from numbers and units."""
    return value & ~U(1) | (h == _SLOTS["name"]).astype(U)


def _windows(column, shapes: list[Shape]):
    """For each chunk and shape: (row, documents, positions of the windows' first tokens, window hashes, token indices,
    slots, values, shape)."""
    for row, end, offsets, data in chunks(column):
        starts, _, h, slot, value, first = canonical(offsets, data)
        n = np.diff(first)
        doc = np.repeat(np.arange(end - row), n)
        pos = np.arange(len(starts)) - first[:-1][doc]
        literal, marked = _literals(slot), _marked(h, value)
        for templated, size, hashed in _shape_hashes(h, value, shapes):
            at = np.flatnonzero(pos + size <= n[doc])
            if templated:
                at = at[literal[at + size] - literal[at] >= LITERALS]
            yield row, doc[at], pos[at], hashed(at), at, slot, marked, (templated, size)


def _batch(key, pos, h, at, slot, value, shape: Shape, extra: bool):
    import pyarrow as pa

    templated, size = shape
    cells = at[:, None] + np.arange(size)[None, :]
    filled = slot[cells] if templated else np.zeros(cells.shape, bool)
    cuts = np.concatenate([[0], np.cumsum(filled.sum(1))]).astype(np.int32)
    columns = [key, pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(cuts, value[cells][filled].view(np.int64))]
    if extra:
        columns += [pa.array(np.full(len(at), templated)), pa.array(np.full(len(at), size, np.int32))]
    return pa.record_batch(columns, names=[f.split()[0] for f in f"key x, {ITEM if extra else ROW}".split(", ")])


ROW = "pos int, hash long, slots array<long>"
ITEM = f"{ROW}, templated boolean, size int"


def _item_rows(batches):
    """The windows of benchmark items, at most WINDOW tokens long. An item that has no window with enough words is looked
    for with its own numbers and names in place of placeholders."""
    import pyarrow as pa

    for b in batches:
        for row, end, offsets, data in chunks(b.column(1)):
            starts, _, h, slot, value, first = canonical(offsets, data)
            literal, marked = _literals(slot), _marked(h, value)
            for k in range(end - row):
                n = int(first[k + 1] - first[k])
                size = min(n, WINDOW)
                if n < SHORTEST:
                    continue
                every = int(first[k]) + np.arange(n - size + 1)
                at = every[literal[every + size] - literal[every] >= LITERALS]
                shape = (len(at) > 0, size)
                at = at if len(at) else every
                hashed = next(_shape_hashes(h, value, [shape]))[2](at)
                yield _batch(b.column(0).take(pa.array(np.full(len(at), row + k))), at - first[k], hashed, at, slot, marked, shape, True)


def _rows(bits, shapes: list[Shape]):
    """(key, pos, hash, slots): windows that may be in the filter; slots are the places and values of its placeholders."""

    def run(batches):
        import pyarrow as pa

        keep = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for b in batches:
            for row, doc, pos, h, at, slot, value, shape in _windows(b.column(1), shapes):
                near = np.flatnonzero(keep[(h & U(FILTER_BITS - 1)).astype(np.int64)])
                if len(near):
                    yield _batch(b.column(0).take(pa.array(row + doc[near])), pos[near], h[near], at[near], slot, value, shape, False)

    return run


def window_filter(windows: DataFrame) -> bytes:
    """A filter of FILTER_BITS bits from the column hash: its size is the same for any number of windows."""
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = windows.select(bit.alias("bit")).selectExpr("shiftright(bit, 5) word", "shiftleft(1L, cast(bit & 31 as int)) bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()  # FILTER_BITS / 32 rows at most
    out = np.zeros(FILTER_BITS // 32, "<u4")
    for r in words:
        out[r.word] = r.bits
    return out.tobytes()


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", least_windows: int = 6, least_share: float = 0.5, mixed_names: bool = False) -> DataFrame:
    """key, item_id, n_windows, item_windows, n_slots of every document and benchmark item that it holds.

    Texts become sequences of template tokens: numbers, names and units are placeholders. Windows of eight tokens, five of
    them words at least, meet by hash. Windows at the same distance between item and document are one placing of the
    item. Each number or unit of the item is assigned the value that stands for it in most of the placing's windows
    (of equally many the larger hash), and windows that contradict this are left out. With mixed_names, so is each name;
    without, a placing in which two values stand for one name is left out as a whole. Two values of the item may have one
    in the document. A placing counts if least_windows windows or the share least_share of the item's remain. So a question
    with other numbers or names is found, with equal numbers that became different ones too, and with mixed_names one in
    which some mentions of a name are changed and others are not, as long as enough of it agrees. The best placing
    of each pair is returned. An item of fewer than eight tokens is one window. An item of which no window has five words
    is looked for with its own numbers, units and names, not with placeholders. Items of fewer than three tokens and
    null and empty texts take no part; rows that repeat a key count as one document, a null key is a key like any other.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    docs, items = docs.select(F.col(key).alias("key"), "text"), benchmark.select(F.col("item_id").alias("key"), "text")
    kind = dict(docs.dtypes)["key"]
    bench = saved(items.mapInArrow(_item_rows, f"key {dict(items.dtypes)['key']}, {ITEM}"), "benchmark-windows")
    shapes = [(r.templated, r["size"]) for r in bench.select("templated", "size").distinct().collect()]  # two kinds of up to WINDOW lengths
    bench = bench.select(F.col("key").alias("item_id"), F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"))
    sizes = bench.groupBy("item_id").agg(F.count_distinct("item_pos").alias("item_windows"))
    bits = spark.sparkContext.broadcast(window_filter(bench))
    found = docs.mapInArrow(_rows(bits, shapes), f"key {kind}, {ROW}").join(bench, "hash")
    pairs = F.expr("transform(arrays_zip(item_slots, slots), p -> struct(p.item_slots as i, p.slots as d))")
    placing = found.groupBy("key", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set(F.struct("item_pos", pairs.alias("pairs"))).alias("windows")
    )  # no more windows than the item has, but for rows that repeat a key
    placing = placing.withColumn("every", F.flatten("windows.pairs")).withColumn("pairs", F.array_distinct("every"))
    if not mixed_names:
        placing = placing.where("size(filter(pairs, p -> p.i & 1 = 1)) = size(array_distinct(transform(filter(pairs, p -> p.i & 1 = 1), p -> p.i)))")
    counted = placing.withColumn("counted", F.expr("transform(pairs, p -> struct(p.i as i, size(filter(every, q -> q = p)) as n, p.d as d))"))
    # pairs that another one with the same value of the item outdoes
    lost = "filter(counted, p -> exists(counted, q -> q.i = p.i and (q.n > p.n or q.n = p.n and q.d > p.d)))"
    placing = counted.withColumn("lost", F.expr(f"transform({lost}, p -> struct(p.i as i, p.d as d))"))
    placing = placing.withColumn("windows", F.expr("filter(windows, w -> not arrays_overlap(w.pairs, lost))"))
    placing = placing.withColumn("n_windows", F.size(F.array_distinct("windows.item_pos"))).withColumn("n_slots", F.size(F.array_distinct(F.flatten("windows.pairs"))))
    placing = placing.where("n_windows > 0").join(sizes, "item_id")
    placing = placing.where((F.col("n_windows") >= least_windows) | (F.col("n_windows") >= least_share * F.col("item_windows")))
    best = placing.groupBy("key", "item_id", "item_windows").agg(F.max(F.struct("n_windows", "n_slots")).alias("best"))
    return best.select(F.col("key").alias(key), "item_id", "best.n_windows", "item_windows", "best.n_slots")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mixed_names: bool = False) -> DataFrame:
    """The rows of docs whose text holds no benchmark item (see find_leaks), with all their columns. Texts are told apart by a 64-bit
    hash, so repeated and null doc_ids do no harm; a null text stays."""
    own = "__text_key"
    keyed = docs.withColumn(own, F.xxhash64("text"))
    leaks = find_leaks(keyed, benchmark, own, mixed_names=mixed_names).select(own).distinct()
    return keyed.join(leaks, own, "left_anti").drop(own).select(*docs.columns)


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, bench, mixed_names=True)


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
