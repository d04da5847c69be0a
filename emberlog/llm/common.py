"""Shared helpers of the training-data operators: durable intermediate tables and vectorised text work."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at a time in a task; temporary arrays take about a hundred times as much.
CHUNK = 1 << 19
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share. Where that is unset, a local
    master (as in tests) takes a folder below the warehouse; on a cluster it is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return f"{top.rstrip('/')}/emberlog/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results of operators read some of them until they are written."""
    _delete(spark, shared_dir(spark))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and return a scan of it.

    This cuts the lineage: an executor lost later costs a re-read only. The shuffle files of the write are released
    as it ends, so that the phases of an operator do not add up on disk; the setting for this holds for the session
    while the write runs, which costs other queries at that time a stage that they would have used again, at most.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what saved() wrote for frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_saved_at", None):
            _delete(df.sparkSession, path)


# ---- numpy over the bytes of Arrow string columns

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U)
_LONG = 128
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string or binary array, without copying; nulls are empty."""
    import pyarrow as pa

    if pa.types.is_string_view(column.type) or not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_string() if not pa.types.is_large_binary(column.type) else pa.large_binary())
    wide = np.int64 if str(column.type).startswith("large") else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(column, size: int = CHUNK):
    """Slices of the column of about size bytes, as (first row, end row, offsets from 0, padded bytes)."""
    at, data = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        own = np.zeros(at[end] - at[row] + 64, np.uint8)
        own[: at[end] - at[row]] = data[at[row] : at[end]]
        yield row, end, at[row : end + 1] - at[row], own
        row = end


def words_of(offsets: np.ndarray, data: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a chunk, and the first word of each document (one more entry than documents).

    gap: for each byte value, whether it separates words. Words never cross documents.
    """
    n = int(offsets[-1])
    word = ~gap[data[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one little-endian number."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words data[start:end]. data has 8 bytes of padding at least."""
    size = ends - starts
    at8, h = eights(data), mix((size + seed).astype(U) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019))
    live = np.arange(len(size))
    long = np.flatnonzero(size > _LONG)
    if len(long):
        live = np.flatnonzero(size <= _LONG)
    k = 0
    while len(live):
        rest = size[live] - k
        if k:
            live, rest = live[rest > 0], rest[rest > 0]
            if not len(live):
                break
        x = at8[starts[live] + k] & _MASKS[np.minimum(rest, 8)]
        g = (h[live] ^ x) * U(0x9FB21C651E98DF25)
        h[live] = g ^ (g >> U(32))
        k += 8
    out = mix(h)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverses modulo 2^64, for i < n; base is odd."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1, U)
            while len(p) < n:
                p = np.concatenate([p, p * U(pow(b, len(p), 1 << 64))])
            both.append(p)
        _powers[base] = tuple(both)
    return _powers[base][0][:n], _powers[base][1][:n]


class Rolling:
    """Hashes of any runs of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])
