"""Exact top-k search by inner product with a three-phase uniform threshold."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, saved

#: Rows of a stripe, queries of a round and queries worked on at a time, at most, about. A stripe has fewer rows where there
#: would be too few stripes for the cores.
CELL_ROWS, CELL_QUERIES, BLOCK = 32_768, 65_536, 256
LEAST_ROWS = 1_024
#: Of so many stripes one takes part in the first phase.
FIRST = 16
#: Components beyond this are taken for it: with any other component of 2 or more the score would leave the longs.
LIMIT = 1 << 62
LONG = (1 << 63) - 1
FOUND = "query long, vec long, tie long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v (floor of scale times each component, as double) of the rows that take part: neither the id nor the
    vector nor a component is null, and all components are finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = float(LIMIT)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most))).cast("long")).alias("v"))


def _cells(queries: DataFrame, rows: DataFrame, stripes: int, step: int, kind: str) -> DataFrame:
    """Rows dealt out to stripes, every step-th of these, each with all queries: a row is sent once."""
    r = rows.withColumn("r", F.pmod(F.xxhash64("vec"), F.lit(stripes))).where(F.col("r") % step == 0)
    q = queries.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"), F.lit(step).cast("long"))))
    v = f"cast(v as array<{kind}>) v"
    return q.selectExpr("0 side", "r", "vec", "0L tie", v, "total").unionByName(r.selectExpr("1 side", "r", "vec", "tie", v, "0L total"))


def _top(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of whole-number rows of a and b, exactly; those beyond a long are the nearest long."""
    bound = a.shape[1] * _top(a) * _top(b)
    if bound < 1 << 53:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LONG, LONG).astype(np.int64)


def _matrix(table) -> np.ndarray:
    cells = table.column("v").combine_chunks()
    cells = cells.chunk(0) if hasattr(cells, "chunk") else cells
    at = np.asarray(cells.offsets)
    out = np.zeros((len(table), int(np.diff(at).max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(table)), np.diff(at))
    out[row, np.arange(at[0], at[-1]) - at[row]] = cells.flatten().to_numpy(zero_copy_only=False)
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == np.int64 else np.rint(x).astype(np.int64)


def _search(k: int, lists: int, size: int, first: bool):
    """Of each stripe and query: the k best totals of the rows that lead the lists (first); else the k best rows, with their
    totals, of those that reach the query's share of its cutoff in a list, and the cutoff as a whole."""
    step = max(1, -(-size // lists))

    def led(s):
        """Totals of the rows with the k best entries of each list; a row counts once."""
        m, at = min(k, s[0].shape[1]), np.arange(len(s[0]))[:, None]
        column = np.sort(np.concatenate([np.argpartition(x, x.shape[1] - m, axis=1)[:, -m:] for x in s], axis=1), axis=1)
        total = sum(_whole(x[at, column]) for x in s)
        total[:, 1:][column[:, 1:] == column[:, :-1]] = -LONG - 1
        return np.repeat(at.ravel(), m), np.sort(total, axis=1)[:, -m:].ravel()

    def reached(s, cutoff):
        each = (-(-cutoff // lists))[:, None].astype(s[0].dtype)
        hit = s[0] >= each
        for x in s[1:]:
            hit |= x >= each
        row, column = np.nonzero(hit)
        total = sum(_whole(x[row, column]) for x in s)
        keep = np.flatnonzero(total >= cutoff[row])
        keep = keep[np.lexsort((column[keep], -total[keep], row[keep]))]
        row, column, total = row[keep], column[keep], total[keep]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], column[keep], total[keep]

    def run(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        q, r = (table.filter(pc.equal(table.column("side"), i)) for i in (0, 1))
        out = []
        if len(q) and len(r):
            a, b = _matrix(q), _matrix(r)
            a, b = (np.pad(x, ((0, 0), (0, lists * step - x.shape[1]))) for x in (a, b))
            tie, vec = r.column("tie").to_numpy(), r.column("vec").to_numpy()
            order = np.lexsort((vec, tie))  # the smaller row id wins a tie
            b, tie, vec = b[order], tie[order], vec[order]
            cutoff, own = q.column("total").to_numpy(), q.column("vec").to_numpy()
            bound = a.shape[1] * _top(a) * _top(b)
            exact = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else None  # sums of whole numbers, none rounded
            if exact:
                a, b = a.astype(exact), b.astype(exact)
            block = BLOCK if exact else BLOCK // 16
            for i in range(0, len(q), block):
                parts = ((a[i : i + block, j : j + step], b[:, j : j + step]) for j in range(0, lists * step, step))
                s = [x @ y.T if exact else products(x, y) for x, y in parts]
                if first:
                    row, total = led(s)
                    out.append((own[i + row], total))
                else:
                    row, column, total = reached(s, cutoff[i : i + block])
                    out.append((own[i + row], vec[column], tie[column], total))
        names = ["query", "score"] if first else [f.split()[0] for f in FOUND.split(", ")]
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64) for _ in names]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _best(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "tie", "vec"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, query: str = "vec_id % 50 = 0", k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, lists: int = 2) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of highest integer inner product, its own row left
    out; all of them if there are fewer. Ties go to the smaller vec_id.

    query is a condition on vec_id. The components of all vectors are cut into `lists` ranges, and a range's inner
    product is a row's entry in that list. Phase one resolves the rows with the best entries of each of a query's lists, in
    one of FIRST stripes of the rows: the K-th best total is a cutoff that the result reaches, whatever the other stripes
    hold. Phase two takes all rows of all stripes with an entry that reaches cutoff / lists: a row without one is below the
    cutoff. Phase three resolves these and keeps those that reach the cutoff, of a stripe at most K for each query. All
    phases work where a stripe's vectors are, so that entries are not sent: what leaves a stripe are results.

    Queries are asked in rounds of bounded numbers, and in a round each row is sent to one stripe, with each of the round's
    queries: what a round puts on disk grows with the rows, not with their square, and goes before the next one. The work
    of all rounds is queries times rows. Equal vectors are searched for once, and as candidates only the k + 1 smallest ids
    of them can matter; that is exact. Rows that do not take part: see quantised. Repeated ids are rows of their own, each a
    query with its own result; vectors of different lengths meet as if padded with zeros. Sums are exact; a score beyond the
    longs is the nearest long, and components beyond 2^62 count as that. Other columns are ignored. An empty table gives no
    rows.
    """
    top = k + 1  # with the query's own row
    rows = quantised(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id())
    stored = rows = saved(rows.withColumn("vec_key", F.unhex(F.sha2(F.array_join("v", ","), 256))), "topk-rows")
    first = Window.partitionBy("vec_key").orderBy("vec_id", "row")
    candidates = kept = saved(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= top).drop("n"), "topk-candidates")
    # a class of equal vectors goes by the row of its smallest id; ties between classes too
    head = Window.partitionBy("vec_key")
    kept = kept.withColumn("tie", F.min("vec_id").over(head)).withColumn("vec", F.min_by("row", F.struct("vec_id", "row")).over(head))
    members = saved(kept.select("vec", "vec_id", "row"), "topk-members")
    classes = saved(kept.where("row = vec").select("vec", "vec_key", "v", "tie"), "topk-classes")
    asking = saved(rows.where(query).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "vec_key"), "topk-asking")
    release(stored, candidates)
    queries = saved(classes.join(asking.select("vec_key").distinct(), "vec_key", "left_semi").select("vec", "vec_key", "v"), "topk-queries")
    peak = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    size, n_rows, most = classes.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*"), F.coalesce(peak, F.lit(0))).first()
    kind = "short" if most < 1 << 15 else "int" if most < 1 << 31 else "long"
    if size * most * most > LONG // 4:  # sums of parts could leave the longs: one list, whose entries are the totals
        lists = 1
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    stripes = max(1, math.ceil(n_rows / CELL_ROWS), min(2 * cores, math.ceil(n_rows / LEAST_ROWS)))
    rounds = max(1, math.ceil(queries.count() / CELL_QUERIES))
    near = None
    for i in range(rounds):
        asked = queries.where(F.pmod(F.xxhash64("vec"), F.lit(rounds)) == i).select("vec", "v")

        def phase(asked: DataFrame, first: bool, step: int, schema: str) -> DataFrame:
            return _cells(asked, classes, stripes, step, kind).groupBy("r").applyInArrow(_search(top, lists, size, first), schema)

        led = phase(asked.withColumn("total", F.lit(0).cast("long")), True, FIRST, "query long, score long")
        least = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        cutoff = saved(led.withColumn("rank", least).where(F.col("rank") == top).select(F.col("query").alias("vec"), F.col("score").alias("total")), "topk-cutoffs")
        # fewer classes than top in those stripes: no cutoff
        asked = asked.join(cutoff, "vec", "left").withColumn("total", F.coalesce("total", F.lit(-LONG)))
        found = saved(_best(phase(asked, False, 1, FOUND), top, ["query"]).select("query", "vec", "score"), "topk-found")
        release(cutoff)
        near = found if near is None else near.unionByName(found)
    # classes back to rows: at most top classes of at most top rows each
    hits = near.join(members, "vec").withColumn("tie", F.col("vec_id"))
    hits = _best(hits.select("query", "score", "vec_id", "tie", F.col("row").alias("vec")), top, ["query"])
    hits = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "vec", "score"))).alias("hits"))
    by_query = asking.join(queries.select("vec_key", F.col("vec").alias("query")), "vec_key").join(hits, "query")
    out = by_query.select("query_id", F.posexplode(F.expr(f"slice(filter(hits, h -> h.vec <> query_row), 1, {k})")).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op3_exact_top_k": op3_exact_top_k}
ORACLES = {
    "op3_exact_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""
}
