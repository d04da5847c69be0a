"""Centroid clustering: Lloyd's rounds with Elkan's bounds, which skip distances without changing any assignment."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved

#: Components beyond this are taken for it; a distance to any vector that is not as far out would leave the longs anyway.
LIMIT = 1 << 62
LONG = (1 << 63) - 1
#: Vectors whose distances are worked on at a time in a task.
ROWS = 4_096


def quantised(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (floor of scale times each component, as double) of the vectors of dims components, all of them finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = float(LIMIT)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most))).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[tuple[int, ...]]:
    """The vectors with the k smallest SHA-256 of `seed:vec_id`, in that order; those of one id by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    best = rows.where("vec_id is not null").select(order.alias("key"), "v").orderBy("key", "v").limit(k)
    return [tuple(r.v) for r in best.collect()]


def squared(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Exact squared distances of the rows of a from those of b, or from the one row b. wide: they may leave the longs, and
    are whole numbers of any size, as objects."""
    d = a.astype(object) - b.astype(object) if wide else a - b
    return (d * d).sum(axis=-1) if wide else np.einsum("...i,...i->...", d, d)


def below(x: np.ndarray) -> np.ndarray:
    """Doubles that are not over the square roots of the whole numbers x."""
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(x.astype(float)), -np.inf), -np.inf), 0.0)


def above(x: np.ndarray) -> np.ndarray:
    """Doubles that are not under the square roots of the whole numbers x."""
    return np.nextafter(np.nextafter(np.sqrt(x.astype(float)), np.inf), np.inf)


def _float_below(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


class Round:
    """One round: the centroids, their distances from each other, and how far each has moved since the round before."""

    def __init__(self, now: list[tuple[int, ...]], before: list[tuple[int, ...]] | None, wide: bool):
        self.now, self.wide, k = np.array(now, dtype=np.int64), wide, len(now)
        self.half = below(np.array([squared(self.now, c, wide) for c in self.now])) / 2
        self.nearest = np.where(np.eye(k, dtype=bool), np.inf, self.half).min(axis=1)
        if before is not None:
            old = np.array(before, dtype=np.int64)
            self.moved = np.where((old != self.now).any(axis=1), above(squared(self.now, old, wide)), 0.0)

    def assign(self, v: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, final: bool):
        """cluster, squared distance (of all rows if final, else of those looked at), upper and lower bounds and the number
        of distances computed, for each row of v. state: cluster, upper and lower of the round before.

        A centroid is skipped only if the row's upper bound is strictly below the centroid's lower bound or half the
        distance of the two centroids: then it is further away than the row's own one. So ties are always computed, and
        the smaller number wins them. Whatever is computed is compared by exact whole numbers.
        """
        n, k = len(v), len(self.now)
        if state is None:
            cluster, upper, lower, look = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k)), np.arange(n)
        else:
            cluster, upper, lower = state
            upper = np.nextafter(upper + self.moved[cluster], np.inf)
            lower = np.maximum(np.nextafter(lower.astype(float) - self.moved, -np.inf), 0.0)
            look = np.flatnonzero(~(upper < self.nearest[cluster]))
            rival = ~(upper[look, None] < np.maximum(lower[look], self.half[cluster[look]]))
            rival[np.arange(len(look)), cluster[look]] = False
            look = look[rival.any(axis=1)]
        best, spent = np.zeros(n, object if self.wide else np.int64), np.zeros(n, np.int64)
        tight = np.arange(n) if final else look
        best[tight] = squared(v[tight], self.now[cluster[tight]], self.wide)
        upper[tight], lower[tight, cluster[tight]] = above(best[tight]), below(best[tight])
        spent[tight] = 1
        for j in range(k):
            at = look[(cluster[look] != j) & ~(upper[look] < lower[look, j]) & ~(upper[look] < self.half[cluster[look], j])]
            d = squared(v[at], self.now[j], self.wide)
            lower[at, j] = below(d)
            spent[at] += 1
            wins = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
            won = at[wins]
            cluster[won], best[won] = j, d[wins]
            upper[won] = above(best[won])
        return cluster, best, upper, _float_below(lower), spent


STATE = "vec_id long, v array<long>, cluster int, computed long, upper double, lower array<float>"
FINAL = "vec_id long, cluster int, distance long, computed long"


def _pass(now: list[tuple[int, ...]], before: list[tuple[int, ...]] | None, wide: bool, final: bool = False):
    def run(batches):
        import pyarrow as pa

        this, k = Round(now, before, wide), len(now)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                state, spent = None, 0
                if before is not None:
                    lower = b.column(5).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
                    state, spent = (b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy(), lower), b.column(3).to_numpy()
                cluster, best, upper, lower, more = this.assign(v, state, final)
                cluster, spent = pa.array(cluster, pa.int32()), pa.array(more + spent, pa.int64())
                if final:
                    best = np.minimum(best, LONG).astype(np.int64) if wide else best
                    yield pa.record_batch([b.column(0), cluster, pa.array(best), spent], names=["vec_id", "cluster", "distance", "computed"])
                else:
                    lower = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, k), pa.int32()), pa.array(lower.ravel(), pa.float32()))
                    yield pa.record_batch([b.column(0), b.column(1), cluster, spent, pa.array(upper), lower], names=["vec_id", "v", "cluster", "computed", "upper", "lower"])

    return run


def moved_centroids(state: DataFrame, centroids: list[tuple[int, ...]], wide: bool) -> list[tuple[int, ...]]:
    """The floors of the means of each centroid's vectors; a centroid without any stays. Sums are exact: longs, or decimals
    where those could overflow. A row for each centroid comes to the driver."""
    number = "decimal(38,0)" if wide else "long"
    sums = [F.sum(F.col("v")[i].cast(number)).alias(f"s{i}") for i in range(len(centroids[0]))]
    out = list(centroids)
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r.cluster] = tuple(int(x) // r.n for x in r[2:])
    return out


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[tuple[int, ...]]]:
    """vec_id, cluster, distance (squared, from its centroid), computed (distances computed for it in all rounds) of every
    vector that takes part (see quantised), and the final centroids.

    Each round assigns every vector to its nearest centroid, the smaller number on a tie, and moves each centroid to the
    floor of its vectors' mean; at the end vectors are assigned once more. A vector's state, an upper bound for its own
    centroid and a lower one for each of the k, travels with it from round to round as a written table, the one before
    is deleted; bounds are rounded away from the distance and tests are strict, so that assignments are those of all
    distances. Centroids go with the tasks: k times dims whole numbers.

    Rows whose id is null take part, but are no first centroids. Repeated ids are vectors of their own. With fewer than k
    vectors with ids there are as many centroids; with none, no rows. Distances are exact; one beyond the longs is given
    as the largest long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    state = rows = saved(quantised(vectors, dims, scale, id_col, vector_col), "cluster-vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, computed long"), []
    n, most = rows.agg(F.count("*"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    wide, before = 4 * dims * most * most > LONG, None
    for _ in range(rounds):
        state, old = saved(state.mapInArrow(_pass(centroids, before, wide), STATE), "cluster-state"), state
        release(old)
        before, centroids = centroids, moved_centroids(state, centroids, n * most > LONG)
    final = saved(state.mapInArrow(_pass(centroids, before, wide, final=True), FINAL), "cluster-final")
    release(state)
    return final, centroids


def clustering_digest(clustered: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    """clustered with cluster_inertia, inertia (sums of distances, the largest long if beyond it) and centroid_sha256."""
    per = clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    sums = {r.cluster: int(r["sum"]) for r in per.collect()}  # a row for each centroid
    total = min(LONG, sum(sums.values()))
    facts = [(j, min(LONG, s), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, s in sorted(sums.items())]
    facts = clustered.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(facts), "cluster")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    clustered, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return clustering_digest(clustered, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}


def _twin(rounds: int) -> str:
    """All distances of all rounds."""
    parts = [
        """rows as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        """first as (select v, row_number() over (order by sha256('1:' || vec_id::varchar), v) - 1 as c from rows where vec_id is not null)""",
        "flat as materialized (select r, unnest(v) as x, generate_subscripts(v, 1) as i from rows)",
        "c0 as materialized (select c, unnest(v) as x, generate_subscripts(v, 1) as i from first where c < 16)",
    ]
    for t in range(rounds + 1):
        parts.append(f"d{t} as (select r, c, sum((f.x - m.x) * (f.x - m.x))::bigint as d from flat f join c{t} m using (i) group by r, c)")
        parts.append(f"a{t} as materialized (select r, c, d from (select *, row_number() over (partition by r order by d, c) as n from d{t}) where n = 1)")
        if t < rounds:
            parts.append(f"m{t} as (select c, i, sum(x)::bigint as s, count(*) as n from flat join a{t} using (r) group by c, i)")
            parts.append(f"c{t + 1} as materialized (select c, i, case when n is null then x else (s - ((s % n) + n) % n) // n end as x from c{t} left join m{t} using (c, i))")
    return f"""with {', '.join(parts)},
hashes as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by c)
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256
from a{rounds} join rows using (r) join hashes using (c)"""


ORACLES = {"op13_centroid_clustering": _twin(3)}
