"""Centroid clustering of integer vectors with Elkan's bounds.

Every vector carries, from round to round, an upper bound of the distance to its centroid and a lower bound of the distance
to each centroid. When centroids move, the bounds move with them. A distance is computed only where no bound rules
the centroid out: its lower bound, or half the distance between it and the vector's centroid, must not exceed the
upper bound. Bounds are rounded away from what they bound and ruling out is strict, so that equal distances are always compared as
integers and the smaller number wins.

A round is one pass over the vectors: each task assigns its vectors in numpy, hands on vectors and bounds, and sums its
members of each centroid, so that only k rows a task meet for the next centroids. Rounds are cut by tables in the shared
folder; a lost task is computed from the former round's table.

Defined results: vectors that are null, of another length, or hold a null or a number that is not finite are left out;
repeated rows are vectors of their own; of equal hashes the smaller vector starts first, ids that are null last; fewer
vectors than k start as many centroids; no vector at all gives no row. Squared distances of components of 2^28 or more don't fit a
long: they end the query with an error. Further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DIMS, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Components below this have squared distances below 2^63: 64 * (2 * 2^27)^2 = 2^62.
MOST = 1 << 27
_UP, _DOWN = np.float32(np.inf), np.float32(0)
_STATE = "part int, vec_id long, v array<int>, cluster int, upper float, lower array<float>, computed int, n long, sums array<long>"


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the kept vectors as integers floor(scale * x)."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size("embedding") == dims) & fine)
    scaled = F.transform(e, lambda x: F.floor(x * scale) if scale != 1 else F.floor(x))
    ok = F.forall(e, lambda x: F.abs(x * scale) < MOST)
    v = F.when(ok, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"components of {MOST} or more are too large")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(ints: DataFrame, k: int = K, dims: int = DIMS) -> np.ndarray:
    """The k vectors whose ids hash lowest."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = ints.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), dims)


def _low(x: np.ndarray) -> np.ndarray:
    """Float32 numbers below x (of at least 0), by more than the error of the computation that gave x."""
    y = (np.asarray(x, dtype=np.float64) * (1 - 1e-12)).astype(np.float32)
    return np.maximum(np.nextafter(y, -_UP), _DOWN)


def _high(x: np.ndarray) -> np.ndarray:
    """Float32 numbers above x."""
    return np.nextafter((np.asarray(x, dtype=np.float64) * (1 + 1e-12)).astype(np.float32), _UP)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """The centroids of one round and what follows from them: halves of their distances and how far each has moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        d = np.array([_squared(now, c) for c in now], dtype=np.float64).reshape(len(now), len(now))
        self.half = _low(np.sqrt(d) / 2)
        far = self.half.copy()
        np.fill_diagonal(far, _UP)
        self.nearest = far.min(axis=1, initial=_UP)
        self.moved = None if before is None else _high(np.sqrt(_squared(now, before).astype(np.float64)))

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Clusters, bounds and the number of distances computed for each vector."""
        if self.moved is not None:
            upper = _high(upper.astype(np.float64) + self.moved[cluster])
            lower = _low(np.maximum(lower.astype(np.float64) - self.moved, 0))
        cluster, computed = cluster.copy(), np.zeros(len(v), dtype=np.int32)
        at = np.flatnonzero(~(upper < self.nearest[cluster]))  # for all others no centroid can be as near as their own
        best = _squared(v[at], self.now[cluster[at]])
        computed[at] += 1
        root = np.sqrt(best.astype(np.float64))
        upper[at], lower[at, cluster[at]] = _high(root), _low(root)
        for j in range(len(self.now)):
            own = cluster[at]
            ask = np.flatnonzero((own != j) & ~(lower[at, j] > upper[at]) & ~(self.half[own, j] > upper[at]))
            rows = at[ask]
            d = _squared(v[rows], self.now[j])
            computed[rows] += 1
            root = np.sqrt(d.astype(np.float64))
            lower[rows, j] = _low(root)
            won = (d < best[ask]) | ((d == best[ask]) & (j < cluster[rows]))
            best[ask[won]], cluster[rows[won]], upper[rows[won]] = d[won], j, _high(root[won])
        return cluster, upper, lower, computed


def _matrix(column: pd.Series, width: int, kind: type) -> np.ndarray:
    return np.concatenate(column.to_numpy()).astype(kind).reshape(-1, width) if len(column) else np.zeros((0, width), kind)


def assign_round(state: DataFrame, round_: Centroids, first: bool) -> DataFrame:
    """One pass: part 0 has the vectors with their new clusters and bounds, part 1 each task's counts and sums."""
    k, dims = round_.now.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for pdf in batches:
            v = _matrix(pdf["v"], dims, np.int64)
            if first:
                bounds = np.zeros(len(v), np.int32), np.full(len(v), _UP), np.zeros((len(v), k), np.float32)
            else:
                bounds = pdf["cluster"].to_numpy(np.int32), pdf["upper"].to_numpy(np.float32), _matrix(pdf["lower"], k, np.float32)
            cluster, upper, lower, computed = round_.assign(v, *bounds)
            counts += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, v)
            yield pd.DataFrame({"part": 0, "vec_id": pdf["vec_id"].array, "v": pdf["v"].array, "cluster": cluster, "upper": upper, "lower": list(lower), "computed": computed, "n": None, "sums": None})
        yield pd.DataFrame({"part": 1, "vec_id": None, "v": None, "cluster": np.arange(k, dtype=np.int32), "upper": None, "lower": None, "computed": None, "n": counts, "sums": list(sums)})

    if first:
        return state.select("vec_id", "v").mapInPandas(run, _STATE)
    return state.select("vec_id", "v", "cluster", "upper", "lower").mapInPandas(run, _STATE)


def next_centroids(sums: DataFrame, now: np.ndarray) -> np.ndarray:
    """The floors of the means, exactly; an empty centroid stays. k rows of dims sums come to the driver."""
    whole = sums.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(now.shape[1])])
    out = now.copy()
    for r in whole.where("n > 0").collect():
        out[r.cluster] = [int(r[f"s{i}"]) // int(r.n) for i in range(now.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, computed: distances computed in the last pass) and the final centroids."""
    ints = integer_vectors(vectors, dims, scale)
    now = first_centroids(ints, k, dims)
    if not len(now):
        return ints.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("computed")).limit(0), now
    state, round_ = ints, Centroids(now)
    for i in range(rounds + 1):
        table = cut(assign_round(state, round_, first=i == 0), by="part")
        state = table.where("part = 0")
        if i < rounds:
            after = next_centroids(table.where("part = 1").select("cluster", "n", "sums"), round_.now)
            round_ = Centroids(after, round_.now)
    own = F.element_at(F.lit(round_.now.tolist()), F.col("cluster") + 1)
    square = F.aggregate(F.zip_with("v", own, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return state.select("vec_id", "cluster", square.alias("distance"), "computed"), round_.now


def digests(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed."""
    got, now = cluster(vectors, k, rounds, dims, scale)
    sums = {r.cluster: int(r.s) for r in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    each = F.lit([sums.get(j, 0) for j in range(len(now))] or [0]).cast("array<long>")
    return got.select(
        "vec_id", "cluster", "distance", F.element_at(each, F.col("cluster") + 1).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.element_at(F.lit(names or [""]), F.col("cluster") + 1).alias("centroid_sha256"), "computed",
    )


def oracle_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """digests() but for `computed` in DuckDB's SQL: every distance of every round."""
    square = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} as (select r, arg_min(struct_pack(c := c.c, d := {square}), struct_pack(d := {square}, c := c.c)) as best from v, c{i} c group by r)")
        if i < rounds:
            steps.append(f"""s{i} as (select c, i, sum(x)::bigint as s, count(*)::bigint as n from (select best.c as c, unnest(v) as x, generate_subscripts(v, 1) as i from v join a{i} using (r)) group by c, i),
n{i} as (select c, list((s - ((s % n) + n) % n) // n order by i) as v from s{i} group by c),
c{i + 1} as (select c, coalesce(n{i}.v, c{i}.v) as v from c{i} left join n{i} using (c))""")
    return f"""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {dims}),
c0 as (select (row_number() over (order by sha256('1:' || vec_id), v) - 1)::int as c, v from v qualify row_number() over (order by sha256('1:' || vec_id), v) <= {k}),
{", ".join(steps)},
o as (select vec_id, best.c as cluster, best.d as distance from v join a{rounds} using (r))
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from o join c{rounds} c on c.c = cluster"""
