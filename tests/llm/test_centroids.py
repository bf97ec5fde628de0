"""Clusters by bounds against distances of all pairs."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import centroids, queries


def brute(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(x * scale) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((square(v, c), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(now)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                now[j] = [sum(x) // len(members) for x in zip(*members)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, o in got if o == j) for j in range(len(now))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted((-1 if i is None else i, j, d, inertia[j], sum(inertia), sha[j]) for i, d, j in got)


def found(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_same_as_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(queries.op12_centroids(spark, sf)) == brute(rows, 16, 3, 64, 64)


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_repeated_rows(spark, seed):
    """Components of so few values that most distances tie."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(150)]
    rows += rows[:20] + [(900 + i, rows[0][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert found(centroids.digests(df, 6, 3, 3, 1)) == brute(rows, 6, 3, 3, 1)


def test_bounds_spare_distances(spark):
    """Far groups need few distances in the last pass; the given vectors, which are not in groups, still fewer than all."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in 1000 * (np.arange(3) == i % 3) + rng.normal(size=3)]) for i in range(600)]
    got, _ = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 3, 3, 1)
    assert got.agg(F.avg("computed")).first()[0] < 2
    got = centroids.digests(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    assert got.agg(F.avg("computed")).first()[0] < 14


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [2.0, 2.0]), (7, [-0.01, 3.0]), (7, [-0.01, 3.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("v", "cluster", "part", "n", "sums", "distance", "upper")})
    got = found(centroids.digests(df, 2, 3, 2, 64))
    assert [x[0] for x in got] == [-1, 1, 7, 7]
    assert found(centroids.digests(df, 50, 3, 2, 64))[0][0] == -1
    assert found(centroids.digests(df.limit(0), 2, 3, 2, 64)) == []
    with pytest.raises(Exception, match="too large"):
        found(centroids.digests(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>"), 2, 3, 2, 64))
