"""Batched k-means against known centres, plain Lloyd steps and Spark's k-means."""

import math

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors

from riskloom.operators import lloyd

CENTRES = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0], [10.0, 10.0]])


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([c + rng.normal(0, 0.5, (60, 2)) for c in CENTRES])
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x.tolist()], ["scaled"]).repartition(5).persist()
    yield x, df
    df.unpersist()


def test_known_centres_and_inertia(points):
    x, df = points
    runs = [(4, s) for s in range(6)] + [(2, 1), (7, 1)]
    got = lloyd.batched_kmeans(df, runs)
    centers, cost = min(got[:6], key=lambda r: r[1])
    near = ((CENTRES[:, None] - centers) ** 2).sum(axis=2)
    assert sorted(near.argmin(axis=1)) == [0, 1, 2, 3] and near.min(axis=1).max() < 0.1
    for (k, _), (c, inertia) in zip(runs, got):
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        assert c.shape == (k, 2) and math.isclose(inertia, d.min(axis=1).sum(), rel_tol=1e-9)
        # Converged: a centroid is the mean of its rows.
        at = d.argmin(axis=1)
        assert all(np.allclose(c[j], x[at == j].mean(axis=0), atol=1e-3) for j in set(at.tolist()))
    theirs = min(KMeans(k=4, seed=s, featuresCol="scaled").fit(df).summary.trainingCost for s in range(3))
    assert cost <= theirs * (1 + 1e-6)


def test_result_does_not_depend_on_partitions(points):
    _, df = points
    a = lloyd.batched_kmeans(df, [(3, 5)])
    b = lloyd.batched_kmeans(df.repartition(2), [(3, 5)])
    assert np.allclose(a[0][0], b[0][0]) and math.isclose(a[0][1], b[0][1])


def test_more_clusters_than_points_and_empty(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)] * 3, ["scaled"])
    (c, cost), = lloyd.batched_kmeans(df, [(2, 0)])
    assert cost == 0 and c.shape == (2, 2)
    assert lloyd.batched_kmeans(df.limit(0), [(2, 0)])[0][1] == 0
