"""Batched k-means (J2): all numbers of clusters and all restarts advance together.

Each iteration is one pass over the rows: a task assigns its rows to the centroids of every
unfinished run and gives the sums and counts per (run, cluster) as one packed row. These are
summed in groups and then over the groups, so the driver only sees numbers per run, cluster and
feature. Runs that no longer move leave the pass.

Starting centroids are drawn by k-means++ from a hash sample of about ``SEED_ROWS`` rows (a
documented bound on the seeding alone; assignment, sums and inertia read all rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_ROWS = 10_000
TOLERANCE = 1e-4
ROWS = 4096


def seeding_sample(df: DataFrame, features: str, seed: int) -> np.ndarray:
    """Rows of the sample, in an order that does not depend on the partitioning."""
    n = df.count()
    h = F.pmod(F.xxhash64(vector_to_array(F.col(features)), F.lit(seed)), F.lit(1 << 40))
    rows = df.select(vector_to_array(F.col(features)).alias("x"), h.alias("h"))
    if n > SEED_ROWS:
        rows = rows.where(F.col("h") < int((1 << 40) * SEED_ROWS / n))
    got = sorted((r.h, list(r.x)) for r in rows.collect())
    return np.array([x for _, x in got], float)


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ centroids among the rows of ``x``."""
    rng = np.random.default_rng([seed, k])
    picked = [x[rng.integers(len(x))]]
    near = ((x - picked[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = near.sum()
        i = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        picked.append(x[i])
        near = np.minimum(near, ((x - x[i]) ** 2).sum(axis=1))
    return np.array(picked)


def assigned_sums(x: np.ndarray, centers: list[np.ndarray]) -> np.ndarray:
    """Per run and cluster: sums of the features, number of rows and squared distances."""
    out = []
    for c in centers:
        total = np.zeros((len(c), x.shape[1] + 2))
        for s in range(0, len(x), ROWS):
            part = x[s:s + ROWS]
            d = ((part[:, None] - c) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            rows = np.column_stack([part, np.ones(len(part)), d[np.arange(len(part)), at]])
            for j in range(len(c)):
                total[j] += rows[at == j].sum(axis=0)
        out.append(total.ravel())
    return np.concatenate(out)


def _pass(df: DataFrame, features: str, centers: list[np.ndarray]) -> list[np.ndarray]:
    groups = max(1, int(df.rdd.getNumPartitions() ** 0.5))
    shared = df.sparkSession.sparkContext.broadcast(centers)
    width = centers[0].shape[1]

    def run(batches):
        total, task = 0.0, TaskContext.get().partitionId()
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total = total + assigned_sums(x, shared.value)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array([task % groups]), pa.array([task]), pa.array([total.tobytes()], pa.binary())],
                names=["g", "task", "v"])

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = sum(np.frombuffer(v) for v in rows.column("v").to_pylist())
        return pa.table({"g": rows.column("g")[:1], "v": [total.tobytes()]})
    got = (df.select(vector_to_array(F.col(features)).alias("x")).mapInArrow(run, "g long, task long, v binary")
           .groupBy("g").applyInArrow(add, "g long, v binary").orderBy("g").collect())
    flat = sum(np.frombuffer(r.v) for r in got)
    sizes = np.cumsum([c.shape[0] * (width + 2) for c in centers])[:-1]
    return [p.reshape(-1, width + 2) for p in np.split(flat, sizes)]


def batched_kmeans(df: DataFrame, runs: list[tuple[int, int]], features: str = "scaled",
                   max_iter: int = 50, seed: int = 42) -> list[tuple[np.ndarray, float]]:
    """(centroids, inertia) of every (k, restart seed) run over all rows of ``df``. A cluster
    that loses all rows keeps its centroid."""
    sample = seeding_sample(df, features, seed)
    if not len(sample):
        return [(np.empty((0, 0)), 0.0) for _ in runs]
    centers = [plus_plus(sample, k, s) for k, s in runs]
    live = list(range(len(runs)))
    for _ in range(max_iter):
        if not live:
            break
        moving = []
        for i, sums in zip(live, _pass(df, features, [centers[i] for i in live])):
            n = sums[:, -2:-1]
            new = np.where(n > 0, sums[:, :-2] / np.maximum(n, 1), centers[i])
            if ((new - centers[i]) ** 2).sum(axis=1).max() > TOLERANCE ** 2:
                moving.append(i)
            centers[i] = new
        live = moving
    last = _pass(df, features, centers)
    return [(c, float(s[:, -1].sum())) for c, s in zip(centers, last)]
