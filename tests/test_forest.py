"""The forest over blocks: its parts against loops, the whole against Spark's forest."""

import itertools

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import classify
from riskloom.operators import forest as T

from test_boosting import frame, small

BINS = [5, 40, 3, 2, 7]


def rows(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, b, n) for b in BINS], 1).astype(np.uint8)
    return rng, x, rng.integers(0, 3, n), rng.random(n)


def tree(rng, levels):
    n = max(1, (1 << levels) - 1)
    left = rng.random((n, 40)) < 0.5
    left[rng.random(n) < 0.2] = True  # nodes that are not split
    return rng.integers(0, len(BINS), n), left


def walked(x, feature, left, levels):
    at = np.zeros(len(x), int)
    for level in range(levels):
        node = (1 << level) - 1 + at
        at = 2 * at + ~left[node, x[np.arange(len(x)), feature[node]]]
    return at


@pytest.mark.parametrize("levels", [0, 1, 4, 6, 8])
def test_places_equal_a_walk(levels):
    rng, x, _, _ = rows()
    feature, left = tree(rng, levels)
    for cells in (0, 100, 4096):
        codes = B.Codes(x, BINS, cells)
        assert sorted(f for g in codes.groups for f in g) == list(range(len(BINS)))
        assert np.array_equal(codes.places(feature, left, levels), walked(x, feature, left, levels))


def test_sums_of_a_tree_equal_loops():
    rng, x, y, w = rows()
    feature, left = tree(rng, 2)
    counts = rng.integers(0, 3, len(y)).astype(np.uint8)
    nodes = np.array([0, 2, 3])  # node 1 is a leaf
    slot = np.array([0, -1, 1, 2])
    picks = T.picked(1, 0, 2, nodes, len(BINS))
    assert all(len(set(p)) == 3 for p in picks.tolist())
    got = T.tree_sums(B.Codes(x, BINS), y, w, counts, slot, picks, feature, left, 2, BINS, 3)
    starts, size = T.layout(picks, BINS, 3)
    assert size == len(got) == sum(BINS[f] * 3 for f in picks.ravel())
    at = walked(x, feature, left, 2)
    for i, node in enumerate(nodes):
        for j, f in enumerate(picks[i]):
            want = np.zeros((BINS[f], 3))
            for r in np.flatnonzero(at == node):
                want[x[r, f], y[r]] += w[r] * counts[r]
            assert np.allclose(got[starts[i, j]:starts[i, j] + BINS[f] * 3].reshape(-1, 3), want)


@pytest.mark.parametrize("kind", ["number", "ordered", "subsets"])
def test_splits_equal_all_cuts(kind):
    rng = np.random.default_rng(3)
    h = rng.random((6, 4, 3)) * (rng.random((6, 4, 1)) < 0.8)  # some bins are empty

    def gini(c):
        return 1 - ((c / c.sum()) ** 2).sum()
    gain, goes, sums = T.feature_splits(h, kind)
    for i, one in enumerate(h):
        if kind == "subsets":
            sets = [s for n in range(1, 4) for s in itertools.combinations(range(4), n)]
        else:
            order = sorted(range(4), key=lambda b: (gini(one[b]) if one[b].sum() else 9) * (kind == "ordered"))
            sets = [order[:n] for n in range(1, 4)]
        total, best = one.sum(0), -np.inf
        for s in sets:
            left = one[list(s)].sum(0)
            right = total - left
            if left.sum() > 1e-9 and right.sum() > 1e-9:
                best = max(best, gini(total) - (left.sum() * gini(left) + right.sum() * gini(right)) / total.sum())
        assert np.isclose(gain[i], best) and np.allclose(one[goes[i]].sum(0), sums[i])


def test_counts_are_poisson():
    share = [(T.COUNTS == i).mean() for i in range(4)]
    assert np.allclose(share, [0.36788, 0.36788, 0.18394, 0.06131], atol=2e-5) and T.COUNTS.mean() == pytest.approx(1, abs=1e-4)


def test_leaves_of_one_class_are_merged():
    feature, left = np.zeros((1, 3), np.uint8), np.zeros((1, 3, 2), bool)
    left[:, :, 0] = True
    sums = np.array([[[6, 4], [5, 1], [1, 3], [3, 0], [2, 1], [1, 0], [0, 3]]], float)
    split = np.array([[True, True, True, False, False, False, False]])
    left, leaf = T._leaves(feature, left, sums, split, 2)
    # Both children of node 1 say class 0; those of node 2 differ.
    assert left[0, 1].all() and not left[0, 2].all()
    assert np.allclose(leaf[0], [[5 / 6, 1 / 6], [0, 0], [1, 0], [0, 1]])


def test_forest_of_many_blocks_is_as_good_as_sparks(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    x, y, w = small(3000, seed=5)
    df = frame(spark, x, y, w)
    train, test = df.filter(F.col("record_id") % 3 > 0), df.filter(F.col("record_id") % 3 == 0)
    f, cuts = T.fit(train, "target", 3, "weight", "record_id", trees=60, depth=5, block_rows=300)
    ours = T.model_of(f, cuts).transform(test).select("target", "p").toPandas()
    m = RandomForestClassifier(labelCol="target", weightCol="weight", numTrees=60, maxDepth=5, maxBins=64).fit(train)
    sparks = m.transform(test).select("target", vector_to_array("probability").alias("p")).toPandas()

    def loss(t):
        return -np.mean([np.log(max(p[c], 1e-9)) for c, p in zip(t.target, t.p)])
    assert np.allclose([sum(p) for p in ours.p], 1)
    assert loss(ours) == pytest.approx(loss(sparks), rel=0.05)
    again, _ = T.fit(train, "target", 3, "weight", "record_id", trees=60, depth=5, block_rows=300)
    assert np.array_equal(again.feature, f.feature) and np.allclose(again.leaf, f.leaf)


def test_trees_in_several_jobs_are_the_same(spark, monkeypatch):
    x, y, w = small(500, seed=6)
    df = frame(spark, x, y, w)
    one, _ = T.fit(df, "target", 3, "weight", "record_id", trees=7, depth=4, block_rows=100)
    monkeypatch.setattr(T, "HIST_MB", 0)  # one tree a job
    many, _ = T.fit(df, "target", 3, "weight", "record_id", trees=7, depth=4, block_rows=100)
    assert np.array_equal(one.feature, many.feature) and np.allclose(one.leaf, many.leaf)


def test_large_tables_take_the_block_forest(spark, monkeypatch, workdir):
    """Categories and numbers, saved and loaded; an unseen category is scored."""
    monkeypatch.setattr(T, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(8)
    data = [(i, float(rng.integers(0, 50)), "abcd"[rng.integers(0, 4)], 1.0) for i in range(800)]
    data = [(i, a, c, int(a > 25) + 2 * (c in "bd"), w) for i, a, c, w in data]
    df = spark.createDataFrame(data, "record_id long, a double, c string, target int, weight double")
    m = classify.fit_risk_classifier(df, ["a"], ["c"], kind="rf", k=4, params={"numTrees": 20})
    assert isinstance(m.stages[-1], T.ForestModel)
    m.write().overwrite().save(f"{workdir}/m")
    odd = df.limit(1).withColumn("c", F.lit("z"))
    out = classify.predict(PipelineModel.load(f"{workdir}/m"), df.unionByName(odd)).toPandas()
    assert (out.y == out.yhat).mean() > 0.95 and np.allclose([sum(p) for p in out.p], 1)


def test_missing_labels_are_refused(spark):
    x, y, w = small(60)
    df = frame(spark, x, y, w).withColumn("target", F.when(F.col("record_id") > 0, F.col("target")))
    with pytest.raises(ValueError, match="labels"):
        T.fit(df, "target", 3, "weight", "record_id", trees=2, depth=2, block_rows=30)


def test_indexers_share_one_pass(spark):
    rows_ = [(1, 2.0, "b", None), (2, None, "a", "x"), (3, 1.0, None, "x")]
    df = spark.createDataFrame(rows_, "record_id long, a double, c string, d string")
    m = classify._prepared(df, ["a"], ["c", "d"])
    assert [s.labels for s in m.stages[1:3]] == [["Desconocido", "a", "b"], ["Desconocido", "x"]]
    assert [list(r.features.toArray()) for r in m.transform(df).orderBy("record_id").collect()] == [
        [2.0, 2.0, 0.0], [0.0, 1.0, 1.0], [1.0, 0.0, 1.0]]
