"""The histogram booster against plain loops over rows, its two engines against each other,
and the regularised gains."""

import json
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import classify
from riskloom.plans.q_clean import risky

from conftest import SF_SMALL


def small(n=400, seed=0, width=3, k=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, width)), 1)
    x[:, -1] = rng.integers(0, 4, n)
    y = np.clip((x[:, 0] + x[:, -1] / 2 + rng.normal(0, 0.7, n)).astype(int), 0, k - 1)
    return x, y, np.round(rng.uniform(0.5, 2, n), 2)


def frame(spark, x, y, w, fold=None):
    rows = [(i, *map(float, r), int(c), float(v), int(fold[i]) if fold is not None else 0)
            for i, (r, c, v) in enumerate(zip(x, y, w))]
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, ["record_id", *names, "target", "weight", "fold"])
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def brute_boost(x, y, w, k, cuts, p, rounds):
    """Margins after each round, by loops over candidate splits and rows."""
    n, m = len(y), np.zeros((len(y), k))

    def t(g):
        return math.copysign(max(abs(g) - p.reg_alpha, 0), g)

    def score(idx, g, h):
        return t(sum(g[i] for i in idx)) ** 2 / (sum(h[i] for i in idx) + p.reg_lambda)

    out = []
    for _ in range(rounds):
        e = np.exp(m - m.max(1, keepdims=True))
        prob = e / e.sum(1, keepdims=True)
        step = np.zeros_like(m)
        for c in range(k):
            g = [(prob[i, c] - (y[i] == c)) * w[i] for i in range(n)]
            h = [2 * prob[i, c] * (1 - prob[i, c]) * w[i] for i in range(n)]

            def build(idx, depth):
                best = None
                if depth < p.max_depth:
                    for f in range(x.shape[1]):
                        for cut in cuts[f]:
                            left = [i for i in idx if x[i, f] <= cut]
                            right = [i for i in idx if x[i, f] > cut]
                            if min(sum(h[i] for i in left), sum(h[i] for i in right)) < p.min_child_weight:
                                continue
                            gain = score(left, g, h) + score(right, g, h) - score(idx, g, h)
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, left, right)
                if best and best[0] > max(p.gamma, 1e-9):
                    build(best[1], depth + 1)
                    build(best[2], depth + 1)
                else:
                    for i in idx:
                        step[i, c] = (-p.learning_rate * t(sum(g[j] for j in idx))
                                      / (sum(h[j] for j in idx) + p.reg_lambda))
            build(list(range(n)), 0)
        m = m + step
        out.append(m)
    return out


@pytest.mark.parametrize("over", [{}, {"gamma": 3.0}, {"reg_alpha": 4.0, "reg_lambda": 0.0}, {"min_child_weight": 20}])
def test_trees_equal_brute_force(spark, over):
    x, y, w = small(120)
    p = B.Boost(n_estimators=3, max_depth=3, **over)
    fitted, = B.fit_many(frame(spark, x, y, w), [p], "target", 3, "weight", bins=16)
    want = brute_boost(x, y, w, 3, fitted.cuts, p, 3)
    for r in range(3):
        got = B.margins(fitted.trees.first(r + 1), B.binned(x, fitted.cuts))
        assert np.allclose(got, want[r], atol=1e-8)


def test_spark_rounds_equal_block_rounds(spark, monkeypatch):
    """Four blocks, one aggregation per level, margins written in the middle."""
    monkeypatch.setattr(B, "CHUNK", 2)
    x, y, w = small(300, seed=1)
    fold = np.arange(300) % 5
    df = frame(spark, x, y, w, fold)
    p = B.Boost(n_estimators=4, max_depth=3, colsample_bytree=0.7, fold=1, patience=50)
    one, = B.fit_many(df, [p], "target", 3, "weight", "fold")
    many, = B.fit_many(df, [p], "target", 3, "weight", "fold", block_rows=80)
    bins_ = B.binned(x, one.cuts)
    assert one.cuts == many.cuts
    assert np.allclose(B.margins(one.trees, bins_), B.margins(many.trees, bins_), atol=1e-9)
    assert np.allclose(one.curve, many.curve, rtol=1e-9) and np.allclose(one.measured, many.measured)
    assert one.measured[3] == (fold == 1).sum() == one.measured[6:].sum()


def test_left_out_rows_do_not_teach(spark):
    x, y, w = small(200, seed=2)
    fold = np.arange(200) % 2
    p = B.Boost(n_estimators=3, max_depth=3, fold=1)
    a, = B.fit_many(frame(spark, x, y, w, fold), [p], "target", 3, "weight", "fold")
    b, = B.fit_many(frame(spark, x, np.where(fold == 1, 0, y), w, fold), [p], "target", 3, "weight", "fold")
    assert np.array_equal(a.trees.leaf, b.trees.leaf) and np.array_equal(a.trees.bin, b.trees.bin)


def test_larger_gamma_never_gives_more_leaves(spark):
    x, y, w = small(400, seed=3)
    grid = [B.Boost(n_estimators=1, gamma=g) for g in (0, 0.5, 2, 8, 1e9)]
    splits = [int((f.trees.bin < 255).sum())
              for f in B.fit_many(frame(spark, x, y, w), grid, "target", 3, "weight")]
    assert splits == sorted(splits, reverse=True) and splits[0] > splits[-1] == 0


def test_training_stops_and_rounds_after_are_not_fitted(spark):
    x, y, w = small(300, seed=4)
    y = np.random.default_rng(0).integers(0, 3, 300)  # nothing to learn
    p = B.Boost(n_estimators=200, patience=5, fold=1)
    f, = B.fit_many(frame(spark, x, y, w, np.arange(300) % 2), [p], "target", 3, "weight", "fold")
    loss = [c[4] / c[3] for c in f.curve]
    assert len(f.trees.leaf) == len(loss) < 200 and min(range(len(loss)), key=loss.__getitem__) == len(loss) - 6


def test_importance_and_round_trip(spark, workdir):
    x, y, w = small(300, seed=5)
    df = frame(spark, x, y, w)
    f, = B.fit_many(df, [B.Boost(n_estimators=5)], "target", 3, "weight")
    rows = {r[0]: r[1:] for r in B.importance(f.trees, ["a", "b", "c"])}
    assert sum(v[1] for v in rows.values()) == (f.trees.bin < 255).sum()
    assert all(v[2] > 0 for v in rows.values()) and rows["a"][0] > rows["b"][0]
    model = B.model_of(f)
    model.write().overwrite().save(f"{workdir}/booster")
    again = B.BoostedModel.load(f"{workdir}/booster")
    one, two = ([tuple(r.p) for r in m.transform(df).orderBy("record_id").collect()] for m in (model, again))
    assert one == two and all(math.isclose(sum(r), 1, abs_tol=1e-9) for r in one)
    want = B.softmax(B.margins(f.trees, B.binned(x, f.cuts)))
    assert np.allclose(one, want)


def test_empty_tables_and_one_class(spark):
    x, y, w = small(50, seed=6)
    df = frame(spark, x, y, w)
    f, = B.fit_many(df.limit(0), [B.Boost(n_estimators=2)], "target", 3, "weight")
    assert B.model_of(f).transform(df).count() == 50
    f, = B.fit_many(df.withColumn("target", F.lit(1)), [B.Boost(n_estimators=2)], "target", 3, "weight")
    assert {r.prediction for r in B.model_of(f).transform(df).collect()} == {1}
    assert B.model_of(f).transform(df.limit(0)).count() == 0


def test_search_refits_the_best(spark):
    t = classify.model_table(risky(spark, SF_SMALL), 1999).filter("Anio <= 1999").persist()
    space = {"n_estimators": [3, 6], "max_depth": [2, 3], "gamma": [0, 1000], "subsample": [0.8]}
    model, table = classify.random_search(t, space, n=4, folds=3)
    assert len(table) == 4 and all(0 <= s <= 1 for _, s, _ in table)
    best = max(table, key=lambda r: r[1])[0]
    trees = model.stages[-1].unpacked()[0]
    assert len(trees.leaf) == best["n_estimators"]
    assert abs(sum(model.transform(t.limit(1)).first().p) - 1) < 1e-9
    json.dumps(table)
    t.unpersist()


def brute_shapley(trees, x, width):
    """Shapley values by all subsets of features, with the path-dependent expectation."""
    from itertools import combinations
    rounds, k, leaves = trees.leaf.shape
    depth = leaves.bit_length() - 1

    def expect(r, c, known, node=0, level=0):
        heap = (1 << level) - 1 + node
        if level == depth or trees.bin[r, c, heap] == 255:
            return trees.leaf[r, c, node << (depth - level)]
        f, b, s = trees.feature[r, c, heap], trees.bin[r, c, heap], trees.share[r, c, heap]
        if f in known:
            return expect(r, c, known, 2 * node + int(x[f] > b), level + 1)
        return (s * expect(r, c, known, 2 * node, level + 1)
                + (1 - s) * expect(r, c, known, 2 * node + 1, level + 1))
    out = np.zeros((k, width))
    for c in range(k):
        def v(known, c=c):
            return sum(expect(r, c, known) for r in range(rounds))
        for f in range(width):
            others = [g for g in range(width) if g != f]
            for size in range(width):
                w = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
                for sub in combinations(others, size):
                    out[c, f] += w * (v({*sub, f}) - v(set(sub)))
    return out


def test_shapley_values_equal_all_subsets(spark):
    from riskloom.operators import attribution
    x, y, w = small(200, seed=7, width=4)
    df = frame(spark, x, y, w)
    f, = B.fit_many(df, [B.Boost(n_estimators=3, max_depth=4)], "target", 3, "weight", bins=16)
    bins_ = B.binned(x, f.cuts)
    phi, base, fx = attribution.shapley_values(f.trees, bins_)
    for i in range(0, 200, 40):
        assert np.allclose(phi[i], brute_shapley(f.trees, bins_[i], 4), atol=1e-10)
    assert np.allclose(base + phi.sum(axis=2), fx, atol=1e-9)
    from pyspark.ml import PipelineModel
    got = attribution.shapley_attribution(PipelineModel([B.model_of(f)]), df, ["a", "b", "c", "d"])
    rows = {(r.record_id, r.cls, r.feature): r.phi for r in got.collect()}
    assert len(rows) == 200 * 3 * 4
    assert all(math.isclose(rows[i, c, n], phi[i, c, j], abs_tol=1e-12)
               for i in (0, 77) for c in range(3) for j, n in enumerate("abcd"))
    # The shares of the cover are those of the training rows' hessians.
    assert ((f.trees.share > 0) & (f.trees.share <= 1)).all()


def test_a_round_over_many_blocks_takes_one_job_a_level(spark):
    x, y, w = small()
    df = frame(spark, x, y, w)
    cuts = B.cut_points(df, "features", 16)
    offsets = np.concatenate(([0], np.cumsum([len(c) + 1 for c in cuts]))).astype(np.int64)
    blocks, n = B.packed(df, cuts, "target", "weight", None, "record_id", block_rows=80)
    rows = B.SparkRows(blocks, n, 3, offsets, B.Boost(n_estimators=4, max_depth=3))
    spark.sparkContext.setJobGroup("rounds", "rounds of a booster")
    try:
        B.train(rows, 3, offsets, rows.p)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) <= 4 * 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows.close()


def test_combined_features_give_the_same_trees(monkeypatch):
    """Sums of several features at once, added up for each, against one feature at a time."""
    rng = np.random.default_rng(4)
    bins = [5, 25, 3, 2, 30]
    x = np.stack([rng.integers(0, b, 3000) for b in bins], 1).astype(np.uint8)
    y = np.clip(x[:, 4] / 10 + x[:, 1] / 20 + rng.normal(0, 0.7, 3000), 0, 2).astype(np.int8)
    offsets, p = np.concatenate(([0], np.cumsum(bins))), B.Boost(n_estimators=3, max_depth=5)

    def trained(least):
        monkeypatch.setattr(B, "COMBINE_ROWS", least)
        rows = B.BlockRows(x, y, np.ones(3000), np.zeros(3000, np.int8), 3, offsets, p)
        return rows.codes.groups, B.train(rows, 3, offsets, p)[0]
    (one, a), (many, b) = trained(10_000), trained(0)
    assert len(one) == 5 > len(many)
    assert np.allclose(B.margins(a, x), B.margins(b, x), atol=1e-9)


def test_grids_of_a_few_blocks_train_one_model_a_task(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    monkeypatch.setattr(B, "SparkRows", None)  # a Spark job for each level of each model
    x, y, w = small(300, seed=9)
    got = B.fit_many(frame(spark, x, y, w), [B.Boost(n_estimators=2, gamma=g) for g in (0, 1.0)], "target", 3, "weight")
    assert [f.params.gamma for f in got] == [0, 1.0]


def test_shapley_tables_of_other_depths(spark):
    """Each row's values from tables over the answers on its path, against all subsets."""
    from riskloom.operators import attribution
    x, y, w = small(150, seed=7, width=3)
    for depth in (1, 2, 3):
        f, = B.fit_many(frame(spark, x, y, w), [B.Boost(n_estimators=2, max_depth=depth)], "target", 3, "weight")
        bins_ = B.binned(x, f.cuts)
        phi, base, fx = attribution.shapley_values(f.trees, bins_)
        assert np.allclose(phi.sum(2) + base, fx, atol=1e-10)

        def known(row, subset):
            out = np.zeros(3)
            for r in range(2):
                for c in range(3):
                    def walk(node, level):
                        heap = (1 << level) - 1 + node
                        if level == depth or f.trees.bin[r, c, heap] == 255:
                            return f.trees.leaf[r, c, node << (depth - level)]
                        u = f.trees.feature[r, c, heap]
                        if u in subset:
                            return walk(2 * node + (row[u] > f.trees.bin[r, c, heap]), level + 1)
                        s = f.trees.share[r, c, heap]
                        return s * walk(2 * node, level + 1) + (1 - s) * walk(2 * node + 1, level + 1)
                    out[c] += walk(0, 0)
            return out
        for i in (0, 70):
            for u in range(3):
                a, b = [v for v in range(3) if v != u]
                want = sum(wt * (known(bins_[i], {*s, u}) - known(bins_[i], set(s)))
                           for s, wt in (((), 1 / 3), ((a,), 1 / 6), ((b,), 1 / 6), ((a, b), 1 / 3)))
                assert np.allclose(phi[i, :, u], want, atol=1e-10)


def test_overlapping_validation_rows_are_refused(spark):
    df = classify.model_table(risky(spark, SF_SMALL))
    early = df.filter(F.col("Anio") <= 1995)
    with pytest.raises(ValueError, match="overlap"):
        classify.early_stop_curve(early, early.limit(3), params={"n_estimators": 1})


def test_a_tree_is_played_once_however_many_rows(monkeypatch):
    from riskloom.operators import attribution
    rng = np.random.default_rng(2)
    x, off, p = rng.integers(0, 6, (400, 3)).astype(np.uint8), np.array([0, 6, 12, 18]), B.Boost(n_estimators=2, max_depth=4)
    trees, _ = B.train(B.BlockRows(x, rng.integers(0, 2, 400), np.ones(400), np.zeros(400), 2, off, p), 2, off, p)
    made, table = [], attribution.Games.table
    monkeypatch.setattr(attribution.Games, "table", lambda *a: made.append(1) or table(*a))
    monkeypatch.setattr(attribution, "ROWS", 50)
    phi, base, fx = attribution.shapley_values(trees, x)
    assert len(made) == 2 * 2 and np.allclose(phi.sum(2) + base, fx)
