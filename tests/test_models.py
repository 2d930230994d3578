"""Model properties: the classifier beats the majority baseline, probabilities sum to one,
save/load round trip, one-call pipeline equals step-by-step, stream equals batch,
Shapley additivity, calibration helps on its own data, two-stage combination."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import classify, cluster, features, metrics
from riskloom.plans.q_clean import risky
from riskloom.sources import files

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    t = classify.model_table(risky(spark, SF_SMALL), 1999).persist()
    return t.filter("Anio <= 1999"), t.filter("Anio = 2000"), t.filter("Anio >= 2001")


@pytest.fixture(scope="module")
def model(data):
    return classify.fit_risk_classifier(data[0], params={"n_estimators": 10})


def test_beats_majority_baseline_and_probabilities(spark, data, model):
    tr, _, te = data
    s = classify.predict(model, te)
    f1 = metrics.label_metrics(metrics.confusion_long(s)).first().f1_macro
    base = classify.majority_predict(tr, te)
    f1_base = metrics.label_metrics(metrics.confusion_long(base)).first().f1_macro
    assert f1 > f1_base
    sums = s.select(F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("t")).collect()
    assert all(math.isclose(r.t, 1.0, abs_tol=1e-9) for r in sums)


def test_model_round_trip(spark, data, model, workdir):
    import os
    te = data[2]
    path = files.save_model(model, os.path.join(workdir, "model"), {"features": classify.CODED_NUM})
    loaded, meta = files.load_model(spark, path)
    a = {r.key: r.p for r in classify.predict(model, te).collect()}
    b = {r.key: r.p for r in classify.predict(loaded, te).collect()}
    assert a == b and meta["features"] == classify.CODED_NUM
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, os.path.join(workdir, "nope"))


def test_pipeline_equals_step_by_step(spark, workdir):
    import os
    prof = cluster.municipal_profile(risky(spark, "/root/testdata/sf0.01"))
    model = cluster.vulnerability_pipeline(prof, k=3, n_pca=2, n_init=3)
    one = {r.Nommunicipio: r.cluster for r in model.transform(prof).collect()}
    # step by step: population z-scores -> nearest of the fitted centroids -> canonical order
    km = [s for s in model.stages if hasattr(s, "clusterCenters")][0]
    z = features.standard_scale(prof, cluster.CLUSTER_FEATURES, suffix="_z")
    raw = cluster.nearest_centroid(z, [list(c) for c in km.clusterCenters()],
                                   [f"{c}_z" for c in cluster.CLUSTER_FEATURES], "raw")
    relabel = cluster.canonical_relabel(km)
    step = {r.Nommunicipio: r.cluster for r in relabel.transform(raw.withColumnRenamed("raw", "_raw")).collect()}
    assert one == step
    path = files.save_model(model, os.path.join(workdir, "kmeans"))
    again, _ = files.load_model(spark, path)
    assert {r.Nommunicipio: r.cluster for r in again.transform(prof).collect()} == one
    cents = cluster.project_centroids(model)
    assert [c for c, _ in cents] == [0, 1, 2] and all(len(v) == 2 for _, v in cents)
    # a converged centroid is the mean of its members and PCA is linear, so the projected
    # centroid equals the mean of the members' PCA coordinates (up to the k-means tolerance)
    pts = model.transform(prof).select("cluster", "pca").collect()
    for c, v in cents:
        members = [r.pca.toArray() for r in pts if r.cluster == c]
        for j in range(2):
            assert math.isclose(v[j], sum(m[j] for m in members) / len(members), abs_tol=1e-2)
    ratios = cluster.explained_variance(model)
    assert 0 < ratios[0][0] <= 1 and math.isclose(ratios[-1][1], sum(r for r, _ in ratios))
    with pytest.raises(ValueError):
        cluster.make_scaler("minmax")


def test_stream_equals_batch(spark, data, workdir):
    from riskloom.streaming.scoring import run_to_completion
    tr, _, te = data
    m = classify.fit_risk_classifier(tr, classify.NATIVE_NUM, classify.NATIVE_CAT, kind="rf",
                                     params={"numTrees": 10})
    req = te.select("record_id", *classify.NATIVE_CAT, "Sembrada", "Precio", "hist_mean")
    batch = sorted(map(tuple, classify.score_batch(m, req).collect()))
    stream = sorted(map(tuple, run_to_completion(spark, m, req, workdir).collect()))
    assert batch == stream and len(batch) > 0


def test_every_request_is_answered(spark, data, workdir):
    from riskloom.streaming.scoring import run_to_completion
    tr, _, te = data
    m = classify.fit_risk_classifier(tr, classify.NATIVE_NUM, classify.NATIVE_CAT, kind="rf",
                                     params={"numTrees": 3})
    cols = ["record_id", *classify.NATIVE_CAT, "Sembrada", "Precio", "hist_mean"]
    good = te.where("Sembrada >= 0 AND Precio >= 0").select(*cols).limit(1)
    edits = {2: {"Precio": None}, 3: {"Nomestado": None}, 4: {"Sembrada": -1.0, "Precio": None},
             5: {"Sembrada": None}, 6: {"Precio": -1.0},
             7: {"Nomcultivo": " ", "Sembrada": float("nan")}}
    first = good.first().asDict() | {"record_id": 1}
    req = spark.createDataFrame(
        [tuple(r[c] for c in cols) for r in
         [first] + [first | {"record_id": k} | e for k, e in edits.items()]], good.schema)
    want = {1: None, 2: None, 3: "missing Nomestado", 4: "negative Sembrada",
            5: "missing Sembrada", 6: "negative Precio", 7: "missing Nomcultivo"}
    batch = classify.score_batch(m, req).collect()
    stream = run_to_completion(spark, m, req, workdir).collect()
    for got in (batch, stream):
        assert len(got) == len(want) and {r.record_id: r.reason for r in got} == want
        for r in got:
            scores = (r.clase, r.nivel_riesgo, r.probabilidades, r.confianza)
            assert all((x is None) == (r.reason is not None) for x in scores)
    one, two = (next(r for r in batch if r.record_id == k) for k in (1, 2))
    assert one.probabilidades == two.probabilidades  # the model does not read the price
    assert classify.score_batch(m, req.drop("Precio")).where("reason IS NULL").count() == 3
    priced = classify.fit_risk_classifier(tr, ["Sembrada", "Precio"], kind="rf",
                                          params={"numTrees": 2})
    assert {r.record_id: r.reason for r in classify.score_batch(priced, req).collect()} == (
        want | {2: "missing Precio"})


def test_shapley_additivity(spark, data):
    tr, _, te = data
    m = classify.fit_risk_classifier(tr, kind="rf", params={"numTrees": 10})
    from riskloom.operators.sorting import seeded_sample
    phi = classify.shapley_attribution(m, seeded_sample(te, "record_id", n=5), seeded_sample(tr, "record_id", n=8),
                                       classify.CODED_NUM, n_perm=3)
    tot = phi.groupBy("record_id", "cls", "base", "fx").agg(F.sum("phi").alias("s")).collect()
    assert len(tot) == 25
    assert all(math.isclose(r.base + r.s, r.fx, abs_tol=1e-9) for r in tot)
    top = classify.shapley_summary(phi).collect()
    assert len(top) == 15 and all(r.rank <= 3 for r in top)


def test_isotonic_calibration_improves_on_its_own_data(data):
    tr, va, _ = data
    m = classify.fit_risk_classifier(tr, kind="rf", params={"numTrees": 10})
    cal = classify.predict(m, va)
    out, rows = classify.isotonic_calibration(cal, cal)
    d = {name: (b, a) for name, b, a in rows}
    assert d["log_loss"][1] <= d["log_loss"][0] + 1e-9 and d["brier"][1] <= d["brier"][0] + 1e-9


def test_two_stage_combination(spark):
    df = spark.createDataFrame([(1, 3, 0.8, [0.1, 0.2, 0.6, 0.1]), (2, 0, 0.1, [0.25, 0.25, 0.25, 0.25])],
                               "record_id long, target int, p_loss double, s array<double>")
    out = {r.key: r for r in classify.combine_two_stage(df).collect()}
    assert out[1].yhat == 3 and math.isclose(out[1].p[3], 0.48) and math.isclose(out[1].p[0], 0.2)
    assert out[2].yhat == 0 and math.isclose(sum(out[2].p), 1.0)


def test_early_stop_requires_disjoint_sets(data):
    tr, va, _ = data
    with pytest.raises(ValueError):
        classify.early_stop_curve(tr, tr, params={"n_estimators": 2})
    rows = classify.early_stop_curve(tr, va, params={"n_estimators": 60}, patience=3)
    losses = [r[2] for r in rows]
    assert rows[0][5] == losses.index(min(losses)) + 1 and rows[0][6] == len(rows)
    assert len(rows) == 60 or len(rows) == rows[0][5] + 3
    assert all(0 <= r[3] <= 1 and 0 <= r[4] <= 1 for r in rows)


def test_registered_fits_have_the_reference_budget(spark, monkeypatch):
    from riskloom.operators import boosting
    from riskloom.plans import q_classify
    b = boosting.Boost()
    assert (b.n_estimators, b.max_depth, b.learning_rate, b.reg_lambda) == (300, 6, 0.3, 1.0)
    assert classify.DEFAULT_RF["numTrees"] >= 300
    assert classify.SEARCH_SPACE["n_estimators"] == [100, 200, 300]
    seen = {}

    def curve(train, val, patience=None):
        seen["patience"] = patience
        return [(1, 0.5, 0.5, 0.5, 0.5, 1, 1)]

    def search(train, n=None, folds=None):
        seen["search"] = (n, folds)
        return None, [({"gamma": 0}, 0.5, 0.1)]

    def sweep(train, val, grids, base=None):
        seen["sweep"] = ({k: len(v) for k, v in grids.items()}, base)
        return [("gamma", 0.0, 0.1, 0.2, 0.3, 4)], {}

    for name, f in (("early_stop_curve", curve), ("random_search", search), ("regularization_sweep", sweep)):
        monkeypatch.setattr(classify, name, f)
    assert q_classify.q_early_stop(spark, SF_SMALL).count() == 1
    assert q_classify.q_random_search(spark, SF_SMALL).first().candidates == 40
    assert q_classify.q_reg_sweep(spark, SF_SMALL).count() == 1
    assert seen == {"patience": 50, "search": (40, 3),
                    "sweep": ({"gamma": 7, "reg_lambda": 8, "reg_alpha": 8}, {"n_estimators": 200})}


def test_feature_importance_and_evaluator(spark, data, model):
    rows = classify.feature_importance(model, classify.CODED_NUM, top=15)
    assert sum(r[2] for r in rows) > 0 and all(r[1] >= 0 and r[3] >= 0 for r in rows)
    s = classify.predict(model, data[2]).withColumnRenamed("yhat", "prediction").withColumnRenamed("y", "target")
    score = classify.CompositeEvaluator().evaluate(s)
    assert -1.0 <= score <= 1.0


def test_sweep_fixes_the_best_value(spark, data):
    tr, va, _ = data
    rows, fixed = classify.regularization_sweep(
        tr, va, {"gamma": [0, 1e9], "reg_lambda": [1, 10]}, base={"n_estimators": 3})
    assert [r[0] for r in rows] == ["gamma"] * 2 + ["reg_lambda"] * 2
    assert rows[0][5] > rows[1][5] == 3 * classify.K  # no gain is that large: one leaf a tree
    assert fixed["gamma"] == max(rows[:2], key=lambda r: r[2])[1] and set(fixed) == {
        "n_estimators", "gamma", "reg_lambda"}


def test_two_stage_probabilities(data):
    tr, _, te = data
    s = classify.two_stage(tr, te, params={"n_estimators": 5})
    assert s.count() == te.count()
    assert s.where("abs(aggregate(p, 0D, (a, x) -> a + x) - 1) > 1e-9").count() == 0


def test_restarted_stream_answers_each_request_once(spark, data, workdir):
    import glob
    import os
    from riskloom.streaming import scoring
    tr, _, te = data
    m = classify.fit_risk_classifier(tr, classify.NATIVE_NUM, classify.NATIVE_CAT, kind="rf",
                                     params={"numTrees": 2})
    src, sink, place = (os.path.join(workdir, x) for x in ("in", "out", "place"))
    req = te.select(*[f.name for f in scoring.REQUEST_SCHEMA.fields]).limit(60).repartition(3)
    req.write.parquet(src)
    run = lambda: scoring.score_stream(spark, m, src, sink, place, files_per_batch=1).awaitTermination()
    run()
    done = sorted(tuple(r) for r in scoring.scored_requests(spark, sink).collect())
    assert len(done) == 60
    # The last batch was written, but the stop came before it was committed.
    last = max(glob.glob(f"{place}/commits/[0-9]*"), key=lambda x: int(os.path.basename(x)))
    os.remove(last)
    for crc in glob.glob(f"{place}/commits/.{os.path.basename(last)}.crc"):
        os.remove(crc)
    run()
    assert sorted(tuple(r) for r in scoring.scored_requests(spark, sink).collect()) == done
    with pytest.raises(ValueError):
        scoring.score_stream(spark, m, src, sink, "")


def test_native_categories_beyond_the_default_bins(spark):
    rows = [(f"crop {i % 454}", float(i % 7), i % 2, 1.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "crop string, area double, target int, weight double")
    m = classify.fit_risk_classifier(df, ["area"], ["crop"], kind="rf", k=2, params={"numTrees": 2})
    assert m.transform(df).where("size(p) <> 2").count() == 0


def test_search_returns_a_model_that_scores(spark, data):
    m, table = classify.random_search(data[0], {"n_estimators": [2, 3], "max_depth": [2, 3]}, n=2, folds=2)
    assert len(table) == 2
    s = classify.predict(m, data[2])
    assert s.where("abs(aggregate(p, 0D, (a, x) -> a + x) - 1) > 1e-9").count() == 0


def test_forest_keeps_node_numbers_and_gives_the_same_trees(data):
    tr, _, te = data
    few = {"numTrees": 3, "maxDepth": 4}
    kept = classify.fit_risk_classifier(tr, kind="rf", params=few)
    walked = classify.fit_risk_classifier(tr, kind="rf", params=few | {"cacheNodeIds": False})
    forest = [next(s for s in m.stages if hasattr(s, "trees")) for m in (kept, walked)]
    assert [f.getCacheNodeIds() for f in forest] == [True, False]
    assert forest[0].toDebugString.split("\n")[1:] == forest[1].toDebugString.split("\n")[1:]
    p = [{r.key: r.p for r in classify.predict(m, te).collect()} for m in (kept, walked)]
    assert p[0] == p[1]


def test_clustering_makes_the_profile_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    cols = cluster.CLUSTER_FEATURES
    df = spark.range(60).select(*[((F.col("id") * (i + 3)) % (7 + i)).cast("double").alias(c)
                                  for i, c in enumerate(cols)]).repartition(2)
    model = cluster.vulnerability_pipeline(df.mapInArrow(run, df.schema), k=3, n_pca=2, n_init=2)
    assert made.value == 60 and len(cluster.project_centroids(model)) == 3
