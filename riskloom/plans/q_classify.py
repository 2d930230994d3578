"""Queries for the risk classifiers (J6-J11, J14-J20, C8). Model fits are not SQL: these
are checked by row count here and by the property tests (beats the majority baseline,
probabilities sum to 1, batch equals stream, calibration, additivity)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import classify, joins
from riskloom.plans.q_clean import TRAIN_TO, VAL_TO, risky
from riskloom.plans.registry import register


def table(spark, sf):
    return classify.model_table(risky(spark, sf), TRAIN_TO)


def splits(spark, sf):
    t = table(spark, sf)
    return (t.filter(F.col("Anio") <= TRAIN_TO),
            t.filter((F.col("Anio") > TRAIN_TO) & (F.col("Anio") <= VAL_TO)),
            t.filter(F.col("Anio") > VAL_TO))


@register("fit_risk_classifier", None)
def q_fit(spark, sf):
    """Softmax booster on the coded features (train <= 1999), scored on the test year."""
    tr, _, te = splits(spark, sf)
    model = classify.fit_risk_classifier(tr)
    return classify.predict(model, te)


@register("align_predictions", None)
def q_align(spark, sf):
    """Predictions re-attached to state and true loss ratio by key."""
    tr, _, te = splits(spark, sf)
    pred = classify.predict(classify.fit_risk_classifier(tr, kind="rf"), te)
    attrs = te.select(F.col("record_id").alias("key"), "Nomestado", "proporcion_siniestro")
    return joins.align_predictions(pred, attrs, "key")


@register("two_stage_classifier", None)
def q_two_stage(spark, sf):
    """P(loss) x severity, scored on the test year."""
    tr, _, te = splits(spark, sf)
    return classify.two_stage(tr, te)


@register("isotonic_calibration", None)
def q_isotonic(spark, sf):
    """Forest fitted <= 1999, calibrated per class on 2000, applied to 2001."""
    tr, va, te = splits(spark, sf)
    m = classify.fit_risk_classifier(tr, kind="rf")
    out, _ = classify.isotonic_calibration(classify.predict(m, va), classify.predict(m, te))
    return out


@register("early_stop_curve", None)
def q_early_stop(spark, sf):
    """Per-round train/validation log-loss and error rate of the multiclass booster, with the
    reference's patience of 50 rounds."""
    tr, va, _ = splits(spark, sf)
    return spark.createDataFrame(
        classify.early_stop_curve(tr, va, patience=50),
        "iteration int, train_loss double, val_loss double, train_error double, "
        "val_error double, best_iteration int, stop_iteration int")


@register("feature_importance", None)
def q_importance(spark, sf):
    """Gain, split counts and cover of the coded features (booster)."""
    tr, _, _ = splits(spark, sf)
    m = classify.fit_risk_classifier(tr)
    rows = classify.feature_importance(m, classify.CODED_NUM)
    return spark.createDataFrame(rows, "feature string, gain double, splits long, cover double")


@register("cross_validate", None)
def q_cross_validate(spark, sf):
    """Five stratified folds over the train and validation years (forest)."""
    tr, va, _ = splits(spark, sf)
    rows = classify.cross_validate(tr.unionByName(va), folds=5)
    return spark.createDataFrame(rows, "fold int, split string, accuracy double, f1_macro double, "
                                       "roc_auc double, log_loss double, "
                                       "balanced_accuracy double, kappa_quadratic double")


@register("score_batch", None)
def q_score_batch(spark, sf):
    """Native-category model (train years) scoring every record of the test year as a
    request: class, label, probabilities by label, confidence, or the reason of rejection."""
    tr, _, te = splits(spark, sf)
    m = classify.fit_risk_classifier(tr, classify.NATIVE_NUM, classify.NATIVE_CAT, kind="rf")
    req = te.select("record_id", *classify.NATIVE_CAT, "Sembrada", "Precio", "hist_mean")
    return classify.score_batch(m, req)


@register("shapley_attribution", None)
def q_shapley(spark, sf):
    """Exact Shapley values of the booster's margins for every row of the test year."""
    from riskloom.operators import attribution
    tr, _, te = splits(spark, sf)
    m = classify.fit_risk_classifier(tr)
    return attribution.shapley_attribution(m, te, classify.CODED_NUM)


@register("shapley_summary", None)
def q_shapley_summary(spark, sf):
    """Mean |phi| per class, top 3 features."""
    return classify.shapley_summary(q_shapley(spark, sf), by_class=True, top=3)


@register("score_stream", None)
def q_score_stream(spark, sf):
    """The test-year requests landed as files and scored by a Structured Streaming query
    (available-now trigger, checkpointed); the sink read back as a table."""
    from riskloom.streaming.scoring import run_to_completion
    tr, _, te = splits(spark, sf)
    m = classify.fit_risk_classifier(tr, classify.NATIVE_NUM, classify.NATIVE_CAT, kind="rf")
    req = te.select("record_id", *classify.NATIVE_CAT, "Sembrada", "Precio", "hist_mean")
    return run_to_completion(spark, m, req)


@register("regularization_sweep", None)
def q_reg_sweep(spark, sf):
    """One-factor sweeps of the least gain, L2 and L1 (the reference's 23 values, 200 rounds),
    each fixing the previous best; validation metrics and leaves per value."""
    tr, va, _ = splits(spark, sf)
    grids = {"gamma": [0, 0.1, 0.5, 1, 2, 5, 10],
             "reg_lambda": [0, 0.01, 0.1, 1, 5, 10, 50, 100],
             "reg_alpha": [0, 0.001, 0.01, 0.1, 1, 5, 10, 50]}
    rows, _ = classify.regularization_sweep(tr, va, grids, base={"n_estimators": 200})
    return spark.createDataFrame(rows, "param string, value double, f1_macro double, "
                                       "accuracy double, log_loss double, leaves long")


@register("random_search", None)
def q_random_search(spark, sf):
    """Seeded random candidates from the reference's ranges scored by 3-fold stratified CV on
    the composite score: the candidates, their scores and the budget (40 x 3 fits and the
    refit)."""
    n, folds = 40, 3
    tr, _, _ = splits(spark, sf)
    _, table = classify.random_search(tr, n=n, folds=folds)
    import json
    return spark.createDataFrame([(i, json.dumps(c, sort_keys=True), s, d, n, folds)
                                  for i, (c, s, d) in enumerate(table)],
                                 "candidate int, params string, composite double, "
                                 "composite_std double, candidates int, folds int")


@register("learning_curve", None)
def q_learning_curve(spark, sf):
    """Fractions .1-1 of the training folds x 3 folds: train/test macro F1, gap, verdict."""
    tr, va, _ = splits(spark, sf)
    rows = classify.learning_curve(tr.unionByName(va))
    return spark.createDataFrame(rows, "fraction double, train_f1 double, train_std double, "
                                       "test_f1 double, test_std double, gap double, verdict string")


@register("ablation", None)
def q_ablation(spark, sf):
    """With and without the loss-history feature and with climate added: same rows, split
    and parameters; metric deltas against the base set."""
    from riskloom.operators.joins import climate_left_join
    from riskloom.plans.q_climate import CLIMA_COLS, cycle_climate
    t = climate_left_join(table(spark, sf), cycle_climate(spark, sf))
    tr, te = t.filter(F.col("Anio") <= TRAIN_TO), t.filter(F.col("Anio") > VAL_TO)
    base = [c for c in classify.CODED_NUM if c != "hist_mean"]
    sets = {"base": base, "base+history": base + ["hist_mean"],
            "base+history+climate": base + ["hist_mean"] + CLIMA_COLS}
    rows = classify.ablation(tr, te, sets, kind="rf")
    cols = ["accuracy", "f1_macro", "balanced_accuracy", "kappa_quadratic", "log_loss"]
    return spark.createDataFrame(rows, "feature_set string, " + ", ".join(f"{c} double" for c in cols)
                                 + ", " + ", ".join(f"delta_{c} double" for c in cols))


@register("calibration_metrics", None)
def q_calibration_metrics(spark, sf):
    """Log-loss and Brier score on the test year before and after isotonic calibration
    (fitted <= 1999, calibrated on 2000)."""
    tr, va, te = splits(spark, sf)
    m = classify.fit_risk_classifier(tr, kind="rf")
    _, rows = classify.isotonic_calibration(classify.predict(m, va), classify.predict(m, te))
    return spark.createDataFrame(rows, "metric string, before double, after double")


@register("cross_validate_summary", None)
def q_cross_validate_summary(spark, sf):
    """Mean and standard deviation of the fold metrics, train and test."""
    folds = q_cross_validate(spark, sf)
    metrics_ = ["accuracy", "f1_macro", "roc_auc", "log_loss", "balanced_accuracy", "kappa_quadratic"]
    return folds.groupBy("split").agg(*[a for c in metrics_ for a in (
        F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])
