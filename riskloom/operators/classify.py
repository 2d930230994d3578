"""Risk classifiers (J5-J11, J14-J20): model inputs, one-vs-rest boosted trees with
probabilities, evaluation studies and batch scoring.

A fitted model is one ``PipelineModel``: missing-value fill (SQL stage) -> category
indexers -> assembler -> a multiclass booster (``boosting``), which gives a probability array
``p`` and a ``prediction``. Five binary GBTs or one random forest, each with a combiner stage,
are other kinds; a forest of more than one block of rows grows over blocks (``forest``). Sweeps and the random search train all their boosters in one Spark job per
grid; cross-validation, learning curves and the ablation take the kind as a parameter.
"""

from __future__ import annotations

import random
import re

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.constants import CAT_FEATURES, RISK_LABELS
from riskloom.functions.numeric import round_to
from riskloom.functions.risk import class_label
from riskloom.operators import boosting, forest, metrics
from riskloom.operators.clean import engineer_features
from riskloom.operators.features import positive_weight, with_class_weight
from riskloom.operators.util import parallel_map
from riskloom.operators.windows import prior_year_mean

K = 5
HIST_KEYS = ["Nomestado", "Nomcultivo", "Nomcicloproductivo", "Nommodalidad"]
CODED_NUM = ["Anio", "Idestado", "Idmunicipio", "Idciclo", "Idmodalidad", "Idcultivo",
             "log_sembrada", "interaccion_mod_ciclo", "hist_mean"]
# The price is missing exactly where nothing was harvested, so it would tell the label.
NATIVE_NUM = ["Sembrada", "hist_mean"]
NATIVE_CAT = list(CAT_FEATURES)
# Rounds and trees are those of the reference (n_estimators = 300).
DEFAULT_GBT = {"maxIter": 300, "maxDepth": 5, "stepSize": 0.1, "maxBins": 64, "seed": 42}
DEFAULT_RF = {"numTrees": 300, "maxDepth": 8, "maxBins": 64, "seed": 42}


def model_table(risky: DataFrame, train_to: int | None = None, year: str = "Anio") -> DataFrame:
    """Model inputs from the record view: engineered features, the prior-years loss
    history (E2, never the raw ratio of the row itself) and the class weight (D25), counted
    over the rows up to ``train_to`` so that later labels stay unseen."""
    t = prior_year_mean(engineer_features(risky), HIST_KEYS)
    fit_on = None if train_to is None else risky.filter(F.col(year) <= train_to)
    return with_class_weight(t, "target", "weight", fit_on)


def argmax_first(cols):
    """Index of the largest of the given columns (lowest index on ties), as a CASE chain."""
    best = F.greatest(*cols) if len(cols) > 1 else cols[0]
    out = F.lit(len(cols) - 1)
    for i in range(len(cols) - 2, -1, -1):
        out = F.when(cols[i] == best, F.lit(i)).otherwise(out)
    return out


def normalised(cols, k):
    """[c_i / sum c] (uniform when the sum is 0), with fixed arity: codegen'd terms."""
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return [F.coalesce(F.try_divide(c, total), F.lit(1.0 / k)) for c in cols]


class ProbabilityCombiner(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Turns classifier outputs into ``p`` (array<double>, sums to 1) and ``prediction``
    (lowest class on ties). mode 'ovr': one binary probability vector per class, the
    positive-class entries are normalised; mode 'multi': one multiclass vector of
    ``numClasses`` entries."""

    mode = Param(Params._dummy(), "mode", "ovr or multi", typeConverter=TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "classes", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, mode="ovr", numClasses=K):
        super().__init__()
        self._setDefault(mode="ovr", numClasses=K)
        self._set(**self._input_kwargs)

    def _transform(self, df):
        cols = self.getInputCols()
        if self.getOrDefault(self.mode) == "ovr":
            raw = [vector_to_array(F.col(c))[1] for c in cols]
        else:
            arr = vector_to_array(F.col(cols[0]))
            raw = [F.coalesce(arr[i], F.lit(0.0)) for i in range(self.getOrDefault(self.numClasses))]
        parts = normalised(raw, len(raw))
        out = df.withColumn("p", F.array(*parts)).drop(*cols)
        return out.withColumn("prediction", argmax_first([F.col("p")[i] for i in range(len(raw))]).cast("int"))


def _prep_stages(num, cat):
    fill = SQLTransformer(statement="SELECT *, " + ", ".join(
        [f"coalesce(CAST({c} AS DOUBLE), 0.0) AS _f_{c}" for c in num]
        + [f"coalesce(CAST({c} AS STRING), 'Desconocido') AS _s_{c}" for c in cat]) + " FROM __THIS__")
    idx = [StringIndexer(inputCol=f"_s_{c}", outputCol=f"_i_{c}", handleInvalid="keep",
                         stringOrderType="alphabetAsc") for c in cat]
    asm = VectorAssembler(inputCols=[f"_f_{c}" for c in num] + [f"_i_{c}" for c in cat],
                          outputCol="features", handleInvalid="error")
    return [fill, *idx, asm]


def _prepared(train: DataFrame, num, cat) -> PipelineModel:
    """Fitted input stages. An indexer needs only the values of its column, so all of them read
    the distinct categories of one pass."""
    num, cat = list(num), list(cat)
    pipeline = Pipeline(stages=_prep_stages(num, cat))
    if not cat:
        return pipeline.fit(train)
    values = train.select(*cat).distinct().persist()
    try:
        return pipeline.fit(values.withColumns({c: F.lit(None).cast("double") for c in num if c not in cat}))
    finally:
        values.unpersist()


def boost_params(params=None, **fixed) -> boosting.Boost:
    return boosting.Boost(**{**(params or {}), **fixed})


def fit_risk_classifier(train: DataFrame, num=CODED_NUM, cat=(), y: str = "target",
                        weight: str | None = "weight", kind: str = "boost", params=None,
                        k: int = K, parallelism: int = 5, key: str = "record_id") -> PipelineModel:
    """Class-weighted risk classifier. 'boost': one softmax booster over all classes;
    'gbt_ovr': k one-vs-rest GBTs (Spark's GBT is binary) whose positive probabilities are
    normalised; 'rf': one multiclass forest."""
    if kind == "boost":
        prep = _prepared(train, num, cat)
        fitted, = boosting.fit_many(prep.transform(train), [boost_params(params)], y, k, weight, key=key)
        return PipelineModel([*prep.stages, boosting.model_of(fitted)])
    num, cat = list(num), list(cat)
    prep = _prepared(train, num, cat)
    data = prep.transform(train).persist()
    stages = list(prep.stages)
    # Trees need a bin per category of the widest column (and one for unseen values).
    widest = max((len(s.labels) + 1 for s in stages if isinstance(s, StringIndexerModel)),
                 default=0)
    params = dict(params or {})
    params["maxBins"] = max(widest, params.get("maxBins", DEFAULT_GBT["maxBins"]))
    if kind == "gbt_ovr":
        p = {**DEFAULT_GBT, **params}

        def fit_one(c):
            lab = data.withColumn("_lab", (F.col(y) == c).cast("double"))
            gbt = (GBTClassifier(featuresCol="features", labelCol="_lab", predictionCol=f"_pred{c}", **p)
                   .setProbabilityCol(f"_prob{c}").setRawPredictionCol(f"_raw{c}"))
            if weight:
                gbt.setWeightCol(weight)
            return gbt.fit(lab)

        stages += parallel_map(fit_one, range(k), parallelism)  # the k binary fits are independent
        combine = ProbabilityCombiner(inputCols=[f"_prob{c}" for c in range(k)], mode="ovr")
        drop = [f"_pred{c}" for c in range(k)] + [f"_raw{c}" for c in range(k)]
        stages += [SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(drop)}) FROM __THIS__"),
                   combine]
    elif kind == "rf":
        p = {**DEFAULT_RF, **params}
        # Spark keeps a count and a node number of every row for every tree.
        if (widest <= 256 and set(p) <= set(DEFAULT_RF) and len(num) + len(cat) <= 256
                and data.count() > forest.BLOCK_ROWS):
            arity = {len(num) + cat.index(s.getInputCol()[3:]): len(s.labels) + 1
                     for s in stages if isinstance(s, StringIndexerModel)}
            trees, cuts = forest.fit(data, y, k, weight, key, "features", arity, p["numTrees"],
                                     p["maxDepth"], p["maxBins"], p["seed"])
            data.unpersist()
            return PipelineModel([*stages, forest.model_of(trees, cuts)])
        # Kept node numbers spare every pass the walk from the root of every tree for every row.
        rf = RandomForestClassifier(featuresCol="features", labelCol=y, predictionCol="_pred",
                                    probabilityCol="_prob", rawPredictionCol="_raw",
                                    **{"cacheNodeIds": True, **p})
        if weight:
            rf.setWeightCol(weight)
        stages.append(rf.fit(data.withColumn(y, F.col(y).cast("double"))))
        stages += [SQLTransformer(statement="SELECT * EXCEPT (_pred, _raw) FROM __THIS__"),
                   ProbabilityCombiner(inputCols=["_prob"], mode="multi", numClasses=k)]
    else:
        raise ValueError(f"unknown classifier kind: {kind!r}")
    data.unpersist()
    return PipelineModel(stages)


def predict(model: PipelineModel, df: DataFrame, key: str = "record_id", y: str | None = "target",
            keep=()) -> DataFrame:
    """Scored table (key, y, yhat, p[, keep...]) for the metric operators."""
    out = model.transform(df)
    cols = [F.col(key).alias("key")] + ([F.col(y).alias("y")] if y else [])
    return out.select(*cols, F.col("prediction").alias("yhat"), "p", *keep)


def evaluate(scored: DataFrame) -> DataFrame:
    """Label metrics plus log-loss of a scored table (one row)."""
    lm = metrics.label_metrics(metrics.confusion_long(scored))
    return lm.crossJoin(metrics.log_loss(scored))  # one row x one row


class CompositeEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """K12 as a Spark ML Evaluator (larger is better): reads ``prediction`` and the label
    column, computes the composite score distributed, returns the number."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", typeConverter=TypeConverters.toString)
    metricName = Param(Params._dummy(), "metricName", "metric column of label_metrics",
                       typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, labelCol="target", metricName="composite"):
        super().__init__()
        self._setDefault(labelCol="target", metricName="composite")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset):
        s = dataset.select(F.col(self.getOrDefault(self.labelCol)).cast("int").alias("y"),
                           F.col("prediction").cast("int").alias("yhat"))
        row = metrics.label_metrics(metrics.confusion_long(s)).select(
            self.getOrDefault(self.metricName)).first()
        return float(row[0] or 0.0)

    def isLargerBetter(self):
        return True


def majority_predict(train: DataFrame, df: DataFrame, key: str = "record_id", y: str = "target"):
    """J5 as a scored table (uniform-free: p is one-hot on the majority class)."""
    s = df.select(F.col(key).alias("key"), F.col(y).alias("y"))
    b = metrics.majority_baseline(train.select(F.col(y).alias("y")), s)
    return b.withColumn("p", F.array(*[(F.col("yhat") == c).cast("double") for c in range(K)]))


def _with_validation(train: DataFrame, val: DataFrame, key: str) -> DataFrame:
    """Rows of both with ``fold`` 0 (train) and 1 (validation), which must not overlap."""
    if train.select(key).join(val.select(key), key, "left_semi").limit(1).count():
        raise ValueError("training and validation rows overlap")
    return train.withColumn("fold", F.lit(0)).unionByName(val.withColumn("fold", F.lit(1)))


def early_stop_curve(train: DataFrame, val: DataFrame, num=CODED_NUM, cat=(), y: str = "target",
                     params=None, patience: int = 50, key: str = "record_id", k: int = K):
    """Multiclass booster fitted on ``train`` only; per round log-loss and error rate on
    train and on ``val``. Training ends when ``patience`` rounds passed without a lower
    validation loss. Rows (round, train loss, validation loss, train error, validation error,
    best round, last round)."""
    both = _prepared(train, num, cat).transform(_with_validation(train, val, key))
    fitted, = boosting.fit_many(both, [boost_params(params, fold=1, patience=patience)], y, k,
                                "weight", "fold", key)
    if not fitted.curve:
        return []
    per = [(tl / max(tn, 1), vl / max(vn, 1), te / max(tn, 1), ve / max(vn, 1))
           for tn, tl, te, vn, vl, ve in fitted.curve]
    best = min(range(len(per)), key=lambda i: (per[i][1], i))
    return [(i + 1, *per[i], best + 1, len(per)) for i in range(len(per))]


def _left_out_metrics(spark, fitted: list, k: int = K) -> list[dict]:
    """Label metrics and log-loss of each model on the rows it left out. The confusion counts
    (k x k numbers a model) come with the models."""
    cells = [(i, y, yhat, int(f.measured[6 + y * k + yhat])) for i, f in enumerate(fitted)
             for y in range(k) for yhat in range(k)]
    conf = spark.createDataFrame(cells, "model int, y int, yhat int, n long").where("n > 0")
    got = {r.model: r.asDict() for r in metrics.label_metrics(conf, ["model"], k=k).collect()}
    return [{**got.get(i, {}), "log_loss": float(f.measured[4] / max(f.measured[3], 1))}
            for i, f in enumerate(fitted)]


def regularization_sweep(train: DataFrame, val: DataFrame, grids: dict, num=CODED_NUM, cat=(),
                         base=None, key: str = "record_id"):
    """One parameter at a time (least gain, L2, L1), each grid fixing the best value found
    before it; macro F1, accuracy, log-loss on ``val`` and the number of leaves of every value.
    The values of a grid train in one job."""
    both = _prepared(train, num, cat).transform(_with_validation(train, val, key)).persist()
    fixed, rows = dict(base or {}), []
    try:
        for name, values in grids.items():
            fitted = boosting.fit_many(both, [boost_params({**fixed, name: v}, fold=1) for v in values],
                                       "target", K, "weight", "fold", key)
            told = _left_out_metrics(both.sparkSession, fitted)
            leaves = [int((f.trees.bin < 255).sum()) + f.trees.bin[:, :, 0].size for f in fitted]
            rows += [(name, float(v), float(t["f1_macro"]), float(t["accuracy"]), t["log_loss"], n)
                     for v, t, n in zip(values, told, leaves)]
            fixed[name] = values[max(range(len(values)), key=lambda i: (told[i]["f1_macro"], -i))]
    finally:
        both.unpersist()
    return rows, fixed


#: Ranges of the reference's random search (fixed values).
SEARCH_SPACE = {
    "gamma": [0, 0.1, 0.5, 1, 2, 5],
    "reg_lambda": [0.01, 0.1, 1, 5, 10, 50],
    "reg_alpha": [0, 0.01, 0.1, 1, 5, 10],
    "max_depth": [3, 5, 7, 9],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "n_estimators": [100, 200, 300],
    "min_child_weight": [1, 3, 5, 10],
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.7, 0.8, 0.9, 1.0],
}


def random_search(train: DataFrame, space: dict | None = None, n: int = 40, folds: int = 3, num=CODED_NUM,
                  cat=(), seed: int = 42, metric: str = "composite", key: str = "record_id"):
    """``n`` seeded random candidates from ``space`` (name -> list of values) scored by
    stratified ``folds``-fold cross-validation with the composite score; the best one is
    refitted on all of ``train``. All candidates and folds train over the same bins, in one
    job. Returns (best model, [(candidate, mean score, standard deviation)])."""
    from riskloom.operators.features import stratified_folds
    rng = random.Random(seed)
    space = space or SEARCH_SPACE
    cands = [{name: rng.choice(v) for name, v in space.items()} for _ in range(n)]
    prep = _prepared(train, num, cat)
    data = prep.transform(stratified_folds(train, "target", folds, seed, key))
    # The longest fits start first, so that the last tasks are short.
    def cost(c):
        return -c.get("n_estimators", 0) * 2 ** (c.get("max_depth", 6) / 3)
    jobs = sorted(((i, f) for i in range(n) for f in range(folds)), key=lambda j: cost(cands[j[0]]))
    fitted = boosting.fit_many(data, [boost_params(cands[i], fold=f, seed=seed) for i, f in jobs],
                               "target", K, "weight", "fold", key)
    scores: dict[int, list] = {}
    for (i, _), t in zip(jobs, _left_out_metrics(train.sparkSession, fitted)):
        scores.setdefault(i, []).append(float(t.get(metric) or 0.0))
    table = []
    for i, c in enumerate(cands):
        mean = sum(scores[i]) / folds
        table.append((c, mean, (sum((x - mean) ** 2 for x in scores[i]) / folds) ** 0.5))
    best = max(range(n), key=lambda i: (table[i][1], -i))
    refit, = boosting.fit_many(data, [boost_params(cands[best], seed=seed)], "target", K, "weight", key=key)
    return PipelineModel([*prep.stages, boosting.model_of(refit)]), table


def two_stage(train: DataFrame, df: DataFrame, num=CODED_NUM, cat=(), params=None,
              sev_params=None) -> DataFrame:
    """Stage 1 = P(any loss), positives weighted by negatives / positives; stage 2 =
    severity 1..4 among losses, weighted by its own classes. P0 = 1 - p, Pk = p * s_k;
    prediction = argmax."""
    any_loss = F.col("target") > 0
    share = positive_weight(train, any_loss).first()
    weight = float(share.weight or 1.0) if share else 1.0
    loss_train = (train.withColumn("_any", any_loss.cast("int"))
                  .withColumn("_w", F.when(any_loss, F.lit(weight)).otherwise(1.0)))
    sev_train = with_class_weight(
        train.filter(any_loss).withColumn("_sev", F.col("target") - 1), "_sev", "_w")
    stages = [(loss_train, "_any", 2, params),
              (sev_train, "_sev", 4, params if sev_params is None else sev_params)]
    loss, sev = parallel_map(lambda s: fit_risk_classifier(s[0], num, cat, y=s[1], weight="_w", k=s[2],
                                                           params=s[3]), stages, 2)
    a = loss.transform(df).select("record_id", "target", F.col("p")[1].alias("p_loss"))
    b = sev.transform(df).select("record_id", F.col("p").alias("s"))
    return combine_two_stage(a.join(b, "record_id"))


def combine_two_stage(df: DataFrame, p_loss: str = "p_loss", sev: str = "s") -> DataFrame:
    """J10 combination (an array expression): p = [1 - p_loss, p_loss * s_1..s_4]."""
    parts = [1 - F.col(p_loss)] + [F.col(sev)[i] * F.col(p_loss) for i in range(K - 1)]
    out = df.withColumn("p", F.array(*parts))
    return out.select(F.col("record_id").alias("key"), F.col("target").alias("y"),
                      argmax_first([F.col("p")[i] for i in range(K)]).cast("int").alias("yhat"), "p")


def isotonic_calibration(cal: DataFrame, scored: DataFrame, k: int = K):
    """Per class an isotonic map p_k -> P(y = k) fitted on the calibration scores,
    applied to ``scored`` and renormalised. Returns (calibrated scored table, metric rows
    before/after: log-loss, Brier)."""
    # Read once per class and by four metrics; ``scored`` stays, as the result reads it again.
    c = cal.select("y", *[F.col("p")[i].alias(f"_p{i}") for i in range(k)],
                   *[(F.col("y") == i).cast("double").alias(f"_y{i}") for i in range(k)]).persist()
    scored = scored.select("key", "y", "yhat", "p").persist()
    s = scored.select("key", "y", "p", *[F.col("p")[i].alias(f"_p{i}") for i in range(k)])
    for i in range(k):
        iso = IsotonicRegression(featuresCol=f"_p{i}", labelCol=f"_y{i}", predictionCol=f"_c{i}").fit(c)
        s = iso.transform(s)
    c.unpersist()
    s = s.withColumn("p_cal", F.array(*normalised([F.col(f"_c{i}") for i in range(k)], k)))
    out = s.select("key", "y", F.col("p_cal").alias("p")).withColumn(
        "yhat", argmax_first([F.col("p")[i] for i in range(k)]).cast("int"))
    before = metrics.log_loss(scored).crossJoin(metrics.brier(scored)).first()  # 1 x 1 row
    after = metrics.log_loss(out).crossJoin(metrics.brier(out)).first()  # 1 x 1 row
    return out, [("log_loss", float(before.log_loss), float(after.log_loss)),
                 ("brier", float(before.brier), float(after.brier))]


def cross_validate(df: DataFrame, folds: int = 5, num=CODED_NUM, cat=(), kind: str = "rf",
                   seed: int = 42, params=None, parallelism: int = 5):
    """Stratified folds; per fold accuracy, macro F1, macro one-vs-rest ROC AUC,
    log-loss, balanced accuracy and quadratic kappa on train and test. Returns rows (fold,
    split, metrics...)."""
    from riskloom.operators.features import stratified_folds
    data = stratified_folds(df, "target", folds, seed).persist()

    def run(f):
        tr, te = data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)
        m = fit_risk_classifier(tr, num, cat, kind=kind, params=params)
        out = []
        for split, part in (("train", tr), ("test", te)):
            scored = predict(m, part).persist()
            try:
                e = evaluate(scored).first()
                auc = metrics.roc_auc_summary(scored).first().auc_macro
            finally:
                scored.unpersist()
            out.append((f, split, float(e.accuracy), float(e.f1_macro),
                        None if auc is None else float(auc), float(e.log_loss),
                        float(e.balanced_accuracy), float(e.kappa_quadratic)))
        return out

    try:
        return [r for fold_rows in parallel_map(run, range(folds), parallelism) for r in fold_rows]
    finally:
        data.unpersist()


def learning_curve(df: DataFrame, fractions=(0.1, 0.25, 0.5, 0.75, 1.0), folds: int = 3,
                   num=CODED_NUM, cat=(), kind: str = "rf", seed: int = 42, parallelism: int = 4):
    """For each training fraction (seeded) and fold: macro F1 on the fold's train part
    and its test part; mean, std, gap and the verdict of the last point."""
    from riskloom.operators.features import stratified_folds
    from riskloom.operators.util import HASH_M, key_hash
    data = stratified_folds(df, "target", folds, seed).persist()

    def run(job):
        frac, f = job
        tr = data.filter((F.col("fold") != f)
                         & (key_hash(F.col("record_id"), seed + 1) < int(frac * HASH_M)))
        te = data.filter(F.col("fold") == f)
        m = fit_risk_classifier(tr, num, cat, kind=kind)
        f1 = [metrics.label_metrics(metrics.confusion_long(predict(m, part))).first().f1_macro
              for part in (tr, te)]
        return float(f1[0]), float(f1[1])

    jobs = [(frac, f) for frac in fractions for f in range(folds)]
    scores = dict(zip(jobs, parallel_map(run, jobs, parallelism)))
    data.unpersist()

    def mean(v):
        return sum(v) / len(v)

    def std(v):
        return (sum((x - mean(v)) ** 2 for x in v) / len(v)) ** 0.5

    pts = []
    for frac in fractions:
        tr_s = [scores[(frac, f)][0] for f in range(folds)]
        te_s = [scores[(frac, f)][1] for f in range(folds)]
        pts.append((frac, mean(tr_s), std(tr_s), mean(te_s), std(te_s)))
    gap = pts[-1][1] - pts[-1][3]
    if gap > 0.05:
        verdict = "overfitting"
    elif len(pts) > 1 and pts[-1][3] - pts[-2][3] > 0.005:
        verdict = "still improving with more data"
    else:
        verdict = "converged"
    return [(f, a, b, c, d, a - c, verdict) for f, a, b, c, d in pts]


def ablation(train: DataFrame, test: DataFrame, feature_sets: dict, kind: str = "gbt_ovr",
             params=None, cat=()):
    """The same rows, split and parameters with each feature set; metric table and
    the difference of every set against the first one (4 decimals)."""
    names = ("accuracy", "f1_macro", "balanced_accuracy", "kappa_quadratic", "log_loss")

    def run(cols):
        e = evaluate(predict(fit_risk_classifier(train, cols, cat, kind=kind, params=params), test)).first()
        return {c: float(e[c]) for c in names}

    # One after the other: each fit holds its rows.
    results = parallel_map(run, list(feature_sets.values()), 1)
    first = results[0]
    return [(name, *[round(v[c], 4) for c in names], *[round(v[c] - first[c], 4) for c in names])
            for name, v in zip(feature_sets, results)]


def feature_importance(model: PipelineModel, names, top: int = 15):
    """Rows (feature, gain, splits, cover) of a boosted model: the mean gain and the mean
    hessian sum ('cover') of the feature's splits and their number ('weight')."""
    booster = next(s for s in model.stages if isinstance(s, boosting.BoostedModel))
    return boosting.importance(booster.unpacked()[0], list(names))[:top]


def shapley_attribution(model: PipelineModel, sample: DataFrame, background: DataFrame,
                        features, n_perm: int = 8, seed: int = 42, key: str = "record_id",
                        k: int = K) -> DataFrame:
    """J18 for any model (permutation Shapley values of the probabilities; exact values of a
    booster come from ``attribution``).

    For each sampled row x and each of ``n_perm`` seeded feature orders, a background row z
    is drawn (by hash, an equi-join, no cross product); the chain z -> x switches one
    feature at a time in that order (d+1 rows, built with explode). All chains are scored
    in one ``transform``; phi(x, f, class) is the mean change of p[class] when f switches.
    Additivity holds exactly: f(x) = base + sum_f phi, base = mean over orders of f(z)."""
    feats = list(features)
    d = len(feats)
    rng = random.Random(seed)
    orders = [rng.sample(range(d), d) for _ in range(n_perm)]
    # the background is a small sample (its size is checked before it is broadcast)
    bg = background.select(*feats).withColumn("_bg", F.row_number().over(Window.orderBy(*feats)) - 1)
    n_bg = bg.count()
    perm = F.explode(F.array(*[F.lit(i) for i in range(n_perm)])).alias("_perm")
    xs = sample.select(key, *[F.col(c).alias(f"_x_{c}") for c in feats], perm)
    xs = xs.withColumn("_bg", F.pmod(F.xxhash64(key, "_perm", F.lit(seed)), F.lit(n_bg)))
    pairs = xs.join(F.broadcast(bg), "_bg") if n_bg <= 10000 else xs.join(bg, "_bg")
    order_arr = F.element_at(F.array(*[F.array(*[F.lit(j) for j in o]) for o in orders]), F.col("_perm") + 1)
    chain = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_step"))
    # feature j takes x's value when its position in the order is < step
    pos = {j: F.array_position(order_arr, F.lit(j)) - 1 for j in range(d)}
    hybrid = chain.select(key, "_perm", "_step", order_arr.alias("_order"),
                          *[F.when(pos[j] < F.col("_step"), F.col(f"_x_{c}")).otherwise(F.col(c)).alias(c)
                            for j, c in enumerate(feats)])
    scored = model.transform(hybrid).select(key, "_perm", "_step", "_order", "p")
    w = Window.partitionBy(key, "_perm").orderBy("_step")  # d+1 rows per chain
    diffs = scored.withColumn("_prev", F.lag("p").over(w)).filter(F.col("_step") > 0)
    diffs = diffs.select(key, "_perm", F.element_at("_order", F.col("_step")).alias("_j"),
                         F.posexplode(F.array(*[F.col("p")[i] - F.col("_prev")[i] for i in range(k)]))
                         .alias("cls", "delta"))
    names = F.element_at(F.array(*[F.lit(c) for c in feats]), F.col("_j") + 1)
    phi = diffs.groupBy(key, names.alias("feature"), "cls").agg(
        (F.sum("delta") / n_perm).alias("phi"))
    base = scored.filter(F.col("_step") == 0).select(
        key, F.posexplode("p").alias("cls", "v")).groupBy(key, "cls").agg(F.avg("v").alias("base"))
    full = scored.filter(F.col("_step") == d).select(
        key, F.posexplode("p").alias("cls", "v")).groupBy(key, "cls").agg(F.first("v").alias("fx"))
    return phi.join(base, [key, "cls"]).join(full, [key, "cls"])


def shapley_summary(phi: DataFrame, by_class: bool = True, top: int = 3) -> DataFrame:
    """Mean |phi| by feature (and class); the top features of each group."""
    from riskloom.operators.windows import topn_per_group
    if by_class:
        agg = phi.groupBy("cls", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
        return topn_per_group(agg, ["cls"], [F.desc("mean_abs_phi"), F.asc("feature")], top)
    agg = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    return agg.orderBy(F.desc("mean_abs_phi"), F.asc("feature")).limit(top)


def reads_number(model: PipelineModel, col: str) -> bool:
    """Whether the model was fitted on the numeric column ``col``."""
    return any(f"_f_{col}" in s.getInputCols() for s in model.stages
               if isinstance(s, VectorAssembler))


def score_batch(model: PipelineModel, requests: DataFrame, key: str = "record_id") -> DataFrame:
    """One row per request. Valid requests (B16; the price is required only of a model
    that reads it) get class, label, the five probabilities by label (6 decimals) and the
    confidence (max p, 3 decimals); rejected ones get NULL there and their ``reason``.
    Missing history -> 0.0, as the loss ratio is unknown before harvest."""
    from riskloom.operators.clean import validate_request
    v = validate_request(requests, need_price=reads_number(model, "Precio"))
    hist = F.col("hist_mean") if "hist_mean" in requests.columns else F.lit(None)
    # Rejected rows pass through the model with blank inputs, so that the requests are read
    # (and a stream is consumed) once; what the model says of them is not given out.
    blank = {c: F.when(F.col("ok"), F.col(c)) for c in requests.columns if c != key}
    out = model.transform(v.withColumns(
        blank | {"hist_mean": F.when(F.col("ok"), F.coalesce(hist, F.lit(0.0)))}))
    probs = F.create_map(*[x for i, lab in enumerate(RISK_LABELS)
                           for x in (F.lit(lab), round_to(F.col("p")[i], 6))])
    scores = {"clase": F.col("prediction"), "nivel_riesgo": class_label(F.col("prediction")),
              "probabilidades": probs,
              "confianza": round_to(F.greatest(*[F.col("p")[i] for i in range(K)]), 3)}
    return out.select(key, *[F.when(F.col("ok"), c).alias(n) for n, c in scores.items()], "reason")
