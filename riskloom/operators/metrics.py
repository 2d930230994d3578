"""Evaluation metrics (K1-K15), error summaries (D27, D28), the majority baseline
and the threshold sweep (J12).

Everything starts from a scored table (key, y, yhat, p array<double>). Label metrics come
from the long confusion table (group..., y, yhat, n): one shuffle, then tiny tables.
Score metrics (AUC, AP, ROC/PR points) collapse tied scores per class first and then use
distributed running sums, so no class is ever sorted in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.constants import SCORE_WEIGHTS
from riskloom.operators.windows import running_totals

K = 5
LOG_EPS = 2.220446049250313e-16  # clip of p[y] inside the log-loss


def confusion_long(scored: DataFrame, group=(), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """K1 (long form): counts per (group..., y, yhat)."""
    return scored.groupBy(*group, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(scored: DataFrame, k: int = K) -> DataFrame:
    """K1: all k x k cells (empty ones 0) with counts and row-normalised rates (empty
    rows divide by 1)."""
    spark = scored.sparkSession
    labels = spark.range(k).select(F.col("id").cast("int").alias("y"))
    grid = labels.crossJoin(labels.withColumnRenamed("y", "yhat"))  # k x k cells, k fixed
    cm = grid.join(confusion_long(scored), ["y", "yhat"], "left").fillna(0, ["n"])
    row = F.sum("n").over(Window.partitionBy("y"))  # k*k rows
    return cm.withColumn("rate", F.col("n") / F.greatest(row, F.lit(1)))


def per_class(conf: DataFrame, group=()) -> DataFrame:
    """Per (group, class): support t, predicted p, true positives tp, precision, recall,
    F1 and F2 (0/0 -> 0)."""
    g = list(group)
    t = conf.groupBy(*g, F.col("y").alias("k")).agg(
        F.sum("n").alias("t"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0))
        .alias("tp"))
    p = conf.groupBy(*g, F.col("yhat").alias("k")).agg(F.sum("n").alias("p"))
    c = t.join(p, [*g, "k"], "full").fillna(0, ["t", "tp", "p"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("p")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("t")), F.lit(0.0))
    c = c.withColumns({"precision": prec, "recall": rec})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    f2 = F.coalesce(F.try_divide(5 * F.col("precision") * F.col("recall"),
                                 4 * F.col("precision") + F.col("recall")), F.lit(0.0))
    return c.withColumns({"f1": f1, "f2": f2})


def label_metrics(conf: DataFrame, group=(), critical: int = 4, k: int = K) -> DataFrame:
    """K2-K7, K12 from a long confusion table: accuracy, errors, balanced accuracy, macro
    and weighted F1 / precision / recall, F2 of the critical class, Cohen kappa (plain and
    quadratic), Matthews correlation and the composite score. One row per group.

    The labels 0..k-1 are fixed, so per-class support, predictions and hits are conditional
    sums of a single aggregation over the (tiny) confusion table; every metric is then a
    column expression -- one shuffle in total."""
    g = list(group)
    y, yh, n_ = F.col("y"), F.col("yhat"), F.col("n")
    aggs = []
    for c in range(k):
        aggs += [F.sum(F.when(y == c, n_).otherwise(0)).alias(f"_t{c}"),
                 F.sum(F.when(yh == c, n_).otherwise(0)).alias(f"_p{c}"),
                 F.sum(F.when((y == c) & (yh == c), n_).otherwise(0)).alias(f"_tp{c}")]
    aggs.append(F.sum(((y - yh) * (y - yh) * n_).cast("double")).alias("_wo"))
    a = conf.groupBy(*g).agg(*aggs)

    def col(name, c):
        return F.col(f"_{name}{c}")

    prec = {c: F.coalesce(F.try_divide(col("tp", c).cast("double"), col("p", c)), F.lit(0.0))
            for c in range(k)}
    rec = {c: F.coalesce(F.try_divide(col("tp", c).cast("double"), col("t", c)), F.lit(0.0))
           for c in range(k)}
    a = a.select("*", *[prec[c].alias(f"_prec{c}") for c in range(k)],
                 *[rec[c].alias(f"_rec{c}") for c in range(k)])
    f1 = {c: F.coalesce(F.try_divide(2 * col("prec", c) * col("rec", c),
                                     col("prec", c) + col("rec", c)), F.lit(0.0)) for c in range(k)}
    f2 = {c: F.coalesce(F.try_divide(5 * col("prec", c) * col("rec", c),
                                     4 * col("prec", c) + col("rec", c)), F.lit(0.0)) for c in range(k)}
    a = a.select("*", *[f1[c].alias(f"_f1{c}") for c in range(k)],
                 *[f2[c].alias(f"_f2{c}") for c in range(k)])

    def ssum(cols):
        out = cols[0]
        for x in cols[1:]:
            out = out + x
        return out

    def cond_avg(vals, conds):
        num = ssum([F.when(cd, v).otherwise(F.lit(0.0)) for v, cd in zip(vals, conds)])
        den = ssum([cd.cast("int") for cd in conds])
        return F.try_divide(num, den)

    present_y = [col("t", c) > 0 for c in range(k)]
    present = [(col("t", c) > 0) | (col("p", c) > 0) for c in range(k)]
    n = ssum([col("t", c) for c in range(k)]).cast("double")
    tp = ssum([col("tp", c) for c in range(k)]).cast("double")
    stp = ssum([col("t", c).cast("double") * col("p", c) for c in range(k)])
    stt = ssum([col("t", c).cast("double") * col("t", c) for c in range(k)])
    spp = ssum([col("p", c).cast("double") * col("p", c) for c in range(k)])
    it = ssum([col("t", c).cast("double") * c for c in range(k)])
    jp = ssum([col("p", c).cast("double") * c for c in range(k)])
    iit = ssum([col("t", c).cast("double") * (c * c) for c in range(k)])
    jjp = ssum([col("p", c).cast("double") * (c * c) for c in range(k)])
    wf1 = ssum([col("t", c) * col("f1", c) for c in range(k)])
    kappa = 1 - F.try_divide((n - tp) / n, (n * n - stp) / (n * n))  # NULL when chance agreement is 1
    exp_q = (iit * n + jjp * n - 2 * it * jp) / (n * n)
    kappa_q = F.coalesce(1 - F.try_divide(F.col("_wo") / n, exp_q), F.lit(0.0))
    mcc = F.coalesce(F.try_divide(tp * n - stp, F.sqrt((n * n - spp) * (n * n - stt))), F.lit(0.0))
    m = a.select(
        *g, n.cast("long").alias("n"), (tp / n).alias("accuracy"),
        (n - tp).cast("long").alias("n_errors"), ((n - tp) / n).alias("error_rate"),
        cond_avg([col("rec", c) for c in range(k)], present_y).alias("balanced_accuracy"),
        cond_avg([col("f1", c) for c in range(k)], present).alias("f1_macro"),
        cond_avg([col("prec", c) for c in range(k)], present).alias("precision_macro"),
        cond_avg([col("rec", c) for c in range(k)], present).alias("recall_macro"),
        (wf1 / n).alias("f1_weighted"), col("f2", critical).alias("f2_critical"),
        col("rec", critical).alias("recall_critical"), kappa.alias("kappa"),
        kappa_q.alias("kappa_quadratic"), mcc.alias("mcc"))
    w = SCORE_WEIGHTS
    return m.withColumn("composite", F.lit(w["f2_critica"]) * F.col("f2_critical")
                        + F.lit(w["bal_acc"]) * F.col("balanced_accuracy")
                        + F.lit(w["kappa_cuad"]) * F.col("kappa_quadratic")
                        + F.lit(w["f1_macro"]) * F.col("f1_macro"))


def classification_report(scored: DataFrame) -> DataFrame:
    """K4: precision / recall / F1 / support per class, plus macro and weighted rows."""
    pc = per_class(confusion_long(scored)).filter((F.col("t") > 0) | (F.col("p") > 0))
    rows = pc.select(F.col("k").cast("string").alias("label"), "precision", "recall", "f1",
                     F.col("t").alias("support"))
    tot = pc.agg(F.sum("t").alias("_n"))
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("t").alias("support"))
    weighted = pc.crossJoin(tot).agg(  # k class rows x one total row
        F.lit("weighted avg").alias("label"),
        F.sum(F.col("precision") * F.col("t") / F.col("_n")).alias("precision"),
        F.sum(F.col("recall") * F.col("t") / F.col("_n")).alias("recall"),
        F.sum(F.col("f1") * F.col("t") / F.col("_n")).alias("f1"), F.sum("t").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def log_loss(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """K8: mean -ln p[y], p clipped to [eps, 1 - eps]."""
    py = F.element_at(F.col(p), F.col(y) + 1)
    clipped = F.least(F.greatest(py, F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    return scored.agg(F.avg(-F.log(clipped)).alias("log_loss"))


def brier(scored: DataFrame, y: str = "y", p: str = "p", k: int = K) -> DataFrame:
    """Mean over rows of sum_k (p_k - [y = k])^2 (k fixed: plain codegen'd terms)."""
    terms = [(F.col(p)[i] - (F.col(y) == i).cast("double")) for i in range(k)]
    sq = terms[0] * terms[0]
    for t in terms[1:]:
        sq = sq + t * t
    return scored.agg(F.avg(sq).alias("brier"))


def count_at_most(values, col):
    """Number of the (literal) ``values`` that are <= ``col``: a sum of comparisons that
    stays inside whole-stage codegen (no per-row array or lambda)."""
    out = F.lit(0)
    for v in values:
        out = out + (F.lit(v) <= col).cast("int")
    return out


def score_points(scored: DataFrame, y: str = "y", p: str = "p", k: int = K) -> DataFrame:
    """Per class and distinct score s (descending): rows and positives at s, and the
    cumulative counts of rows / positives with score >= s; plus class totals."""
    long = scored.select(F.posexplode(F.col(p)).alias("k", "s"), F.col(y).alias("_y"))
    d = long.groupBy("k", "s").agg(F.count(F.lit(1)).alias("cnt"),
                                   F.count_if(F.col("_y") == F.col("k")).alias("pos"))
    d = d.withColumn("neg_s", -F.col("s"))
    run = running_totals(d, ["k"], ["neg_s"], ["cnt", "pos"], include_current=True, prefix="cum_")
    # From the persisted ranges under ``run``: ``d`` would read and score all rows again.
    tot = run.groupBy("k").agg(F.sum("pos").alias("P"), (F.sum("cnt") - F.sum("pos")).alias("Nn"))
    return run.join(tot, "k").drop("neg_s", "cum_n")


def roc_auc(scored: DataFrame) -> DataFrame:
    """K9: one-vs-rest ROC AUC per class by the Mann-Whitney statistic with ties counted
    one half: AUC = (sum of positives' average ranks - P(P+1)/2) / (P N); NULL when a class
    has no positive or no negative."""
    pts = score_points(scored)
    # ascending average rank of score s = rows below s + (cnt + 1) / 2
    below = F.col("P") + F.col("Nn") - F.col("cum_cnt")
    rank = below + (F.col("cnt") + 1) / 2
    per = pts.groupBy("k", "P", "Nn").agg(F.sum(F.col("pos") * rank).alias("_rs"))
    auc = F.try_divide(F.col("_rs") - F.col("P") * (F.col("P") + 1) / 2,
                       F.col("P").cast("double") * F.col("Nn"))
    return per.select("k", F.col("P").alias("support"), F.when((F.col("P") > 0) & (F.col("Nn") > 0), auc)
                      .alias("auc"))


def roc_auc_summary(scored: DataFrame) -> DataFrame:
    """K9: macro and support-weighted AUC over the classes where it is defined."""
    a = roc_auc(scored).filter(F.col("auc").isNotNull())
    return a.agg(F.avg("auc").alias("auc_macro"),
                 (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc_weighted"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Per class sum over distinct thresholds of (R_n - R_(n-1)) P_n, for classes that
    have positives."""
    pts = score_points(scored).filter(F.col("P") > 0)
    ap = pts.groupBy("k").agg(F.sum((F.col("pos") / F.col("P")) * (F.col("cum_pos") / F.col("cum_cnt")))
                              .alias("ap"))
    return ap


def average_precision_macro(scored: DataFrame) -> DataFrame:
    """Mean of the classes' average precision over those that have positives (one row)."""
    return average_precision(scored).agg(F.avg("ap").alias("ap_macro"),
                                         F.count(F.lit(1)).alias("classes"))


def roc_pr_points(scored: DataFrame) -> DataFrame:
    """Every distinct threshold of every class with a positive: fpr, tpr, precision,
    recall (all points kept)."""
    pts = score_points(scored).filter(F.col("P") > 0)
    return pts.select("k", F.col("s").alias("threshold"),
                      F.try_divide(F.col("cum_cnt") - F.col("cum_pos"), F.col("Nn").cast("double")).alias("fpr"),
                      (F.col("cum_pos") / F.col("P")).alias("tpr"),
                      (F.col("cum_pos") / F.col("cum_cnt")).alias("precision"),
                      (F.col("cum_pos") / F.col("P")).alias("recall"))


def pr_area(scored: DataFrame) -> DataFrame:
    """Trapezoid area under the precision-recall points, starting at (R=0, P=1).
    The previous point is the cumulative count minus this threshold's rows, so no lag
    window is needed."""
    pts = score_points(scored).filter(F.col("P") > 0)
    r = F.col("cum_pos") / F.col("P")
    pr = F.col("cum_pos") / F.col("cum_cnt")
    prev_cnt = F.col("cum_cnt") - F.col("cnt")
    prev_pos = F.col("cum_pos") - F.col("pos")
    r0 = prev_pos / F.col("P")
    p0 = F.when(prev_cnt == 0, F.lit(1.0)).otherwise(prev_pos / prev_cnt)
    return pts.groupBy("k").agg(F.sum((r - r0) * (pr + p0) / 2).alias("pr_auc"))


def calibration_curve(scored: DataFrame, cls: int = 4, bins: int = 10, y: str = "y",
                      p: str = "p") -> DataFrame:
    """Quantile bins of p[cls] (inner edges = exact percentiles; a score equal to
    an edge belongs to the bin below it); per non-empty bin: mean predicted probability, observed rate, count."""
    d = scored.select(F.element_at(F.col(p), cls + 1).alias("_p"), (F.col(y) == cls).cast("double").alias("_o"))
    from riskloom.operators.quantiles import exact_quantiles
    qs = [i / bins for i in range(1, bins)]
    eq = exact_quantiles(d, "_p", qs)
    edges = eq.groupBy().agg(F.array(*[F.max(F.when(F.col("prob") == x, F.col("q")))
                                       for x in qs]).alias("_e"))  # one row
    b = d.crossJoin(F.broadcast(edges))  # edges: one row
    nbin = F.lit(0)
    for i in range(bins - 1):
        nbin = nbin + (F.col("_e")[i] < F.col("_p")).cast("int")
    b = b.withColumn("bin", nbin)
    return b.groupBy("bin").agg(F.avg("_p").alias("mean_p"), F.avg("_o").alias("observed"),
                                F.count(F.lit(1)).alias("n"))


def majority_baseline(train: DataFrame, df: DataFrame, y: str = "y", out: str = "yhat") -> DataFrame:
    """Predict the most frequent training class (smallest class on ties) for every row."""
    mode = train.agg(F.mode(y, deterministic=True).alias("_mode"))  # one row
    return df.crossJoin(F.broadcast(mode)).withColumn(out, F.col("_mode")).drop("_mode")  # 1-row mode


def error_by_state(scored: DataFrame, state: str = "Nomestado", n: int = 20) -> DataFrame:
    """Errors, rows and error rate per state; top n by rate (ties by state) with a
    severity band (> .40 high, > .20 medium, else low)."""
    agg = (scored.filter(F.col(state).isNotNull()).groupBy(state)
           .agg(F.count_if(F.col("y") != F.col("yhat")).alias("n_errors"), F.count(F.lit(1)).alias("n"))
           .withColumn("error_rate", F.col("n_errors") / F.col("n")))
    top = agg.orderBy(F.desc("error_rate"), F.asc(state)).limit(n)
    return top.withColumn("severity", F.when(F.col("error_rate") > 0.40, "alta")
                          .when(F.col("error_rate") > 0.20, "media").otherwise("baja"))


def error_by_state_volume(scored: DataFrame, state: str = "Nomestado", n: int = 12) -> DataFrame:
    """D27 (variant): the n states with most rows; errors, rows and error rate, highest
    rate first."""
    from riskloom.operators.joins import topn_semi_join
    top = topn_semi_join(scored.filter(F.col(state).isNotNull()), state, n)
    agg = top.groupBy(state).agg(F.count_if(F.col("y") != F.col("yhat")).alias("n_errors"),
                                 F.count(F.lit(1)).alias("n"))
    return agg.withColumn("error_rate", F.col("n_errors") / F.col("n")).orderBy(
        F.desc("error_rate"), F.asc(state))


def top_confusions(scored: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent (true, predicted) error pairs, with their share of all errors."""
    errs = confusion_long(scored.filter(F.col("y") != F.col("yhat")))
    tot = errs.agg(F.sum("n").alias("n_errors_total"))  # one row
    top = errs.orderBy(F.desc("n"), F.asc("y"), F.asc("yhat")).limit(n)
    return top.crossJoin(tot).withColumn(  # n rows x one total row
        "pct_of_errors", F.col("n") * 100.0 / F.col("n_errors_total"))


def linspace(lo: float, hi: float, n: int):
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [hi]


def threshold_sweep(scored: DataFrame, cls: int = 4, lo: float = 0.02, hi: float = 0.90,
                    n: int = 60, p: str = "p") -> DataFrame:
    """For every threshold tau, raise the prediction to ``cls`` when p[cls] >= tau,
    and score the result (all label metrics, composite included).

    No row is repeated per threshold: each row gets j = number of thresholds <= p[cls]
    (the row is raised for thresholds 1..j), rows are counted per (y, yhat, j) -- at most
    5 x 5 x (n+1) cells -- and only that small table is expanded over the thresholds."""
    taus = linspace(lo, hi, n)
    pc = F.col(p)[cls]
    cells = scored.select("y", "yhat", count_at_most(taus, pc).alias("j")).groupBy(
        "y", "yhat", "j").agg(F.count(F.lit(1)).alias("n"))
    tau_tab = F.broadcast(scored.sparkSession.createDataFrame(
        [(i + 1, float(t)) for i, t in enumerate(taus)], "i int, tau double"))  # n fixed rows
    ex = cells.crossJoin(tau_tab).select(  # <= 5*5*(n+1) cells x n thresholds
        "i", "tau", "y", F.when(F.col("j") >= F.col("i"), F.lit(cls)).otherwise(F.col("yhat")).alias("yhat"),
        "n")
    conf = ex.groupBy("i", "tau", "y", "yhat").agg(F.sum("n").alias("n"))
    return label_metrics(conf, ["i", "tau"], cls)
