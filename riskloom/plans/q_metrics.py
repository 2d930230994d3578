"""Queries for evaluation metrics on the scored role (K1-K15), error summaries (D27,
D28), the majority baseline (J5), the threshold sweep (J12) and the small tables read
off it (E6, F4, F5, F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.constants import SCORE_WEIGHTS
from riskloom.functions.numeric import round_to_sql as rnd
from riskloom.operators import metrics, sorting, windows
from riskloom.operators.util import key_hash_sql
from riskloom.plans.q_clean import TRAIN_TO
from riskloom.plans.registry import register
from riskloom.plans.sql_base import final, with_base
from riskloom.sources.tables import scored

LABEL_COLS = ["n", "accuracy", "n_errors", "error_rate", "balanced_accuracy", "f1_macro",
              "precision_macro", "recall_macro", "f1_weighted", "f2_critical", "recall_critical",
              "kappa", "kappa_quadratic", "mcc", "composite"]
LABEL_INTS = ["n", "n_errors"]
LABEL_DBL = [c for c in LABEL_COLS if c not in LABEL_INTS]
TAUS = metrics.linspace(0.02, 0.90, 60)


def _d(x) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def label_metrics_sql(conf: str, pre: str, group=(), critical: int = 4) -> str:
    """CTE text computing the label metrics from CTE ``conf`` (group..., y, yhat, n); the
    final CTE is named ``{pre}m``. Formulas mirror ``metrics.label_metrics``."""
    g = list(group)
    gs = "".join(f"{c}, " for c in g)
    on = " AND ".join([f"t.{c} = p.{c}" for c in g] + ["t.k = p.k"])
    co = "".join(f"COALESCE(t.{c}, p.{c}) AS {c}, " for c in g)
    gb = f"GROUP BY {', '.join(g)}" if g else ""
    join_sq = (f"JOIN {pre}sq USING ({', '.join(g)})" if g else f"CROSS JOIN {pre}sq")
    w = SCORE_WEIGHTS
    return f"""
{pre}t AS (SELECT {gs}y AS k, SUM(n) AS t, SUM(CASE WHEN y = yhat THEN n ELSE 0 END) AS tp
           FROM {conf} GROUP BY {gs}y),
{pre}p AS (SELECT {gs}yhat AS k, SUM(n) AS p FROM {conf} GROUP BY {gs}yhat),
{pre}pc0 AS (SELECT {co}COALESCE(t.k, p.k) AS k, COALESCE(t.t, 0) AS t, COALESCE(t.tp, 0) AS tp,
                    COALESCE(p.p, 0) AS p FROM {pre}t t FULL JOIN {pre}p p ON {on}),
{pre}pc1 AS (SELECT *, COALESCE(CAST(tp AS DOUBLE) / NULLIF(p, 0), 0) AS precision,
                    COALESCE(CAST(tp AS DOUBLE) / NULLIF(t, 0), 0) AS recall FROM {pre}pc0),
{pre}pc AS (SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1,
                   COALESCE(5 * precision * recall / NULLIF(4 * precision + recall, 0), 0) AS f2
            FROM {pre}pc1),
{pre}cls AS (SELECT {gs}CAST(SUM(t) AS DOUBLE) AS N, CAST(SUM(tp) AS DOUBLE) AS TP,
   AVG(CASE WHEN t > 0 THEN recall END) AS balanced_accuracy,
   AVG(CASE WHEN t > 0 OR p > 0 THEN f1 END) AS f1_macro,
   AVG(CASE WHEN t > 0 OR p > 0 THEN precision END) AS precision_macro,
   AVG(CASE WHEN t > 0 OR p > 0 THEN recall END) AS recall_macro,
   SUM(t * f1) AS _wf1, CAST(SUM(t * p) AS DOUBLE) AS _stp, CAST(SUM(t * t) AS DOUBLE) AS _stt,
   CAST(SUM(p * p) AS DOUBLE) AS _spp, CAST(SUM(k * t) AS DOUBLE) AS _it,
   CAST(SUM(k * p) AS DOUBLE) AS _jp, CAST(SUM(k * k * t) AS DOUBLE) AS _iit,
   CAST(SUM(k * k * p) AS DOUBLE) AS _jjp,
   COALESCE(MAX(CASE WHEN k = {critical} THEN f2 END), 0) AS f2_critical,
   COALESCE(MAX(CASE WHEN k = {critical} THEN recall END), 0) AS recall_critical
   FROM {pre}pc {gb}),
{pre}sq AS (SELECT {gs}CAST(SUM((y - yhat) * (y - yhat) * n) AS DOUBLE) AS _wo FROM {conf} {gb}),
{pre}m0 AS (SELECT {gs}N AS n, TP / N AS accuracy, N - TP AS n_errors, (N - TP) / N AS error_rate,
   balanced_accuracy, f1_macro, precision_macro, recall_macro, _wf1 / N AS f1_weighted,
   f2_critical, recall_critical,
   1 - ((N - TP) / N) / ((N * N - _stp) / (N * N)) AS kappa,
   COALESCE(1 - (_wo / N) / NULLIF((_iit * N + _jjp * N - 2 * _it * _jp) / (N * N), 0), 0) AS kappa_quadratic,
   COALESCE((TP * N - _stp) / NULLIF(sqrt((N * N - _spp) * (N * N - _stt)), 0), 0) AS mcc
   FROM {pre}cls {join_sq}),
{pre}m AS (SELECT *, {w['f2_critica']!r} * f2_critical + {w['bal_acc']!r} * balanced_accuracy
                      + {w['kappa_cuad']!r} * kappa_quadratic + {w['f1_macro']!r} * f1_macro AS composite
           FROM {pre}m0)"""


CONF = "conf AS (SELECT y, yhat, COUNT(*) AS n FROM scored GROUP BY y, yhat)"
MODEL = CONF + "," + label_metrics_sql("conf", "s_")


def sc(spark, sf):
    return scored(spark, sf)


def model_metrics(spark, sf):
    return metrics.label_metrics(metrics.confusion_long(sc(spark, sf)))


@register("confusion_matrix", final(with_base("""
SELECT a.y, b.yhat, COALESCE(c.n, 0) AS n,
       COALESCE(c.n, 0) / CAST(GREATEST(SUM(COALESCE(c.n, 0)) OVER (PARTITION BY a.y), 1) AS DOUBLE) AS rate
FROM range(5) a(y) CROSS JOIN range(5) b(yhat) LEFT JOIN conf c ON c.y = a.y AND c.yhat = b.yhat""", CONF),
    ["rate"], ["y", "yhat", "n"]))
def q_confusion(spark, sf):
    return metrics.confusion_matrix(sc(spark, sf))


def _metric_query(name, cols, doc):
    ints = [c for c in cols if c in LABEL_INTS]
    dbl = [c for c in cols if c not in LABEL_INTS]

    @register(name, final(with_base(f"SELECT {', '.join(cols)} FROM s_m", MODEL), dbl, ints))
    def q(spark, sf):
        return model_metrics(spark, sf).select(*cols)
    q.__doc__ = doc
    return q


_metric_query("accuracy", ["n", "accuracy", "n_errors", "error_rate"], "K2")
_metric_query("balanced_accuracy", ["balanced_accuracy"], "K3")
_metric_query("fbeta_critical", ["f2_critical", "recall_critical"], "K5")
_metric_query("cohen_kappa", ["kappa", "kappa_quadratic"], "K6")
_metric_query("matthews_corrcoef", ["mcc"], "K7")
_metric_query("composite_score", ["f2_critical", "balanced_accuracy", "kappa_quadratic", "f1_macro",
                                  "composite"], "K12")
_metric_query("label_metrics", LABEL_COLS, "K2-K7, K12 together")


@register("classification_report", final(with_base("""
SELECT CAST(k AS VARCHAR) AS label, precision, recall, f1, t AS support FROM s_pc WHERE t > 0 OR p > 0
UNION ALL
SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(t) FROM s_pc WHERE t > 0 OR p > 0
UNION ALL
SELECT 'weighted avg', SUM(precision * t / n), SUM(recall * t / n), SUM(f1 * t / n), SUM(t)
FROM s_pc CROSS JOIN (SELECT SUM(t) AS n FROM s_pc WHERE t > 0 OR p > 0) tot WHERE t > 0 OR p > 0""", MODEL),
    ["precision", "recall", "f1"], ["support"]))
def q_report(spark, sf):
    return metrics.classification_report(sc(spark, sf))


@register("log_loss", final(with_base(
    f"SELECT AVG(-ln(LEAST(GREATEST(p[y + 1], {_d(metrics.LOG_EPS)}), {_d(1 - metrics.LOG_EPS)}))) "
    "AS log_loss FROM scored"), ["log_loss"]))
def q_log_loss(spark, sf):
    return metrics.log_loss(sc(spark, sf))


@register("brier", final(with_base(
    "SELECT AVG(" + " + ".join(f"(p{k} - CAST(y = {k} AS DOUBLE)) * (p{k} - CAST(y = {k} AS DOUBLE))"
                               for k in range(5)) + ") AS brier FROM scored"), ["brier"]))
def q_brier(spark, sf):
    return metrics.brier(sc(spark, sf))


POINTS = """
long AS (""" + " UNION ALL ".join(f"SELECT y, {k} AS k, p{k} AS s FROM scored" for k in range(5)) + """),
d AS (SELECT k, s, COUNT(*) AS cnt, COUNT(*) FILTER (WHERE y = k) AS pos FROM long GROUP BY k, s),
pts AS (SELECT d.*,
          SUM(cnt) OVER (PARTITION BY k ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cum_cnt,
          SUM(pos) OVER (PARTITION BY k ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
          SUM(pos) OVER (PARTITION BY k) AS P, SUM(cnt) OVER (PARTITION BY k) - SUM(pos) OVER (PARTITION BY k) AS Nn
        FROM d),
roc AS (SELECT k, P AS support,
          CASE WHEN P > 0 AND Nn > 0 THEN
            (SUM(pos * (P + Nn - cum_cnt + (cnt + 1) / CAST(2 AS DOUBLE))) - P * (P + 1) / CAST(2 AS DOUBLE))
            / (CAST(P AS DOUBLE) * Nn) END AS auc
        FROM pts GROUP BY k, P, Nn)"""


@register("roc_auc", final(with_base("SELECT k, support, auc FROM roc", POINTS), ["auc"],
                           ["k", "support"]))
def q_roc_auc(spark, sf):
    """One-vs-rest AUC per class (ties count one half)."""
    return metrics.roc_auc(sc(spark, sf))


@register("roc_auc_summary", final(with_base(
    "SELECT AVG(auc) AS auc_macro, SUM(auc * support) / SUM(support) AS auc_weighted FROM roc "
    "WHERE auc IS NOT NULL", POINTS), ["auc_macro", "auc_weighted"]))
def q_roc_auc_summary(spark, sf):
    return metrics.roc_auc_summary(sc(spark, sf))


@register("average_precision", final(with_base(
    "SELECT k, SUM((pos / CAST(P AS DOUBLE)) * (cum_pos / CAST(cum_cnt AS DOUBLE))) AS ap FROM pts "
    "WHERE P > 0 GROUP BY k", POINTS), ["ap"], ["k"]))
def q_average_precision(spark, sf):
    return metrics.average_precision(sc(spark, sf))


@register("average_precision_macro", final(with_base(
    "SELECT AVG(ap) AS ap_macro, COUNT(*) AS classes FROM (SELECT k, SUM((pos / CAST(P AS DOUBLE)) "
    "* (cum_pos / CAST(cum_cnt AS DOUBLE))) AS ap FROM pts WHERE P > 0 GROUP BY k)", POINTS),
    ["ap_macro"], ["classes"]))
def q_average_precision_macro(spark, sf):
    return metrics.average_precision_macro(sc(spark, sf))


@register("roc_pr_points", final(with_base("""
SELECT k, s AS threshold, (cum_cnt - cum_pos) / CAST(Nn AS DOUBLE) AS fpr, cum_pos / CAST(P AS DOUBLE) AS tpr,
       cum_pos / CAST(cum_cnt AS DOUBLE) AS precision, cum_pos / CAST(P AS DOUBLE) AS recall
FROM pts WHERE P > 0""", POINTS), ["threshold", "fpr", "tpr", "precision", "recall"], ["k"]))
def q_roc_pr_points(spark, sf):
    return metrics.roc_pr_points(sc(spark, sf))


@register("pr_area", final(with_base("""
SELECT k, SUM((cum_pos / CAST(P AS DOUBLE) - (cum_pos - pos) / CAST(P AS DOUBLE))
              * (cum_pos / CAST(cum_cnt AS DOUBLE)
                 + CASE WHEN cum_cnt - cnt = 0 THEN CAST(1 AS DOUBLE)
                        ELSE (cum_pos - pos) / CAST(cum_cnt - cnt AS DOUBLE) END) / 2) AS pr_auc
FROM pts WHERE P > 0 GROUP BY k""", POINTS), ["pr_auc"], ["k"]))
def q_pr_area(spark, sf):
    return metrics.pr_area(sc(spark, sf))


_EDGES = ", ".join(str(i / 10) for i in range(1, 10))


@register("calibration_curve", final(with_base(f"""
SELECT bin, AVG(p4) AS mean_p, AVG(CAST(y = 4 AS DOUBLE)) AS observed, COUNT(*) AS n
FROM (SELECT p4, y, len(list_filter(e, lambda x: x < p4)) AS bin
      FROM scored CROSS JOIN (SELECT quantile_cont(p4, [{_EDGES}]) AS e FROM scored) ed) b
GROUP BY bin""", ), ["mean_p", "observed"], ["bin", "n"]))
def q_calibration(spark, sf):
    """Ten quantile bins of p(critical): mean predicted vs observed rate."""
    return metrics.calibration_curve(sc(spark, sf), 4, 10)


_BASE = f"""
mode_tr AS (SELECT y AS m FROM scored WHERE Anio <= {TRAIN_TO} GROUP BY y ORDER BY COUNT(*) DESC, y LIMIT 1),
base AS (SELECT s.key, s.y, mode_tr.m AS yhat, s.Nomestado FROM scored s CROSS JOIN mode_tr),
bconf AS (SELECT y, yhat, COUNT(*) AS n FROM base GROUP BY y, yhat)"""


def baseline(spark, sf):
    s = sc(spark, sf)
    return metrics.majority_baseline(s.filter(F.col("Anio") <= TRAIN_TO), s.drop("yhat"))


@register("majority_baseline", final(with_base("SELECT key, y, yhat FROM base", _BASE), [],
                                     ["key", "y", "yhat"]))
def q_majority(spark, sf):
    """Most frequent training class predicted for every row."""
    return baseline(spark, sf).select("key", "y", "yhat")


_MT = ["accuracy", "balanced_accuracy", "f1_macro", "kappa_quadratic", "composite"]


@register("metric_table", final(with_base(
    " UNION ALL ".join(
        f"SELECT '{c}' AS metric, {rnd('b.' + c, 4)} AS baseline, {rnd('s.' + c, 4)} AS model, "
        f"{rnd(rnd('s.' + c, 4) + ' - ' + rnd('b.' + c, 4), 4)} AS delta FROM b_m b CROSS JOIN s_m s"
        for c in _MT),
    MODEL + "," + _BASE + "," + label_metrics_sql("bconf", "b_")), ["baseline", "model", "delta"]))
def q_metric_table(spark, sf):
    """Baseline vs model on five metrics, 4 decimals, and their difference."""
    from riskloom.functions.numeric import round_to
    b = metrics.label_metrics(metrics.confusion_long(baseline(spark, sf)))
    m = model_metrics(spark, sf)
    rows = []
    for c in _MT:
        bb, mm = round_to(F.col("b." + c), 4), round_to(F.col("m." + c), 4)
        rows.append(F.struct(F.lit(c).alias("metric"), bb.alias("baseline"), mm.alias("model"),
                             round_to(mm - bb, 4).alias("delta")))
    return b.alias("b").crossJoin(m.alias("m")).select(F.inline(F.array(*rows)))  # 1 x 1 rows


@register("error_by_state", final(with_base("""
SELECT Nomestado, n_errors, n, error_rate,
       CASE WHEN error_rate > 0.40 THEN 'alta' WHEN error_rate > 0.20 THEN 'media' ELSE 'baja' END AS severity
FROM (SELECT Nomestado, COUNT(*) FILTER (WHERE y <> yhat) AS n_errors, COUNT(*) AS n,
             COUNT(*) FILTER (WHERE y <> yhat) / CAST(COUNT(*) AS DOUBLE) AS error_rate
      FROM scored WHERE Nomestado IS NOT NULL GROUP BY Nomestado) t
ORDER BY error_rate DESC, Nomestado LIMIT 20"""), ["error_rate"], ["n_errors", "n"]))
def q_error_by_state(spark, sf):
    return metrics.error_by_state(sc(spark, sf))


@register("top_confusions", final(with_base("""
SELECT y, yhat, n, n_errors_total, n * CAST(100 AS DOUBLE) / n_errors_total AS pct_of_errors
FROM (SELECT y, yhat, COUNT(*) AS n FROM scored WHERE y <> yhat GROUP BY y, yhat
      ORDER BY n DESC, y, yhat LIMIT 10) t
CROSS JOIN (SELECT COUNT(*) AS n_errors_total FROM scored WHERE y <> yhat) e"""),
    ["pct_of_errors"], ["y", "yhat", "n", "n_errors_total"]))
def q_top_confusions(spark, sf):
    return metrics.top_confusions(sc(spark, sf))


_J = " + ".join(f"CASE WHEN {_d(t)} <= p4 THEN 1 ELSE 0 END" for t in TAUS)
_SWEEP = f"""
cells AS (SELECT y, yhat, {_J} AS j, COUNT(*) AS n FROM scored GROUP BY y, yhat, j),
taus AS (SELECT * FROM (VALUES {', '.join(f"({i + 1}, {_d(t)})" for i, t in enumerate(TAUS))}) v(i, tau)),
tconf AS (SELECT i, tau, y, CASE WHEN j >= i THEN 4 ELSE yhat END AS yhat, SUM(n) AS n
          FROM cells CROSS JOIN taus GROUP BY i, tau, y, CASE WHEN j >= i THEN 4 ELSE yhat END),""" + label_metrics_sql("tconf", "t_", ["i", "tau"])


def sweep(spark, sf):
    return metrics.threshold_sweep(sc(spark, sf))


@register("threshold_sweep", final(with_base(
    f"SELECT i, tau, {', '.join(LABEL_COLS)} FROM t_m", _SWEEP), ["tau", *LABEL_DBL],
    ["i", *LABEL_INTS]))
def q_threshold_sweep(spark, sf):
    """60 thresholds 0.02-0.90 for raising predictions to the critical class, each with all
    label metrics and the composite score."""
    return sweep(spark, sf)


@register("running_best", final(with_base(
    "SELECT i, composite, MAX(composite) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    " AS best_so_far FROM t_m", _SWEEP), ["composite", "best_so_far"], ["i"]))
def q_running_best(spark, sf):
    """Best composite score so far along the sweep (a 60-row table)."""
    return windows.running_best(sweep(spark, sf).select("i", "composite"), "composite", "i")


@register("best_threshold", final(with_base(
    "SELECT i, tau, composite, recall_critical FROM t_m ORDER BY composite DESC, i LIMIT 1", _SWEEP),
    ["tau", "composite", "recall_critical"], ["i"]))
def q_best_threshold(spark, sf):
    """The threshold with the best composite score (first on ties)."""
    return sorting.best_row(sweep(spark, sf).select("i", "tau", "composite", "recall_critical"),
                            "composite", "i")


@register("rank_candidates", final(with_base(
    "SELECT * FROM (SELECT i, tau, composite, rank() OVER (ORDER BY composite DESC) AS rank FROM t_m) r "
    "WHERE rank <= 10", _SWEEP), ["tau", "composite"], ["i", "rank"]))
def q_rank_candidates(spark, sf):
    """Sweep candidates ranked by composite score (ties share a rank), top 10 ranks."""
    from pyspark.sql import Window
    s = sweep(spark, sf).select("i", "tau", "composite")
    return s.withColumn("rank", F.rank().over(Window.orderBy(F.desc("composite")))).filter(
        F.col("rank") <= 10)


@register("first_match", final(with_base(
    "SELECT key, y, yhat, p4 FROM scored WHERE y = 4 AND yhat = 4 ORDER BY key LIMIT 1"),
    ["p4"], ["key", "y", "yhat"]))
def q_first_match(spark, sf):
    """The first record (by key) of the critical class that was predicted critical."""
    s = sc(spark, sf).select("key", "y", "yhat", F.element_at("p", 5).alias("p4"))
    return sorting.first_match(s, (F.col("y") == 4) & (F.col("yhat") == 4), "key")


@register("error_by_state_volume", final(with_base("""
SELECT Nomestado, COUNT(*) FILTER (WHERE y <> yhat) AS n_errors, COUNT(*) AS n,
       COUNT(*) FILTER (WHERE y <> yhat) / CAST(COUNT(*) AS DOUBLE) AS error_rate
FROM scored WHERE Nomestado IN (SELECT Nomestado FROM scored WHERE Nomestado IS NOT NULL
                                GROUP BY Nomestado ORDER BY COUNT(*) DESC, Nomestado LIMIT 12)
GROUP BY Nomestado"""), ["error_rate"], ["n_errors", "n"]))
def q_error_by_state_volume(spark, sf):
    """Error rate of the 12 states with most rows (sorted by rate in the report)."""
    return metrics.error_by_state_volume(sc(spark, sf), n=12)


@register("scatter_ratio_vs_critical", final(with_base(f"""
SELECT key, proporcion_siniestro, p4 AS p_critica, y FROM scored
ORDER BY {key_hash_sql('key', 42)}, key
LIMIT 8000"""), ["proporcion_siniestro", "p_critica"], ["key", "y"]))
def q_scatter_critical(spark, sf):
    """Seeded sample (8,000 rows) of the true loss ratio against p(critical), by class."""
    s = sc(spark, sf).select("key", "proporcion_siniestro", F.element_at("p", 5).alias("p_critica"), "y")
    return sorting.seeded_sample(s, "key", n=8000, seed=42)
