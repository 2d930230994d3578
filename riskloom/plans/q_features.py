"""Queries for history features, encodings and label helpers
(B6, B11, E1, E2, E8, I1-I3, I7, C6, D25, D26, D29, J13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.constants import FEATURES_SOWING
from riskloom.functions.numeric import round_to_sql as rnd
from riskloom.operators import clean, features, profile, windows
from riskloom.operators.util import key_hash_sql
from riskloom.plans.q_clean import TRAIN_TO, risky
from riskloom.plans.registry import register
from riskloom.plans.sql_base import final, with_base

HIST_KEYS = ["Nomestado", "Nomcultivo", "Nomcicloproductivo", "Nommodalidad"]
_HK = ", ".join(HIST_KEYS)
SEED = 42
N_FOLDS = 5
TE_COLS = ["Idestado", "Idmunicipio", "Idcultivo"]
ORD_COLS = ["Nomestado", "Nommunicipio", "Nomcultivo"]


@register("select_features", final(with_base(
    f"SELECT record_id, {', '.join(FEATURES_SOWING)} FROM risky"),
    ["Sembrada", "Precio"], ["record_id"]))
def q_select_features(spark, sf):
    """The six pre-harvest features (post-harvest columns are refused)."""
    return clean.select_features(risky(spark, sf), FEATURES_SOWING, key="record_id")


_READABLE = {"Nomestado": "estado", "Nomcultivo": "cultivo", "Nommodalidad": "modalidad",
             "Nomcicloproductivo": "ciclo", "Sembrada": "superficie_sembrada"}


@register("rename_readable", final(with_base(
    "SELECT record_id, " + ", ".join(f"{k} AS {v}" for k, v in _READABLE.items()) + " FROM records"),
    ["superficie_sembrada"], ["record_id"]))
def q_rename(spark, sf):
    r = risky(spark, sf).select("record_id", *_READABLE)
    return clean.rename_readable(r, _READABLE)


_E2 = f"""
py AS (SELECT {_HK}, Anio, SUM(proporcion_siniestro) AS s, COUNT(proporcion_siniestro) AS n
       FROM risky GROUP BY {_HK}, Anio),
hist AS (SELECT {_HK}, Anio,
                SUM(s) OVER (PARTITION BY {_HK} ORDER BY Anio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                / SUM(n) OVER (PARTITION BY {_HK} ORDER BY Anio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
         FROM py),
e2 AS (SELECT r.*, COALESCE(h.m, CAST(0 AS DOUBLE)) AS hist_mean FROM risky r
       JOIN hist h USING ({_HK}, Anio))"""


def with_history(spark, sf):
    return windows.prior_year_mean(risky(spark, sf), HIST_KEYS)


@register("prior_year_mean", final(with_base("SELECT record_id, Anio, hist_mean FROM e2", _E2),
                                   ["hist_mean"], ["record_id", "Anio"]))
def q_prior_year_mean(spark, sf):
    """Mean loss ratio of the same (state, crop, cycle, mode) in strictly earlier years."""
    return with_history(spark, sf).select("record_id", "Anio", "hist_mean")


@register("prior_row_mean", final(with_base(f"""
SELECT record_id, Anio, COALESCE(AVG(proporcion_siniestro) OVER (
    PARTITION BY {_HK} ORDER BY Anio, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    CAST(0 AS DOUBLE)) AS hist_mean_rows
FROM risky"""), ["hist_mean_rows"], ["record_id", "Anio"]))
def q_prior_row_mean(spark, sf):
    """Mean loss ratio over all earlier rows of the group in (year, key) order."""
    return windows.prior_row_mean(risky(spark, sf), HIST_KEYS).select(
        "record_id", "Anio", "hist_mean_rows")


@register("share_zero_history", final(with_base(f"""
SELECT COUNT(*) FILTER (WHERE hist_mean = 0) AS n_zero,
       {rnd('COUNT(*) FILTER (WHERE hist_mean = 0) * CAST(100 AS DOUBLE) / COUNT(*)', 2)} AS pct_zero,
       MIN(hist_mean) AS min, MAX(hist_mean) AS max, AVG(hist_mean) AS mean FROM e2""", _E2),
    ["pct_zero", "min", "max", "mean"], ["n_zero"]))
def q_share_zero_history(spark, sf):
    return profile.share_zero_history(with_history(spark, sf), "hist_mean")


_OTS_H = key_hash_sql("record_id", SEED)


@register("ordered_target_statistic", final(with_base(f"""
SELECT record_id, Nomcultivo,
       (COALESCE(SUM(proporcion_siniestro) OVER w, 0) + CAST(0 AS DOUBLE)) / (COUNT(*) OVER w + CAST(1 AS DOUBLE))
         AS Nomcultivo_ots
FROM risky
WINDOW w AS (PARTITION BY Nomcultivo ORDER BY {_OTS_H}, record_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""), ["Nomcultivo_ots"], ["record_id"]))
def q_ordered_ts(spark, sf):
    """Loss-ratio statistic of the crop from rows before each row in a seeded order
    (prior 0, weight 1)."""
    out = windows.ordered_target_statistic(risky(spark, sf), "Nomcultivo", "proporcion_siniestro",
                                           prior=0.0, seed=SEED)
    return out.select("record_id", "Nomcultivo", "Nomcultivo_ots")


@register("label_encode", final(with_base(
    "SELECT record_id, " + ", ".join(
        f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_encoded" for c in TE_COLS) + " FROM records"),
    [], ["record_id", *[f"{c}_encoded" for c in TE_COLS]]))
def q_label_encode(spark, sf):
    """Dense codes in sorted order for state, municipality and crop ids."""
    out = features.label_encode(risky(spark, sf), TE_COLS)
    return out.select("record_id", *[f"{c}_encoded" for c in TE_COLS])


_ORD_SQL = "SELECT r.record_id, " + ", ".join(
    f"COALESCE(k{i}.code, -1) AS {c}_ord" for i, c in enumerate(ORD_COLS)) + " FROM records r " + " ".join(
    f"LEFT JOIN (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM "
    f"(SELECT DISTINCT {c} AS v FROM records WHERE Anio <= {TRAIN_TO} AND {c} IS NOT NULL) d) k{i} "
    f"ON k{i}.v = r.{c}" for i, c in enumerate(ORD_COLS))


@register("ordinal_encode", final(with_base(_ORD_SQL), [], ["record_id", *[f"{c}_ord" for c in ORD_COLS]]))
def q_ordinal(spark, sf):
    """Codes fitted on the training years only; unseen values -> -1."""
    r = risky(spark, sf)
    out = features.ordinal_encode(r.filter(F.col("Anio") <= TRAIN_TO), r, ORD_COLS)
    return out.select("record_id", *[f"{c}_ord" for c in ORD_COLS])


_TE_SQL = f"""
SELECT r.record_id, {', '.join(f'COALESCE((k{i}.s + g.g * CAST(100 AS DOUBLE)) / (k{i}.n + CAST(100 AS DOUBLE)), g.g) AS {c}_te' for i, c in enumerate(TE_COLS))}
FROM risky r CROSS JOIN (SELECT AVG(proporcion_siniestro) AS g FROM risky WHERE Anio <= {TRAIN_TO}) g
{' '.join(f'LEFT JOIN (SELECT {c} AS v, SUM(proporcion_siniestro) AS s, COUNT(proporcion_siniestro) AS n FROM risky WHERE Anio <= {TRAIN_TO} AND {c} IS NOT NULL GROUP BY {c}) k{i} ON k{i}.v = r.{c}' for i, c in enumerate(TE_COLS))}"""


@register("target_encode", final(with_base(_TE_SQL), [f"{c}_te" for c in TE_COLS], ["record_id"]))
def q_target_encode(spark, sf):
    """Smoothed (m = 100) loss-ratio means of state, municipality and crop from the
    training years; unseen -> global train mean."""
    r = risky(spark, sf)
    out = features.target_encode(r.filter(F.col("Anio") <= TRAIN_TO), r, TE_COLS,
                                 "proporcion_siniestro", 100.0)
    return out.select("record_id", *[f"{c}_te" for c in TE_COLS])


@register("one_hot_label", final(with_base(
    "SELECT record_id, target, " + ", ".join(
        f"CAST(target = {k} AS INTEGER) AS y_{k}" for k in range(5)) + " FROM risky"),
    [], ["record_id", "target", *[f"y_{k}" for k in range(5)]]))
def q_one_hot(spark, sf):
    return features.one_hot_label(risky(spark, sf)).select(
        "record_id", "target", *[f"y_{k}" for k in range(5)])


@register("class_weights", final(with_base("""
SELECT target, n_k, CAST(SUM(n_k) OVER () AS DOUBLE) / (COUNT(*) OVER () * n_k) AS weight
FROM (SELECT target, COUNT(*) AS n_k FROM risky WHERE target IS NOT NULL GROUP BY target) t"""),
    ["weight"], ["target", "n_k"]))
def q_class_weights(spark, sf):
    return features.class_weights(risky(spark, sf))


@register("map_lookup_join", final(with_base("""
SELECT r.record_id, r.target, COALESCE(w.weight, CAST(0 AS DOUBLE)) AS weight FROM risky r
LEFT JOIN (SELECT target, CAST(SUM(n_k) OVER () AS DOUBLE) / (COUNT(*) OVER () * n_k) AS weight
           FROM (SELECT target, COUNT(*) AS n_k FROM risky GROUP BY target) t) w ON w.target = r.target"""),
    ["weight"], ["record_id", "target"]))
def q_map_lookup(spark, sf):
    """Class weight attached to every record through a lookup join."""
    return features.with_class_weight(risky(spark, sf)).select("record_id", "target", "weight")


@register("positive_weight", final(with_base("""
SELECT negatives, positives, CAST(negatives AS DOUBLE) / positives AS weight
FROM (SELECT COUNT(*) FILTER (WHERE NOT (target > 0)) AS negatives,
             COUNT(*) FILTER (WHERE target > 0) AS positives FROM risky) t"""),
    ["weight"], ["negatives", "positives"]))
def q_positive_weight(spark, sf):
    """Negatives / positives for the binary 'any loss' label."""
    return features.positive_weight(risky(spark, sf), F.col("target") > 0)


_FH = key_hash_sql("record_id", SEED)


@register("stratified_folds", final(with_base(f"""
SELECT record_id, target, (row_number() OVER (PARTITION BY target ORDER BY {_FH}, record_id) - 1)
       % {N_FOLDS} AS fold FROM risky"""), [], ["record_id", "target", "fold"]))
def q_folds(spark, sf):
    """Five folds balanced within each risk class, seeded order."""
    return features.stratified_folds(risky(spark, sf), "target", N_FOLDS, SEED).select(
        "record_id", "target", "fold")
