"""Queries for the record view, cleaning and derived columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import clean, profile
from riskloom.plans.registry import register
from riskloom.plans.sql_base import final, with_base
from riskloom.sources.tables import records

TRAIN_TO, VAL_TO = 1999, 2000

ID_INTS = ["record_id", "Anio", "Idestado", "Idmunicipio", "Idciclo", "Idmodalidad", "Idcultivo"]
MEAS = ["Sembrada", "Siniestrada", "Cosechada", "Volumenproduccion", "Rendimiento", "Precio",
        "Valorproduccion"]


def risky(spark, sf):
    return clean.with_risk(records(spark, sf))


@register("records", final(with_base("SELECT * FROM records"), MEAS, ID_INTS))
def q_records(spark, sf):
    """The record-grain view over the driver tables."""
    return records(spark, sf)


@register("loss_ratio", final(with_base(
    "SELECT record_id, Sembrada, Siniestrada, proporcion_siniestro FROM risky"),
    ["Sembrada", "Siniestrada", "proporcion_siniestro"], ["record_id"]))
def q_loss_ratio(spark, sf):
    return risky(spark, sf).select("record_id", "Sembrada", "Siniestrada", "proporcion_siniestro")


@register("risk_class", final(with_base(
    "SELECT record_id, proporcion_siniestro, target, nivel_riesgo FROM risky"),
    ["proporcion_siniestro"], ["record_id", "target"]))
def q_risk_class(spark, sf):
    return risky(spark, sf).select("record_id", "proporcion_siniestro", "target", "nivel_riesgo")


_CLASS_SQL = with_base("""
SELECT l.target, l.nivel_riesgo, COALESCE(c.registros, 0) AS registros,
       COALESCE(c.sembrada, CAST(0 AS DOUBLE)) AS sembrada,
       (round(COALESCE(c.registros, 0) * CAST(100 AS DOUBLE)
             / SUM(COALESCE(c.registros, 0)) OVER () * 100) / CAST(100 AS DOUBLE)) AS pct
FROM (VALUES (0, 'Sin siniestro'), (1, 'Riesgo bajo'), (2, 'Riesgo medio'), (3, 'Riesgo alto'),
             (4, 'Pérdida crítica')) AS l(target, nivel_riesgo)
LEFT JOIN (SELECT target, COUNT(*) AS registros, SUM(Sembrada) AS sembrada
           FROM risky GROUP BY target) c ON c.target = l.target""")


@register("class_distribution", final(_CLASS_SQL, ["sembrada", "pct"], ["target", "registros"]))
def q_class_distribution(spark, sf):
    """Flagship: records and sown area per risk level."""
    return profile.class_distribution(risky(spark, sf))


@register("apply_types", final(with_base("""
SELECT record_id, TRY_CAST(TRY_CAST(CAST(Anio AS VARCHAR) AS DOUBLE) AS INTEGER) AS Anio,
       TRY_CAST(CAST(Sembrada AS VARCHAR) AS DOUBLE) AS Sembrada,
       TRY_CAST(COALESCE(CAST(Precio AS VARCHAR), 'n/d') AS DOUBLE) AS Precio
FROM records"""), ["Sembrada", "Precio"], ["record_id", "Anio"]))
def q_apply_types(spark, sf):
    """Coercing casts on a text rendering of the records ('n/d' where price is missing)."""
    r = records(spark, sf)
    text = r.select("record_id", F.col("Anio").cast("string").alias("Anio"),
                    F.col("Sembrada").cast("string").alias("Sembrada"),
                    F.coalesce(F.col("Precio").cast("string"), F.lit("n/d")).alias("Precio"))
    return clean.apply_types(text, numeric=["Sembrada", "Precio", "absent_col"])


_IMPUTE = ", ".join(
    f"CASE WHEN Cosechada = 0 AND {c} IS NULL THEN CAST(0 AS DOUBLE) ELSE {c} END AS {c}"
    for c in ["Precio", "Rendimiento", "Valorproduccion", "Volumenproduccion"])


@register("impute_structural_nulls", final(with_base(
    f"SELECT record_id, Cosechada, {_IMPUTE} FROM records"),
    ["Cosechada", "Precio", "Rendimiento", "Valorproduccion", "Volumenproduccion"], ["record_id"]))
def q_impute(spark, sf):
    out = clean.impute_structural_nulls(records(spark, sf))
    return out.select("record_id", "Cosechada", "Precio", "Rendimiento", "Valorproduccion",
                      "Volumenproduccion")


@register("drop_residual_nulls", final(with_base(
    "SELECT record_id, Sembrada, Volumenproduccion FROM records "
    "WHERE Sembrada IS NOT NULL AND Volumenproduccion IS NOT NULL"),
    ["Sembrada", "Volumenproduccion"], ["record_id"]))
def q_drop_residual(spark, sf):
    return clean.drop_residual_nulls(records(spark, sf)).select(
        "record_id", "Sembrada", "Volumenproduccion")


def _norm_sql(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^\\x01-\\x7F]', '', 'g'))"


@register("normalize_text", final(with_base(
    f"SELECT record_id, {_norm_sql('Nomcicloproductivo')} AS ciclo_norm, "
    f"{_norm_sql('nivel_riesgo')} AS nivel_norm FROM risky"), [], ["record_id"]))
def q_normalize_text(spark, sf):
    from riskloom.functions.risk import normalize_text
    return risky(spark, sf).select("record_id",
                                   normalize_text("Nomcicloproductivo").alias("ciclo_norm"),
                                   normalize_text("nivel_riesgo").alias("nivel_norm"))


_LABEL_SQL = f"""
SELECT record_id, nivel_riesgo,
  CASE WHEN n IS NULL OR n IN ('', 'nan', 'none') THEN 0
       WHEN contains(n, 'sin') THEN 0 WHEN contains(n, 'bajo') THEN 1
       WHEN contains(n, 'medio') THEN 2 WHEN contains(n, 'alto') THEN 3 ELSE 4 END AS clase
FROM (SELECT record_id, nivel_riesgo, {_norm_sql('nivel_riesgo')} AS n FROM risky) t"""


@register("label_to_class", final(with_base(_LABEL_SQL), [], ["record_id", "clase"]))
def q_label_to_class(spark, sf):
    from riskloom.functions.risk import label_to_class
    return risky(spark, sf).select("record_id", "nivel_riesgo",
                                   label_to_class("nivel_riesgo").alias("clase"))


@register("temporal_split", final(with_base(f"""
SELECT split, n, CAST(n AS DOUBLE) / SUM(n) OVER () AS share FROM (
  SELECT CASE WHEN Anio <= {TRAIN_TO} THEN 'train' WHEN Anio <= {VAL_TO} THEN 'val'
              WHEN Anio > {VAL_TO} THEN 'test' END AS split, COUNT(*) AS n
  FROM risky GROUP BY 1) t WHERE split IS NOT NULL"""), ["share"], ["n"]))
def q_temporal_split(spark, sf):
    """Split sizes and shares; train <= 1999, validation 2000, test >= 2001."""
    counts = (risky(spark, sf).withColumn("split", clean.split_label(TRAIN_TO, VAL_TO))
              .filter(F.col("split").isNotNull()).groupBy("split").agg(F.count(F.lit(1)).alias("n")))
    return counts.withColumn("share", F.col("n").cast("double")
                             / F.sum("n").over(Window.partitionBy()))  # 3 rows


@register("engineer_features", final(with_base(
    "SELECT record_id, ln(1 + Sembrada) AS log_sembrada, "
    "Idmodalidad * Idciclo AS interaccion_mod_ciclo FROM records"),
    ["log_sembrada"], ["record_id", "interaccion_mod_ciclo"]))
def q_engineer(spark, sf):
    return clean.engineer_features(records(spark, sf)).select(
        "record_id", "log_sembrada", "interaccion_mod_ciclo")


@register("fill_model_inputs", final(with_base(
    "SELECT record_id, COALESCE(Nomestado, 'Desconocido') AS Nomestado, "
    "COALESCE(Nomcicloproductivo, 'Desconocido') AS Nomcicloproductivo, "
    "COALESCE(Nommodalidad, 'Desconocido') AS Nommodalidad, "
    "COALESCE(Nomcultivo, 'Desconocido') AS Nomcultivo, "
    "COALESCE(Sembrada, CAST(0 AS DOUBLE)) AS Sembrada, "
    "COALESCE(Precio, CAST(0 AS DOUBLE)) AS Precio FROM records"),
    ["Sembrada", "Precio"], ["record_id"]))
def q_fill_inputs(spark, sf):
    out = clean.fill_model_inputs(records(spark, sf))
    return out.select("record_id", "Nomestado", "Nomcicloproductivo", "Nommodalidad",
                      "Nomcultivo", "Sembrada", "Precio")


@register("rainfed_area", final(with_base(
    "SELECT record_id, CAST(contains(lower(Nommodalidad), 'temporal') AS INTEGER) AS es_temporal, "
    "Sembrada * CAST(contains(lower(Nommodalidad), 'temporal') AS INTEGER) AS area_temporal "
    "FROM records"), ["area_temporal"], ["record_id", "es_temporal"]))
def q_rainfed(spark, sf):
    return clean.rainfed_area(records(spark, sf)).select("record_id", "es_temporal", "area_temporal")


_TEXTS = clean.REQUEST_TEXTS
_VALIDATE_SQL = with_base(f"""
SELECT r.record_id,
  CASE {' '.join(f"WHEN r.{c} IS NULL OR trim(r.{c}) = '' THEN 'missing {c}'" for c in _TEXTS)}
       WHEN r.Sembrada IS NULL THEN 'missing Sembrada' WHEN r.Sembrada < 0 THEN 'negative Sembrada'
       WHEN r.Precio IS NULL THEN 'missing Precio' WHEN r.Precio < 0 THEN 'negative Precio'
  END AS reason,
  CASE {' '.join(f"WHEN k{i}.v IS NULL THEN 'unknown {c}'" for i, c in reversed(list(enumerate(_TEXTS))))}
  END AS flag
FROM records r
{' '.join(f"LEFT JOIN (SELECT DISTINCT {c} AS v FROM records WHERE Anio <= {TRAIN_TO}) k{i} ON k{i}.v = r.{c}"
          for i, c in enumerate(_TEXTS))}""")


@register("validate_request", final(
    f"SELECT record_id, reason IS NULL AS ok, reason, flag FROM ({_VALIDATE_SQL}) v",
    [], ["record_id"]))
def q_validate(spark, sf):
    """Scoring requests taken from the records; categories unseen in training are flagged."""
    r = records(spark, sf)
    req = r.select("record_id", *_TEXTS, "Sembrada", "Precio")
    train = r.filter(F.col("Anio") <= TRAIN_TO)
    out = clean.validate_request(req, {c: train.select(c) for c in _TEXTS})
    return out.select("record_id", "ok", "reason", "flag")


@register("label_report", final(with_base(f"""
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE n IS NULL OR n IN ('', 'nan', 'none')) AS n_unknown,
       {', '.join(f"COUNT(*) FILTER (WHERE CASE WHEN n IS NULL OR n IN ('', 'nan', 'none') THEN 0 WHEN contains(n, 'sin') THEN 0 WHEN contains(n, 'bajo') THEN 1 WHEN contains(n, 'medio') THEN 2 WHEN contains(n, 'alto') THEN 3 ELSE 4 END = {k}) AS n_clase_{k}" for k in range(5))}
FROM (SELECT {_norm_sql('nivel_riesgo')} AS n FROM risky) t"""), [],
    ["n_rows", "n_unknown", *[f"n_clase_{k}" for k in range(5)]]))
def q_label_report(spark, sf):
    """Labels of the records mapped to classes, with the count of unknown labels reported."""
    from riskloom.functions.risk import label_report
    return label_report(risky(spark, sf), "nivel_riesgo")
