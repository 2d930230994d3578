"""Queries for the municipal profile and clustering."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.constants import CANONICAL_CLUSTERS, CLUSTER_FEATURES, CLUSTER_NAMES
from riskloom.functions.numeric import round_to_sql as rnd
from riskloom.operators import cluster, features
from riskloom.plans.q_clean import risky
from riskloom.plans.q_profile import _five_sql as five_sql
from riskloom.plans.registry import register
from riskloom.plans.sql_base import final, with_base

PROFILE_COLS = ["Sembrada_total", "Siniestrada_total", "Cosechada_total", "Volumen_total",
                "Valor_total", "Area_temporal_total", "Precio_medio", "Rendimiento_medio",
                "proporcion_siniestro_total", "prop_temporal", "log_Sembrada_total",
                "log_Rendimiento_medio", "log_Precio_medio", "log_Diversidad_cultivos"]
# Fixed reference centroids in the standardised feature space, used to give the summary
# operators a deterministic assignment that SQL can check.
CENTROIDS = [
    [0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    [1.0, -0.5, 0.5, 0.0, 0.0, 1.0],
    [0.0, -1.0, -1.0, 0.5, 0.5, 0.0],
    [-0.5, 1.5, 0.5, -0.5, 0.0, -0.5],
]
Z = [f"z_{c}" for c in CLUSTER_FEATURES]

PROFILE_SQL = f"""
mun0 AS (
  SELECT Nomestado, Nommunicipio,
         COALESCE(SUM(Sembrada), 0) AS Sembrada_total, COALESCE(SUM(Siniestrada), 0) AS Siniestrada_total,
         COALESCE(SUM(Cosechada), 0) AS Cosechada_total, COALESCE(SUM(Volumenproduccion), 0) AS Volumen_total,
         COALESCE(SUM(Valorproduccion), 0) AS Valor_total,
         COALESCE(SUM(Sembrada * CAST(contains(lower(Nommodalidad), 'temporal') AS INTEGER)), 0) AS Area_temporal_total,
         COALESCE(AVG(Precio), 0) AS Precio_medio, COALESCE(AVG(Rendimiento), 0) AS Rendimiento_medio,
         COUNT(DISTINCT Nomcultivo) AS Diversidad_cultivos
  FROM records WHERE Nomestado IS NOT NULL AND Nommunicipio IS NOT NULL
  GROUP BY Nomestado, Nommunicipio
  HAVING COALESCE(SUM(Sembrada), 0) >= CAST(0.1 AS DOUBLE)),
mun AS (
  SELECT *, LEAST(GREATEST(Siniestrada_total / Sembrada_total, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))
              AS proporcion_siniestro_total,
         LEAST(GREATEST(Area_temporal_total / Sembrada_total, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))
              AS prop_temporal,
         ln(1 + Sembrada_total) AS log_Sembrada_total, ln(1 + Rendimiento_medio) AS log_Rendimiento_medio,
         ln(1 + Precio_medio) AS log_Precio_medio, ln(1 + Diversidad_cultivos) AS log_Diversidad_cultivos
  FROM mun0),
zst AS (SELECT {', '.join(f'AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}' for c in CLUSTER_FEATURES)} FROM mun),
munz AS (SELECT mun.*, {', '.join(f'COALESCE(({c} - m_{c}) / NULLIF(s_{c}, 0), 0) AS z_{c}' for c in CLUSTER_FEATURES)}
         FROM mun CROSS JOIN zst)"""


def _d2(cent) -> str:
    return " + ".join(f"(z_{c} - CAST({v!r} AS DOUBLE)) * (z_{c} - CAST({v!r} AS DOUBLE))"
                      for c, v in zip(CLUSTER_FEATURES, cent))


ASSIGN_SQL = PROFILE_SQL + f""",
dist AS (SELECT munz.*, {', '.join(f'{_d2(c)} AS d{i}' for i, c in enumerate(CENTROIDS))} FROM munz),
assigned AS (SELECT dist.*, CASE {' '.join(f'WHEN d{i} = LEAST({", ".join(f"d{j}" for j in range(len(CENTROIDS)))}) THEN {i}' for i in range(len(CENTROIDS) - 1))} ELSE {len(CENTROIDS) - 1} END AS cluster FROM dist)"""


def profile(spark, sf):
    return cluster.municipal_profile(risky(spark, sf))


def assigned(spark, sf):
    z = features.standard_scale(profile(spark, sf), CLUSTER_FEATURES, suffix="_z")
    z = z.withColumnsRenamed({f"{c}_z": f"z_{c}" for c in CLUSTER_FEATURES})
    return cluster.nearest_centroid(z, CENTROIDS, Z)


@register("municipal_profile", final(with_base(
    f"SELECT Nomestado, Nommunicipio, {', '.join(PROFILE_COLS)}, Diversidad_cultivos FROM mun",
    PROFILE_SQL), PROFILE_COLS, ["Diversidad_cultivos"]))
def q_profile(spark, sf):
    """One row per municipality with sown area >= 0.1: totals, means, shares, logs."""
    return profile(spark, sf).select("Nomestado", "Nommunicipio", *PROFILE_COLS, "Diversidad_cultivos")


@register("min_area_filter", final(with_base(
    "SELECT COUNT(*) AS n_kept FROM mun", PROFILE_SQL), [], ["n_kept"]))
def q_min_area(spark, sf):
    """Municipalities kept by the minimum-area rule."""
    return profile(spark, sf).agg(F.count(F.lit(1)).alias("n_kept"))


@register("standard_scale", final(with_base(
    f"SELECT Nomestado, Nommunicipio, {', '.join(Z)} FROM munz", PROFILE_SQL), Z))
def q_standard_scale(spark, sf):
    """Population z-scores of the six clustering features."""
    z = features.standard_scale(profile(spark, sf), CLUSTER_FEATURES, suffix="_z")
    return z.select("Nomestado", "Nommunicipio", *[F.col(f"{c}_z").alias(f"z_{c}") for c in CLUSTER_FEATURES])


_ROB = f"""rst AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS md_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iq_{c}' for c in CLUSTER_FEATURES)} FROM mun)"""


@register("robust_scale", final(with_base(
    f"SELECT Nomestado, Nommunicipio, {', '.join(f'COALESCE(({c} - md_{c}) / NULLIF(iq_{c}, 0), 0) AS r_{c}' for c in CLUSTER_FEATURES)} "
    "FROM mun CROSS JOIN rst", PROFILE_SQL + "," + _ROB), [f"r_{c}" for c in CLUSTER_FEATURES]))
def q_robust_scale(spark, sf):
    """(x - median) / IQR of the six clustering features."""
    r = features.robust_scale(profile(spark, sf), CLUSTER_FEATURES, suffix="_r")
    return r.select("Nomestado", "Nommunicipio", *[F.col(f"{c}_r").alias(f"r_{c}") for c in CLUSTER_FEATURES])


@register("assign_cluster", final(with_base(
    "SELECT Nomestado, Nommunicipio, cluster FROM assigned", ASSIGN_SQL), [], ["cluster"]))
def q_assign(spark, sf):
    """Nearest of four given centroids in the standardised space."""
    return assigned(spark, sf).select("Nomestado", "Nommunicipio", "cluster")


_SUMMARY = ", ".join(f"{rnd(f'AVG({src})', 4)} AS {name}" for name, src in cluster.SUMMARY_COLS)


@register("cluster_summary", final(with_base(
    f"SELECT cluster, COUNT(*) AS Municipios, {_SUMMARY} FROM assigned GROUP BY cluster", ASSIGN_SQL),
    [n for n, _ in cluster.SUMMARY_COLS], ["cluster", "Municipios"]))
def q_cluster_summary(spark, sf):
    return cluster.cluster_summary(assigned(spark, sf))


_NAMES = ", ".join("({}, '{}', '{}')".format(k, *CLUSTER_NAMES[n])
                   for k, n in enumerate(CANONICAL_CLUSTERS))


@register("cluster_sizes", final(with_base(
    f"SELECT a.cluster, a.municipios, n.nombre, n.perfil FROM (SELECT cluster, COUNT(*) AS municipios "
    f"FROM assigned GROUP BY cluster) a LEFT JOIN (VALUES {_NAMES}) n(cluster, nombre, perfil) "
    "ON n.cluster = a.cluster", ASSIGN_SQL), [], ["cluster", "municipios"]))
def q_cluster_sizes(spark, sf):
    return cluster.cluster_sizes(assigned(spark, sf))


@register("cluster_geography", final(with_base("""
SELECT * FROM (SELECT cluster, Nomestado, municipios,
                      row_number() OVER (PARTITION BY cluster ORDER BY municipios DESC, Nomestado) AS rank
               FROM (SELECT cluster, Nomestado, COUNT(*) AS municipios FROM assigned GROUP BY 1, 2) c) r
WHERE rank <= 5""", ASSIGN_SQL), [], ["cluster", "municipios", "rank"]))
def q_cluster_geography(spark, sf):
    return cluster.cluster_geography(assigned(spark, sf), 5)


_MM = ["Riesgo_siniestro_medio", "Prop_temporal_media", "Rendimiento_promedio", "Precio_promedio",
       "Diversidad_media", "Sembrada_media"]


@register("minmax_profile", final(with_base(
    f"SELECT cluster, {', '.join(f'COALESCE(({c} - MIN({c}) OVER ()) / NULLIF(MAX({c}) OVER () - MIN({c}) OVER (), 0), 0) AS {c}_norm' for c in _MM)} "
    f"FROM (SELECT cluster, {_SUMMARY} FROM assigned GROUP BY cluster) s", ASSIGN_SQL),
    [f"{c}_norm" for c in _MM], ["cluster"]))
def q_minmax(spark, sf):
    """Min-max scaled cluster means (six profile columns)."""
    s = cluster.cluster_summary(assigned(spark, sf))
    return cluster.minmax_profile(s, _MM).select("cluster", *[f"{c}_norm" for c in _MM])


# Model-based queries: checked by row count and by the property tests.

@register("vulnerability_pipeline", None)
def q_vulnerability(spark, sf):
    """Scale -> best of 15 k-means (k=4) -> canonical numbering -> PCA(2), applied to the
    municipal profile: cluster and the two principal components per municipality."""
    prof = profile(spark, sf)
    model = cluster.vulnerability_pipeline(prof, k=4, n_pca=2, n_init=15)
    out = model.transform(prof)
    pcs = vector_to_array(F.col("pca"))
    return out.select("Nomestado", "Nommunicipio", "cluster", pcs[0].alias("pc1"), pcs[1].alias("pc2"))


@register("kmeans_fit", None)
def q_kmeans_fit(spark, sf):
    """Cost of each of the 15 seeded k-means runs (k=4); the best one is kept."""
    prof = profile(spark, sf)
    with cluster.profile_once(prof, CLUSTER_FEATURES) as prof:
        prep = cluster.Pipeline(stages=[cluster.VectorAssembler(inputCols=CLUSTER_FEATURES, outputCol="features"),
                                        cluster.PopulationStandardScaler()]).fit(prof)
        _, costs = cluster.kmeans_fit(prep.transform(prof), 4, 15, 42)
    return spark.createDataFrame(costs, "seed long, inertia double")


@register("elbow_silhouette", None)
def q_elbow(spark, sf):
    """Inertia for k = 1..10 and silhouettes (squared-Euclidean evaluator; centroid-based)."""
    rows = cluster.elbow_silhouette(profile(spark, sf), max_k=10, n_init=10)
    return spark.createDataFrame(rows, "k int, inertia double, silhouette_sq double, "
                                       "silhouette_centroid double")


@register("pca", None)
def q_pca(spark, sf):
    """Explained-variance ratios of the two principal components and their cumulative sum."""
    prof = profile(spark, sf)
    model = cluster.vulnerability_pipeline(prof, k=4, n_pca=2, n_init=3)
    return spark.createDataFrame([(i + 1, r, c) for i, (r, c) in enumerate(cluster.explained_variance(model))],
                                 "component int, ratio double, cumulative double")


@register("five_number_by_cluster", final(with_base(
    five_sql("assigned", "proporcion_siniestro_total", "cluster"), ASSIGN_SQL),
    ["min", "q1", "median", "q3", "max", "whisker_low", "whisker_high"], ["cluster", "n"]))
def q_five_by_cluster(spark, sf):
    """Box-plot statistics of the municipal loss share by cluster."""
    from riskloom.operators.profile import five_number_by_group
    return five_number_by_group(assigned(spark, sf), "proporcion_siniestro_total", "cluster")


@register("pca_centroids", None)
def q_pca_centroids(spark, sf):
    """The four k-means centroids projected on the two principal components."""
    prof = profile(spark, sf)
    model = cluster.vulnerability_pipeline(prof, k=4, n_pca=2, n_init=15)
    rows = [(k, v[0], v[1]) for k, v in cluster.project_centroids(model)]
    return spark.createDataFrame(rows, "cluster int, pc1 double, pc2 double")


@register("assemble", None)
def q_assemble(spark, sf):
    """The six clustering features of every municipality assembled into one vector (a
    missing input is an error, not a silent NaN)."""
    from pyspark.ml.feature import VectorAssembler
    asm = VectorAssembler(inputCols=CLUSTER_FEATURES, outputCol="features", handleInvalid="error")
    return asm.transform(profile(spark, sf)).select("Nomestado", "Nommunicipio", "features")
