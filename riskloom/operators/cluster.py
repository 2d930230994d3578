"""Municipal vulnerability clustering.

The municipal profile is one grouped aggregation of the records. The model is a Spark ML
``Pipeline``: assembler -> scaler (population std, or median/IQR) -> k-means (best of n
seeded restarts, clusters renumbered in a canonical order) -> PCA (sign fixed by the
largest loading). Everything it learns is a handful of numbers, so it persists as a
plain ``PipelineModel`` of built-in stages.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (PCA, ElementwiseProduct, RobustScaler, SQLTransformer,
                                StandardScaler, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.constants import CANONICAL_CLUSTERS, CLUSTER_FEATURES, CLUSTER_NAMES, MIN_MUNICIPAL_AREA
from riskloom.functions.numeric import round_to
from riskloom.operators.clean import min_area_filter, rainfed_area, require_columns
from riskloom.operators.lloyd import batched_kmeans
from riskloom.operators.util import parallel_map
from riskloom.operators.windows import topn_per_group


def municipal_profile(df: DataFrame, min_ha: float = MIN_MUNICIPAL_AREA,
                      keys=("Nomestado", "Nommunicipio")) -> DataFrame:
    """D19 (+B13, B14): one row per municipality (NULL keys dropped): totals, mean price and
    yield (missing -> 0), crop diversity, loss and rainfed shares clipped to [0, 1], and
    log1p of scale, yield, price and diversity. Municipalities under ``min_ha`` are dropped."""
    keys = list(keys)
    require_columns(df, keys + ["Sembrada", "Siniestrada", "Cosechada", "Nommodalidad"])
    base = rainfed_area(df.filter(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()))
    agg = base.groupBy(*keys).agg(
        F.coalesce(F.sum("Sembrada"), F.lit(0.0)).alias("Sembrada_total"),
        F.coalesce(F.sum("Siniestrada"), F.lit(0.0)).alias("Siniestrada_total"),
        F.coalesce(F.sum("Cosechada"), F.lit(0.0)).alias("Cosechada_total"),
        F.coalesce(F.sum("Volumenproduccion"), F.lit(0.0)).alias("Volumen_total"),
        F.coalesce(F.sum("Valorproduccion"), F.lit(0.0)).alias("Valor_total"),
        F.coalesce(F.sum("area_temporal"), F.lit(0.0)).alias("Area_temporal_total"),
        F.coalesce(F.avg("Precio"), F.lit(0.0)).alias("Precio_medio"),
        F.coalesce(F.avg("Rendimiento"), F.lit(0.0)).alias("Rendimiento_medio"),
        F.count_distinct("Nomcultivo").alias("Diversidad_cultivos"))
    agg = min_area_filter(agg, min_ha)

    def clip01(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    return agg.withColumns({
        "proporcion_siniestro_total": clip01(F.col("Siniestrada_total") / F.col("Sembrada_total")),
        "prop_temporal": clip01(F.col("Area_temporal_total") / F.col("Sembrada_total")),
        "log_Sembrada_total": F.log1p("Sembrada_total"),
        "log_Rendimiento_medio": F.log1p("Rendimiento_medio"),
        "log_Precio_medio": F.log1p("Precio_medio"),
        "log_Diversidad_cultivos": F.log1p("Diversidad_cultivos")})


def nearest_centroid(df: DataFrame, centroids, cols, out: str = "cluster") -> DataFrame:
    """J3 on given centroids: index of the nearest centroid (squared Euclidean; lowest
    index on ties). The k x d centroid numbers become literals of one expression."""
    d2 = [sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
               for c, v in zip(cols, cent)), F.lit(0.0)) for cent in centroids]
    best = F.least(*d2) if len(d2) > 1 else d2[0]
    idx = F.lit(len(d2) - 1)
    for i in range(len(d2) - 2, -1, -1):
        idx = F.when(d2[i] == best, F.lit(i)).otherwise(idx)
    return df.withColumn(out, idx)


SUMMARY_COLS = [("Sembrada_media", "Sembrada_total"), ("Siniestrada_media", "Siniestrada_total"),
                ("Riesgo_siniestro_medio", "proporcion_siniestro_total"),
                ("Prop_temporal_media", "prop_temporal"), ("Rendimiento_promedio", "Rendimiento_medio"),
                ("Precio_promedio", "Precio_medio"), ("Diversidad_media", "Diversidad_cultivos")]


def cluster_summary(prof: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Municipalities and seven means per cluster, 4 decimals."""
    return prof.groupBy(cluster).agg(F.count(F.lit(1)).alias("Municipios"),
                                     *[round_to(F.avg(src), 4).alias(name) for name, src in SUMMARY_COLS])


def cluster_sizes(prof: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Municipalities per cluster with the profile name."""
    names = prof.sparkSession.createDataFrame(
        [(k, *CLUSTER_NAMES[n]) for k, n in enumerate(CANONICAL_CLUSTERS)], f"{cluster} int, nombre string, perfil string")
    sizes = prof.groupBy(cluster).agg(F.count(F.lit(1)).alias("municipios"))
    return sizes.join(F.broadcast(names), cluster, "left")  # names: k fixed rows


def cluster_geography(prof: DataFrame, top_n: int = 5, cluster: str = "cluster",
                      state: str = "Nomestado") -> DataFrame:
    """Municipalities per (cluster, state); the top_n states of each cluster."""
    counts = prof.groupBy(cluster, state).agg(F.count(F.lit(1)).alias("municipios"))
    return topn_per_group(counts, [cluster], [F.desc("municipios"), F.asc(state)], top_n)


def minmax_profile(summary: DataFrame, cols) -> DataFrame:
    """Column-wise min-max scaling across the (k-row) cluster summary; constant -> 0."""
    w = Window.partitionBy()  # k rows
    return summary.withColumns({
        f"{c}_norm": F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w),
                                             F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0))
        for c in cols})


# -- model -------------------------------------------------------------------------------

class PopulationStandardScaler(Estimator, HasInputCol, HasOutputCol):
    """I4 as a pipeline stage: z-scores with the population std. Fits Spark's
    StandardScaler (sample std) and rescales by sqrt(n / (n - 1)); the fitted model is a
    PipelineModel of built-in stages, so it saves and loads like any other."""

    def __init__(self, inputCol: str = "features", outputCol: str = "scaled"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset):
        tmp = self.getOutputCol() + "_sample"
        sc = StandardScaler(inputCol=self.getInputCol(), outputCol=tmp, withMean=True,
                            withStd=True).fit(dataset)
        n = dataset.count()
        dim = len(sc.mean)
        c = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        fix = ElementwiseProduct(inputCol=tmp, outputCol=self.getOutputCol(),
                                 scalingVec=Vectors.dense([c] * dim))
        drop = SQLTransformer(statement=f"SELECT * EXCEPT ({tmp}) FROM __THIS__")
        return PipelineModel([sc, fix, drop])


def make_scaler(kind: str, inputCol: str = "features", outputCol: str = "scaled"):
    """'standard' (population std) or 'robust' (median / IQR, exact quantiles)."""
    if kind == "standard":
        return PopulationStandardScaler(inputCol, outputCol)
    if kind == "robust":
        return RobustScaler(inputCol=inputCol, outputCol=outputCol, withCentering=True,
                            withScaling=True, lower=0.25, upper=0.75, relativeError=0.0)
    raise ValueError(f"unknown scaler: {kind!r} (use 'standard' or 'robust')")


@contextmanager
def profile_once(prof: DataFrame, features):
    """The features of a profile, persisted: the scaler, its count and the runs read them again
    and again, which would aggregate all records each time."""
    slim = prof.select(*features).persist()
    try:
        yield slim
    finally:
        slim.unpersist()


def kmeans_fit(df: DataFrame, k: int = 4, n_init: int = 15, seed: int = 42,
               features: str = "scaled", max_iter: int = 50, parallelism: int = 8):
    """Best of ``n_init`` seeded k-means runs by inertia (within-cluster sum of squares).
    The runs are independent Spark jobs, submitted ``parallelism`` at a time (as
    CrossValidator does) over the persisted input. Returns (model, [(seed, cost)])."""
    from concurrent.futures import ThreadPoolExecutor
    mine = df.storageLevel == StorageLevel.NONE  # a frame the caller persisted stays so
    data = df.select(features).persist() if mine else df
    data.count()  # once, before the runs ask for it at the same time

    def run(i):
        m = KMeans(k=k, seed=seed + i, featuresCol=features, predictionCol="_raw",
                   maxIter=max_iter).fit(data)
        return seed + i, m, float(m.summary.trainingCost)

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            runs = list(pool.map(run, range(n_init)))
    finally:
        if mine:
            data.unpersist()
    best = min(runs, key=lambda r: (r[2], r[0]))
    return best[1], [(s_, c) for s_, _, c in runs]


def canonical_relabel(model, order_feature: int = 1, out: str = "cluster") -> SQLTransformer:
    """Cluster numbers are arbitrary: renumber by ascending centroid value of one feature
    (the loss share), as a persistable SQL stage."""
    cents = model.clusterCenters()
    order = sorted(range(len(cents)), key=lambda i: (float(cents[i][order_feature]), i))
    rank = [0] * len(cents)
    for r, i in enumerate(order):
        rank[i] = r
    arr = ", ".join(str(r) for r in rank)
    return SQLTransformer(statement=f"SELECT *, element_at(array({arr}), _raw + 1) AS {out} FROM __THIS__")


def vulnerability_pipeline(prof: DataFrame, k: int = 4, n_pca: int = 2, n_init: int = 15,
                           seed: int = 42, scaler: str = "standard",
                           features=CLUSTER_FEATURES) -> PipelineModel:
    """Assemble -> scale -> best-of-n k-means -> canonical numbering -> PCA (sign fixed
    so that each component's largest loading is positive). One PipelineModel."""
    features = list(features)
    with profile_once(prof, features) as prof:
        prep = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features",
                                                handleInvalid="error"),
                                make_scaler(scaler)]).fit(prof)
        scaled = prep.transform(prof).persist()
        km, _ = kmeans_fit(scaled, k, n_init, seed)
        relabel = canonical_relabel(km)
        pca = PCA(k=n_pca, inputCol="scaled", outputCol="pca_raw").fit(scaled)
        scaled.unpersist()
    pc = pca.pc.toArray()  # d x n_pca
    signs = []
    for j in range(n_pca):
        col = pc[:, j]
        i = max(range(len(col)), key=lambda r: abs(col[r]))
        signs.append(1.0 if col[i] >= 0 else -1.0)
    flip = ElementwiseProduct(inputCol="pca_raw", outputCol="pca", scalingVec=Vectors.dense(signs))
    return PipelineModel(prep.stages + [km, relabel, pca, flip])


def explained_variance(model: PipelineModel):
    """Explained-variance ratios and their cumulative sum."""
    from pyspark.ml.feature import PCAModel
    pca = [s for s in model.stages if isinstance(s, PCAModel)][0]
    ratios = [float(v) for v in pca.explainedVariance]
    cum, out = 0.0, []
    for r in ratios:
        cum += r
        out.append((r, cum))
    return out


def project_centroids(model: PipelineModel):
    """The k-means centroids in principal-component space (canonical cluster numbers),
    as (cluster, [pc...]) pairs -- k small vectors read from the fitted stages."""
    from pyspark.ml.clustering import KMeansModel
    from pyspark.ml.feature import PCAModel
    km = [s for s in model.stages if isinstance(s, KMeansModel)][0]
    pca = [s for s in model.stages if isinstance(s, PCAModel)][0]
    flip = model.stages[-1].getScalingVec().toArray()
    relabel = [s for s in model.stages if isinstance(s, SQLTransformer) and "_raw + 1" in s.getStatement()][0]
    order = [int(x) for x in relabel.getStatement().split("array(")[1].split(")")[0].split(",")]
    pc = pca.pc.toArray()
    out = []
    for raw, c in enumerate(km.clusterCenters()):
        proj = [float(sum(c[i] * pc[i, j] for i in range(len(c))) * flip[j]) for j in range(pc.shape[1])]
        out.append((order[raw], proj))
    return sorted(out)


def total_sum_of_squares(df: DataFrame, features: str = "scaled") -> float:
    """Inertia for k = 1 (Spark's k-means needs k >= 2): sum of squared distances to the mean."""
    from pyspark.ml.stat import Summarizer
    row = df.select(Summarizer.metrics("variance", "count").summary(F.col(features)).alias("s")).first()
    n = row.s["count"]
    return float(sum(row.s["variance"]) * (n - 1))


def simplified_silhouette(df: DataFrame, centroids, features: str = "scaled",
                          cluster: str = "_raw") -> DataFrame:
    """Centroid-based Euclidean silhouette (a = distance to own centroid, b = to the nearest
    other one), averaged: linear in the rows, unlike the all-pairs definition."""
    v = vector_to_array(F.col(features))
    dists = [F.sqrt(sum(((v[j] - F.lit(float(c[j]))) * (v[j] - F.lit(float(c[j])))
                         for j in range(len(c))), F.lit(0.0))) for c in centroids]
    lab = F.col(cluster)
    pts = df.select(lab.alias("_lab"), F.array(*dists).alias("_d"))
    own = F.element_at(F.col("_d"), F.col("_lab") + 1)
    other = F.array_min(F.array(*[F.when(F.col("_lab") != i, F.col("_d")[i]) for i in range(len(dists))]))
    s = F.coalesce(F.try_divide(other - own, F.greatest(own, other)), F.lit(0.0))
    return pts.agg(F.avg(s).alias("silhouette_centroid"))


def elbow_silhouette(prof: DataFrame, max_k: int = 10, n_init: int = 10, seed: int = 42,
                     features=CLUSTER_FEATURES):
    """Inertia for k = 1..max_k (best of n_init; all runs in one batch) and, for k >= 2, the
    silhouette with Spark's squared-Euclidean evaluator and the centroid-based Euclidean silhouette.
    Returns a list of (k, inertia, silhouette_sq, silhouette_centroid)."""
    prep = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                            PopulationStandardScaler()]).fit(prof)
    scaled = prep.transform(prof).select("scaled").persist()
    try:
        rows = [(1, total_sum_of_squares(scaled), None, None)]
        runs = [(k, seed + i) for k in range(2, max_k + 1) for i in range(n_init)]
        best: dict = {}
        for (k, s), (centers, cost) in zip(runs, batched_kmeans(scaled, runs, seed=seed)):
            if k not in best or (cost, s) < best[k][:2]:
                best[k] = (cost, s, centers)
        ev = ClusteringEvaluator(featuresCol="scaled", predictionCol="_raw",
                                 distanceMeasure="squaredEuclidean")

        def judge(k):
            cost, _, centers = best[k]
            v = vector_to_array(F.col("scaled"))
            pred = nearest_centroid(scaled.select("scaled", *[v[j].alias(f"_x{j}") for j in range(centers.shape[1])]),
                                    centers.tolist(), [f"_x{j}" for j in range(centers.shape[1])], "_raw")
            pred = pred.select("scaled", F.col("_raw").cast("int").alias("_raw"))
            return (k, cost, float(ev.evaluate(pred)),
                    float(simplified_silhouette(pred, centers.tolist()).first()[0]))
        return rows + parallel_map(judge, sorted(best), 4)
    finally:
        scaled.unpersist()
