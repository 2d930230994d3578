"""Queries for profiling (D1, D3-D18) and the joins they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.constants import MEASURES
from riskloom.functions.numeric import round_to_sql as rnd
from riskloom.operators import joins, profile
from riskloom.plans.q_clean import risky
from riskloom.plans.registry import register
from riskloom.plans.sql_base import final, with_base
from riskloom.sources.tables import records

RECORD_TYPES = [
    ("record_id", "bigint"), ("Anio", "int"), ("Idestado", "int"), ("Nomestado", "string"),
    ("Idmunicipio", "bigint"), ("Nommunicipio", "string"), ("Idciclo", "int"),
    ("Nomcicloproductivo", "string"), ("Idmodalidad", "int"), ("Nommodalidad", "string"),
    ("Idcultivo", "int"), ("Nomcultivo", "string")] + [(m, "double") for m in MEASURES]
CATS = ["Nomestado", "Nomcicloproductivo", "Nommodalidad", "Nomcultivo", "nivel_riesgo"]
DUP_COLS = ["Anio", "Nomestado", "Nomcultivo", "Nommodalidad", "Nomcicloproductivo"]
D = "CAST(100 AS DOUBLE)"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# D1 -----------------------------------------------------------------------------------
_OVERVIEW = with_base(f"""
SELECT a.n_rows, {len(RECORD_TYPES)} AS n_columns, a.year_min, a.year_max, c.*
FROM (SELECT COUNT(*) AS n_rows, MIN(Anio) AS year_min, MAX(Anio) AS year_max FROM records) a
CROSS JOIN ({_union(f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, COUNT({c}) AS non_null, COUNT(DISTINCT {c}) AS n_distinct FROM records" for i, (c, t) in enumerate(RECORD_TYPES))}) c""")


@register("dataset_overview", final(_OVERVIEW, [], ["n_rows", "n_columns", "year_min", "year_max",
                                                    "position", "non_null", "n_distinct"]))
def q_overview(spark, sf):
    return profile.dataset_overview(records(spark, sf))


# D3 -----------------------------------------------------------------------------------
_NULLS = with_base(f"""
SELECT column_name, n_null, {rnd(f'n_null * {D} / n', 2)} AS pct_null FROM (
{_union(f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_null, COUNT(*) AS n FROM records" for c, _ in RECORD_TYPES)}
) t WHERE n_null > 0""")


@register("null_report", final(_NULLS, ["pct_null"], ["n_null"]))
def q_null_report(spark, sf):
    return profile.null_report(records(spark, sf))


# D4 -----------------------------------------------------------------------------------
_NC = [c for c, _ in RECORD_TYPES]
_NULLCORR = with_base(f"""
SELECT col_a, col_b,
       (n * cab - za * zb) / sqrt((n * za - za * za) * (n * zb - zb * zb)) AS corr FROM (
{_union(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(COUNT(*) AS DOUBLE) AS n, CAST(COUNT(*) - COUNT({a}) AS DOUBLE) AS za, CAST(COUNT(*) - COUNT({b}) AS DOUBLE) AS zb, CAST(COUNT(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS DOUBLE) AS cab FROM records" for a in _NC for b in _NC)}
) t WHERE za > 0 AND zb > 0""")


@register("null_correlation", final(_NULLCORR, ["corr"]))
def q_null_corr(spark, sf):
    return profile.null_correlation(records(spark, sf))


# D5 -----------------------------------------------------------------------------------
@register("structural_null_check", final(with_base(f"""
SELECT n_missing, n_zero_harvest, {rnd(f'n_zero_harvest * {D} / n_missing', 2)} AS pct_zero_harvest
FROM (SELECT COUNT(*) FILTER (WHERE Precio IS NULL) AS n_missing,
             COUNT(*) FILTER (WHERE Precio IS NULL AND Cosechada = 0) AS n_zero_harvest
      FROM records) t"""), ["pct_zero_harvest"], ["n_missing", "n_zero_harvest"]))
def q_structural(spark, sf):
    return profile.structural_null_check(records(spark, sf))


# D6 -----------------------------------------------------------------------------------
@register("duplicate_count", final(with_base(f"""
SELECT COALESCE(SUM(c - 1), 0) AS n_duplicates, COALESCE(SUM(c), 0) AS n_rows, COUNT(*) AS n_unique
FROM (SELECT COUNT(*) AS c FROM records GROUP BY {', '.join(DUP_COLS)}) t"""), [],
    ["n_duplicates", "n_rows", "n_unique"]))
def q_duplicates(spark, sf):
    """Exact duplicates of the (year, state, crop, mode, cycle) projection."""
    return profile.duplicate_count(records(spark, sf).select(*DUP_COLS))


# D7 -----------------------------------------------------------------------------------
_DESC = with_base(_union(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS count, AVG({c}) AS mean, STDDEV_SAMP({c}) AS std, "
    f"MIN({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
    f"quantile_cont({c}, 0.75) AS q75, MAX({c}) AS max, MAX({c}) - MIN({c}) AS range FROM records"
    for c in MEASURES))


@register("describe_numeric", final(_DESC, ["mean", "std", "min", "q25", "q50", "q75", "max",
                                            "range"], ["count"]))
def q_describe_numeric(spark, sf):
    return profile.describe_numeric(records(spark, sf), MEASURES)


# D8 / D13 -----------------------------------------------------------------------------
_VC = f"""
vc AS ({_union(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM risky WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATS)}),
vcr AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC) AS rank,
               COUNT(*) OVER (PARTITION BY column_name) AS n_distinct FROM vc)"""


@register("describe_categorical", final(with_base("""
SELECT a.column_name, a.n_distinct, m.value AS mode, a.rank, a.value, a.n
FROM vcr a JOIN vcr m ON m.column_name = a.column_name AND m.rank = 1
WHERE a.rank <= 3""", _VC), [], ["n_distinct", "rank", "n"]))
def q_describe_categorical(spark, sf):
    return profile.describe_categorical(risky(spark, sf), CATS)


@register("category_frequency", final(with_base(
    "SELECT column_name, value, n, rank FROM vcr WHERE rank <= 15", _VC), [], ["n", "rank"]))
def q_category_frequency(spark, sf):
    return profile.category_frequency(risky(spark, sf), CATS, 15)


# D9 -----------------------------------------------------------------------------------
_IQR = with_base(f"""
SELECT column_name, q1, q3, iqr, lower, upper, n_outliers,
       {rnd(f'n_outliers * {D} / n', 2)} AS pct_outliers FROM (
{_union(f'''SELECT '{c}' AS column_name, f.q1, f.q3, f.q3 - f.q1 AS iqr,
       f.q1 - CAST(1.5 AS DOUBLE) * (f.q3 - f.q1) AS lower, f.q3 + CAST(1.5 AS DOUBLE) * (f.q3 - f.q1) AS upper,
       (SELECT COUNT(*) FROM records r WHERE r.{c} < f.q1 - CAST(1.5 AS DOUBLE) * (f.q3 - f.q1)
                                      OR r.{c} > f.q3 + CAST(1.5 AS DOUBLE) * (f.q3 - f.q1)) AS n_outliers,
       (SELECT COUNT(*) FROM records) AS n
  FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM records) f''' for c in MEASURES)}
) t""")


@register("iqr_outliers", final(_IQR, ["q1", "q3", "iqr", "lower", "upper", "pct_outliers"],
                                ["n_outliers"]))
def q_iqr(spark, sf):
    return profile.iqr_outliers(records(spark, sf), MEASURES)


# D10 ----------------------------------------------------------------------------------
@register("five_number_by_group", final(with_base("""
SELECT q.Nommodalidad, q.n, q.min, q.q1, q.median, q.q3, q.max,
       MIN(CASE WHEN r.Sembrada >= q.q1 - CAST(1.5 AS DOUBLE) * (q.q3 - q.q1) THEN r.Sembrada END) AS whisker_low,
       MAX(CASE WHEN r.Sembrada <= q.q3 + CAST(1.5 AS DOUBLE) * (q.q3 - q.q1) THEN r.Sembrada END) AS whisker_high
FROM (SELECT Nommodalidad, COUNT(*) AS n, MIN(Sembrada) AS min, quantile_cont(Sembrada, 0.25) AS q1,
             quantile_cont(Sembrada, 0.5) AS median, quantile_cont(Sembrada, 0.75) AS q3,
             MAX(Sembrada) AS max
      FROM records WHERE Nommodalidad IS NOT NULL AND Sembrada IS NOT NULL GROUP BY Nommodalidad) q
JOIN records r ON r.Nommodalidad = q.Nommodalidad AND r.Sembrada IS NOT NULL
GROUP BY q.Nommodalidad, q.n, q.min, q.q1, q.median, q.q3, q.max"""),
    ["min", "q1", "median", "q3", "max", "whisker_low", "whisker_high"], ["n"]))
def q_five_number(spark, sf):
    """Box-plot statistics of sown area by water mode."""
    return profile.five_number_by_group(records(spark, sf), "Sembrada", "Nommodalidad")


# D11 ----------------------------------------------------------------------------------
_HIST = with_base("""
SELECT bin, log_scale, lo + (bin - 1) * ((hi - lo) / 60) AS bin_lo, lo + bin * ((hi - lo) / 60) AS bin_hi,
       n, n / (cnt * ((hi - lo) / 60)) AS density
FROM (
  SELECT COALESCE(LEAST(FLOOR((t - lo) / NULLIF(hi - lo, 0) * 60) + 1, 60), 1) AS bin,
         log_scale, lo, hi, cnt, COUNT(*) AS n
  FROM (SELECT t, log_scale, cnt, MIN(t) OVER () AS lo, MAX(t) OVER () AS hi
        FROM (SELECT CASE WHEN log_scale THEN ln(1 + x) ELSE x END AS t, log_scale, cnt
              FROM (SELECT x, cnt, COALESCE(g1 * sqrt(CAST(cnt AS DOUBLE) * (cnt - 1)) / (cnt - 2) > 2, false)
                           AS log_scale
                    FROM (SELECT Sembrada AS x, COUNT(*) OVER () AS cnt,
                                 AVG(POW(Sembrada - mu, 3)) OVER () / POW(AVG(POW(Sembrada - mu, 2)) OVER (), 1.5) AS g1
                          FROM (SELECT Sembrada, AVG(Sembrada) OVER () AS mu FROM records
                                WHERE Sembrada IS NOT NULL) s0) s1) s2) s3) s4
  GROUP BY 1, log_scale, lo, hi, cnt) s5""")


@register("histogram", final(_HIST, ["bin_lo", "bin_hi", "density"], ["bin", "n"]))
def q_histogram(spark, sf):
    """60-bin histogram of sown area (log1p when the sample skewness exceeds 2)."""
    return profile.histogram(records(spark, sf), "Sembrada", 60)


# D12 ----------------------------------------------------------------------------------
_PAIRS = [(a, b) for a in MEASURES for b in MEASURES]
_SPEARMAN = with_base(f"""
SELECT col_a, col_b, corr(ra, rb) AS corr FROM (
  SELECT col_a, col_b,
         rank() OVER (PARTITION BY col_a, col_b ORDER BY va)
           + (COUNT(*) OVER (PARTITION BY col_a, col_b, va) - 1) / CAST(2 AS DOUBLE) AS ra,
         rank() OVER (PARTITION BY col_a, col_b ORDER BY vb)
           + (COUNT(*) OVER (PARTITION BY col_a, col_b, vb) - 1) / CAST(2 AS DOUBLE) AS rb
  FROM ({_union(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {a} AS va, {b} AS vb FROM records WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS)}) l
) t GROUP BY col_a, col_b""")


@register("correlation_matrix", final(_SPEARMAN, ["corr"]))
def q_correlation(spark, sf):
    """Spearman correlation of the seven measures, pairwise-complete."""
    return profile.correlation_matrix(records(spark, sf), MEASURES, "spearman")


# D14 ----------------------------------------------------------------------------------
_ANNUAL = ", ".join(f"COALESCE(SUM({c}), 0) / CAST(1000000 AS DOUBLE) AS {c.lower()}_m"
                    for c in ("Sembrada", "Cosechada", "Siniestrada"))


@register("annual_series", final(with_base(
    f"SELECT Anio, {_ANNUAL} FROM records WHERE Anio IS NOT NULL GROUP BY Anio"),
    ["sembrada_m", "cosechada_m", "siniestrada_m"], ["Anio"]))
def q_annual(spark, sf):
    return profile.annual_series(records(spark, sf))


@register("annual_series_by_mode", final(with_base(
    f"SELECT Anio, Nommodalidad, {_ANNUAL} FROM records "
    "WHERE Anio IS NOT NULL AND Nommodalidad IS NOT NULL GROUP BY Anio, Nommodalidad"),
    ["sembrada_m", "cosechada_m", "siniestrada_m"], ["Anio"]))
def q_annual_mode(spark, sf):
    return profile.annual_series(records(spark, sf), by="Nommodalidad")


# D15 ----------------------------------------------------------------------------------
@register("top_states_loss", final(with_base("""
SELECT Nomestado, COALESCE(SUM(Siniestrada), 0) / CAST(1000000 AS DOUBLE) AS siniestrada_m
FROM records WHERE Nomestado IS NOT NULL GROUP BY Nomestado
ORDER BY siniestrada_m DESC, Nomestado LIMIT 15"""), ["siniestrada_m"]))
def q_top_states_loss(spark, sf):
    return profile.top_states_loss(records(spark, sf), 15)


# D16 / C3 -----------------------------------------------------------------------------
@register("top_states_harvested", final(with_base("""
SELECT t.Nomestado, t.total,
       COALESCE(SUM(CASE WHEN r.Nommodalidad = 'Riego' THEN r.Cosechada END), 0) AS Riego,
       COALESCE(SUM(CASE WHEN r.Nommodalidad = 'Temporal' THEN r.Cosechada END), 0) AS Temporal
FROM (SELECT Nomestado, COALESCE(SUM(Cosechada), 0) AS total FROM records
      WHERE Nomestado IS NOT NULL GROUP BY Nomestado ORDER BY total DESC, Nomestado LIMIT 10) t
JOIN records r ON r.Nomestado = t.Nomestado
GROUP BY t.Nomestado, t.total"""), ["total", "Riego", "Temporal"]))
def q_top_states_harvested(spark, sf):
    return profile.top_states_harvested(records(spark, sf), 10)


# D17 / C4 / C5 ------------------------------------------------------------------------
_TOPS = """
ts AS (SELECT Nomestado FROM records WHERE Nomestado IS NOT NULL GROUP BY Nomestado
       ORDER BY COUNT(*) DESC, Nomestado LIMIT 5),
tc AS (SELECT Nomcultivo FROM records WHERE Nomcultivo IS NOT NULL GROUP BY Nomcultivo
       ORDER BY COUNT(*) DESC, Nomcultivo LIMIT 5)"""


@register("top_crops_by_state", final(with_base("""
SELECT ts.Nomestado, tc.Nomcultivo,
       (SELECT COUNT(*) FROM records r
        WHERE r.Nomestado = ts.Nomestado AND r.Nomcultivo = tc.Nomcultivo) AS n
FROM ts CROSS JOIN tc""", _TOPS), [], ["n"]))
def q_top_crops_by_state(spark, sf):
    return profile.top_crops_by_state(records(spark, sf), 5, 5)


@register("topn_semi_join", final(with_base("""
SELECT record_id, Nomcultivo FROM records WHERE Nomcultivo IN (
  SELECT Nomcultivo FROM records WHERE Nomcultivo IS NOT NULL GROUP BY Nomcultivo
  ORDER BY COUNT(*) DESC, Nomcultivo LIMIT 3)"""), [], ["record_id"]))
def q_topn_semi(spark, sf):
    """Records of the three most frequent crops."""
    return joins.topn_semi_join(records(spark, sf), "Nomcultivo", 3).select("record_id", "Nomcultivo")


@register("dense_grid", final(with_base("""
SELECT s.Nomestado, c.Nomcultivo, COALESCE(v.n, 0) AS n
FROM (SELECT DISTINCT Nomestado FROM records) s CROSS JOIN (SELECT DISTINCT Nomcultivo FROM records) c
LEFT JOIN (SELECT Nomestado, Nomcultivo, COUNT(*) FILTER (WHERE target = 4) AS n
           FROM risky GROUP BY 1, 2) v ON v.Nomestado = s.Nomestado AND v.Nomcultivo = c.Nomcultivo"""),
    [], ["n"]))
def q_dense_grid(spark, sf):
    """Critical-loss record counts for every state x crop cell (missing -> 0)."""
    r = risky(spark, sf)
    counts = r.groupBy("Nomestado", "Nomcultivo").agg(F.count_if(F.col("target") == 4).alias("n"))
    return joins.dense_grid(counts, r.select("Nomestado").distinct(),
                            r.select("Nomcultivo").distinct(), "n")


# D18 ----------------------------------------------------------------------------------
_SHARE = ", ".join(
    f"{rnd(f'COUNT(*) FILTER (WHERE target = {k}) * {D} / COUNT(*)', 2)} AS pct_clase_{k}"
    for k in range(5))


@register("state_class_share", final(with_base(f"""
SELECT Nomestado, {_SHARE} FROM risky
WHERE Nomestado IN (SELECT Nomestado FROM records WHERE Nomestado IS NOT NULL GROUP BY Nomestado
                    ORDER BY COUNT(*) DESC, Nomestado LIMIT 20)
GROUP BY Nomestado"""), [f"pct_clase_{k}" for k in range(5)]))
def q_state_class_share(spark, sf):
    return profile.state_class_share(risky(spark, sf), 20)


# D10 variants -------------------------------------------------------------------------
def _five_sql(src: str, col: str, by: str, shift: str = "") -> str:
    v = f"({col}{shift})"
    return f"""
SELECT q.{by}, q.n, q.min, q.q1, q.median, q.q3, q.max,
       MIN(CASE WHEN r.v >= q.q1 - CAST(1.5 AS DOUBLE) * (q.q3 - q.q1) THEN r.v END) AS whisker_low,
       MAX(CASE WHEN r.v <= q.q3 + CAST(1.5 AS DOUBLE) * (q.q3 - q.q1) THEN r.v END) AS whisker_high
FROM (SELECT {by}, COUNT(*) AS n, MIN(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3, MAX(v) AS max
      FROM (SELECT {by}, {v} AS v FROM {src} WHERE {by} IS NOT NULL AND {col} IS NOT NULL) b GROUP BY {by}) q
JOIN (SELECT {by}, {v} AS v FROM {src} WHERE {by} IS NOT NULL AND {col} IS NOT NULL) r ON r.{by} = q.{by}
GROUP BY q.{by}, q.n, q.min, q.q1, q.median, q.q3, q.max"""


_FIVE_DBL = ["min", "q1", "median", "q3", "max", "whisker_low", "whisker_high"]


@register("five_number_by_class", final(with_base(
    _five_sql("risky", "proporcion_siniestro", "target", " + CAST(0.0001 AS DOUBLE)")), _FIVE_DBL, ["target", "n"]))
def q_five_by_class(spark, sf):
    """Box-plot statistics of the loss ratio (+1e-4, for a log axis) by risk class."""
    return profile.five_number_by_group(risky(spark, sf), "proporcion_siniestro", "target", shift=1e-4)


# E5 -----------------------------------------------------------------------------------
@register("topn_per_group", final(with_base("""
SELECT * FROM (SELECT Nomestado, Nomcultivo, n,
                      row_number() OVER (PARTITION BY Nomestado ORDER BY n DESC, Nomcultivo) AS rank
               FROM (SELECT Nomestado, Nomcultivo, COUNT(*) AS n FROM records
                     WHERE Nomestado IS NOT NULL AND Nomcultivo IS NOT NULL GROUP BY 1, 2) c) r
WHERE rank <= 3"""), [], ["n", "rank"]))
def q_topn_per_group(spark, sf):
    """The three crops with most records in every state (ties by name)."""
    from riskloom.operators.windows import topn_per_group
    counts = (records(spark, sf).filter(F.col("Nomestado").isNotNull() & F.col("Nomcultivo").isNotNull())
              .groupBy("Nomestado", "Nomcultivo").agg(F.count(F.lit(1)).alias("n")))
    return topn_per_group(counts, ["Nomestado"], [F.desc("n"), F.asc("Nomcultivo")], 3)


@register("total_with_breakdown_join", final(with_base("""
SELECT t.Nomestado, t.total,
       COALESCE(SUM(CASE WHEN r.Nommodalidad = 'Riego' THEN r.Siniestrada END), 0) AS Riego,
       COALESCE(SUM(CASE WHEN r.Nommodalidad = 'Temporal' THEN r.Siniestrada END), 0) AS Temporal
FROM (SELECT Nomestado, COALESCE(SUM(Siniestrada), 0) AS total FROM records
      WHERE Nomestado IS NOT NULL GROUP BY Nomestado ORDER BY total DESC, Nomestado LIMIT 15) t
JOIN records r ON r.Nomestado = t.Nomestado
GROUP BY t.Nomestado, t.total"""), ["total", "Riego", "Temporal"]))
def q_total_breakdown(spark, sf):
    """Lost area of the 15 states with most loss, left-joined to its per-mode breakdown."""
    base = records(spark, sf).filter(F.col("Nomestado").isNotNull())
    totals = base.groupBy("Nomestado").agg(F.coalesce(F.sum("Siniestrada"), F.lit(0.0)).alias("total"))
    top = totals.orderBy(F.desc("total"), F.asc("Nomestado")).limit(15)
    return joins.total_with_breakdown_join(top, base, "Nomestado", "Nommodalidad", "Siniestrada",
                                           ["Riego", "Temporal"])
