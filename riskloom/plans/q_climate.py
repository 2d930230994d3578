"""Queries for climate enrichment (A4, H1-H3, E3, E4, E7, drought index, C1, C2, C7, D24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.constants import (CLIMATE_CYCLE_MEASURES, HEAT_A_COEF, HEAT_EXP, MID_MONTH_DOY,
                                PET_HOT_COEF, PET_HOT_T, SPEI_SCALES, ZSCORE_EPS)
from riskloom.functions.climate import daylight_hours, pet_thornthwaite
from riskloom.functions.numeric import round_to_sql as rnd
from riskloom.operators import climate as clim
from riskloom.operators import joins
from riskloom.plans.q_clean import risky
from riskloom.plans.registry import register
from riskloom.plans.sql_base import final, with_base
from riskloom.sources.tables import climate_monthly

MONTH_COLS = ["precip_mm_dia", "temp_media_c", "temp_max_c", "temp_min_c", "humedad_rel_pct",
              "viento_ms"]


def _dbl(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


_DAYS = "day(last_day(make_date(year, month, 1)))"
_DOY = "[" + ", ".join(str(d) for d in MID_MONTH_DOY) + "][month]"
_DAYLIGHT = (f"(24 / pi() * acos(least(greatest(-tan(radians(lat)) * tan({_dbl(0.409)} * "
             f"sin(2 * pi() * {_DOY} / 365 - {_dbl(1.39)})), {_dbl(-1.0)}), {_dbl(1.0)})))")
_C3, _C2, _C1, _C0 = HEAT_A_COEF
_K0, _K1, _K2 = PET_HOT_COEF
_HEAT_A = (f"{_dbl(_C3)} * pow(heat_I, 3) + {_dbl(_C2)} * pow(heat_I, 2) + {_dbl(_C1)} * heat_I "
           f"+ {_dbl(_C0)}")
_PET = (f"(greatest(CASE WHEN temp_media_c IS NULL OR temp_media_c <= 0 THEN {_dbl(0.0)} "
        f"WHEN temp_media_c < {_dbl(PET_HOT_T)} THEN {_dbl(16.0)} * pow(10 * temp_media_c / heat_I, heat_a) "
        f"ELSE {_dbl(_K0)} + {_dbl(_K1)} * temp_media_c + {_dbl(_K2)} * temp_media_c * temp_media_c END, "
        f"{_dbl(0.0)}) * ({_DAYLIGHT} / 12) * ({_DAYS} / 30))")

CLIMATE_CTES = f"""
cm AS (SELECT *, {rnd(f'precip_mm_dia * {_DAYS}', 2)} AS precip_mm_mes FROM climate),
hi0 AS (SELECT Idestado, SUM(CASE WHEN norm > 0 THEN pow(norm / 5, {_dbl(HEAT_EXP)}) ELSE {_dbl(0.0)} END)
               AS heat_I
        FROM (SELECT Idestado, month, AVG(temp_media_c) AS norm FROM cm GROUP BY Idestado, month) n
        GROUP BY Idestado),
hi AS (SELECT Idestado, heat_I, {_HEAT_A} AS heat_a FROM hi0),
pet AS (SELECT cm.*, {_DAYLIGHT} AS daylight, hi.heat_I, hi.heat_a FROM cm JOIN hi USING (Idestado)),
bal AS (SELECT pet.*, {_PET} AS PET, precip_mm_mes - {_PET} AS D FROM pet),
span AS (SELECT Idestado, MIN(year * 12 + month - 1) AS lo, MAX(year * 12 + month - 1) AS hi
         FROM bal GROUP BY Idestado),
grid AS (SELECT Idestado, idx, CAST(floor(idx / 12) AS INTEGER) AS year, CAST(idx % 12 + 1 AS INTEGER) AS month
         FROM (SELECT Idestado, unnest(range(lo, hi + 1)) AS idx FROM span) s),
gd AS (SELECT grid.*, bal.D FROM grid LEFT JOIN bal USING (Idestado, year, month)),
acc AS (SELECT gd.*,
  {', '.join(f"CASE WHEN COUNT(D) OVER (PARTITION BY Idestado ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = {k} THEN SUM(D) OVER (PARTITION BY Idestado ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS a{k}" for k in SPEI_SCALES)}
  FROM gd),
zs AS (SELECT Idestado, year, month,
  {', '.join(rnd(f"(a{k} - AVG(a{k}) OVER (PARTITION BY Idestado, month)) / (STDDEV_POP(a{k}) OVER (PARTITION BY Idestado, month) + {_dbl(ZSCORE_EPS)})", 4) + f" AS spei_{k:02d}" for k in SPEI_SCALES)}
  FROM acc),
drought AS (SELECT bal.*, {', '.join(f'zs.spei_{k:02d}' for k in SPEI_SCALES)}
            FROM bal LEFT JOIN zs USING (Idestado, year, month)),
cyc AS (
  SELECT d.*, 1 AS Idciclo, year AS Anio FROM drought d WHERE month BETWEEN 5 AND 10
  UNION ALL SELECT d.*, 2 AS Idciclo, year AS Anio FROM drought d WHERE month BETWEEN 10 AND 12
  UNION ALL SELECT d.*, 2 AS Idciclo, year - 1 AS Anio FROM drought d WHERE month BETWEEN 1 AND 3
  UNION ALL SELECT d.*, 3 AS Idciclo, year AS Anio FROM drought d),
bycycle AS (
  SELECT Anio, Idestado, Idciclo, COUNT(*) AS n_months,
         {', '.join(f'CASE WHEN COUNT({c}) > 0 THEN list_reduce(list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL)), lambda a, b: a + b) / COUNT({c}) END AS clima_{c}' for c in CLIMATE_CYCLE_MEASURES)}
  FROM cyc GROUP BY Anio, Idestado, Idciclo
  HAVING CASE WHEN Idciclo = 3 THEN COUNT(*) = 12 WHEN Idciclo = 2 THEN COUNT(*) >= 4
              ELSE COUNT(*) >= 1 END)"""

CLIMA_COLS = [f"clima_{c}" for c in CLIMATE_CYCLE_MEASURES]
SPEI_COLS = [f"spei_{k:02d}" for k in SPEI_SCALES]


def _q(body: str) -> str:
    return with_base(body, CLIMATE_CTES)


def monthly(spark, sf):
    return climate_monthly(spark, sf)


def cycle_climate(spark, sf):
    return joins.climate_by_cycle(clim.drought_index(monthly(spark, sf)))


@register("climate_from_json", final(_q(
    f"SELECT year, month, Idestado, lat, {', '.join(MONTH_COLS)}, precip_mm_mes FROM cm"),
    ["lat", *MONTH_COLS, "precip_mm_mes"], ["year", "month", "Idestado"]))
def q_climate_from_json(spark, sf):
    """Monthly climate documents (one JSON per state, rendered by Spark from the orders
    role) parsed back into one row per state-month."""
    m = monthly(spark, sf)
    docs = clim.climate_to_json(m)
    centroids = m.select("Idestado", "lat").distinct()
    out = clim.climate_from_json(docs, centroids)
    return out.select("year", "month", "Idestado", "lat", *MONTH_COLS, "precip_mm_mes")


@register("heat_index", final(_q("SELECT Idestado, heat_I, heat_a FROM hi"),
                              ["heat_I", "heat_a"], ["Idestado"], 4), digits=4)
def q_heat_index(spark, sf):
    return clim.heat_index(clim.with_monthly_precip(monthly(spark, sf)))


@register("water_balance", final(_q(
    "SELECT year, month, Idestado, precip_mm_mes, daylight, PET, D FROM bal"),
    ["precip_mm_mes", "daylight", "PET", "D"], ["year", "month", "Idestado"], 4), digits=4)
def q_water_balance(spark, sf):
    """Daylight hours (FAO), Thornthwaite PET and the balance D = P - PET per state-month."""
    m = clim.with_monthly_precip(monthly(spark, sf))
    m = m.join(clim.heat_index(m), "Idestado")
    pet = pet_thornthwaite("temp_media_c", "heat_I", "heat_a", "lat", "year", "month")
    return m.select("year", "month", "Idestado", "precip_mm_mes",
                    daylight_hours("lat", "month").alias("daylight"), pet.alias("PET"),
                    (F.col("precip_mm_mes") - pet).alias("D"))


@register("drought_index", final(_q(
    f"SELECT year, month, Idestado, PET, D, {', '.join(SPEI_COLS)} FROM drought"),
    ["PET", "D", *SPEI_COLS], ["year", "month", "Idestado"], 4), digits=4)
def q_drought_index(spark, sf):
    """PET -> balance -> k-month sums (k = 3, 6, 12) -> z-score per state and month."""
    d = clim.drought_index(monthly(spark, sf))
    return d.select("year", "month", "Idestado", "PET", "D", *SPEI_COLS)


@register("rolling_sum", final(_q(
    "SELECT Idestado, idx, a3, a6, a12 FROM acc"), ["a3", "a6", "a12"], ["Idestado", "idx"], 4),
    digits=4)
def q_rolling_sum(spark, sf):
    """3/6/12-month sums of the water balance over the month grid (NULL unless complete)."""
    m = clim.with_monthly_precip(monthly(spark, sf))
    m = m.join(clim.heat_index(m), "Idestado")
    m = m.withColumn("D", F.col("precip_mm_mes")
                     - pet_thornthwaite("temp_media_c", "heat_I", "heat_a", "lat", "year", "month"))
    g = clim.month_grid(m).join(m.select("Idestado", "year", "month", "D"),
                                ["Idestado", "year", "month"], "left")
    from riskloom.operators.windows import rolling_sum
    for k in SPEI_SCALES:
        g = rolling_sum(g, k, ["Idestado"], ["_idx"], "D", f"a{k}")
    return g.select("Idestado", F.col("_idx").alias("idx"), "a3", "a6", "a12")


@register("zscore_by_month", final(_q(
    "SELECT Idestado, year, month, spei_03, spei_06, spei_12 FROM zs"),
    SPEI_COLS, ["Idestado", "year", "month"], 4), digits=4)
def q_zscore(spark, sf):
    """z-score of the k-month sums per state x calendar month (population std + 1e-9),
    over every grid month."""
    m = clim.with_monthly_precip(monthly(spark, sf))
    m = m.join(clim.heat_index(m), "Idestado")
    m = m.withColumn("D", F.col("precip_mm_mes")
                     - pet_thornthwaite("temp_media_c", "heat_I", "heat_a", "lat", "year", "month"))
    g = clim.month_grid(m).join(m.select("Idestado", "year", "month", "D"),
                                ["Idestado", "year", "month"], "left")
    from riskloom.functions.numeric import round_to
    from riskloom.operators.windows import rolling_sum, zscore_by_group
    for k in SPEI_SCALES:
        g = rolling_sum(g, k, ["Idestado"], ["_idx"], "D", f"a{k}")
        g = zscore_by_group(g, f"a{k}", ["Idestado", "month"], f"z{k}", ZSCORE_EPS)
    return g.select("Idestado", "year", "month",
                    *[round_to(F.col(f"z{k}"), 4).alias(f"spei_{k:02d}") for k in SPEI_SCALES])


@register("cross_year_cycle_match", final(_q(
    "SELECT Idestado, year, month, Idciclo, Anio FROM cyc"), [],
    ["Idestado", "year", "month", "Idciclo", "Anio"]))
def q_cycle_match(spark, sf):
    """Each month with the (cycle, cycle year) pairs it feeds; Jan-Mar feed the previous
    year's autumn-winter cycle, October feeds two cycles."""
    return joins.cycle_months(monthly(spark, sf)).select("Idestado", "year", "month", "Idciclo", "Anio")


@register("climate_by_cycle", final(_q(
    f"SELECT Anio, Idestado, Idciclo, n_months, {', '.join(CLIMA_COLS)} FROM bycycle"),
    CLIMA_COLS, ["Anio", "Idestado", "Idciclo", "n_months"]))
def q_climate_by_cycle(spark, sf):
    return cycle_climate(spark, sf)


@register("climate_left_join", final(_q(
    f"SELECT r.record_id, r.Anio, r.Idestado, r.Idciclo, {', '.join('b.' + c for c in CLIMA_COLS)} "
    "FROM records r LEFT JOIN bycycle b ON b.Anio = r.Anio AND b.Idestado = r.Idestado "
    "AND b.Idciclo = r.Idciclo"), CLIMA_COLS, ["record_id", "Anio", "Idestado", "Idciclo"]))
def q_climate_join(spark, sf):
    """Every record with the climate of its (year, state, cycle); row count unchanged."""
    r = risky(spark, sf).select("record_id", "Anio", "Idestado", "Idciclo")
    return joins.climate_left_join(r, cycle_climate(spark, sf))


@register("join_coverage", final(_q(f"""
SELECT r.Idciclo, r.Anio, COUNT(*) AS n, COUNT(b.clima_temp_media_c) AS n_match,
       {rnd('AVG(CAST(b.clima_temp_media_c IS NOT NULL AS DOUBLE)) * 100', 2)} AS pct_match
FROM records r LEFT JOIN bycycle b ON b.Anio = r.Anio AND b.Idestado = r.Idestado AND b.Idciclo = r.Idciclo
GROUP BY r.Idciclo, r.Anio"""), ["pct_match"], ["Idciclo", "Anio", "n", "n_match"]))
def q_join_coverage(spark, sf):
    """% of records that found their climate, by cycle and year."""
    r = risky(spark, sf).select("record_id", "Anio", "Idestado", "Idciclo")
    joined = joins.climate_left_join(r, cycle_climate(spark, sf))
    return joins.join_coverage(joined, "clima_temp_media_c", ["Idciclo", "Anio"])


@register("daylight_hours", final(_q(
    f"SELECT DISTINCT Idestado, month, lat, {_DAYLIGHT} AS daylight FROM cm"),
    ["lat", "daylight"], ["Idestado", "month"], 4), digits=4)
def q_daylight(spark, sf):
    """Mean daylight hours of every (state, calendar month) observed (FAO formula)."""
    m = monthly(spark, sf)
    return m.select("Idestado", "month", "lat", daylight_hours("lat", "month").alias("daylight")).distinct()


@register("pet_thornthwaite", final(_q(
    "SELECT year, month, Idestado, temp_media_c, heat_I, heat_a, PET FROM bal"),
    ["temp_media_c", "heat_I", "heat_a", "PET"], ["year", "month", "Idestado"], 4), digits=4)
def q_pet(spark, sf):
    """Thornthwaite potential evapotranspiration per state-month with its heat index."""
    m = clim.with_monthly_precip(monthly(spark, sf))
    m = m.join(clim.heat_index(m), "Idestado")
    return m.select("year", "month", "Idestado", "temp_media_c", "heat_I", "heat_a",
                    pet_thornthwaite("temp_media_c", "heat_I", "heat_a", "lat", "year", "month").alias("PET"))
