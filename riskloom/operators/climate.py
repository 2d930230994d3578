"""Climate enrichment: monthly series -> drought index (E3, E4, E7, H1-H3) -> per cycle
(C7, D24) -> left join onto the records (C1).

Everything is grouped by state: windows are partitioned by state and ordered by month
index, so a window partition holds one state's months (bounded by the time span, not by
the data volume).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.constants import SPEI_SCALES, ZSCORE_EPS
from riskloom.functions.climate import (days_in_month, heat_exponent, heat_term,
                                        pet_thornthwaite, water_balance)
from riskloom.functions.numeric import round_to
from riskloom.operators.windows import rolling_sum, zscore_by_group


def with_monthly_precip(monthly: DataFrame) -> DataFrame:
    """precip_mm_mes = round(precip_mm_dia x days in month, 2)."""
    return monthly.withColumn(
        "precip_mm_mes", round_to(F.col("precip_mm_dia") * days_in_month("year", "month"), 2))


def heat_index(monthly: DataFrame, state: str = "Idestado", temp: str = "temp_media_c") -> DataFrame:
    """Per state, monthly temperature normals (mean over years of each calendar month),
    heat index I = sum over positive normals of (normal/5)^1.514 and the exponent a(I)."""
    normals = monthly.groupBy(state, "month").agg(F.avg(temp).alias("_norm"))
    return (normals.groupBy(state).agg(F.sum(heat_term(F.col("_norm"))).alias("heat_I"))
            .withColumn("heat_a", heat_exponent(F.col("heat_I"))))


def month_grid(monthly: DataFrame, state: str = "Idestado") -> DataFrame:
    """Every month between each state's first and last observed month (gaps included)."""
    idx = F.col("year") * 12 + F.col("month") - 1
    span = monthly.groupBy(state).agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"))
    grid = span.select(state, F.explode(F.sequence("_lo", "_hi")).alias("_idx"))
    return grid.select(state, "_idx", (F.floor(F.col("_idx") / 12)).cast("int").alias("year"),
                       (F.pmod(F.col("_idx"), F.lit(12)) + 1).cast("int").alias("month"))


def drought_index(monthly: DataFrame, scales=SPEI_SCALES, state: str = "Idestado") -> DataFrame:
    """Composite drought index on a monthly climate table (year, month, state, lat, ...):
    PET (Thornthwaite) -> balance D = P - PET -> k-month sums over the month grid (NULL
    unless all k months exist) -> z-score per state and calendar month, 4 decimals."""
    m = with_monthly_precip(monthly)
    hi = heat_index(m, state)
    m = m.join(hi, state, "left")
    m = m.withColumn("PET", pet_thornthwaite("temp_media_c", "heat_I", "heat_a", "lat", "year",
                                             "month"))
    m = m.withColumn("D", water_balance("precip_mm_mes", "PET")).drop("heat_I", "heat_a")
    grid = month_grid(m, state).join(m.select(state, "year", "month", "D"),
                                     [state, "year", "month"], "left")
    for k in scales:
        grid = rolling_sum(grid, k, [state], ["_idx"], "D", f"_acc{k}")
    for k in scales:
        grid = zscore_by_group(grid, f"_acc{k}", [state, "month"], f"_z{k}", ZSCORE_EPS)
    spei = grid.select(state, "year", "month",
                       *[round_to(F.col(f"_z{k}"), 4).alias(f"spei_{k:02d}") for k in scales])
    return m.join(spei, [state, "year", "month"], "left")


def climate_from_json(docs: DataFrame, centroids: DataFrame, text_col: str = "json",
                      state: str = "Idestado") -> DataFrame:
    """A4: one JSON document per state ({"properties": {"parameter": {CODE: {yyyymm: v}}}})
    -> one row per (state, year, month); month 13 (annual mean) dropped; -999 -> NULL;
    codes renamed; monthly precipitation derived. Parsed with from_json + explode +
    a pivot with the six codes given (no extra job to discover them)."""
    from riskloom.constants import CLIMATE_CODES, CLIMATE_MISSING
    schema = "properties struct<parameter: map<string, map<string, double>>>"
    parsed = docs.select(state, F.from_json(F.col(text_col), schema).alias("_j"))
    params = parsed.select(state, F.explode("_j.properties.parameter").alias("code", "_series"))
    cells = params.select(state, "code", F.explode("_series").alias("ym", "v"))
    cells = cells.select(
        state, "code", F.substring("ym", 1, 4).cast("int").alias("year"),
        F.substring("ym", 5, 2).cast("int").alias("month"),
        F.nullif(F.col("v"), F.lit(CLIMATE_MISSING)).alias("v")
    ).filter(F.col("month").between(1, 12))
    wide = (cells.groupBy(state, "year", "month").pivot("code", list(CLIMATE_CODES))
            .agg(F.first("v")))
    wide = wide.withColumnsRenamed(dict(CLIMATE_CODES))
    wide = wide.join(centroids.select(state, "lat"), state, "left")
    return with_monthly_precip(wide)


def climate_to_json(monthly: DataFrame, state: str = "Idestado") -> DataFrame:
    """Inverse of A4 (used to exercise the parser on data Spark derives from the tables):
    one JSON document per state, with the annual mean as month 13 and NULL as -999."""
    from riskloom.constants import CLIMATE_CODES, CLIMATE_MISSING
    ym = F.format_string("%04d%02d", F.col("year"), F.col("month"))
    per_code = []
    for code, name in CLIMATE_CODES.items():
        per_code.append(F.struct(F.lit(code).alias("code"), F.col(name).alias("v")))
    cells = monthly.select(state, "year", ym.alias("ym"), F.explode(F.array(*per_code)).alias("_c"))
    cells = cells.select(state, "year", "ym", "_c.code",
                         F.coalesce(F.col("_c.v"), F.lit(CLIMATE_MISSING)).alias("v"))
    annual = (cells.groupBy(state, "year", "code").agg(F.avg("v").alias("v"))
              .select(state, "code", F.format_string("%04d13", F.col("year")).alias("ym"), "v"))
    allc = cells.select(state, "code", "ym", "v").unionByName(annual)
    series = allc.groupBy(state, "code").agg(F.map_from_entries(F.collect_list(
        F.struct("ym", "v"))).alias("series"))
    doc = series.groupBy(state).agg(F.map_from_entries(F.collect_list(
        F.struct("code", "series"))).alias("parameter"))
    return doc.select(state, F.to_json(F.struct(F.struct("parameter").alias("properties")))
                      .alias("json"))


def state_centroids(spark) -> DataFrame:
    """A5: literal dimension (Idestado, lat, lon) of 32 states -- fixed size, broadcast."""
    from riskloom.constants import STATE_CENTROIDS
    return F.broadcast(spark.createDataFrame(STATE_CENTROIDS, "Idestado int, lat double, lon double"))
