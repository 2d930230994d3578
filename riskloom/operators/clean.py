"""Projections, casts, filters and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.constants import (CAT_FEATURES, CYCLES, POST_HARVEST,
                                STRUCTURAL_NULL_COLUMNS)
from riskloom.functions.risk import class_label, loss_ratio, normalize_text, risk_class


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, cols) -> None:
    """Fail when the plan is built, not when it runs."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing columns: {missing}")


def _number(c: str):
    """Double of a column; NULL for text that is no number, NaN and infinities."""
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def apply_types(df: DataFrame, numeric=(), categorical=(), integer=("Anio",)) -> DataFrame:
    """B1: coercing casts; text that is not a number becomes NULL; absent columns skipped."""
    casts = {}
    for c in numeric:
        if c in df.columns:
            casts[c] = _number(c)
    for c in integer:
        if c in df.columns:
            # Whole numbers as they are; text such as '2010.0' by way of a double.
            casts[c] = F.coalesce(F.col(c).try_cast("bigint"), _number(c).try_cast("bigint"))
    for c in categorical:
        if c in df.columns:
            casts[c] = F.col(c).cast("string")
    return df.withColumns(casts) if casts else df


def with_loss_ratio(df: DataFrame, lost: str = "Siniestrada", sown: str = "Sembrada") -> DataFrame:
    """B2: adds proporcion_siniestro. Returns an empty frame when inputs are absent."""
    if lost not in df.columns or sown not in df.columns:
        return df.sparkSession.createDataFrame([], "proporcion_siniestro double")
    return df.withColumn("proporcion_siniestro", loss_ratio(lost, sown))


def with_risk_class(df: DataFrame, ratio: str = "proporcion_siniestro") -> DataFrame:
    """Adds target (0..4) and nivel_riesgo (label)."""
    require_columns(df, [ratio])
    return df.withColumns({"target": risk_class(ratio)}).withColumn(
        "nivel_riesgo", class_label(F.col("target")))


def with_risk(df: DataFrame) -> DataFrame:
    """B2 then B3."""
    return with_risk_class(with_loss_ratio(df))


def impute_structural_nulls(df: DataFrame, cols=STRUCTURAL_NULL_COLUMNS,
                            harvested: str = "Cosechada") -> DataFrame:
    """Where nothing was harvested, a missing price/yield/value/volume is 0."""
    zero = F.col(harvested) == 0
    return df.withColumns({
        c: F.when(zero & F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c))
        for c in cols if c in df.columns})


def drop_residual_nulls(df: DataFrame, cols=("Sembrada", "Volumenproduccion")) -> DataFrame:
    """B5."""
    return df.dropna(subset=list(cols))


def select_features(df: DataFrame, cols, forbidden=POST_HARVEST, key: str | None = None) -> DataFrame:
    """B6 leakage guard: selecting any post-harvest column is refused."""
    leaked = [c for c in cols if c in forbidden]
    if leaked:
        raise ValueError(f"post-harvest columns refused as features: {leaked}")
    require_columns(df, cols)
    return df.select(*([key] if key else []), *cols)


def temporal_split(df: DataFrame, train_to: int, val_to: int, year: str = "Anio"):
    """Train (year <= train_to), validation (train_to < year <= val_to), test (> val_to).
    A missing year belongs to no split."""
    y = F.col(year)
    return (df.filter(y <= train_to), df.filter((y > train_to) & (y <= val_to)),
            df.filter(y > val_to))


def split_label(train_to: int, val_to: int, year: str = "Anio"):
    y = F.col(year)
    return (F.when(y <= train_to, "train").when(y <= val_to, "val")
            .when(y > val_to, "test"))


def engineer_features(df: DataFrame) -> DataFrame:
    """B10."""
    return df.withColumns({
        "log_sembrada": F.log1p("Sembrada"),
        "interaccion_mod_ciclo": F.col("Idmodalidad") * F.col("Idciclo")})


def rename_readable(df: DataFrame, mapping: dict) -> DataFrame:
    """B11."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def fill_model_inputs(df: DataFrame, cats=CAT_FEATURES, nums=("Sembrada", "Precio"),
                      unknown: str = "Desconocido") -> DataFrame:
    """Categories as text with a placeholder for missing; numerics coerced, missing 0."""
    out = {c: F.coalesce(F.col(c).cast("string"), F.lit(unknown)) for c in cats if c in df.columns}
    out.update({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in nums
                if c in df.columns})
    return df.withColumns(out)


def rainfed_area(df: DataFrame, mode: str = "Nommodalidad", sown: str = "Sembrada") -> DataFrame:
    """es_temporal (case-insensitive 'temporal') and area_temporal."""
    flag = F.lower(F.col(mode)).contains("temporal").cast("int")
    return df.withColumns({"es_temporal": flag}).withColumn(
        "area_temporal", F.col(sown) * F.col("es_temporal"))


def min_area_filter(df: DataFrame, min_ha: float = 0.1, col: str = "Sembrada_total") -> DataFrame:
    """B13 (applied after aggregation: a HAVING)."""
    return df.filter(F.col(col) >= min_ha)


REQUEST_TEXTS = ["Nomestado", "Nomcultivo", "Nomcicloproductivo", "Nommodalidad"]


def validate_request(df: DataFrame, known: dict | None = None,
                     need_price: bool = True) -> DataFrame:
    """Adds ``ok`` and ``reason`` (first failing rule) to scoring requests, and a
    ``flag`` for categories unseen at training time (``known``: column -> DataFrame of
    known values, joined left-semi style so it never goes through the driver). Without
    ``need_price`` the price may be missing, but not negative."""
    reason = F.lit(None).cast("string")
    checks = ([(F.col(c).isNull() | (F.trim(F.col(c)) == ""), f"missing {c}") for c in REQUEST_TEXTS]
              + [(F.col("Sembrada").isNull(), "missing Sembrada"),
                 (F.col("Sembrada") < 0, "negative Sembrada")])
    if need_price:
        checks.append((F.col("Precio").isNull(), "missing Precio"))
    if need_price or "Precio" in df.columns:
        checks.append((F.col("Precio") < 0, "negative Precio"))
    for cond, text in reversed(checks):
        reason = F.when(cond, F.lit(text)).otherwise(reason)
    out = df.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
    flag = F.lit(None).cast("string")
    if known:
        for c, values in known.items():
            tag = f"_known_{c}"
            out = out.join(values.select(F.col(c).alias(tag)).distinct()
                           .withColumn(tag + "_hit", F.lit(True)),
                           out[c] == F.col(tag), "left").drop(tag)
            flag = F.when(F.col(tag + "_hit").isNull(), F.lit(f"unknown {c}")).otherwise(flag)
        out = out.withColumn("flag", flag).drop(*[f"_known_{c}_hit" for c in known])
    return out


def cycle_code(name_col: str = "Nomcicloproductivo"):
    """Cycle name -> 1/2/3 (text folded, so encodings of the accent do not matter)."""
    s = normalize_text(F.col(name_col))
    expr = F.lit(None).cast("int")
    for code, name in CYCLES.items():
        expr = F.when(s == normalize_text(F.lit(name)), F.lit(code)).otherwise(expr)
    return expr
