"""Joins (C1-C8).

Broadcast policy: only fixed-size sides are broadcast explicitly (class levels, the 60
thresholds, 32 state centroids, a top-N list). Sides that grow with the data (climate by
cycle, encoders, per-key rates) are left to AQE, which broadcasts them only when their
runtime size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and otherwise
keeps a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.constants import CLIMATE_CYCLE_MEASURES
from riskloom.functions.numeric import round_to
from riskloom.operators.clean import cycle_code


class JoinContractError(ValueError):
    pass


def climate_left_join(df: DataFrame, climate: DataFrame, keys=("Anio", "Idestado", "Idciclo"),
                      check_unique: bool = False, cycle_name: str | None = None,
                      cycle: str = "Idciclo") -> DataFrame:
    """Attach cycle climate to every record (left join on year, state, cycle). With
    ``cycle_name`` the records' cycle comes from that column's names (folded text; a name
    that is no cycle has no climate). The right side must be unique on the keys so that no
    record is duplicated; with ``check_unique`` that is verified by an aggregate before the
    plan is returned."""
    keys = list(keys)
    if cycle_name:
        df = df.withColumn(cycle, cycle_code(cycle_name))
    if check_unique:
        dup = climate.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).count()
        if dup:
            raise JoinContractError("climate table is not unique on " + ", ".join(keys))
    right = climate.select(*keys, *[c for c in climate.columns if c.startswith("clima_")])
    return df.join(right, keys, "left")


def join_coverage(df: DataFrame, col: str, by=()) -> DataFrame:
    """% of rows with a match (``col`` not NULL), overall or per ``by``."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(col).isNotNull()).alias("n_match"),
                 round_to(F.avg(F.col(col).isNotNull().cast("double")) * 100, 2).alias("pct_match"))


def total_with_breakdown_join(top: DataFrame, detail: DataFrame, key: str, by: str, value: str,
                              levels) -> DataFrame:
    """Top-N totals left-joined to their per-level pivot; missing levels -> 0. The
    pivot levels are given, so no extra job discovers them."""
    kept = detail.join(F.broadcast(top.select(key)), key, "left_semi")  # top is N rows
    pivot = kept.groupBy(key).pivot(by, list(levels)).agg(F.sum(value))
    out = top.join(pivot, key, "left")
    return out.fillna(0.0, subset=list(levels))


def topn_semi_join(df: DataFrame, key: str, n: int) -> DataFrame:
    """C4: keep only rows whose ``key`` is among the n most frequent (ties by key). The
    top-n list has n rows, so it is broadcast."""
    top = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), F.asc(key)).limit(n).select(key))
    return df.join(F.broadcast(top), key, "left_semi")


def dense_grid(values: DataFrame, rows: DataFrame, cols: DataFrame, value: str,
               fill=0) -> DataFrame:
    """Every (row, col) cell of two small key lists, filled from ``values``.
    The cross product is of the two key lists only (their sizes are the grid's)."""
    r, c = rows.columns[0], cols.columns[0]
    grid = rows.crossJoin(cols)  # the two category lists only (grid size = |rows| x |cols|)
    return grid.join(values, [r, c], "left").fillna(fill, subset=[value])


def map_lookup_join(df: DataFrame, mapping: DataFrame, key, value: str, default,
                    out: str | None = None) -> DataFrame:
    """Attach ``value`` looked up by ``key`` (encoder code, smoothed rate, weight);
    unseen keys get ``default``."""
    keys = [key] if isinstance(key, str) else list(key)
    out = out or value
    right = mapping.select(*keys, F.col(value).alias("_lookup"))
    return (df.join(right, keys, "left")
            .withColumn(out, F.coalesce(F.col("_lookup"), F.lit(default))).drop("_lookup"))


def cycle_months(monthly: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """Give each month its (cycle, cycle_year) pairs without a self join:
    spring-summer (1) = months 5-10 of the year; autumn-winter (2) = months 10-12 of year y
    and 1-3 of y+1 (October counts in both); perennial (3) = every month of the year."""
    m, y = F.col(month), F.col(year)
    pairs = F.array(
        F.when(m.between(5, 10), F.struct(F.lit(1).alias("Idciclo"), y.alias("Anio"))),
        F.when(m.between(10, 12), F.struct(F.lit(2).alias("Idciclo"), y.alias("Anio")))
         .when(m.between(1, 3), F.struct(F.lit(2).alias("Idciclo"), (y - 1).alias("Anio"))),
        F.struct(F.lit(3).alias("Idciclo"), y.alias("Anio")))
    return (monthly.withColumn("_cy", F.explode(pairs)).filter(F.col("_cy").isNotNull())
            .withColumns({"Idciclo": F.col("_cy.Idciclo"), "Anio": F.col("_cy.Anio")}).drop("_cy"))


def ordered_mean(col: str):
    """Mean of a small bounded group (here: the <= 12 months of a cycle) summed in sorted
    order, so the result is the same bits whatever order the rows arrive in."""
    vals = F.array_sort(F.collect_list(col))
    total = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(vals) > 0, total / F.size(vals))


def climate_by_cycle(monthly: DataFrame, measures=CLIMATE_CYCLE_MEASURES) -> DataFrame:
    """Mean of the climate measures per (year, state, cycle); a cycle needs >= 1
    month (1), >= 4 months (2) or all 12 months (3). A cycle has at most 12 months, so the
    means are taken over the collected, sorted months (order-independent results)."""
    exploded = cycle_months(monthly)
    agg = exploded.groupBy("Anio", "Idestado", "Idciclo").agg(
        F.count(F.lit(1)).alias("n_months"),
        *[ordered_mean(c).alias(f"clima_{c}") for c in measures])
    need = F.when(F.col("Idciclo") == 1, 1).when(F.col("Idciclo") == 2, 4).otherwise(12)
    cond = F.when(F.col("Idciclo") == 3, F.col("n_months") == 12).otherwise(F.col("n_months") >= need)
    return agg.filter(cond)


def align_predictions(pred: DataFrame, attrs: DataFrame, key: str = "key") -> DataFrame:
    """Re-attach attributes to predictions by key (Spark rows have no position)."""
    return pred.join(attrs, key, "inner")
