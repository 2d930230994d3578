"""Queries for sorting, limits, sampling (F1-F4, F6, F7) and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.constants import YEAR_FILE_RENAMES
from riskloom.operators import sorting
from riskloom.operators.util import HASH_M, key_hash_sql
from riskloom.plans.q_clean import TRAIN_TO, VAL_TO, risky
from riskloom.plans.q_profile import DUP_COLS
from riskloom.plans.registry import register
from riskloom.plans.sql_base import final, with_base
from riskloom.sources.tables import records

SEED = 42
OLD_TO = 1997  # yearly files up to this year use the old column names
_H = key_hash_sql("record_id", SEED)


@register("top_k", final(with_base(
    "SELECT record_id, Sembrada FROM records ORDER BY Sembrada DESC, record_id LIMIT 10"),
    ["Sembrada"], ["record_id"]))
def q_top_k(spark, sf):
    """The ten records with the largest sown area (ties by key)."""
    return sorting.top_k(records(spark, sf).select("record_id", "Sembrada"),
                         [F.desc("Sembrada"), F.asc("record_id")], 10)


@register("multi_key_sort", final(with_base("""
SELECT target, Nomestado, n, row_number() OVER (ORDER BY target ASC, n DESC, Nomestado ASC) AS position
FROM (SELECT target, Nomestado, COUNT(*) AS n FROM risky GROUP BY target, Nomestado) t"""),
    [], ["target", "n", "position"]))
def q_multi_key_sort(spark, sf):
    """Class ascending, count descending (state breaks ties), with the sort position.
    The sorted table is an aggregate (classes x states), so numbering it is cheap."""
    counts = risky(spark, sf).groupBy("target", "Nomestado").agg(F.count(F.lit(1)).alias("n"))
    keys = [F.asc("target"), F.desc("n"), F.asc("Nomestado")]
    return sorting.multi_key_sort(counts, keys).withColumn(
        "position", F.row_number().over(Window.orderBy(*keys)))


@register("seeded_sample", final(with_base(
    f"SELECT record_id, Anio, target FROM risky ORDER BY {_H}, record_id LIMIT 200"),
    [], ["record_id", "Anio", "target"]))
def q_seeded_sample(spark, sf):
    """200 records drawn with seed 42 (reproducible under any partitioning)."""
    return sorting.seeded_sample(risky(spark, sf).select("record_id", "Anio", "target"),
                                 "record_id", n=200, seed=SEED)


@register("seeded_fraction", final(with_base(
    f"SELECT record_id, target FROM risky WHERE {_H} < {int(0.6 * HASH_M)}"),
    [], ["record_id", "target"]))
def q_seeded_fraction(spark, sf):
    """A 60 % seeded fraction of the records."""
    return sorting.seeded_sample(risky(spark, sf).select("record_id", "target"), "record_id",
                                 fraction=0.6, seed=SEED)


@register("best_row", final(with_base(
    "SELECT record_id, Nomestado, Valorproduccion FROM records "
    "WHERE Valorproduccion IS NOT NULL ORDER BY Valorproduccion DESC, record_id LIMIT 1"),
    ["Valorproduccion"], ["record_id"]))
def q_best_row(spark, sf):
    """The record with the highest production value (first key on ties)."""
    r = records(spark, sf).select("record_id", "Nomestado", "Valorproduccion").filter(
        F.col("Valorproduccion").isNotNull())
    return sorting.best_row(r, "Valorproduccion", "record_id")


@register("scatter_table", final(with_base(f"""
SELECT record_id, Nommodalidad, ln(1 + Sembrada) AS log_Sembrada, ln(1 + Siniestrada) AS log_Siniestrada
FROM (SELECT * FROM records ORDER BY {_H}, record_id LIMIT 50000) s"""),
    ["log_Sembrada", "log_Siniestrada"], ["record_id"]))
def q_scatter(spark, sf):
    """Seeded sample (50,000 rows) of sown vs lost area on log scale, by water mode."""
    return sorting.scatter_table(records(spark, sf), "Sembrada", "Siniestrada", "Nommodalidad",
                                 "record_id", n=50000, seed=SEED)


_OLD = {v: k for k, v in YEAR_FILE_RENAMES.items()}  # current name -> old name


@register("union_years", final(with_base(
    "SELECT record_id, Anio, Nomcultivo, Precio, "
    f"CASE WHEN Anio <= {OLD_TO} THEN NULL ELSE Valorproduccion END AS Valorproduccion FROM records"),
    ["Precio", "Valorproduccion"], ["record_id", "Anio"]))
def q_union_years(spark, sf):
    """Two batches of yearly records with drifting schemas (old names, and no production
    value, up to 1997) integrated by renaming and a by-name union."""
    r = records(spark, sf).select("record_id", "Anio", "Nomcultivo", "Precio", "Valorproduccion")
    old = (r.filter(F.col("Anio") <= OLD_TO).drop("Valorproduccion")
           .withColumnsRenamed(_OLD))
    new = r.filter(F.col("Anio") > OLD_TO)
    return sorting.union_years([old, new], YEAR_FILE_RENAMES)


@register("union_train_val", final(with_base(
    f"SELECT record_id, Anio FROM records WHERE Anio <= {VAL_TO}"), [], ["record_id", "Anio"]))
def q_union_train_val(spark, sf):
    r = records(spark, sf).select("record_id", "Anio")
    return sorting.union_train_val(r.filter(F.col("Anio") <= TRAIN_TO),
                                   r.filter((F.col("Anio") > TRAIN_TO) & (F.col("Anio") <= VAL_TO)))


@register("drop_duplicates", final(with_base(
    f"SELECT DISTINCT {', '.join(DUP_COLS)} FROM records"), [], ["Anio"]))
def q_drop_duplicates(spark, sf):
    """Distinct (year, state, crop, mode, cycle) combinations."""
    return sorting.drop_duplicates(records(spark, sf).select(*DUP_COLS))


