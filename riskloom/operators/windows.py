"""Window operators (E1-E6, E8) and the distributed running-sum building block.

A plain ``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task. When one
group may hold a third of the rows, that task gets a third of the data. ``running_totals``
computes the same "sum over all preceding rows of my group" without that: the rows are
range-partitioned on (group, order) -- so a hot group is cut into many ranges -- each range
is summed locally, and the per-range totals (a table of ranges x groups, tiny) give
every range its offset.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.util import key_hash


def _num_ranges(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, part_cols, order_cols, value_cols, n_ranges: int | None = None,
                   include_current: bool = False, prefix: str = "run_") -> DataFrame:
    """Add ``run_<v>`` = sum of v over rows of the same ``part_cols`` that come before this
    row in ``order_cols`` order (plus this row when ``include_current``) and ``run_n``,
    their count. ``order_cols`` must be a total order within a group."""
    part_cols, order_cols, value_cols = list(part_cols), list(order_cols), list(value_cols)
    n = _num_ranges(df, n_ranges)
    # The range bounds are sampled from the input. Both consumers below (local sums and
    # per-range totals) must see the same bounds, so they read one persisted instance of
    # the range exchange: a block lost with an executor is recomputed from that same
    # exchange (same bounds, same range ids), never from a second sampling.
    ranged = df.repartitionByRange(n, *part_cols, *order_cols).withColumn(
        "_rng", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    frame = (Window.partitionBy("_rng", *part_cols).orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1))
    local = ranged.withColumns(
        {f"_loc_{v}": F.coalesce(F.sum(v).over(frame), F.lit(0)) for v in value_cols}
        | {"_loc_n": F.count(F.lit(1)).over(frame)})
    totals = ranged.groupBy("_rng", *part_cols).agg(
        *[F.coalesce(F.sum(v), F.lit(0)).alias(f"_tot_{v}") for v in value_cols],
        F.count(F.lit(1)).alias("_tot_n"))
    before = Window.partitionBy(*part_cols).orderBy("_rng").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_rng", *part_cols,
        *[F.coalesce(F.sum(f"_tot_{v}").over(before), F.lit(0)).alias(f"_off_{v}")
          for v in value_cols],
        F.coalesce(F.sum("_tot_n").over(before), F.lit(0)).alias("_off_n"))
    # Null-safe: rows whose group key is NULL are a group like any other.
    names = {c: f"_part_{i}" for i, c in enumerate(part_cols)}
    same = local["_rng"] == F.col("_off_rng")
    for c, name in names.items():
        same = same & F.col(c).eqNullSafe(F.col(name))
    joined = local.join(offsets.withColumnsRenamed(names | {"_rng": "_off_rng"}), same, "left")
    out = joined.withColumns(
        {f"{prefix}{v}": F.col(f"_loc_{v}") + F.coalesce(F.col(f"_off_{v}"), F.lit(0))
         for v in value_cols}
        | {f"{prefix}n": F.col("_loc_n") + F.coalesce(F.col("_off_n"), F.lit(0))})
    drop = ["_rng", "_off_rng", *names.values(), "_loc_n", "_off_n"] + [f"_loc_{v}" for v in value_cols] + [
        f"_off_{v}" for v in value_cols]
    return out.drop(*drop)


def average_rank(df: DataFrame, part_cols, value_col: str, rank_col: str = "avg_rank",
                 n_ranges: int | None = None) -> DataFrame:
    """Average rank (ties share the mean of their positions, 1-based) of ``value_col``
    within ``part_cols``. Returns one row per distinct (group, value) with its rank and
    count. Ties are collapsed first, so a hot value is one row."""
    part_cols = list(part_cols)
    distinct = df.groupBy(*part_cols, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    run = running_totals(distinct, part_cols, [value_col], ["_cnt"], n_ranges, prefix="_below_")
    return run.select(*part_cols, value_col, "_cnt",
                      (F.col("_below__cnt") + (F.col("_cnt") + 1) / 2).alias(rank_col)
                      ).withColumnRenamed("_cnt", "n_ties")


def prior_year_mean(df: DataFrame, keys, value: str = "proporcion_siniestro",
                    year: str = "Anio", out: str = "hist_mean") -> DataFrame:
    """Mean of ``value`` over the group's rows in strictly earlier years; 0 when none.
    Rows whose key is NULL are a group like any other, as in ``prior_row_mean``.

    Rows are first reduced to (group, year) sums -- at most one row per year per group --
    so the window only ever sees those few rows, even for a hot group."""
    keys = list(keys)
    per_year = df.groupBy(*keys, year).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    hist = per_year.select(*keys, year,
                           F.try_divide(F.sum("_s").over(before), F.sum("_n").over(before))
                           .alias("_m"))
    names = {c: f"_key_{i}" for i, c in enumerate([*keys, year])}
    same = [df[c].eqNullSafe(F.col(name)) for c, name in names.items()]
    return (df.join(hist.withColumnsRenamed(names), same, "left").drop(*names.values())
            .withColumn(out, F.coalesce(F.col("_m"), F.lit(0.0))).drop("_m"))


def prior_row_mean(df: DataFrame, keys, value: str = "proporcion_siniestro",
                   year: str = "Anio", tie: str = "record_id", out: str = "hist_mean_rows",
                   n_ranges: int | None = None) -> DataFrame:
    """Mean of ``value`` over all earlier rows of the group in (year, tie) order that
    have one; 0 when none has. Distributed running sums, so a hot group is split."""
    counted = df.withColumn("_has", F.col(value).isNotNull().cast("long"))
    run = running_totals(counted, keys, [year, tie], [value, "_has"], n_ranges, prefix="_p_")
    return (run.withColumn(out, F.coalesce(F.try_divide(F.col(f"_p_{value}"), F.col("_p__has")),
                                           F.lit(0.0)))
            .drop("_has", f"_p_{value}", "_p__has", "_p_n"))


def rolling_sum(df: DataFrame, k: int, part, order, value: str, out: str) -> DataFrame:
    """Sum of the last k rows (current included) of ``value``; NULL unless all k rows
    exist and are non-null. Rows must already form a gap-free grid (see climate)."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(k - 1), 0)
    return df.withColumn(out, F.when(F.count(value).over(w) == k, F.sum(value).over(w)))


def zscore_by_group(df: DataFrame, value: str, part, out: str, eps: float = 1e-9) -> DataFrame:
    """(x - mean) / (population std + eps) within ``part``, from a grouped
    aggregate joined back (no unbounded window buffer)."""
    part = list(part)
    stats = df.groupBy(*part).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    return (df.join(stats, part, "left")
            .withColumn(out, (F.col(value) - F.col("_mu")) / (F.col("_sd") + F.lit(eps)))
            .drop("_mu", "_sd"))


def topn_per_group(df: DataFrame, part, order, n: int, rank_col: str = "rank",
                   buckets: int | None = None) -> DataFrame:
    """E5: first n rows per group in ``order`` (which must be a total order).

    Two phases so that a group with very many rows is never ranked in one task: rows are
    salted into buckets (hash of the whole row), the top n of each (group, bucket) are
    kept -- every global top-n row survives that -- and the survivors (n x buckets per
    group at most) are ranked again per group."""
    part = list(part)
    b = buckets or _num_ranges(df, None)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(b)))
    first = salted.withColumn(
        "_r1", F.row_number().over(Window.partitionBy(*part, "_salt").orderBy(*order))
    ).filter(F.col("_r1") <= n).drop("_r1", "_salt")
    w = Window.partitionBy(*part).orderBy(*order)
    return first.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def running_best(trials: DataFrame, score: str, order: str = "trial",
                 out: str = "best_so_far") -> DataFrame:
    """Best score so far. ``trials`` is a small table (one row per trial)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn(out, F.max(score).over(w))


def ordered_target_statistic(df: DataFrame, cat: str, y: str, prior: float, seed: int = 42,
                             key: str = "record_id", weight: float = 1.0,
                             out: str | None = None, n_ranges: int | None = None) -> DataFrame:
    """Smoothed target mean of a category using only rows that come before each row in
    a seeded random order: (sum_before + weight * prior) / (n_before + weight). A row's own
    label never enters its own code."""
    out = out or f"{cat}_ots"
    ordered = df.withColumn("_ord", key_hash(F.col(key), seed))
    run = running_totals(ordered, [cat], ["_ord", key], [y], n_ranges, prefix="_b_")
    return (run.withColumn(out, (F.col(f"_b_{y}") + F.lit(weight * prior))
                           / (F.col("_b_n") + F.lit(weight)))
            .drop("_ord", f"_b_{y}", "_b_n"))
