"""Profiling aggregates (D1-D18, D29): each is one grouped aggregation (partial
aggregation map-side, one shuffle on the group key) plus small projections.

pandas semantics kept on purpose: NULL keys are dropped before grouping (pandas groupby
does), a sum of nothing is 0, value counts ignore missing values.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.constants import RISK_LABELS
from riskloom.functions.numeric import round_to
from riskloom.operators.quantiles import column_quantiles, exact_quantiles, wide_quantiles
from riskloom.operators.windows import running_totals, topn_per_group


def _pct(part, whole, digits=2):
    return round_to(F.try_divide(part * F.lit(100.0), whole), digits)


def dataset_overview(df: DataFrame, year: str = "Anio", exact: bool = True) -> DataFrame:
    """One row per column: type, non-null count, distinct count, plus the table's row
    and column counts and year range. ``exact=False`` uses HyperLogLog++ distinct counts
    (one pass, mergeable) for very large tables."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("_rows"), F.min(year).alias("_ymin"), F.max(year).alias("_ymax")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(c).alias(f"_nn{i}"), distinct(c).alias(f"_nd{i}")]
    one = df.agg(*aggs)
    types = dict(df.dtypes)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                     F.lit(types[c]).alias("data_type"), F.col(f"_nn{i}").alias("non_null"),
                     F.col(f"_nd{i}").alias("n_distinct"))
            for i, c in enumerate(df.columns)]
    return one.select(F.col("_rows").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                      F.col("_ymin").alias("year_min"), F.col("_ymax").alias("year_max"),
                      F.inline(F.array(*rows)))


def class_distribution(df: DataFrame, cls: str = "target") -> DataFrame:
    """Records and % (2 decimals) per risk class, all five classes listed."""
    spark = df.sparkSession
    levels = F.broadcast(spark.createDataFrame(list(enumerate(RISK_LABELS)),
                                               f"{cls} int, nivel_riesgo string"))
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("registros"),
                                 F.sum("Sembrada").alias("sembrada"))
    out = levels.join(counts, cls, "left").fillna(0, ["registros"]).fillna(0.0, ["sembrada"])
    total = F.sum("registros").over(Window.partitionBy())  # 5 rows
    return out.withColumn("pct", _pct(F.col("registros"), total))


def null_report(df: DataFrame) -> DataFrame:
    """D3: columns with missing values, count and % (2 decimals), most missing first."""
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_z{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"_z{i}").alias("n_null"))
            for i, c in enumerate(df.columns)]
    return (one.select("_n", F.inline(F.array(*rows))).filter(F.col("n_null") > 0)
            .select("column_name", "n_null", _pct(F.col("n_null"), F.col("_n")).alias("pct_null"))
            .orderBy(F.desc("pct_null"), F.asc("column_name")))


def null_correlation(df: DataFrame, cols=None) -> DataFrame:
    """Pearson correlation of the null indicators of every pair of columns that both
    have missing values (empty when fewer than two do). One aggregation pass of counts:
    for 0/1 indicators r = (n c_ab - z_a z_b) / sqrt((n z_a - z_a^2)(n z_b - z_b^2)), with
    z the null counts and c_ab the rows where both are null -- exact integer arithmetic up
    to the final division."""
    cols = list(cols or df.columns)
    k = len(cols)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"_c{i}_{j}")
             for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    one = df.agg(*aggs)
    n = F.col("_n").cast("double")

    def cnt(i, j):
        return F.col(f"_c{min(i, j)}_{max(i, j)}").cast("double")

    rows = []
    for i in range(k):
        for j in range(k):
            za, zb, cab = cnt(i, i), cnt(j, j), cnt(i, j)
            r = F.try_divide(n * cab - za * zb, F.sqrt((n * za - za * za) * (n * zb - zb * zb)))
            rows.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                                 za.alias("_za"), zb.alias("_zb"), r.alias("corr")))
    out = one.select(F.inline(F.array(*rows))).filter((F.col("_za") > 0) & (F.col("_zb") > 0))
    return out.select("col_a", "col_b", "corr")


def structural_null_check(df: DataFrame, col: str = "Precio", harvested: str = "Cosechada") -> DataFrame:
    """Of rows missing ``col``, how many and what % had nothing harvested."""
    miss = F.col(col).isNull()
    return df.agg(F.count_if(miss).alias("n_missing"),
                  F.count_if(miss & (F.col(harvested) == 0)).alias("n_zero_harvest")
                  ).withColumn("pct_zero_harvest",
                               _pct(F.col("n_zero_harvest"), F.col("n_missing")))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Exact duplicates (NULL equals NULL) beyond the first copy. Distinct rows are
    found with a grouped count (partial aggregation), never by collecting."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_duplicates"),
                      F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"),
                      F.count(F.lit(1)).alias("n_unique"))


def describe_numeric(df: DataFrame, cols) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation, exact and
    distributed), max, range."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"),
                 F.stddev_samp(c).alias(f"std{i}"), F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"),
                     F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
                     F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
                     (F.col(f"max{i}") - F.col(f"min{i}")).alias("range"))
            for i, c in enumerate(cols)]
    stats = one.select(F.inline(F.array(*rows)))
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75]).groupBy("column_name").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n)
          for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return stats.join(q, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "range")


def value_counts(df: DataFrame, cols) -> DataFrame:
    """Long table (column_name, value, n) of non-missing value counts for several columns:
    one pass that unpivots and counts (partial aggregation collapses hot values)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("_kv")).select("_kv.*").filter(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def describe_categorical(df: DataFrame, cols, top: int = 3) -> DataFrame:
    """Distinct count, mode (smallest value on ties) and the top values with counts."""
    vc = value_counts(df, cols)
    nd = vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"),
                                       F.min_by("value", F.struct(-F.col("n"), F.col("value")))
                                       .alias("mode"))
    tops = topn_per_group(vc, ["column_name"], [F.desc("n"), F.asc("value")], top)
    return tops.join(nd, "column_name").select("column_name", "n_distinct", "mode", "rank",
                                               "value", "n")


def iqr_outliers(df: DataFrame, cols, k: float = 1.5) -> DataFrame:
    """Quartiles, IQR, fences and outlier count / % of all rows, per column.
    Two passes: exact distributed quartiles, then one conditional count against them."""
    q = wide_quantiles(df, cols, [0.25, 0.75])  # one row
    n = df.agg(F.count(F.lit(1)).alias("_n"))  # one row
    fences = q.crossJoin(n).select("_n", F.inline(F.array(*[  # 1 x 1 row
        F.struct(F.lit(c).alias("column_name"), F.col(f"_q{i}_0").alias("q1"),
                 F.col(f"_q{i}_1").alias("q3")) for i, c in enumerate(cols)])))
    fences = (fences.withColumn("iqr", F.col("q3") - F.col("q1"))
              .withColumn("lower", F.col("q1") - k * F.col("iqr"))
              .withColumn("upper", F.col("q3") + k * F.col("iqr")))
    wide = q.select(*[(F.col(f"_q{i}_0") - k * (F.col(f"_q{i}_1") - F.col(f"_q{i}_0"))).alias(f"_lower{i}")
                      for i in range(len(cols))],
                    *[(F.col(f"_q{i}_1") + k * (F.col(f"_q{i}_1") - F.col(f"_q{i}_0"))).alias(f"_upper{i}")
                      for i in range(len(cols))])
    counts = df.crossJoin(F.broadcast(wide)).agg(*[  # wide is a single row
        F.count_if((F.col(c) < F.col(f"_lower{i}")) | (F.col(c) > F.col(f"_upper{i}")))
        .alias(f"_o{i}") for i, c in enumerate(cols)])
    counts = counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_o{i}").alias("n_outliers"))
        for i, c in enumerate(cols)])))
    return (fences.join(counts, "column_name")
            .withColumn("pct_outliers", _pct(F.col("n_outliers"), F.col("_n"))).drop("_n"))


def five_number_by_group(df: DataFrame, col: str, by: str, shift: float = 0.0) -> DataFrame:
    """Box-plot statistics per group (min, quartiles, max, whiskers at 1.5 IQR).
    NULL groups and NULL values are dropped."""
    v = (F.col(col) + F.lit(shift)) if shift else F.col(col)
    base = df.filter(F.col(by).isNotNull() & F.col(col).isNotNull()).select(by, v.alias("_v"))
    mm = base.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"),
                              F.max("_v").alias("max"))
    qs = exact_quantiles(base, "_v", [0.25, 0.5, 0.75], [by]).groupBy(by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n)
          for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    q = mm.join(qs, by).select(by, "n", "min", "q1", "median", "q3", "max")
    q = q.withColumns({"_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                       "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    # q has one row per group (small); the join is broadcast by AQE when it is.
    wh = base.join(q.select(by, "_lo", "_hi"), by).groupBy(by).agg(
        F.min(F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= F.col("_hi"), F.col("_v"))).alias("whisker_high"))
    return q.drop("_lo", "_hi").join(wh, by)


def histogram(df: DataFrame, col: str, bins: int = 60, skew_cut: float = 2.0) -> DataFrame:
    """When the (bias-adjusted) sample skewness exceeds ``skew_cut`` the values are
    log1p-transformed; then ``bins`` equal-width bins between min and max (the max falls
    in the last bin), with counts and density."""
    vals = df.select(F.col(col).alias("_x")).filter(F.col("_x").isNotNull())
    st = vals.agg(F.count(F.lit(1)).alias("_n"), F.skewness("_x").alias("_g1"))
    n = F.col("_n").cast("double")
    adj = F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)
    st = st.select("_n", F.coalesce(adj > skew_cut, F.lit(False)).alias("log_scale"))
    t = vals.crossJoin(F.broadcast(st)).select(  # st is a single row
        "_n", "log_scale", F.when(F.col("log_scale"), F.log1p("_x")).otherwise(F.col("_x"))
        .alias("_t"))
    rng = t.groupBy("_n", "log_scale").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = t.crossJoin(F.broadcast(rng.drop("_n", "log_scale"))).select(  # one-row min/max
        "_n", "log_scale", "lo", "hi",
        F.least(F.floor(F.try_divide(F.col("_t") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)
                + 1, F.lit(bins)).alias("bin"))
    b = b.withColumn("bin", F.coalesce(F.col("bin"), F.lit(1)))
    counts = b.groupBy("bin", "_n", "log_scale", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.col("bin").cast("bigint").alias("bin"), "log_scale",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
        (F.col("lo") + F.col("bin") * width).alias("bin_hi"), "n",
        F.try_divide(F.col("n"), F.col("_n") * width).alias("density"))


def _safe_corr(x: str, y: str):
    """Pearson correlation that is NULL (not an ANSI error) when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(df: DataFrame, cols, method: str = "spearman") -> DataFrame:
    """Correlation of every ordered pair of ``cols``, each over its pairwise-complete rows.

    Spearman = Pearson on average ranks, ranked within each pair's complete rows. Pairs
    whose missing values fall on the same null masks have the same complete rows, so each
    (column, set of null masks) is ranked once: a cheap statistic pass (null counts, and
    which columns share a null mask) picks these, all rankings share one distributed
    running-count pass (tied values collapsed first), ranks are pivoted back per row and
    every pair's correlation comes from one aggregation. The matrix is symmetric: a <= b is
    computed, then mirrored."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    rid = df.select(F.monotonically_increasing_id().alias("_rid"),
                    *[F.col(c).cast("double").alias(c) for c in cols])
    if method == "pearson":
        one = rid.agg(*[_safe_corr(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    else:
        # Read by the statistics, the distinct values and the join: made once.
        rid = rid.persist(StorageLevel.MEMORY_AND_DISK)
        # planning statistics (one pass, a few numbers): null counts, and for every pair of
        # columns the rows where exactly one of them is missing -- 0 means the same null mask
        stats = rid.agg(*[F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(cols)],
                        *[F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias(f"x{i}_{j}")
                          for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]).first()
        partial = [c for i, c in enumerate(cols) if stats[f"z{i}"] > 0]
        mask = {}  # column with missing values -> representative column of its null mask
        for i, a in enumerate(cols):
            if a in partial and a not in mask:
                mask[a] = a
                for j in range(i + 1, len(cols)):
                    if cols[j] in partial and cols[j] not in mask and stats[f"x{i}_{j}"] == 0:
                        mask[cols[j]] = a

        def sig(a, b):
            return tuple(sorted({mask[c] for c in (a, b) if c in mask}))

        keys: dict = {}
        for a, b in pairs:
            for c in (a, b):
                keys.setdefault((c, sig(a, b)), len(keys))
        # One long row per value; bit s of ``_o`` tells that the row is complete for mask set s,
        # so a value is shuffled once however many sets it is ranked in.
        sets = list(dict.fromkeys(sg for _, sg in keys))
        entries = []
        for i, c in enumerate(cols):
            bits = F.lit(0)
            for s, sg in enumerate(sets):
                if (c, sg) in keys:
                    ok = F.lit(True)
                    for other in sg:
                        ok = ok & F.col(other).isNotNull()
                    bits = bits + F.when(ok, 1 << s).otherwise(0)
            entries.append(F.when(F.col(c).isNotNull() & (bits > 0),
                                  F.struct(F.lit(i).alias("_k"), F.col(c).alias("_v"), bits.alias("_o"))))
        long = rid.select("_rid", F.explode(F.array(*entries)).alias("_e")).filter(
            F.col("_e").isNotNull()).select("_rid", "_e._k", "_e._v", "_e._o")

        def within(s):
            return F.col("_o").bitwiseAND(1 << s) != 0
        counts = [f"_n{s}" for s in range(len(sets))]
        distinct = long.groupBy("_k", "_v").agg(*[F.count_if(within(s)).alias(n) for s, n in enumerate(counts)])
        run = running_totals(distinct, ["_k"], ["_v"], counts, prefix="_below_")
        ranks = run.select("_k", "_v", *[(F.col(f"_below_{n}") + (F.col(n) + 1) / 2).alias(f"_q{s}")
                                         for s, n in enumerate(counts)])
        # Dealt by row before the sums: those of a task would be a wide row for each value.
        ranked = long.join(ranks, ["_k", "_v"]).drop("_v").repartition("_rid")
        wide = ranked.groupBy("_rid").agg(
            *[F.max(F.when((F.col("_k") == cols.index(c)) & within(sets.index(sg)), F.col(f"_q{sets.index(sg)}")))
              .alias(f"_r{k}") for (c, sg), k in keys.items()])
        one = wide.agg(*[_safe_corr(f"_r{keys[(a, sig(a, b))]}", f"_r{keys[(b, sig(a, b))]}")
                         .alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    half = one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])))
    mirror = half.filter(F.col("col_a") != F.col("col_b")).select(
        F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr")
    return half.unionByName(mirror)


def category_frequency(df: DataFrame, cols, top_n: int = 15) -> DataFrame:
    """Top-N value counts for each category column (ties by value)."""
    return topn_per_group(value_counts(df, cols), ["column_name"],
                          [F.desc("n"), F.asc("value")], top_n)


def annual_series(df: DataFrame, year: str = "Anio", by: str | None = None, scale: float = 1e6) -> DataFrame:
    """Per year (and optionally per ``by``): sown, harvested and lost totals / scale."""
    keys = [year] + ([by] if by else [])
    base = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return base.groupBy(*keys).agg(
        *[(F.coalesce(F.sum(c), F.lit(0.0)) / scale).alias(f"{c.lower()}_m")
          for c in ("Sembrada", "Cosechada", "Siniestrada")])


def top_states_loss(df: DataFrame, n: int = 15, state: str = "Nomestado",
                    scale: float = 1e6) -> DataFrame:
    """Lost area per state, top n (ties by name), in millions."""
    agg = (df.filter(F.col(state).isNotNull()).groupBy(state)
           .agg((F.coalesce(F.sum("Siniestrada"), F.lit(0.0)) / scale).alias("siniestrada_m")))
    return agg.orderBy(F.desc("siniestrada_m"), F.asc(state)).limit(n)


def top_states_harvested(df: DataFrame, n: int = 10, state: str = "Nomestado",
                         mode: str = "Nommodalidad", modes=("Riego", "Temporal")) -> DataFrame:
    """D16 (with C3): top-n states by harvested area, left-joined to their per-mode
    breakdown; both mode columns always present, missing -> 0."""
    from riskloom.operators.joins import total_with_breakdown_join
    base = df.filter(F.col(state).isNotNull())
    totals = base.groupBy(state).agg(F.coalesce(F.sum("Cosechada"), F.lit(0.0)).alias("total"))
    top = totals.orderBy(F.desc("total"), F.asc(state)).limit(n)
    return total_with_breakdown_join(top, base, state, mode, "Cosechada", list(modes))


def top_crops_by_state(df: DataFrame, s: int = 5, c: int = 5, state: str = "Nomestado",
                       crop: str = "Nomcultivo") -> DataFrame:
    """Record counts for the top-s states x top-c crops (both ranked on the full
    table), every cell of the two lists present (missing -> 0). The counts table has one row
    per state and crop at most; the lists have s and c rows."""
    from riskloom.operators.joins import dense_grid
    counts = df.groupBy(state, crop).agg(F.count(F.lit(1)).alias("n"))

    def top(key: str, k: int) -> DataFrame:
        return (counts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("_n"))
                .orderBy(F.desc("_n"), F.asc(key)).limit(k).select(key))
    return dense_grid(counts, top(state, s), top(crop, c), "n")


def state_class_share(df: DataFrame, n: int = 20, state: str = "Nomestado", cls: str = "target") -> DataFrame:
    """For the n states with most records, % of records in each class (row-normalised,
    2 decimals); all five classes are columns."""
    from riskloom.operators.joins import topn_semi_join
    base = topn_semi_join(df.filter(F.col(state).isNotNull()), state, n)
    wide = base.groupBy(state).pivot(cls, list(range(5))).agg(F.count(F.lit(1)))
    wide = wide.fillna(0)
    total = reduce(lambda a, b: a + b, [F.col(str(k)) for k in range(5)])
    return wide.select(state, *[_pct(F.col(str(k)), total).alias(f"pct_clase_{k}") for k in range(5)])


def share_zero_history(df: DataFrame, col: str = "hist_mean") -> DataFrame:
    """Rows whose prior-history mean is 0, and min / max / mean of it."""
    return df.agg(F.count_if(F.col(col) == 0).alias("n_zero"),
                  _pct(F.count_if(F.col(col) == 0), F.count(F.lit(1))).alias("pct_zero"),
                  F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))
