"""Feature transforms and label helpers.

Encoders are fitted as small DataFrames (one row per category) and applied with a join
(C6); nothing goes through the driver. Dense codes over a category list use the
distributed running count, so a list of a billion municipalities is not ranked in one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.joins import map_lookup_join
from riskloom.operators.util import key_hash
from riskloom.operators.windows import running_totals


def dense_codes(values: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Codes 0..n-1 for the distinct non-NULL values of ``col`` in sorted value order."""
    distinct = values.select(col).filter(F.col(col).isNotNull()).distinct().withColumn("_one", F.lit(1))
    run = running_totals(distinct, [], [col], ["_one"], prefix="_before_")
    return run.select(col, F.col("_before__one").cast("int").alias(out))


def label_encode(df: DataFrame, cols, suffix: str = "_encoded") -> DataFrame:
    """Dense codes in sorted value order, fitted on ``df`` itself."""
    for c in cols:
        df = map_lookup_join(df, dense_codes(df, c), c, "code", None, f"{c}{suffix}")
    return df


def ordinal_encode(train: DataFrame, df: DataFrame, cols, suffix: str = "_ord",
                   unknown: int = -1) -> DataFrame:
    """Codes fitted on ``train`` only; values unseen in train get ``unknown``."""
    for c in cols:
        df = map_lookup_join(df, dense_codes(train, c), c, "code", unknown, f"{c}{suffix}")
    return df


def target_encoder(train: DataFrame, col: str, y: str, m: float = 100.0) -> DataFrame:
    """I3 (fit): per category (sum_y + global_mean * m) / (n + m) from ``train`` only."""
    glob = train.agg(F.avg(y).alias("_g"))  # one row
    per = train.filter(F.col(col).isNotNull()).groupBy(col).agg(
        F.sum(y).alias("_s"), F.count(y).alias("_n"))
    return per.crossJoin(F.broadcast(glob)).select(  # glob: the one-row global mean
        col, ((F.col("_s") + F.col("_g") * m) / (F.col("_n") + m)).alias("te"), "_g")


def target_encode(train: DataFrame, df: DataFrame, cols, y: str, m: float = 100.0,
                  suffix: str = "_te") -> DataFrame:
    """I3 (apply): smoothed target mean per category; unseen categories get the global
    train mean."""
    glob = train.agg(F.avg(y).alias("_glob"))  # one row
    for c in cols:
        enc = target_encoder(train, c, y, m).drop("_g")
        df = df.join(enc, c, "left").withColumnRenamed("te", f"_{c}_te")
    df = df.crossJoin(F.broadcast(glob))  # one-row global mean attached to every row
    df = df.withColumns({f"{c}{suffix}": F.coalesce(F.col(f"_{c}_te"), F.col("_glob")) for c in cols})
    return df.drop("_glob", *[f"_{c}_te" for c in cols])


def scaler_stats(df: DataFrame, cols, kind: str = "standard") -> DataFrame:
    """One-row table of centre/scale per column: population mean/std ('standard') or
    median/IQR ('robust'). Any other kind is an error."""
    if kind == "standard":
        aggs = [a for c in cols for a in (F.avg(c).alias(f"_c_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
        return df.agg(*aggs)
    if kind == "robust":
        from riskloom.operators.quantiles import wide_quantiles
        q = wide_quantiles(df, cols, [0.25, 0.5, 0.75])  # exact, distributed; one row
        return q.select(*[a for i, c in enumerate(cols) for a in (
            F.col(f"_q{i}_1").alias(f"_c_{c}"),
            (F.col(f"_q{i}_2") - F.col(f"_q{i}_0")).alias(f"_s_{c}"))])
    raise ValueError(f"unknown scaler: {kind!r} (use 'standard' or 'robust')")


def apply_scaler(df: DataFrame, stats: DataFrame, cols, suffix: str = "") -> DataFrame:
    """(x - centre) / scale with a one-row stats table (broadcast); scale 0 -> NULL
    becomes 0, as a constant column carries no information."""
    j = df.crossJoin(F.broadcast(stats))  # one-row scaler statistics
    j = j.withColumns({f"{c}{suffix}": F.coalesce(
        F.try_divide(F.col(c) - F.col(f"_c_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))),
        F.lit(0.0)) for c in cols})
    return j.drop(*[f"_c_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def standard_scale(df: DataFrame, cols, suffix: str = "") -> DataFrame:
    """I4: z-score with the population std."""
    return apply_scaler(df, scaler_stats(df, cols, "standard"), cols, suffix)


def robust_scale(df: DataFrame, cols, suffix: str = "") -> DataFrame:
    """(x - median) / IQR, exact percentiles."""
    return apply_scaler(df, scaler_stats(df, cols, "robust"), cols, suffix)


def one_hot_label(df: DataFrame, y: str = "target", k: int = 5, prefix: str = "y_") -> DataFrame:
    """K indicator columns for the class label."""
    return df.withColumns({f"{prefix}{i}": (F.col(y) == i).cast("int") for i in range(k)})


def class_weights(df: DataFrame, y: str = "target") -> DataFrame:
    """N / (K * n_k) over the K classes present; one row per class."""
    counts = df.filter(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n_k"))
    tot = Window.partitionBy()  # one row per class: at most a handful
    return counts.select(y, "n_k", (F.sum("n_k").over(tot).cast("double")
                                    / (F.count(F.lit(1)).over(tot) * F.col("n_k"))).alias("weight"))


def with_class_weight(df: DataFrame, y: str = "target", out: str = "weight",
                      fit_on: DataFrame | None = None) -> DataFrame:
    """D25 + C6: the class weight attached to every row (the class table is tiny). Weights
    come from ``fit_on`` (the training rows) if given; a class absent there weighs 0."""
    w = class_weights(df if fit_on is None else fit_on, y)
    return map_lookup_join(df, F.broadcast(w), y, "weight", 0.0, out)


def positive_weight(df: DataFrame, positive) -> DataFrame:
    """Negatives / positives for a binary condition."""
    return df.agg(F.count_if(~positive).alias("negatives"), F.count_if(positive).alias("positives")
                  ).withColumn("weight", F.try_divide(F.col("negatives").cast("double"),
                                                      F.col("positives")))


def stratified_folds(df: DataFrame, y: str, n: int, seed: int = 42, key: str = "record_id",
                     out: str = "fold", n_ranges: int | None = None) -> DataFrame:
    """Folds balanced per class (fold sizes within a class differ by at most one).

    Rows of each class are dealt round-robin in a seeded pseudo-random order (hash, key):
    fold = (position within the class) mod n. The position is a distributed running count
    (range-partitioned on (class, hash, key)), so the majority class is cut into as many
    ranges as there are shuffle partitions instead of being numbered in one task."""
    d = df.withColumn("_h", key_hash(F.col(key), seed)).withColumn("_one", F.lit(1))
    run = running_totals(d, [y], ["_h", key], ["_one"], n_ranges=n_ranges, prefix="_pos_")
    return run.withColumn(out, F.pmod(F.col("_pos_n"), F.lit(n)).cast("int")).drop(
        "_h", "_one", "_pos__one", "_pos_n")
