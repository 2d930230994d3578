"""Exact quantiles without gathering a group's values in one task.

``F.percentile`` keeps every distinct value of a group in one aggregation buffer, and
the final merge of a global percentile runs in a single task -- a continuous measure over
100 TB would not fit. Here ties are collapsed first (``groupBy(value).count()``), the
cumulative counts come from the range-partitioned running sums, and only the rows whose
count block covers the two positions around (n - 1) * p are kept. The result is the
linear-interpolation quantile (pandas / SQL ``quantile_cont``):
lo * (1 - d) + hi * d with d = pos - floor(pos).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.windows import running_totals


def exact_quantiles(df: DataFrame, value: str, probs, part=(), n_ranges: int | None = None) -> DataFrame:
    """One row per (part..., prob): ``prob``, ``q`` (NULL when the group has no values) and
    ``n`` (non-null values in the group)."""
    part = list(part)
    d = (df.filter(F.col(value).isNotNull())
         .groupBy(*part, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    run = running_totals(d, part, ["_v"], ["_c"], n_ranges=n_ranges, include_current=True,
                         prefix="_cum")
    tot = d.groupBy(*part).agg(F.sum("_c").alias("n"))
    x = run.join(tot, part) if part else run.crossJoin(tot)  # no part: tot is one row
    x = x.select(*part, "_v", "n", (F.col("_cum_c") - F.col("_c")).alias("_first"),
                 F.col("_cum_c").alias("_end"),
                 F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    pos = (F.col("n") - 1) * F.col("prob")
    lo, hi = F.floor(pos), F.ceil(pos)

    def covers(i):
        return (F.col("_first") <= i) & (i < F.col("_end"))

    x = x.filter(covers(lo) | covers(hi)).select(
        *part, "prob", "n", pos.alias("_pos"), lo.alias("_lo"),
        F.when(covers(lo), F.col("_v")).alias("_vlo"), F.when(covers(hi), F.col("_v")).alias("_vhi"))
    g = x.groupBy(*part, "prob", "n", "_pos", "_lo").agg(F.max("_vlo").alias("_a"), F.max("_vhi").alias("_b"))
    frac = F.col("_pos") - F.col("_lo")
    q = F.when(frac == 0, F.col("_a")).otherwise(F.col("_a") * (1 - frac) + F.col("_b") * frac)
    return g.select(*part, "prob", "n", q.alias("q"))


def column_quantiles(df: DataFrame, cols, probs, name: str = "column_name") -> DataFrame:
    """Exact quantiles of several columns in one job: (column_name, prob, n, q)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("_x")) for c in cols])).alias("_kv")
    ).select("_kv.*")
    return exact_quantiles(long, "_x", probs, [name])


def wide_quantiles(df: DataFrame, cols, probs, prefix: str = "_q") -> DataFrame:
    """One row with ``{prefix}{i}_{j}`` = quantile probs[j] of cols[i] (for cross joins of
    a single row of statistics)."""
    q = column_quantiles(df, cols, probs)
    return q.groupBy().agg(*[
        F.max(F.when((F.col("column_name") == c) & (F.col("prob") == float(p)), F.col("q")))
        .alias(f"{prefix}{i}_{j}") for i, c in enumerate(cols) for j, p in enumerate(probs)])
