"""Sorts, limits, top-k and seeded sampling (F1-F7) and set operations.

``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: every task keeps its own top n
and only n rows per task reach the final merge, so a top-k never sorts the table.
Seeded samples order by a hash of the row key, which is reproducible under any
partitioning (unlike ``DataFrame.sample``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.util import HASH_M, key_hash


def top_k(df: DataFrame, order, n: int) -> DataFrame:
    """first n rows in ``order`` (give a tie-breaker for a deterministic result)."""
    return df.orderBy(*order).limit(n)


def multi_key_sort(df: DataFrame, keys) -> DataFrame:
    """a total sort on several keys with mixed directions (range-partitioned sort)."""
    return df.orderBy(*keys)


def seeded_sample(df: DataFrame, key: str, n: int | None = None, fraction: float | None = None,
                  seed: int = 42) -> DataFrame:
    """n rows (the n smallest seeded hashes) or a fraction (hash below a cut)."""
    h = key_hash(F.col(key), seed)
    if n is not None:
        return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")
    if fraction is None:
        raise ValueError("give n or fraction")
    return df.filter(h < F.lit(int(fraction * HASH_M)))


def best_row(df: DataFrame, score: str, tie: str, highest: bool = True) -> DataFrame:
    """the row with the best score; the smallest ``tie`` value wins ties."""
    return df.orderBy(F.desc(score) if highest else F.asc(score), F.asc(tie)).limit(1)


def first_match(df: DataFrame, cond: Column, key: str) -> DataFrame:
    """the first row (by key) that meets ``cond``."""
    return df.filter(cond).orderBy(key).limit(1)


def scatter_table(df: DataFrame, x: str, y: str, group: str, key: str, n: int = 50000,
                  seed: int = 42, log: bool = True) -> DataFrame:
    """seeded sample of two measures (log1p on both) with a group column."""
    s = seeded_sample(df, key, n=n, seed=seed)
    fx = F.log1p(x) if log else F.col(x)
    fy = F.log1p(y) if log else F.col(y)
    return s.select(key, group, fx.alias(f"log_{x}" if log else x), fy.alias(f"log_{y}" if log else y))


def union_years(dfs, renames: dict | None = None) -> DataFrame:
    """G1 / A2: rename drifting column names in each part, then union by name; a column
    missing in a part is NULL there."""
    parts = [d.withColumnsRenamed({k: v for k, v in (renames or {}).items() if k in d.columns})
             for d in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_train_val(train: DataFrame, val: DataFrame) -> DataFrame:
    """G2."""
    return train.unionByName(val)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (NULL equals NULL)."""
    return df.dropDuplicates()
