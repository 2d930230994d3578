"""Registry of named queries: one per operator of the inventory, each a function
(spark, sf_dir) -> DataFrame over the driver tables, with its oracle SQL when the
operator can be stated in SQL."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators.util import normalize_types, round_doubles


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    digits: int | None


QUERIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, digits: int | None = 6):
    """Register ``fn`` under ``name``. The result is normalised (integral -> bigint,
    decimal -> double) and doubles are rounded to ``digits`` (None: untouched)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = normalize_types(fn(spark, sf_dir))
            return round_doubles(df, digits) if digits is not None else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = Entry(name, run, sql, digits)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # Importing the plan modules fills the registry.
    from riskloom.plans import (q_checks, q_classify, q_climate, q_cluster, q_clean,  # noqa: F401
                                q_features, q_files, q_metrics, q_profile, q_sets)
    return QUERIES
