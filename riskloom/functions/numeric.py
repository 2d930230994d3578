"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(col: Column, digits: int) -> Column:
    """Round to ``digits`` decimals as round(x * 10^d) / 10^d: the rounding happens on an
    integer, where every engine agrees (half away from zero on the binary value)."""
    scale = float(10 ** digits)
    return F.round(col * F.lit(scale)) / F.lit(scale)


def round_to_sql(expr: str, digits: int) -> str:
    return f"(round(({expr}) * CAST({10 ** digits} AS DOUBLE)) / CAST({10 ** digits} AS DOUBLE))"
