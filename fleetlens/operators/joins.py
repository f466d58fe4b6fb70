"""Joins in which a null key meets a null key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a and what b has besides the keys; equal keys meet, nulls too. Still an equi-join."""
    b = b.select(*(F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in b.columns))
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"_{k}"])
    return a.join(b, cond, how).drop(*(f"_{k}" for k in keys))
