"""Unfolding arrays that are costly to compute."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, keep: list, array: Column | str, name: str, pos: str | None = None) -> DataFrame:
    """``keep`` and one row per element of ``array``.

    A plain explode lets the optimizer infer a filter on the array's size and push it to the
    scan, which computes the array twice, and before any repartitioning. The outer form does
    not; the row it leaves for an empty array is dropped here.
    """
    parts = F.explode_outer(array).alias(name) if pos is None else F.posexplode_outer(array).alias(pos, name)
    return df.select(*keep, parts).filter(F.col(name).isNotNull())
