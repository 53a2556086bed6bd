"""Joins on keys that may be missing: a missing key equals a missing key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, which come from ``left``; missing keys meet each other.

    It is an equi-join for the optimizer, so it is dealt by the keys, and a large key is split.
    """
    named = right.select(*(F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = left.join(named, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"__{k}" for k in keys))
