"""Joins with a table that has one row per key and knows how many rows each key meets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold at least one part in so many of all rows are broadcast; there are at most so many of them.
HOT_PARTS = 8192


def join_counted(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, parts: int = HOT_PARTS) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose ``keys`` are unique and not null and whose ``count`` tells the rows of ``left`` with them.

    A hot key's rows never meet in one task: the keys that hold at least one
    part in ``parts`` of all rows, at most ``parts`` rows of ``right``, go to
    every executor, and only the others are shuffled, none of which is large.
    Counts may be too high or too low: the result is the same, only its balance
    is not. Both tables are read twice, so pass written ones. Rows of ``left``
    with a null key or one that ``right`` has not are left out.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    is_hot = F.coalesce(F.col(count) * F.lit(parts) >= F.lit(total), F.lit(False))
    hot, cold = right.where(is_hot), right.where(~is_hot)
    found = left.join(F.broadcast(hot), list(keys))
    rest = left.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(cold, list(keys))
    return found.unionByName(rest)
