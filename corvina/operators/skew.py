"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if at least one row in so many has it; hence there are never more hot keys than this number.
MAX_HOT_KEYS = 200


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys (column ``key``) that more than one row in ``MAX_HOT_KEYS`` has, and more than one row."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    least = F.greatest(F.lit(1), F.floor(counts.agg(F.sum("_n")).scalar() / MAX_HOT_KEYS))
    return counts.where(F.col(key).isNotNull() & (F.col("_n") > least)).select(key)


def meet(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined ('inner' or 'left') with ``table``, which has one row per key, on the column ``key``.

    Hot keys meet their rows in a broadcast of at most ``MAX_HOT_KEYS`` rows, so no task gets the whole group; all others
    meet in a shuffle. ``rows`` is read three times and ``table`` twice, so both should be written tables.
    """
    hot = hot_keys(rows, key)
    known = F.broadcast(hot).join(table, key, how)
    near = rows.join(F.broadcast(known), key)
    far = rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how)
    return near.unionByName(far)
