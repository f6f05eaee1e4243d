"""Help for hot join keys.

Adaptive execution splits a hot key of a sort-merge join when both sides come
straight from a shuffle on the join key. A side that was just aggregated by that
key does not: its rows already lie where the join wants them, so no shuffle is
added, and the other side's hot key would stay in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def splittable(per_key: DataFrame, *keys: str) -> DataFrame:
    """Give up the partitioning by ``keys``, so that the join adds a shuffle that can be split.

    Meant for results with one row per key; the extra shuffle moves only those.
    """
    return per_key.repartition(F.xxhash64(*keys))
