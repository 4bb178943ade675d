"""Joins of many rows with one row a group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast holds at most.
BROADCAST_GROUPS = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``groups`` (a written table, one row a ``key`` (one column or several), none null).

    ``size`` counts the rows of a group. Groups of more than 1 / ``BROADCAST_GROUPS`` of all
    grouped rows are fewer than ``BROADCAST_GROUPS``, so they can be broadcast whatever the
    input; the rows of the other groups meet in a shuffle in which no key has more than that share.
    """
    count, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    least = 0 if count <= BROADCAST_GROUPS else total // BROADCAST_GROUPS
    own = [c for c in groups.columns if c != size]
    hot = F.broadcast(groups.where(F.col(size) > least).select(*own))
    if not least:
        return rows.join(hot, key, how)
    cold = groups.where(F.col(size) <= least).select(*own)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key, how))
