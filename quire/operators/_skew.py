"""Joins with a row a group, where a few groups may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most groups that are broadcast, and the fewest rows that such a group has.
MOST_HOT = 1 << 16
LEAST_HOT = 1000


def with_group(rows: DataFrame, per: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of their group's row in per (key, size, ...), inner; size is how many of the rows a group has.

    Groups of at least 1/65536 of all rows, 65536 at most, are broadcast; the rest, each a small share, is shuffled."""
    total = per.agg(F.sum(size)).first()[0] or 0
    bound = max(LEAST_HOT, -(-total // MOST_HOT))
    g = per.withColumnRenamed(key, "_g")
    same = F.col(key).eqNullSafe(F.col("_g"))
    hot, cold = F.broadcast(g.where(F.col(size) >= bound)), g.where(F.col(size) < bound)
    many = rows.join(hot, same).drop("_g")
    return many.unionByName(rows.join(hot, same, "left_anti").join(cold, same).drop("_g"))
