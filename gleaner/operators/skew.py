"""Joins of rows with one value for each group, where a group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.history import fresh

#: A group with more than one of so many rows is frequent; there are fewer than this.
HOT = 64


def with_group(rows: DataFrame, values: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` with the other columns of ``values`` (a row for each value of ``key``, null too, and the number ``n`` of its rows; ``n`` goes).

    The values of frequent groups are few and are broadcast; the rows of all other groups are few for each key and are shuffled.
    ``rows`` is read twice and should be a stored table.
    """
    share = (values.agg(F.sum(n)).first()[0] or 0) // HOT
    other = fresh(rows, "key")
    own = values.withColumnRenamed(key, other)
    same = F.col(key).eqNullSafe(F.col(other))
    hot, rare = F.broadcast(own.where(F.col(n) > share).drop(n)), own.where(F.col(n) <= share).drop(n)
    often = rows.join(hot, same, "inner")
    return often.unionByName(rows.join(hot, same, "left_anti").join(rare, same, "inner")).drop(other)
