"""Relational operators that neither the DataFrame API nor SQL has under one name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions


def _same(left: DataFrame, right: DataFrame) -> Column:
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{len(left.columns)} and {len(right.columns)} columns")
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in zip(left.columns, right.columns)))


def bag_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left, repeated ones included, that right has too; nulls equal each other."""
    right = right.distinct()
    return left.join(right, _same(left, right), "left_semi")


def bag_except(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left, repeated ones included, that right lacks; nulls equal each other."""
    right = right.distinct()
    return left.join(right, _same(left, right), "left_anti")


def top_k(df: DataFrame, order: list[Column], k: int, by: list[str] | None = None) -> DataFrame:
    """The first k rows, or with by the first k of each group; Spark keeps k rows of each task before it shuffles."""
    if by is None:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def whole_partition(aggregate: Column, by: list[str]) -> Column:
    """An aggregate over all rows of the partition, whatever their order."""
    return aggregate.over(Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def nearest(df: DataFrame, vector: str, to: list[float], k: int, metric: str = "l2") -> DataFrame:
    """The k rows nearest to a vector, exactly, with their distance."""
    target = "array(" + ", ".join(f"cast({float(x)!r} as double)" for x in to) + ")"
    distance = functions.column("vector_distance", vector, target, f"'{metric}'", types=("vector", "vector", "text"))
    return df.withColumn("distance", distance).filter("distance IS NOT NULL").orderBy("distance").limit(k)
