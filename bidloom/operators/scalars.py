"""Whole-table figures next to each row, as scalar subqueries.

A one-row aggregate becomes a subquery whose result is a constant in the scan's
projection: no join and no single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalars(stats: DataFrame, *names: str) -> dict[str, Column]:
    """Columns holding the values of a one-row DataFrame."""
    names = names or tuple(stats.columns)
    return {name: stats.select(name).scalar() for name in names}


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    carried = df.withColumn("_scalars", packed)
    return carried.select(*df.columns, *[F.col(f"_scalars.{c}").alias(c) for c in stats.columns])
