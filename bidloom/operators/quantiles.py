"""Exact, linearly interpolated quantiles that survive one huge group.

The values of each group are counted, the counts laid out in ranges over all
groups, and the ranks next to each requested position picked by a plain
aggregate. There is one way for every size: a group that holds a third of all
rows spreads over many ranges, and a small one costs a few counted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.operators.scalars import with_scalars
from bidloom.sources.staging import PARTITION_ID, range_layout, stage_table


def _picked(values: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    histogram = values.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    laid = range_layout(histogram, [*map(F.col, keys), F.col("_v")], "histogram")
    parts = laid.groupBy(*keys, PARTITION_ID).agg(F.sum("_n").alias("_part_n"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy(PARTITION_ID).rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and range
    parts = parts.select(
        *keys,
        PARTITION_ID,
        F.coalesce(F.sum("_part_n").over(before), F.lit(0)).alias("_below"),
        F.sum("_part_n").over(whole).alias("_total"),
    )
    inside = (
        Window.partitionBy(*keys, PARTITION_ID).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # numbered before the join, which then needs no sort of these rows of its own
    numbered = laid.withColumn("_inside", F.sum("_n").over(inside))
    ranked = numbered.join(parts, [*keys, PARTITION_ID]).withColumn("_upto", F.col("_below") + F.col("_inside"))

    def value_at(rank: Column) -> Column:
        covered = (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
        return F.max(F.when(covered, F.col("_v")))

    picks = []
    for name, p in probs.items():
        position = (F.col("_total") - 1) * F.lit(float(p))
        picks += [
            value_at(F.floor(position)).alias(f"_lo_{name}"),
            value_at(F.ceil(position)).alias(f"_hi_{name}"),
        ]
    found = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)

    def interpolate(name: str, p: float) -> Column:
        position = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return found.select(*keys, *[interpolate(name, p) for name, p in probs.items()])


def group_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: list[str] | None = None,
    also: list[Column] | None = None,
) -> DataFrame:
    """One row per group with a column per requested quantile.

    Nulls and NaN are ignored and rows with a null key belong to no group; a group
    without values has nulls. Without keys the result has one row, all null for an
    empty input. ``also`` are further aggregates of ``df``.
    """
    keys, also = keys or [], also or []
    number = F.col(value).cast("double")
    rows = df.withColumn("_v", F.when(~F.isnan(number), number))
    if keys:
        rows = rows.dropna(subset=keys)
    found = _picked(rows.where(F.col("_v").isNotNull()).select(*keys, "_v"), keys, probs)
    if not keys:
        return with_scalars(rows.agg(*also), stage_table(found, "quantiles")) if also else found
    # one row per group on both sides
    groups = rows.groupBy(*keys).agg(*also) if also else rows.select(*keys).distinct()
    others = [c for c in groups.columns if c not in keys]
    return groups.join(found, keys, "left").select(*keys, *probs, *others)
