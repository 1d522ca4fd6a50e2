"""Global and per-group row order without a single-task window.

Rows are laid out in ranges; numbering happens inside a range, and a table with
one row per range (or per group and range) carries the offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.sources.staging import PARTITION_ID, range_layout

_OFFSET = "_offset"
_ONE_GROUP = "_all_ranges"


def row_positions(df: DataFrame, order: list, out: str = "position", keys: list[str] | None = None) -> DataFrame:
    """1-based position of each row in ``order``, overall or within ``keys``."""
    keys = keys or []
    laid = range_layout(df, [*map(F.col, keys), *order], "positions")
    part = [*keys, PARTITION_ID]
    sizes = laid.groupBy(*part).agg(F.count("*").alias("_rows"))
    before = (
        Window.partitionBy(*(keys or [F.lit(_ONE_GROUP)]))
        .orderBy(PARTITION_ID)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(*part, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(_OFFSET))
    if not keys:
        # one row per range: the size is bounded by the number of partitions
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*part).orderBy(*order)
    # a null key is a group of its own, hence the null-safe match
    same = [F.col(f"laid.{c}").eqNullSafe(F.col(f"start.{c}")) for c in part]
    joined = laid.alias("laid").join(offsets.alias("start"), same, "inner").select("laid.*", f"start.{_OFFSET}")
    return joined.withColumn(out, F.col(_OFFSET) + F.row_number().over(inside)).drop(_OFFSET, PARTITION_ID)


def previous_value(
    df: DataFrame, value: str, order: list, out: str = "previous", keys: list[str] | None = None
) -> DataFrame:
    """Value of the row just before, in ``order`` over the whole table or within ``keys``.

    Rows are laid out in ranges of (keys, order), so a key that holds a third of
    all rows is spread over many. What crosses a border is the last (keys, value)
    of each range; it is passed on only while the key lasts. A null key is a key.
    """
    keys = keys or []
    laid = range_layout(df, [*map(F.col, keys), *order], "previous")
    inside = Window.partitionBy(PARTITION_ID).orderBy(*keys, *order)
    before = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(value).alias("value"))
    # the last row of each range, found with a partial aggregate
    marked = laid.withColumn("_rank", F.row_number().over(inside)).withColumn("_lag", F.lag(before).over(inside))
    last = marked.groupBy(PARTITION_ID).agg(F.max_by(before, "_rank").alias("_tail"))
    by_range = Window.partitionBy(F.lit(_ONE_GROUP)).orderBy(PARTITION_ID)
    carry = last.select(PARTITION_ID, F.lag("_tail").over(by_range).alias("_carry"))
    # one row per range: the size is bounded by the number of partitions
    met = marked.join(F.broadcast(carry), PARTITION_ID).withColumn(
        "_before", F.when(F.col("_rank") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    )
    found = F.col("_before.value")
    for i, c in enumerate(keys):
        found = F.when(F.col(f"_before.k{i}").eqNullSafe(F.col(c)), found)
    return met.withColumn(out, found).drop("_rank", "_lag", "_carry", "_before", PARTITION_ID)
