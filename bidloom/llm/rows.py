"""A number for every row, so that verdicts meet rows and not ids that repeat or are null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.operators.ordering import row_positions
from bidloom.sources.staging import stage_table


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that no column of a table has, whatever their case."""
    lowered = {c.lower() for c in taken}
    mark = "_own"
    while any(f"{mark}_{w}".lower() in lowered for w in wanted):
        mark += "_"
    return [f"{mark}_{w}" for w in wanted]


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number (long) of their own, and the column it is in.

    Rows that come straight from Parquet files are numbered by file and place in
    it: nothing is written, and a task that runs again finds the same numbers.
    Other rows are written with a number.
    """
    file, place, row = free_names(docs.columns, "file", "place", "row")
    own = [F.col(f"`{c}`") for c in docs.columns]
    try:
        located = docs.withColumns({file: F.col("_metadata.file_path"), place: F.col("_metadata.row_index")})
    except AnalysisException:
        return stage_table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows"), row
    # one row for each file; its places must be those of one reading of the whole file, each once
    at = F.col(place).cast("decimal(38,0)")
    n = F.col("n").cast("decimal(38,0)")
    each = located.groupBy(file).agg(
        F.count("*").alias("n"), F.max(place).alias("last"), F.sum(at).alias("sum"), F.sum(F.col(place) * at).alias("squares")
    )
    once = (F.col("last") == F.col("n") - 1) & (2 * F.col("sum") == n * (n - 1)) & (6 * F.col("squares") == n * (n - 1) * (2 * n - 1))
    files = stage_table(row_positions(each.select(file, once.alias("once")), [F.col(file)], row), "numbered-files")
    if not files.agg(F.bool_and("once")).first()[0]:
        # the columns are those of a table joined to the rows, or some rows are left out or repeated
        return stage_table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows"), row
    number = F.shiftleft(F.col(row).cast("bigint"), 40) + F.col(place)
    return located.join(files.select(file, row), file).select(*own, number.alias(row)), row
