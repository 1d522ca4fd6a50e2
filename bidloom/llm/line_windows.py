"""Line dedup: repeated windows of three consecutive lines, later occurrences removed.

Native throughout: hashing, search and removal are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.rows import numbered
from bidloom.sources.staging import stage_table

WIDTH = 3

_PLACE = "decimal(38,0)"
_SPAN = 10**12


def _window_hashes(lines: Column, width: int) -> Column:
    """Two independent 64-bit hashes of each run of ``width`` lines, with its place."""
    run = lambda i: F.slice(lines, i + 1, F.lit(width))
    return F.when(
        F.size(lines) >= width,
        F.transform(
            F.sequence(F.lit(0), F.size(lines) - width),
            lambda i: F.struct(
                i.alias("at"), F.xxhash64(run(i)).alias("h1"), F.xxhash64(F.lit("second"), run(i)).alias("h2")
            ),
        ),
    )


def drop_repeated_lines(
    docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document with its later occurrences of repeated line windows removed.

    Lines are the text split at ``\\n``; all lines count, blank ones too. A
    window is ``width`` consecutive lines. Windows with equal lines are one
    passage; its first occurrence in (id, line) order stays, and the lines that
    any later occurrence covers go, overlapping ones once. What goes is judged
    on the input, not on what is left.

    Returns the id, ``n_lines`` and ``n_removed`` (long), ``n_spans`` (long,
    maximal runs of removed lines) and ``kept_text``. A null text has no lines
    and stays null; an empty text is one empty line; a text with fewer lines
    than ``width`` loses nothing. Rows are told apart by a number of their own:
    of rows that repeat an id, a passage at the same line of several stays in all
    of them. A null id is larger than any other, so its lines are the later ones.
    An empty table gives no rows. Other columns are not read.
    """
    rows, row = numbered(docs)
    own = rows.select(
        F.col(row).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")
    )
    lines = own.select("_row", "_id", F.split("_text", "\n").alias("_lines"))
    windows = (
        lines.select("_row", "_id", F.explode(_window_hashes(F.col("_lines"), width)).alias("_w"))
        .select("_row", "_id", "_w.at", "_w.h1", "_w.h2")
    )
    # (id, line) as one number: the smallest place is then a hash aggregate
    by_id = F.coalesce(F.col("_id").cast(_PLACE) + F.lit(str(2**63)).cast(_PLACE), F.lit(str(2**64)).cast(_PLACE))
    place = (by_id.cast(_PLACE) * F.lit(str(_SPAN)).cast(_PLACE) + F.col("at").cast(_PLACE)).cast(_PLACE)
    repeated = stage_table(
        windows.withColumn("_place", place)
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
        .where("_n > 1")
        .select("h1", "h2", "_first"),
        "line-windows",
    )
    later = (
        windows.withColumn("_place", place)
        .join(repeated, ["h1", "h2"])
        .where(F.col("_place") > F.col("_first"))
    )
    starts = later.groupBy("_row").agg(F.array_sort(F.collect_set("at")).alias("_starts"))
    marked = own.join(starts, "_row", "left").select(
        "_id",
        F.split("_text", "\n").alias("_lines"),
        F.coalesce("_starts", F.array().cast("array<int>")).alias("_starts"),
    )
    # a run begins where the window before ended earlier, and ends where the next one begins later
    opens = F.filter("_starts", lambda s, k: (k == 0) | (s > F.get("_starts", k - 1) + width))
    closes = F.filter("_starts", lambda s, k: F.coalesce(F.get("_starts", k + 1) > s + width, F.lit(True)))
    runs = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("a"), (b + width).alias("b")))
    merged = marked.select("_id", "_lines", F.when(F.size("_starts") > 0, runs).alias("_runs"))
    gone = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    # what stays lies between the runs: one slice for each gap
    between = F.transform(
        F.sequence(F.lit(0), F.size("_runs")),
        lambda k: F.slice(
            F.col("_lines"),
            F.when(k == 0, F.lit(0)).otherwise(F.get("_runs", k - 1)["b"]) + 1,
            F.when(k == F.size("_runs"), F.size("_lines")).otherwise(F.get("_runs", k)["a"])
            - F.when(k == 0, F.lit(0)).otherwise(F.get("_runs", k - 1)["b"]),
        ),
    )
    return merged.select(
        F.col("_id").alias(id_col),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_runs").isNull(), F.lit(0)).otherwise(F.size("_runs")).cast("long").alias("n_spans"),
        F.when(F.col("_runs").isNull(), F.concat_ws("\n", "_lines"))
        .otherwise(F.concat_ws("\n", F.flatten(between)))
        .alias("_kept"),
        F.col("_lines").isNull().alias("_none"),
    ).select(
        id_col,
        F.when(F.col("_none"), F.lit(0)).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        "n_removed",
        "n_spans",
        F.when(~F.col("_none"), F.col("_kept")).alias("kept_text"),
    )
