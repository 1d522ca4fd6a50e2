"""Mixing sources to target weights: whole copies plus one seeded coin per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.rows import free_names
from bidloom.operators.ordering import row_positions
from bidloom.sources.staging import stage_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0

_BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of runs without blanks (space, tab to carriage return); 0 for null."""
    blank = F.translate(F.coalesce(text, F.lit("")), _BLANKS, " " * len(_BLANKS))
    return F.size(F.array_remove(F.split(blank, " +"), "")).cast("long")


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    ``sizes`` has ``source`` and ``source_size``. Sources in code point order,
    null last, take ``weights`` in turn and share ``share`` times all sizes in
    proportion; a target above ``most`` times its source's size stops there,
    and what it leaves goes to the others by weight until none is above. Each
    round is one aggregate over this table; a round stops at least one more
    source, and the common case needs two or three.
    """
    count = len(weights)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_nth") - 1) % count + 1).cast("int"))
    ordered = row_positions(sizes, [F.col("source").isNull(), F.col("source")], "_nth")
    table = stage_table(ordered.withColumn("_weight", turn), "mixture-sources")
    cap = F.col("source_size") * F.lit(float(most))
    left = F.lit(0.0)
    level, stopped = None, -1
    while True:
        # a source has stopped when its share of the level before reached its cap
        at_cap = F.lit(False) if level is None else F.col("_weight") * F.lit(level) >= cap
        sums = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(at_cap, cap).otherwise(left)).alias("full"),
            F.sum(F.when(at_cap, left).otherwise(F.col("_weight"))).alias("open"),
            F.count_if(at_cap).alias("n"),
        ).first()
        if sums["all"] is None or sums["n"] == stopped or not sums["open"]:
            break
        stopped = sums["n"]
        level = max(level or 0.0, (share * sums["all"] - sums["full"]) / sums["open"])
    target = F.least(F.col("_weight") * F.lit(level or 0.0), cap)
    if level is not None and not sums["open"]:
        target = cap
    return table.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = "mixture-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix takes every document.

    Returns the id, ``source``, ``size`` (words), ``source_size``, ``target``,
    ``rate`` (target over source size), ``copies`` and ``taken`` (copies times
    size). A document gets floor(rate) copies and one more where its seeded
    hash falls below the fraction, so reruns and other partitionings agree. No
    document is taken more than ``most`` (rounded up) times.

    A null text has no words. A null source is a source of its own. A source
    without words has target and rate 0. Rows that repeat an id toss the same
    coin. A null id tosses the coin of the text ``null``. An empty table gives
    no rows. Other columns are not read.
    """
    rows = stage_table(
        docs.select(
            F.col(id_col).cast("long").alias("_id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(F.col(text_col)).alias("size"),
        ),
        "mixture-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = stage_table(targets(sizes, weights, share, most), "mixture-targets")
    rate, copies = _taken(F.col("_id"), F.col("target"), F.col("source_size"), seed)
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    return (
        rows.alias("d")
        .join(table.alias("s"), same, "left")
        .select("d._id", "d.source", "d.size", "s.source_size", "s.target")
        .withColumn("rate", rate)
        .withColumn("copies", copies)
        .select(
            F.col("_id").alias(id_col),
            "source",
            "size",
            "source_size",
            "target",
            "rate",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def _taken(own_id: Column, target: Column, source_size: Column, seed: str) -> tuple[Column, Column]:
    """Rate and copies of a row."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(own_id.cast("string"), F.lit("null"))))
    coin = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    rate = F.coalesce(F.try_divide(target, source_size), F.lit(0.0))
    return rate, (F.floor(rate) + (coin < rate - F.floor(rate)).cast("long")).cast("long")


def emit(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = "mixture-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of the mix: every row as often as it is taken, all columns kept.

    Copies are counted on the row itself, as ``mix`` counts them: rows that
    repeat an id and rows with a null id are each taken by their own number.
    """
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    of, target, size, times = free_names(docs.columns, "source", "target", "size", "times")
    table = stage_table(targets(sizes, weights, share, most), "mixture-targets").select(
        F.col("source").alias(of), F.col("target").alias(target), F.col("source_size").alias(size)
    )
    _, copies = _taken(F.col(id_col).cast("long"), F.col(target), F.col(size), seed)
    joined = docs.join(table, F.col(source_col).cast("string").eqNullSafe(F.col(of)))
    taken = joined.withColumn(times, copies).where(F.col(times) > 0)
    each = F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))
    return taken.withColumn(times, each).select(*[F.col(f"`{c}`") for c in docs.columns])
