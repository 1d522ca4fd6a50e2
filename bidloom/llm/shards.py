"""Shards that each hold the mixture: proportional stratified interleaving.

Rows are shuffled inside their source by a seeded hash and ranked; a row's
fraction is (rank - 1/2) / rows of its source. Sorting all rows by fraction
interleaves the sources in proportion, and equal cuts of that order give shards
with equal counts and the same mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.operators.ordering import row_positions
from bidloom.operators.scalars import scalars
from bidloom.sources.staging import stage_table

LAW = "rows"


def interleave(
    docs: DataFrame,
    n_shards: int = 16,
    seed: str = "shards-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The shard and slot of every row.

    Returns the id, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``
    (unsigned), ``source``, ``law``, ``shard`` (from 0), ``slot`` (gapless from
    0 in its shard) and ``grown_shard`` (null: under this law a further shard
    moves rows between the others).

    Shard counts differ by at most one, and a source's share in a shard differs
    from its share of all rows by about one row. A null source is a source of
    its own; a null text has no bytes. The order is total by (hash, id, crc,
    size); rows equal in all of these are interchangeable, so repeated rows get
    slots of their own. Fewer rows than shards leave the last shards empty, an
    empty table gives no rows. Other columns are not read.

    A source that holds a third of all rows is ranked over many range
    partitions, not in one window; only narrow rows move.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col(source_col).cast("string").alias("source"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("_hash"),
    )
    staged = stage_table(narrow, "shard-rows")
    order = [F.col(c) for c in ("_hash", "_id", "text_crc32", "size")]
    ranked = row_positions(staged, order, "_rank", keys=["source"])
    counts = staged.groupBy("source").agg(F.count("*").alias("_in_source"))
    # one row per source: joined, not broadcast by hint
    same = F.col("r.source").eqNullSafe(F.col("c.source"))
    shared = ranked.alias("r").join(counts.alias("c"), same).select("r.*", "c._in_source")
    fraction = (F.col("_rank") - F.lit(0.5)) / F.col("_in_source")
    placed = row_positions(
        stage_table(shared.withColumn("_fraction", fraction), "shard-fractions"),
        [F.col("_fraction"), F.col("source"), F.col("_rank")],
        "_position",
    )
    total = scalars(staged.agg(F.count("*").alias("n")))["n"]
    numbered = placed.select("*", (F.col("_position") - 1).alias("_zero"), total.alias("_total"))
    sharded = numbered.withColumn("_shard", F.expr(f"(_zero * {int(n_shards)}) div _total"))
    # a shard starts at the first position whose share of the total reaches its number
    start = F.expr(f"(_shard * _total + {int(n_shards) - 1}) div {int(n_shards)}")
    return sharded.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        "source",
        F.lit(LAW).alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_zero") - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
