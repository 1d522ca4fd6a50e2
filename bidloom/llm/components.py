"""Connected components by alternating star contraction, in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.sources.staging import stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) is connected with.

    Every round links each node's larger neighbours, then its smaller ones, to
    the smallest of them (two joins on aggregated minima), until the edges are
    stars; the number of rounds grows with the logarithm of the longest path.
    Edges and minima stay in tables; only one row of checks reaches the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()
    pairs = stage_table(pairs, "component-edges")
    before = None
    while True:
        both = pairs.select("v", "u").unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # large star: neighbours above a node point to the smallest around it
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its neighbours below point to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("v"), F.col("e.m").alias("u"))
            .where("v <> u")
            .distinct()
        )
        pairs = stage_table(small, "component-edges")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
