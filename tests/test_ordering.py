import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bidloom.operators.ordering import previous_value, row_positions


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    data = [
        (i, "hot" if i % 3 == 0 else f"k{i % 7}" if i % 11 else None, rng.randint(0, 5), rng.randint(0, 50))
        for i in range(4000)
    ]
    return spark.createDataFrame(data, "id long, key string, score int, number int").cache()


@pytest.mark.parametrize("parts", [1, 8])
def test_positions_equal_one_window(scored, parts):
    order = [F.desc("score"), F.col("id")]
    got = row_positions(scored.repartition(parts, "number"), order, "p")
    want = scored.withColumn("p", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert sorted(map(tuple, got.select("id", "p").collect())) == sorted(map(tuple, want.select("id", "p").collect()))


def test_positions_within_groups_and_null_group(scored):
    order = [F.col("score"), F.col("id")]
    got = row_positions(scored, order, "p", ["key"])
    want = scored.withColumn("p", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("long"))
    assert sorted(map(tuple, got.select("id", "p").collect())) == sorted(map(tuple, want.select("id", "p").collect()))


@pytest.mark.parametrize("parts", [1, 8])
def test_previous_value_crosses_range_borders(scored, parts):
    order = [F.col("score"), F.col("id")]
    got = previous_value(scored.repartition(parts, "number"), "number", order, "before")
    want = scored.withColumn("before", F.lag("number").over(Window.orderBy(*order)))
    assert sorted(map(tuple, got.select("id", "before").fillna(-1).collect())) == sorted(
        map(tuple, want.select("id", "before").fillna(-1).collect())
    )


@pytest.mark.parametrize("parts", [1, 8])
def test_previous_value_within_keys(scored, parts):
    # one key holds a third of all rows, so it spreads over ranges
    keyed = scored.withColumn("k", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 50)))
    order = [F.col("score"), F.col("id")]
    got = previous_value(keyed.repartition(parts, "number"), "number", order, "before", ["k"])
    want = keyed.withColumn("before", F.lag("number").over(Window.partitionBy("k").orderBy(*order)))
    assert sorted(map(tuple, got.select("id", "before").fillna(-1).collect())) == sorted(
        map(tuple, want.select("id", "before").fillna(-1).collect())
    )


def test_ranges_are_really_several(spark, scored):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [F.col("id")]
        got = row_positions(scored, order, "p")
        assert got.where(F.col("p") != F.col("id") + 1).count() == 0
        before = previous_value(scored, "id", order, "before")
        assert before.where(F.col("before") != F.col("id") - 1).count() == 0
        assert before.where(F.col("before").isNull()).count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_input(scored):
    assert row_positions(scored.where("false"), [F.col("id")], "p").count() == 0
    assert previous_value(scored.where("false"), "number", [F.col("id")]).count() == 0
