import random

import numpy as np
import pytest

from bidloom.operators.quantiles import group_quantiles

SEEN = {}
PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p05": 0.05}


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    data = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else f"k{i % 40}"
        value = None if i % 97 == 0 else float("nan") if i % 89 == 0 else float(rng.choice([rng.randint(0, 9), rng.random() * 100]))
        data.append((key if i % 211 else None, value))
    return spark.createDataFrame(data, "key string, v double").cache()


def _expected(values):
    groups = {}
    for key, v in values.collect():
        if key is not None and v is not None and not np.isnan(v):
            groups.setdefault(key, []).append(v)
    return {k: [float(np.percentile(vs, p * 100)) for p in PROBS.values()] for k, vs in groups.items()}


@pytest.mark.parametrize("partitions", ["1", "3", "32"])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_exact_quantiles_under_any_layout(spark, values, coalesce, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r[0]: list(r[1:]) for r in group_quantiles(values, "v", PROBS, ["key"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = _expected(values)
    assert got.keys() == want.keys()
    # the same to the last bit, however the rows lie
    first = SEEN.setdefault("first", got)
    assert got == first
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-9), key


def test_whole_table(values):
    clean = [v for _, v in values.collect() if v is not None and not np.isnan(v)]
    got = group_quantiles(values, "v", PROBS).first()
    assert list(got) == pytest.approx([float(np.percentile(clean, p * 100)) for p in PROBS.values()], abs=1e-9)


def test_empty_table_gives_nulls(values):
    assert list(group_quantiles(values.where("false"), "v", PROBS).first()) == [None] * 4


def test_counted_values_are_sorted_once(spark):
    df = spark.range(1000).selectExpr("id % 7 AS g", "cast(id % 50 AS double) AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = group_quantiles(df, "v", {"median": 0.5}, ["g"])
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the sort of the positions' window is also the join's
    joined = [line for line in plan.splitlines() if "Sort [g#" in line and "_layout_part#" in line]
    by_value = [line for line in joined if "_v#" in line]
    assert len(by_value) == 1 and len(joined) == 3
