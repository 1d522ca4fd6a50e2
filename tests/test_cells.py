"""The cell index against comparing everything."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from bidloom.operators import cells, retrieval

SCHEMA = "vec_id bigint, embedding array<float>, n int"


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v], 1) for i, v in zip(ids, x)], SCHEMA)


def clustered(n, width, groups, spread, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, width))[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, width))


def asked(df, where="vec_id % 20 = 0"):
    return df.where(where).selectExpr("vec_id as question_id", "embedding as question_embedding")


def flat(df, questions, k):
    rows = retrieval.nearest_chunks(df, questions, k=k).collect()
    return sorted((r.question_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in rows)


def by_cells(search):
    return sorted((r.question_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in search.hits.collect())


@pytest.mark.parametrize("kind", ["clustered", "uniform", "copies", "one"])
def test_same_as_flat_search(spark, kind):
    rng = np.random.default_rng(3)
    x = {
        "clustered": lambda: clustered(600, 8, 12, 0.05, 1),
        "uniform": lambda: rng.normal(size=(300, 16)),
        # a third of all vectors are one vector: ties by id, one cell of many rings
        "copies": lambda: np.concatenate([np.tile(rng.normal(size=6), (150, 1)), clustered(250, 6, 5, 0.2, 2)]),
        "one": lambda: np.ones((40, 3)),
    }[kind]()
    df = vectors(spark, [*x.astype(np.float32), None], [*range(len(x)), 7777])
    index = cells.build_index(df, ring_rows=16)
    found = cells.search(index, asked(df), k=4)
    assert by_cells(found) == flat(df, asked(df), 4)
    assert index.codes.count() == len(x)
    work = found.work.collect()
    assert len(work) == -(-len(x) // 20)
    assert all(4 <= r.compared <= r.bounded <= r.total == len(x) for r in work)
    if kind == "clustered":
        assert np.mean([r.bounded / r.total for r in work]) < 0.3
    if kind == "uniform":
        assert np.mean([r.compared / r.total for r in work]) < 0.3


def test_more_asked_for_than_there_is(spark):
    df = vectors(spark, clustered(10, 4, 2, 0.1, 5))
    assert by_cells(cells.search(cells.build_index(df, ring_rows=2), asked(df, "vec_id < 3"), k=20)) == flat(df, asked(df, "vec_id < 3"), 20)
    assert cells.nearest_by_cells(df.where("false"), asked(df)).count() == 0
    assert cells.nearest_by_cells(df, asked(df, "false")).count() == 0


def test_a_question_moves_once_for_a_lot_of_rings(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(400, 8)).astype(np.float32)
    df = vectors(spark, x)
    expected = flat(df, asked(df), 4)
    for rows, lots in ((10_000, 1), (40, 10)):
        monkeypatch.setattr(cells, "LOT_ROWS", rows)
        index = cells.build_index(df, ring_rows=8)
        assert index.lots == lots and index.rings.count() > lots
        assert by_cells(cells.search(index, asked(df), k=4)) == expected


def test_bounds_keep_all_that_may_be_near():
    rng = np.random.default_rng(8)
    near, q = rng.normal(size=(200, 6)), rng.normal(size=(30, 6))
    lost = rng.uniform(0, 0.3, 200)
    away = np.sqrt(((q[:, None] - near[None]) ** 2).sum(axis=2))
    for limit in (np.full(30, np.inf), np.where(np.arange(30) % 2, 1.5, np.inf), np.full(30, 0.0), np.full(30, 2.0)):
        row, col, lower, upper, most = cells._candidates(q, limit, near, lost, 4)
        expected = np.minimum(limit, np.partition(away + lost, 3, axis=1)[:, 3])
        assert np.allclose(most, expected)
        r, c = np.nonzero(np.maximum(away - lost, 0) <= expected[:, None])
        assert set(zip(r, c)) == set(zip(row.tolist(), col.tolist()))
        assert np.allclose(lower, np.maximum(away - lost, 0)[row, col]) and np.allclose(upper, (away + lost)[row, col])


def test_large_tables_of_few_values_are_not_gathered_in_the_driver(spark):
    alike = spark.range(300).select(F.concat(F.lit("v"), "id").alias("vec_id"), F.array(*[F.lit(1.0)] * 8).alias("embedding"))
    asked = spark.range(60).select(F.col("id").alias("question_id"), F.array(*[F.lit(0.5)] * 8).alias("question_embedding"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # every vector is as near as the others: 18,000 pairs, in files of far less
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "500k")
    try:
        hits = cells.search(cells.build_index(alike, cells=2), asked).hits
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [id" in plan
        found = sorted(rows(hits, "question_id", "vec_id", "rank"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == [(q, f"v{v}", n) for q in range(60) for n, v in enumerate((0, 1, 10, 100), 1)]
