"""Registered corpus queries against their SQL, and the pipeline against its stages."""

import pytest
from compare import connect, difference, rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

import corpus_pipeline
from bidloom.llm import exact_dedup, near_dedup
from bidloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(rows_of_spark(QUERIES[name](spark, SF_DIR)), rows_of_sql(connect(SF_DIR), ORACLES[name])) is None


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR).cache()
        assert after.columns == docs.columns
        counts.append(after.count())
        docs = after
    # this scale has too few ratings to reject anything
    assert counts[0] >= counts[1] > counts[2] >= counts[3] < counts[4]
    # what is left has no exact and no near copies but those of the mixture
    single = docs.dropDuplicates(["doc_id"])
    assert exact_dedup.classes(single).where("not kept").count() == 0
    assert near_dedup.near_components(single, 5, 80).where("not kept").count() == 0
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert coded.count() == counts[-1] and coded.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_stages_take_awkward_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", "en", "s", 0), (3, "some words here", None, "s", 5), (4, "some words here", None, "s", 5)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, kind)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).collect()
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_stages_judge_rows_not_ids(spark):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    long = " ".join(f"w{k}" for k in range(60))
    texts = [(None, "one"), (5, "one"), (None, "alone"), (6, "same"), (6, "same"), (6, "other"), (None, long), (9, long + " x"), (9, "apart")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], kind).repartition(3)
    exact = corpus_pipeline.drop_exact(spark, docs, SF_DIR).cache()
    got = sorted((str(r.doc_id), r.text) for r in exact.collect())
    assert got == sorted(
        [("5", "one"), ("None", "alone"), ("6", "same"), ("6", "other"), ("None", long), ("9", long + " x"), ("9", "apart")]
    )
    near = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_near(spark, exact, SF_DIR).collect())
    assert near == [x for x in got if x != ("None", long)]
    # nothing speaks against these: each row stays, whatever its id
    assert corpus_pipeline.keep_quality(spark, docs, SF_DIR).count() == len(texts)


def test_stages_leave_columns_alone_that_they_might_use(spark, tmp_path):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, _mix_row bigint, _mix_times int, _file string, `a.b` int"
    rows = [(i, f"some words {i}", "en", "s", 7, 10 + i, 20 + i, "f", i) for i in range(30)]
    plain = spark.createDataFrame(rows, kind).repartition(3)
    plain.write.parquet(str(tmp_path / "t"))
    for docs in (plain, spark.read.parquet(str(tmp_path / "t"))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF_DIR)
            assert got.columns == docs.columns
            assert {tuple(r) for r in got.collect()} == set(rows)


def test_one_row_many_times(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the same words again and again", "en", "s", 1)] * 1000, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(4).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert [stage(spark, docs, SF_DIR).count() for _, stage in corpus_pipeline.STAGES[:3]] == [1000, 1, 1]
    assert 1000 <= corpus_pipeline.mix_sources(spark, docs, SF_DIR).count() <= 2000
