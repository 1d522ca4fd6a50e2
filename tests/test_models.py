import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from bidloom.operators import isolation, models
from bidloom.sources import staging


@pytest.fixture(scope="module")
def vendors(spark):
    data = []
    for i in range(60):
        good = i % 2 == 0
        base = 85 if good else 50
        data.append((i, base + i % 7, base + i % 5, base + i % 6, i % 2 if good else 3 + i % 3, int(good)))
    return spark.createDataFrame(
        data,
        "id int, delivery_score int, cost_competitiveness int, quality_score int, dispute_count int, reliable int",
    )


def test_split_is_stable_under_layout(vendors):
    one = set(rows(vendors.repartition(1).where(models.train_share("id")), "id"))
    many = set(rows(vendors.repartition(9).where(models.train_share("id")), "id"))
    assert one == many and 0.6 < len(one) / 60 < 0.95


@pytest.mark.parametrize("kind", ["random_forest", "logistic_regression"])
def test_classifiers(spark, vendors, kind):
    model = models.train_model(vendors, "reliable", "id", kind, n_estimators=10)
    assert model.metrics["train_accuracy"] == 1.0 and model.metrics["f1_score"] == 1.0
    new = spark.createDataFrame([(88, 85, 90, 0), (50, 55, 52, 4)], "delivery_score int, cost_competitiveness int, quality_score int, dispute_count int")
    assert [r[0] for r in rows(model.predict(new), "prediction")] == [1.0, 0.0]
    chances = [r[0] for r in rows(model.predict_proba(new), "probability")]
    assert all(sum(c) == pytest.approx(1) for c in chances) and chances[0][1] > 0.5
    with pytest.raises(ValueError):
        model.predict(new.drop("quality_score"))
    if kind == "random_forest":
        values = [r[0] for r in rows(model.feature_importance(), "importance")]
        assert values == sorted(values, reverse=True) and sum(values) == pytest.approx(1)
    else:
        with pytest.raises(ValueError):
            model.feature_importance()


def test_weighted_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [(False, 1.0, 1.0)] * 3 + [(False, 1.0, 0.0)] + [(False, 0.0, 0.0)] * 2 + [(False, 0.0, 1.0)] * 2 + [(True, 0.0, 0.0)],
        "_train boolean, y double, prediction double",
    )
    got = models.classification_metrics(df, "y")
    assert got["test_accuracy"] == pytest.approx(5 / 8)
    assert got["precision"] == pytest.approx(0.5 * 3 / 5 + 0.5 * 2 / 3)
    assert got["recall"] == pytest.approx(0.5 * 3 / 4 + 0.5 * 2 / 4)


def test_regressors_and_reload(spark, vendors, tmp_path):
    df = vendors.withColumn("price", F.col("delivery_score") * 2.0 + F.col("dispute_count") * 5.0 + 1).drop("reliable")
    linear = models.train_model(df, "price", "id", "linear_regression", "regression")
    assert linear.metrics["test_r2"] == pytest.approx(1.0) and linear.metrics["test_rmse"] == pytest.approx(0, abs=1e-6)
    forest = models.train_model(df, "price", "id", "random_forest", "regression", n_estimators=10)
    assert {"train_r2", "test_r2", "train_rmse", "test_rmse"} <= set(forest.metrics)
    linear.save(str(tmp_path / "m"))
    again = models.TrainedModel.load(str(tmp_path / "m"))
    assert again.features == linear.features and again.metrics == pytest.approx(linear.metrics)
    first, second = (sorted(r[0] for r in rows(m.predict(df, ("id",)), "prediction")) for m in (linear, again))
    assert first == pytest.approx(second)
    with pytest.raises(ValueError):
        models.train_model(df, "price", "id", "other", "regression")
    with pytest.raises(ValueError):
        models.train_model(df, "nothing", "id")


def test_planted_anomalies(spark):
    data = [(i, 1000.0 + i * 10, 5.0 + i % 3, 200.0 + i) for i in range(8)] + [(8, 150000.0, 30.0, 5000.0), (9, 200000.0, 40.0, 5000.0)]
    df = spark.createDataFrame(data, "id int, amount double, items double, unit_price double")
    out = isolation.detect_anomalies(df, "id", ["amount", "items", "unit_price"], contamination=0.2)
    assert {r[0] for r in rows(out.where("is_anomaly"), "id")} == {8, 9}
    assert all(-1 <= r[0] < 0 for r in rows(out, "anomaly_score"))


def test_scores_do_not_depend_on_layout(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))], "id int, a double, b double")
    one = isolation.detect_anomalies(df.repartition(1), "id", ["a", "b"], n_trees=20, sample=64)
    many = isolation.detect_anomalies(df.repartition(7), "id", ["a", "b"], n_trees=20, sample=64)
    assert sorted(rows(one, "id", "anomaly_score")) == sorted(rows(many, "id", "anomaly_score"))
    # a tenth is flagged, a twentieth graded high
    assert 250 <= many.where("is_anomaly").count() <= 300
    assert 120 <= many.where("anomaly_severity = 'high'").count() <= 150


def test_mean_path():
    assert isolation.mean_path(np.array([1.0, 2.0])).tolist() == [0.0, 1.0]
    assert float(isolation.mean_path(256.0)) == pytest.approx(10.2448, abs=1e-3)


def test_forest_of_a_table_with_few_keys(spark):
    rows = spark.range(400_000, numPartitions=8).select(
        F.lit("same").alias("key"), (F.col("id") % 7).cast("double").alias("a"), F.lit(1.0).alias("b")
    )
    forest, size = isolation.fit_forest(rows, "key", ["a", "b"], n_trees=5)
    assert len(forest) == 5 and size == isolation.SAMPLE
    assert all((t["feature"] >= 0).any() for t in forest)


def test_rows_of_one_partition_are_fitted_in_several(spark, monkeypatch):
    written = []

    def keep(df, label="stage"):
        written.append(staging.stage_table(df, label))
        return written[-1]

    monkeypatch.setattr(models, "stage_table", keep)
    rows_in_one = spark.range(0, 400_000, 1, 1).select(
        F.col("id").alias("key"), F.rand(3).alias("x"), (F.rand(5) + F.col("id")).alias("label"))
    fitted = models.train_model(rows_in_one, "label", "key", "linear_regression", "regression")
    assert len(written[0].inputFiles()) > 1 and written[0].rdd.getNumPartitions() > 1
    assert written[0].count() == 400_000 and fitted.features == ["x"]
