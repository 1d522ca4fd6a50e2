import pytest
from conftest import rows

from bidloom.operators import outliers


def _column(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")


def test_summary(spark):
    got = outliers.summary(_column(spark, [100, 120, 110, 130, 105, 115, 125, 135]), "v").first()
    assert (got["count"], got["mean"], got["median"]) == (8, 117.5, 117.5)


def test_summary_of_nothing_one_and_gaps(spark):
    empty = outliers.summary(_column(spark, [None, None]), "v").first()
    assert empty["count"] == 0 and empty["mean"] is None and empty["iqr"] is None
    one = outliers.summary(_column(spark, [100]), "v").first()
    assert (one["count"], one["std"], one["variance"]) == (1, 0.0, 0.0)
    assert outliers.summary(_column(spark, [100, 110, None, 120, None, 130]), "v").first()["count"] == 4


def test_zscore(spark):
    eight = outliers.zscore_outliers(_column(spark, [100, 110, 105, 115, 108, 112, 200, 20]), "v")
    assert eight.where("is_outlier_zscore").count() == 0
    flat = outliers.zscore_outliers(_column(spark, [100] * 5), "v")
    assert set(rows(flat, "zscore", "outlier_type", "severity")) == {(0.0, "none", "none")}


def test_iqr(spark):
    out = outliers.iqr_outliers(_column(spark, [100, 105, 110, 115, 120, 125, 130, 300, 10]), "v")
    assert set(rows(out, "lower_bound", "upper_bound")) == {(75.0, 155.0)}
    assert rows(out.where("is_outlier_iqr").orderBy("v"), "v", "outlier_type", "severity") == [
        (10.0, "low", "high"),
        (300.0, "high", "high"),
    ]


def test_combined(spark):
    out = outliers.combined_outliers(_column(spark, [100, 105, 110, 115, 120, 125, 130, 135, 400, 5]), "v")
    assert rows(out.where("is_outlier").orderBy("v"), "v", "detection_method") == [(5.0, "iqr_only"), (400.0, "iqr_only")]


def test_bid_prices(spark):
    prices = [250000, 260000, 255000, 258000, 450000, 150000, 252000]
    df = spark.createDataFrame([(f"V{i:03d}", float(p)) for i, p in enumerate(prices, 1)], "vendor_id string, quoted_price double")
    out = outliers.bid_price_analysis(df)
    assert out.first()["price_std"] == pytest.approx(89406.24, abs=0.01)
    assert sorted(
        rows(out.where("is_price_outlier"), "vendor_id", "outlier_type", "outlier_severity", "detection_method")
    ) == [("V005", "none", "high", "iqr_only"), ("V006", "none", "high", "iqr_only")]


def test_vendor_metric(spark):
    df = spark.createDataFrame(
        [(f"V{i:03d}", float(v)) for i, v in enumerate([92, 88, 90, 45, 91, 89], 1)], "vendor_id string, delivery_score double"
    )
    out = outliers.vendor_metric_analysis(df)
    assert rows(out.where("is_performance_outlier"), "vendor_id") == [("V004",)]


def test_nan_is_missing_not_an_outlier(spark):
    df = _column(spark, [100, 105, 110, 115, 120, 125, 130, 135, 400, float("nan")])
    for found in (outliers.combined_outliers(df, "v"), outliers.iqr_outliers(df, "v"), outliers.zscore_outliers(df, "v")):
        flag = next(c for c in ("is_outlier", "is_outlier_iqr", "is_outlier_zscore") if c in found.columns)
        assert rows(found.where("v is null"), flag) == [(False,)]
    assert rows(outliers.combined_outliers(df, "v").where("is_outlier"), "v") == [(400.0,)]
