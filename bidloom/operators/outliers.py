"""Distribution summaries and outlier flags, global or per group.

NaN counts as missing: it is no outlier and is returned as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import flag, nan_to_null
from bidloom.operators.quantiles import group_quantiles
from bidloom.operators.scalars import with_scalars
from bidloom.sources.staging import attach, stage_table

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def summary(
    df: DataFrame,
    value: str,
    by: list[str] | None = None,
    also: list[Column] | None = None,
) -> DataFrame:
    """Count, moments, extremes and exact quartiles; an empty group has nulls and count 0.

    Sample variance of a single value is 0. ``also`` adds aggregates of other columns.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    n = F.count(v)
    single = n == 1
    moments = [
        n.alias("count"),
        F.avg(v).alias("mean"),
        F.when(single, F.lit(0.0)).otherwise(F.stddev_samp(v)).alias("std"),
        F.when(single, F.lit(0.0)).otherwise(F.var_samp(v)).alias("variance"),
        F.stddev_pop(v).alias("std_pop"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]
    table = group_quantiles(df, value, QUARTILES, by, [*moments, *(also or [])])
    return table.withColumns({"iqr": F.col("q3") - F.col("q1"), "range": F.col("max") - F.col("min")})


def _with_stats(df: DataFrame, value: str, by: list[str] | None) -> DataFrame:
    df = nan_to_null(df)
    names = ["mean", "median", "std", "std_pop", "q1", "q3"]
    stats = summary(df, value, by).select(*(by or []), *[F.col(n).alias(f"_{n}") for n in names])
    # a one-row table keyed by nothing becomes a scalar subquery
    return attach(df, stats, by, "group-stats") if by else with_scalars(df, stage_table(stats, "stats"))


def _z(value: Column) -> Column:
    spread = F.col("_std")
    return F.when(spread == 0, F.lit(0.0)).otherwise(F.try_divide(value - F.col("_mean"), spread))


def _z_columns(value: Column, threshold: float) -> dict[str, Column]:
    z = _z(value)
    return {
        "zscore": z,
        "is_outlier_zscore": flag(F.abs(z) > threshold),
        "z_type": F.when(z > threshold, "high").when(z < -threshold, "low").otherwise("none"),
        "z_severity": F.when(F.abs(z) > threshold * 1.5, "high").when(F.abs(z) > threshold, "medium").otherwise("none"),
    }


def _iqr_columns(value: Column, multiplier: float) -> dict[str, Column]:
    iqr = F.col("_q3") - F.col("_q1")
    low, high = F.col("_q1") - iqr * multiplier, F.col("_q3") + iqr * multiplier
    distance = F.when(value < low, F.abs(value - low)).when(value > high, F.abs(value - high)).otherwise(F.lit(0.0))
    outside = flag((value < low) | (value > high))
    return {
        "iqr": iqr,
        "lower_bound": low,
        "upper_bound": high,
        "is_outlier_iqr": outside,
        "iqr_type": F.when(value < low, "low").when(value > high, "high").otherwise("none"),
        "distance_from_bound": distance,
        "iqr_severity": F.when(distance > iqr, "high").when(outside, "medium").otherwise("none"),
    }


_INTERNAL = ["_mean", "_median", "_std", "_std_pop", "_q1", "_q3"]


def zscore_outliers(
    df: DataFrame, value: str, by: list[str] | None = None, threshold: float = 3.0
) -> DataFrame:
    out = _with_stats(df, value, by).withColumns(_z_columns(F.col(value), threshold))
    return out.withColumnsRenamed({"z_type": "outlier_type", "z_severity": "severity"}).drop(*_INTERNAL)


def iqr_outliers(
    df: DataFrame, value: str, by: list[str] | None = None, multiplier: float = 1.5
) -> DataFrame:
    out = _with_stats(df, value, by).withColumns(_iqr_columns(F.col(value), multiplier))
    return out.withColumnsRenamed({"iqr_type": "outlier_type", "iqr_severity": "severity"}).drop(*_INTERNAL)


def _combined(df: DataFrame, value: str, by, threshold: float, multiplier: float) -> DataFrame:
    v = F.col(value)
    z, q = _z_columns(v, threshold), _iqr_columns(v, multiplier)
    by_z, by_iqr = z["is_outlier_zscore"], q["is_outlier_iqr"]
    severity = (
        F.when((z["z_severity"] == "high") | (q["iqr_severity"] == "high"), "high")
        .when((z["z_severity"] == "medium") | (q["iqr_severity"] == "medium"), "medium")
        .otherwise("none")
    )
    method = F.when(by_z & by_iqr, "both").when(by_z, "zscore_only").when(by_iqr, "iqr_only").otherwise("none")
    return _with_stats(df, value, by).withColumns(
        {
            "zscore": z["zscore"],
            "is_outlier_zscore": by_z,
            "is_outlier_iqr": by_iqr,
            "is_outlier": by_z | by_iqr,
            "outlier_type": z["z_type"],
            "severity": severity,
            "detection_method": method,
        }
    )


def combined_outliers(
    df: DataFrame,
    value: str,
    by: list[str] | None = None,
    threshold: float = 3.0,
    multiplier: float = 1.5,
) -> DataFrame:
    """Either method flags; the type follows the z-score alone, the severity is the higher one."""
    return _combined(df, value, by, threshold, multiplier).drop(*_INTERNAL)


def bid_price_analysis(
    df: DataFrame, price: str = "quoted_price", by: list[str] | None = None
) -> DataFrame:
    out = _combined(df, price, by, 3.0, 1.5)
    deviation = F.when(F.col("_mean") > 0, (F.col(price) - F.col("_mean")) / F.col("_mean") * 100).otherwise(F.lit(0.0))
    out = out.withColumns(
        {
            "price_mean": F.col("_mean"),
            "price_median": F.col("_median"),
            "price_std": F.col("_std"),
            "deviation_pct": deviation,
        }
    ).drop(*_INTERNAL, "is_outlier_zscore", "is_outlier_iqr")
    return out.withColumnsRenamed({"is_outlier": "is_price_outlier", "severity": "outlier_severity"})


def vendor_metric_analysis(
    df: DataFrame, metric: str = "delivery_score", by: list[str] | None = None
) -> DataFrame:
    out = _combined(df, metric, by, 3.0, 1.5)
    out = out.withColumns({"metric_mean": F.col("_mean"), "metric_median": F.col("_median")})
    return out.withColumnRenamed("is_outlier", "is_performance_outlier").drop(
        *_INTERNAL, "is_outlier_zscore", "is_outlier_iqr", "detection_method"
    )
