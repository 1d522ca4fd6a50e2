"""Bid anomalies: price, delivery and specification, per bid set or overall."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import any_true, count_true, flag, has, last_match, nan_to_null, require
from bidloom.operators.outliers import summary
from bidloom.operators.recommend import Rule
from bidloom.operators.rules import differs
from bidloom.operators.scalars import with_scalars
from bidloom.sources.staging import attach, stage_table

REQUIRED = ("vendor_id", "quoted_price")


@dataclass(frozen=True)
class BidSettings:
    price_high_pct: float = 30
    price_low_pct: float = 20
    delivery_pct: float = 15
    iqr_multiplier: float = 1.5
    extreme_z: float = 3


DEFAULTS = BidSettings()


def price_statistics(
    df: DataFrame,
    by: list[str] | None = None,
    s: BidSettings = DEFAULTS,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Mean, median, population deviation, extremes, quartiles and fences."""
    also = also or {}
    stats = summary(df, "quoted_price", by, [c.alias(name) for name, c in also.items()])
    return stats.select(
        *(by or []),
        "mean",
        "median",
        F.col("std_pop").alias("std"),
        "min",
        "max",
        "q1",
        "q3",
        "iqr",
        (F.col("q1") - s.iqr_multiplier * F.col("iqr")).alias("lower_bound"),
        (F.col("q3") + s.iqr_multiplier * F.col("iqr")).alias("upper_bound"),
        *also,
    )


def _with_baseline(df: DataFrame, by: list[str] | None, s: BidSettings) -> DataFrame:
    also = {"delivery": F.avg("delivery_days")} if has(df, "delivery_days") else {}
    stats = price_statistics(df, by, s, also)
    names = ["mean", "std", "lower_bound", "upper_bound", *also]
    stats = stats.select(*(by or []), *[F.col(n).alias(f"_{n}") for n in names])
    return attach(df, stats, by, "bid-stats") if by else with_scalars(df, stage_table(stats, "bid-stats"))


def detect(
    df: DataFrame, by: list[str] | None = None, s: BidSettings = DEFAULTS
) -> DataFrame:
    """All anomaly flags, counts and severities in one projection over the bids."""
    df = nan_to_null(df)
    require(df, *REQUIRED)
    price, mean = F.col("quoted_price"), F.col("_mean")
    deviation = F.try_divide(price - mean, mean) * 100
    z = F.try_divide(price - mean, F.col("_std"))
    out = _with_baseline(df, by, s).withColumns(
        {
            "price_deviation_pct": deviation,
            "price_too_high": flag(deviation > s.price_high_pct),
            "price_too_low": flag(deviation < -s.price_low_pct),
            "is_outlier": flag((price < F.col("_lower_bound")) | (price > F.col("_upper_bound"))),
            "z_score": z,
            "extreme_outlier": flag(F.abs(z) > s.extreme_z),
        }
    )
    if has(df, "delivery_days"):
        late = F.try_divide(F.col("delivery_days") - F.col("_delivery"), F.col("_delivery")) * 100
        out = out.withColumns(
            {"delivery_deviation_pct": late, "delivery_anomaly": flag(F.abs(late) > s.delivery_pct)}
        )
    else:
        out = out.withColumn("delivery_anomaly", F.lit(False))
    mismatch = []
    if has(df, "payment_terms", "required_payment_terms"):
        mismatch.append(differs(F.col("payment_terms"), F.col("required_payment_terms")))
    if has(df, "quoted_quantity", "required_quantity"):
        out = out.withColumn("quantity_mismatch", differs(F.col("quoted_quantity"), F.col("required_quantity")))
        mismatch.append(F.col("quantity_mismatch"))
    out = out.withColumn("spec_mismatch", any_true(*mismatch) if mismatch else F.lit(False))
    counted = [F.col(c) for c in ("price_too_high", "price_too_low", "delivery_anomaly", "spec_mismatch")]
    out = out.withColumns(
        {"has_anomaly": any_true(*counted, F.col("is_outlier")), "anomaly_count": count_true(*counted)}
    )
    return out.drop("_mean", "_std", "_lower_bound", "_upper_bound", "_delivery")


def classify(df: DataFrame) -> DataFrame:
    n, extreme = F.col("anomaly_count"), F.col("extreme_outlier")
    severity = last_match(
        "none",
        ((n == 1) & ~extreme, "low"),
        ((n == 2) | extreme, "medium"),
        (n >= 3, "high"),
    )
    out = df.withColumn("severity", severity)
    return out.withColumns(
        {
            "requires_review": F.col("severity").isin("medium", "high"),
            "reject_bid": F.col("severity") == "high",
        }
    )


def analyze(
    df: DataFrame, by: list[str] | None = None, s: BidSettings = DEFAULTS
) -> DataFrame:
    return classify(detect(df, by, s))


def bid_set_result(detail: DataFrame, by: list[str] | None = None) -> DataFrame:
    level = F.col("severity")
    return detail.groupBy(*(by or [])).agg(
        F.count("*").alias("total_bids"),
        F.count_if("has_anomaly").alias("anomalies_detected"),
        F.count_if(level == "high").alias("high_severity"),
        F.count_if(level == "medium").alias("medium_severity"),
        F.count_if(level == "low").alias("low_severity"),
    )


# Recommendation texts.
RULES = [
    Rule(
        "reject", None, "severity = 'high'", id_col="vendor_id",
        message="🚨 REJECT {count} bids with HIGH severity anomalies",
    ),
    Rule(
        "review", None, "severity = 'medium'", id_col="vendor_id",
        message="⚠️  REVIEW {count} bids with MEDIUM severity - seek clarification",
    ),
    Rule(
        "investigate", None, "price_too_low", id_col="vendor_id",
        message="🔍 INVESTIGATE {count} bids with suspiciously low prices",
    ),
    Rule(
        "approve", None, "NOT has_anomaly", id_col="vendor_id",
        message="✅ {count} clean bids ready for evaluation",
    ),
]
