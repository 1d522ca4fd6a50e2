"""Vendor shortlisting: score, filter, rank, flag."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.expr import band, clip, count_true, has, label_text, require, round_scaled, with_defaults
from bidloom.operators.ordering import row_positions
from bidloom.operators.recommend import Rule

REQUIRED = ("vendor_id", "vendor_name")

# Category bounds.
CATEGORIES = [(85, "Excellent"), (70, "Good"), (50, "Average")]


@dataclass(frozen=True)
class ShortlistSettings:
    weights: dict = field(
        default_factory=lambda: {
            "delivery_score": 0.30,
            "quality_score": 0.25,
            "cost_competitiveness": 0.25,
            "payment_compliance": 0.10,
            "dispute_history": 0.10,
        }
    )
    min_delivery: int = 60
    min_quality: int = 60
    max_disputes: int = 3
    min_overall: int = 50
    risk_delivery: float = 75
    risk_quality: float = 75
    risk_disputes: int = 1


DEFAULTS = ShortlistSettings()


def best_first() -> list[Column]:
    return [F.desc_nulls_last("final_score"), F.col("vendor_id")]


def score(df: DataFrame, s: ShortlistSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    require(df, *REQUIRED)
    out = with_defaults(df, defaults)
    if not has(out, "dispute_history"):
        out = out.withColumn("dispute_history", clip(100 - F.col("dispute_count") * 20, 0, 100))
    terms = [F.col(name) * weight for name, weight in s.weights.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return out.withColumn("final_score", round_scaled(total, 2))


def eligibility(df: DataFrame, s: ShortlistSettings = DEFAULTS) -> DataFrame:
    """Every vendor with the reasons against it; no reasons means eligible."""
    reasons: list[tuple[Column, str]] = [
        (F.col("delivery_score") < s.min_delivery, f"Low delivery score (<{s.min_delivery})"),
        (F.col("quality_score") < s.min_quality, f"Low quality score (<{s.min_quality})"),
    ]
    if has(df, "dispute_count"):
        reasons.append((F.col("dispute_count") > s.max_disputes, f"Too many disputes (>{s.max_disputes})"))
    reasons.append((F.col("final_score") < s.min_overall, f"Low overall score (<{s.min_overall})"))
    out = df.withColumn("rejection_reasons", label_text(*reasons))
    return out.withColumn("eligible", F.col("rejection_reasons") == "")


def category(score: Column) -> Column:
    return band(score, CATEGORIES, "Poor")


def rank(checked: DataFrame) -> DataFrame:
    """Eligible vendors numbered 1..n, best first, ties by vendor id."""
    eligible = checked.where("eligible")
    ranked = row_positions(eligible, best_first(), "rank")
    return ranked.withColumn("category", category(F.col("final_score")))


def shortlist(checked: DataFrame, count: int = 10, s: ShortlistSettings = DEFAULTS) -> DataFrame:
    """The best ``count`` eligible vendors with their risk flags; needs no full ranking."""
    best = checked.where("eligible").orderBy(*best_first()).limit(count)
    columns = [
        "vendor_id", "vendor_name", "final_score", "category", "delivery_score", "quality_score",
        "cost_competitiveness", "payment_compliance", "dispute_history", "dispute_count",
    ]
    # a window over at most ``count`` rows
    placed = best.withColumn("rank", F.row_number().over(Window.orderBy(*best_first())).cast("bigint"))
    placed = placed.withColumn("category", category(F.col("final_score")))
    return risk_flags(placed.select("rank", *[c for c in columns if c in placed.columns]), s)


def risk_flags(df: DataFrame, s: ShortlistSettings = DEFAULTS) -> DataFrame:
    signs = []
    if has(df, "delivery_score"):
        signs.append((F.col("delivery_score") < s.risk_delivery, "Low delivery"))
    if has(df, "quality_score"):
        signs.append((F.col("quality_score") < s.risk_quality, "Quality concerns"))
    if has(df, "dispute_count"):
        signs.append((F.col("dispute_count") > s.risk_disputes, "Past disputes"))
    n = count_true(*[c for c, _ in signs])
    return df.withColumns(
        {"risk_flags": label_text(*signs), "risk_count": n, "risk_level": band(n, [(2, "High"), (1, "Medium")], "Low")}
    )


def result(checked: DataFrame, count: int = 10) -> DataFrame:
    eligible = F.count_if("eligible")
    return checked.agg(
        F.count("*").alias("total_vendors"),
        eligible.alias("eligible_vendors"),
        F.least(eligible, F.lit(count)).alias("shortlisted_count"),
        F.count_if(~F.col("eligible")).alias("rejected_count"),
        F.avg(F.when(F.col("eligible"), F.col("final_score"))).alias("average_score"),
    )


# Recommendation texts (over a shortlist).
RULES = [
    Rule(
        "top_vendors", None, "true", id_col="vendor_id", top=3, top_by=("rank",), top_name="vendor_name",
        top_only=True, always=True,
        message="✅ TOP 3 VENDORS: {ids} - Recommend for immediate invitation",
    ),
    Rule(
        "excellent", None, "category = 'Excellent'", id_col="vendor_id",
        message="⭐ {count} EXCELLENT vendors in shortlist - Priority consideration",
    ),
    Rule(
        "risk_warning", None, "risk_level = 'High'", id_col="vendor_id",
        message="⚠️  {count} vendors have HIGH risk flags - Require additional due diligence",
    ),
    Rule(
        "statistics", None, "true", mean="final_score", always=True,
        message="📊 Shortlist average score: {mean:2} - Quality threshold maintained",
    ),
]
