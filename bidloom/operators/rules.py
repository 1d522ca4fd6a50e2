"""Business rules: vendor scoring, bid deviation flags, contract grading."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import any_true, band, count_true, flag, has, nan_to_null, points, require, round_scaled
from bidloom.operators.recommend import Rule, recommend
from bidloom.operators.scalars import with_scalars
from bidloom.sources.staging import attach


@dataclass(frozen=True)
class RuleSettings:
    weights: dict = field(
        default_factory=lambda: {
            "cost_competitiveness": 30,
            "on_time_delivery": 25,
            "quality_score": 20,
            "compliance_score": 15,
            "past_disputes": 10,
        }
    )
    dispute_step: int = 20
    price_high_pct: float = 30
    price_low_pct: float = 20
    delivery_pct: float = 15
    max_disputes: int = 2
    min_compliance: float = 70
    preferred_score: float = 85
    high_value: float = 10_000_000
    board_value: float = 50_000_000
    rule_clauses: tuple = ("payment_clause", "penalty_clause", "termination_clause", "warranty_clause", "liability_clause")
    scored_clauses: tuple = ("payment_clause", "penalty_clause", "termination_clause")

    def __post_init__(self):
        if abs(sum(self.weights.values()) - 100) > 0.01:
            raise ValueError(f"weights must sum to 100, got {sum(self.weights.values())}")


DEFAULTS = RuleSettings()


def vendor_score(df: DataFrame, settings: RuleSettings = DEFAULTS) -> Column:
    """Weighted 0-100 score over the inputs the table has."""
    terms = []
    for name, weight in settings.weights.items():
        if name not in df.columns:
            continue
        value = F.col(name)
        if name == "past_disputes":
            value = F.greatest(F.lit(0), 100 - value * settings.dispute_step)
        else:
            value = F.least(F.lit(100), value)
        terms.append(value * F.lit(weight / 100))
    return round_scaled(reduce(lambda a, b: a + b, terms, F.lit(0.0)), 2)


def score_risk(score: Column) -> Column:
    """75 up to 100 low, 50 medium, 0 high; anything outside counts as low."""
    return (
        F.when((score >= 75) & (score < 100), "low")
        .when((score >= 50) & (score < 75), "medium")
        .when((score >= 0) & (score < 50), "high")
        .otherwise("low")
    )


def vendor_rules(df: DataFrame, settings: RuleSettings = DEFAULTS) -> DataFrame:
    df = nan_to_null(df)
    out = df.withColumn("vendor_score", vendor_score(df, settings))
    out = out.withColumn("risk_level", score_risk(F.col("vendor_score")))
    if has(df, "dispute_count"):
        out = out.withColumn("high_dispute_flag", flag(F.col("dispute_count") > settings.max_disputes))
    if has(df, "compliance_score"):
        out = out.withColumn("low_compliance_flag", flag(F.col("compliance_score") < settings.min_compliance))
    no_disputes = (F.col("dispute_count") == 0) if has(df, "dispute_count") else F.lit(True)
    preferred = (F.col("vendor_score") >= settings.preferred_score) & (F.col("risk_level") == "low") & no_disputes
    return out.withColumn("preferred_vendor", flag(preferred))


def bid_rules(df: DataFrame, by: list[str] | None = None, settings: RuleSettings = DEFAULTS) -> DataFrame:
    """Deviation from the table mean, or from the mean of each group ``by``."""
    df = nan_to_null(df)
    require(df, "quoted_price")
    means = [F.avg("quoted_price").alias("mean_price")]
    if has(df, "delivery_days"):
        means.append(F.avg("delivery_days").alias("mean_delivery"))
    out = attach(df, df.groupBy(*by).agg(*means), by, "bid-means") if by else with_scalars(df, df.agg(*means))
    price, mean = F.col("quoted_price"), F.col("mean_price")
    flags = {
        "price_high_flag": flag(F.try_divide(price - mean, mean) * 100 > settings.price_high_pct),
        "price_low_flag": flag(F.try_divide(mean - price, mean) * 100 > settings.price_low_pct),
    }
    if has(df, "delivery_days"):
        gap = F.abs(F.col("delivery_days") - F.col("mean_delivery"))
        flags["delivery_deviation_flag"] = flag(F.try_divide(gap, F.col("mean_delivery")) * 100 > settings.delivery_pct)
    if has(df, "payment_terms", "rfq_payment_terms"):
        flags["payment_terms_flag"] = differs(F.col("payment_terms"), F.col("rfq_payment_terms"))
    out = out.withColumns(flags)
    found = [F.col(name) for name in flags]
    return out.withColumns(
        {"anomaly_detected": any_true(*found), "anomaly_severity": flag_severity(count_true(*found))}
    )


def differs(left: Column, right: Column) -> Column:
    """Inequality in which a missing value differs from everything."""
    return left.isNull() | right.isNull() | flag(left != right)


def flag_severity(n_flags: Column) -> Column:
    return band(n_flags, [(3, "high"), (2, "medium"), (1, "low")], "none")


def contract_rules(df: DataFrame, settings: RuleSettings = DEFAULTS) -> DataFrame:
    df = nan_to_null(df)
    flags = {}
    for clause in settings.rule_clauses:
        if clause in df.columns:
            flags[f"{clause}_missing"] = F.col(clause).isNull() | flag(F.col(clause) == "")
    if has(df, "gcc_compliant"):
        flags["gcc_deviation"] = flag(~F.col("gcc_compliant"))
    if has(df, "contract_value"):
        flags["high_value_contract"] = flag(F.col("contract_value") > settings.high_value)
        flags["requires_board_approval"] = flag(F.col("contract_value") > settings.board_value)
    out = df.withColumns(flags)
    return out.withColumn("contract_risk_score", contract_risk(out, settings)).withColumn(
        "rag_status", traffic_light(F.col("contract_risk_score"))
    )


def contract_risk(df: DataFrame, settings: RuleSettings = DEFAULTS) -> Column:
    scored = [(f"{c}_missing", 20) for c in settings.scored_clauses]
    scored += [("gcc_deviation", 15), ("high_value_contract", 10)]
    parts = [(F.col(name), value) for name, value in scored if name in df.columns]
    if has(df, "vendor_risk_level"):
        parts += [(F.col("vendor_risk_level") == "high", 25), (F.col("vendor_risk_level") == "medium", 10)]
    return F.least(F.lit(100), points(*parts)) if parts else F.lit(0)


def traffic_light(score: Column) -> Column:
    return band(score, [(70, "Red"), (40, "Amber")], "Green")


# Recommendation texts.
VENDOR_RULES = [
    Rule(
        "preferred_vendors", None, "preferred_vendor", id_col="vendor_id",
        message="Found {count} preferred vendors with score >= 85 and low risk",
    ),
    Rule(
        "high_risk_vendors", None, "risk_level = 'high'", id_col="vendor_id",
        message="⚠️  {count} vendors flagged as HIGH RISK - avoid or escalate",
    ),
]
BID_RULES = [
    Rule(
        "critical_anomalies", None, "anomaly_severity = 'high'",
        message="🚨 {count} bids with HIGH severity anomalies - requires immediate review",
    ),
]
CONTRACT_RULES = [
    Rule(
        "red_contracts", None, "rag_status = 'Red'", id_col="contract_id",
        message="🔴 {count} contracts flagged RED - do not approve without legal review",
    ),
]
RULE_SETS = {"vendor": VENDOR_RULES, "bid": BID_RULES, "contract": CONTRACT_RULES}


def rule_recommendations(df: DataFrame, kind: str) -> DataFrame:
    return recommend(df, RULE_SETS[kind])
