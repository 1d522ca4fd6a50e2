"""Entity risk in four dimensions, overall score and mitigation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import band, clip, flag, require, round_scaled, with_defaults
from bidloom.operators.recommend import Rule

REQUIRED = ("entity_id", "entity_type")

# Risk points per certification status, and the order of the areas.
CERTIFICATION_RISK = {"Valid": 0, "Pending": 30, "Expired": 60}
AREAS = ("Financial", "Delivery", "Compliance", "Performance")


@dataclass(frozen=True)
class RiskSettings:
    financial: float = 0.30
    delivery: float = 0.25
    compliance: float = 0.25
    performance: float = 0.20
    high_risk: float = 70
    medium_risk: float = 40
    urgent_financial: float = 80
    urgent_violations: int = 3


DEFAULTS = RiskSettings()


def financial_risk(df: DataFrame) -> DataFrame:
    score = (
        ((850 - F.col("credit_score")) / 850 * 100) * 0.4
        + clip(F.col("debt_to_equity") / 4.0 * 100, 0, 100) * 0.35
        + clip((3.0 - F.col("liquidity_ratio")) / 3.0 * 100, 0, 100) * 0.25
    )
    return df.withColumn("financial_risk_score", clip(score, 0, 100))


def delivery_risk(df: DataFrame) -> DataFrame:
    score = (
        (100 - F.col("on_time_delivery_pct")) * 0.5
        + clip(F.col("average_delay_days") / 30 * 100, 0, 100) * 0.3
        + (F.col("project_complexity_score") / 10 * 100) * 0.2
    )
    return df.withColumn("delivery_risk_score", clip(score, 0, 100))


def compliance_risk(df: DataFrame) -> DataFrame:
    """An unknown certification status leaves the score unknown."""
    certificate = F
    for status, value in CERTIFICATION_RISK.items():
        certificate = certificate.when(F.col("certification_status") == status, F.lit(value))
    score = (
        clip(F.col("compliance_violations") / 5 * 100, 0, 100) * 0.4
        + (100 - F.col("audit_score")) * 0.4
        + certificate * 0.2
    )
    return df.withColumn("compliance_risk_score", clip(score, 0, 100))


def performance_risk(df: DataFrame) -> DataFrame:
    score = (
        (100 - F.col("quality_score")) * 0.4
        + clip(F.col("defect_rate_pct") / 10 * 100, 0, 100) * 0.35
        + (100 - F.col("customer_satisfaction")) * 0.25
    )
    return df.withColumn("performance_risk_score", clip(score, 0, 100))


def overall_risk(df: DataFrame, s: RiskSettings = DEFAULTS) -> DataFrame:
    mix = (
        F.col("financial_risk_score") * s.financial
        + F.col("delivery_risk_score") * s.delivery
        + F.col("compliance_risk_score") * s.compliance
        + F.col("performance_risk_score") * s.performance
    )
    return df.withColumn("overall_risk_score", round_scaled(mix, 2))


def classify(df: DataFrame, s: RiskSettings = DEFAULTS) -> DataFrame:
    out = df.withColumn(
        "risk_level", band(F.col("overall_risk_score"), [(s.high_risk, "High"), (s.medium_risk, "Medium")], "Low")
    )
    urgent = (
        (F.col("risk_level") == "High")
        | flag(F.col("financial_risk_score") >= s.urgent_financial)
        | flag(F.col("compliance_violations") >= s.urgent_violations)
    )
    scores = {area: F.col(f"{area.lower()}_risk_score") for area in AREAS}
    top = F.greatest(*scores.values())
    area = F
    for name, score in scores.items():
        area = area.when(score == top, F.lit(name))
    return out.withColumns({"requires_immediate_action": urgent, "primary_risk_area": area})


def analyze(df: DataFrame, s: RiskSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    require(df, *REQUIRED)
    out = with_defaults(df, defaults)
    for step in (financial_risk, delivery_risk, compliance_risk, performance_risk):
        out = step(out)
    return classify(overall_risk(out, s), s)


def distribution(detail: DataFrame) -> DataFrame:
    levels = [
        F.count_if(F.col("risk_level") == level).alias(f"level_{level.lower()}") for level in ("High", "Medium", "Low")
    ]
    areas = [F.count_if(F.col("primary_risk_area") == area).alias(f"area_{area.lower()}") for area in AREAS]
    means = [F.avg(f"{area.lower()}_risk_score").alias(f"mean_{area.lower()}") for area in AREAS]
    return detail.agg(*levels, *areas, *means)


def result(detail: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    return detail.agg(
        F.count("*").alias("total_entities"),
        F.count_if(level == "High").alias("high_risk_count"),
        F.count_if(level == "Medium").alias("medium_risk_count"),
        F.count_if(level == "Low").alias("low_risk_count"),
        F.avg("overall_risk_score").alias("average_risk_score"),
        F.count_if("requires_immediate_action").alias("critical_risks"),
    )


# Mitigation actions.
ACTIONS = {
    "High": [
        "Conduct immediate risk assessment meeting",
        "Request updated financial statements",
        "Implement enhanced monitoring",
        "Consider contract restructuring",
        "Activate contingency plans",
    ],
    "Financial": [
        "Request bank guarantees or performance bonds",
        "Implement milestone-based payments",
        "Reduce credit exposure",
        "Monitor financial health monthly",
    ],
    "Compliance": [
        "Conduct compliance audit",
        "Require immediate certification renewal",
        "Implement compliance training",
        "Increase inspection frequency",
    ],
    "Delivery": [
        "Add penalty clauses for delays",
        "Request detailed project timeline",
        "Implement weekly progress reviews",
        "Identify backup vendors",
    ],
}


def _mitigation(name: str, priority: str, when: str) -> Rule:
    return Rule(name, priority, when, id_col="entity_id", action="; ".join(ACTIONS[name]))


RULES = [
    _mitigation("High", "Critical", "risk_level = 'High'"),
    _mitigation("Financial", "High", "primary_risk_area = 'Financial'"),
    _mitigation("Compliance", "High", "primary_risk_area = 'Compliance'"),
    _mitigation("Delivery", "Medium", "primary_risk_area = 'Delivery'"),
]
