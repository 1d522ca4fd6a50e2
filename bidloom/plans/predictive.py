"""Price, delay, demand and budget outlook per item."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import clip, flag, has, pct_over, require, share_pct, with_defaults
from bidloom.operators.recommend import Rule

REQUIRED = ("item_id", "current_price")


@dataclass(frozen=True)
class OutlookSettings:
    horizon_days: int = 90
    volatility_pct: float = 15
    price_trend_pct: float = 5
    demand_trend_pct: float = 10


DEFAULTS = OutlookSettings()


def _trend(value: Column, limit: float, up: str, down: str) -> Column:
    return F.when(value > limit, up).when(value < -limit, down).otherwise("Stable")


def price_outlook(df: DataFrame, s: OutlookSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    require(df, *REQUIRED)
    price = F.col("current_price")
    out = with_defaults(df, defaults).withColumns(
        {
            "price_change_3m_pct": pct_over(price, F.col("price_3m_ago")),
            "price_change_6m_pct": pct_over(price, F.col("price_6m_ago")),
        }
    )
    recent, older = F.col("price_change_3m_pct"), F.col("price_change_6m_pct")
    out = out.withColumns(
        {"predicted_price_change_pct": recent * 0.6 + older * 0.4, "price_volatility": F.abs(recent - older)}
    )
    change = F.col("predicted_price_change_pct")
    return out.withColumns(
        {
            "predicted_price": price * (1 + change / 100),
            "price_trend": _trend(change, s.price_trend_pct, "Increasing", "Decreasing"),
            "high_volatility": flag(F.col("price_volatility") > s.volatility_pct),
        }
    )


def delay_outlook(df: DataFrame) -> DataFrame:
    odds = (
        (100 - F.col("past_delivery_performance")) / 100 * 0.4
        + (100 - F.col("supplier_reliability_score")) / 100 * 0.3
        + (F.col("lead_time_days") / 90) * 0.2
        + F.col("high_volatility").cast("int") * 0.1
    )
    out = df.withColumn("delay_probability", clip(odds, 0, 1))
    p = F.col("delay_probability")
    return out.withColumns(
        {
            "expected_delay_days": (p * F.col("lead_time_days") * 0.3).cast("bigint"),
            "delay_risk": F.when(p > 0.6, "High").when(p > 0.3, "Medium").otherwise("Low"),
        }
    )


def demand_outlook(df: DataFrame, s: OutlookSettings = DEFAULTS) -> DataFrame:
    now = F.col("current_monthly_demand")
    growth = pct_over(now, F.col("demand_3m_ago"))
    return df.withColumns(
        {
            "demand_growth_rate": growth,
            "forecasted_demand": (now * (1 + growth / 100)).cast("bigint"),
            "demand_trend": _trend(growth, s.demand_trend_pct, "Growing", "Declining"),
        }
    )


def budget_outlook(df: DataFrame) -> DataFrame:
    out = df
    if not has(df, "allocated_budget"):
        out = out.withColumn("allocated_budget", F.col("current_price") * F.col("current_monthly_demand") * 3)
    out = out.withColumn("predicted_spend", F.col("predicted_price") * F.col("forecasted_demand") * 3)
    out = out.withColumn("budget_variance", F.col("predicted_spend") - F.col("allocated_budget"))
    odds = (
        F.when(F.col("price_trend") == "Increasing", 0.3).otherwise(0.0)
        + F.when(F.col("demand_trend") == "Growing", 0.2).otherwise(0.0)
        + F.col("delay_probability") * 0.3
        + F.when(F.col("high_volatility"), 0.2).otherwise(0.0)
    )
    out = out.withColumns(
        {
            "budget_variance_pct": share_pct(F.col("budget_variance"), F.col("allocated_budget")),
            "budget_overrun_probability": clip(odds, 0, 1),
        }
    )
    p = F.col("budget_overrun_probability")
    return out.withColumn("budget_risk", F.when(p > 0.7, "High").when(p > 0.4, "Medium").otherwise("Low"))


def analyze(df: DataFrame, s: OutlookSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    return budget_outlook(demand_outlook(delay_outlook(price_outlook(df, s, defaults)), s))


def summary(detail: DataFrame, s: OutlookSettings = DEFAULTS) -> DataFrame:
    return detail.agg(
        F.lit(s.horizon_days).alias("forecast_horizon_days"),
        F.count("*").alias("total_items_analyzed"),
        F.avg("predicted_price_change_pct").alias("average_price_change"),
        F.avg("delay_probability").alias("average_delay_probability"),
        F.sum("predicted_spend").alias("total_predicted_spend"),
        F.sum("allocated_budget").alias("total_budget_allocated"),
        F.sum("budget_variance").alias("overall_budget_variance"),
        F.count_if(F.col("price_trend") == "Increasing").alias("at_risk_price_increase"),
        F.count_if(F.col("delay_risk") == "High").alias("at_risk_high_delay"),
        F.count_if(F.col("budget_risk") == "High").alias("at_risk_budget_overrun"),
    )


def result(detail: DataFrame) -> DataFrame:
    return detail.agg(
        F.count("*").alias("total_items"),
        F.count_if(F.col("price_trend") == "Increasing").alias("items_with_price_increase"),
        F.count_if(F.col("delay_risk") == "High").alias("high_delay_risk_items"),
        F.count_if(F.col("budget_overrun_probability") > 0.7).alias("budget_overrun_risk"),
        F.avg("predicted_price_change_pct").alias("average_price_change_pct"),
    )


# Recommendation texts.
RULES = [
    Rule(
        "price_increase", "High", "price_trend = 'Increasing'", id_col="item_id", top=3,
        top_by=("-predicted_price_change_pct",),
        message="📈 PRICE ALERT: {count} items expected to increase - Consider bulk purchasing now",
        action="Accelerate procurement for high-increase items",
    ),
    Rule(
        "delay_risk", "High", "delay_risk = 'High'", id_col="item_id",
        message="⏱️  DELAY RISK: {count} items have high delay probability - Plan buffer time",
        action="Identify alternative suppliers or increase safety stock",
    ),
    Rule(
        "budget_overrun", "Critical", "budget_risk = 'High'", id_col="item_id", amount="budget_variance",
        message="💰 BUDGET ALERT: {count} items risk overrun of {amount}",
        action="Review and increase budget allocation or reduce demand",
    ),
    Rule(
        "opportunity", "Info", "price_trend = 'Decreasing'", id_col="item_id",
        message="✅ OPPORTUNITY: {count} items expected to decrease - Delay purchasing if possible",
        action="Wait for price decrease or negotiate better rates",
    ),
]
