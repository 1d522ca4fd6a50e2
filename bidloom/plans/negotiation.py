"""Negotiation insight: price position, counter-offers, success odds, strategy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import clip, flag, last_match, label_text, pct_over, points, require, with_defaults
from bidloom.functions.formats import currency
from bidloom.operators.quantiles import group_quantiles
from bidloom.operators.recommend import Rule, recommend
from bidloom.operators.scalars import with_scalars

REQUIRED = ("vendor_id", "current_price")


@dataclass(frozen=True)
class NegotiationSettings:
    target_savings_pct: float = 10
    min_discount_pct: float = 5
    max_rounds: int = 3
    market_offer: float = 0.95


DEFAULTS = NegotiationSettings()


def price_position(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    require(df, *REQUIRED)
    price = F.col("current_price")
    return with_defaults(df, defaults).withColumns(
        {
            "price_vs_market_pct": pct_over(price, F.col("market_avg_price")),
            "price_trend_pct": pct_over(price, F.col("historical_avg_price")),
            "above_market": flag(price > F.col("market_avg_price")),
        }
    )


def counter_offers(df: DataFrame, s: NegotiationSettings = DEFAULTS) -> DataFrame:
    price = F.col("current_price")
    reduced = price * (1 - s.min_discount_pct / 100)
    target = F.when(F.col("above_market"), price * (1 - s.target_savings_pct / 100)).otherwise(reduced)
    out = df.withColumn("target_price", target)
    return out.withColumns(
        {
            "recommended_discount_pct": F.try_divide(price - F.col("target_price"), price) * 100,
            "potential_savings": price - F.col("target_price"),
            "conservative_offer": reduced,
            "aggressive_offer": F.col("market_avg_price") * s.market_offer,
        }
    )


def success_odds(df: DataFrame) -> DataFrame:
    over, discount = F.col("price_vs_market_pct"), F.col("recommended_discount_pct")
    odds = F.lit(0.5)
    for condition, step in [
        (over > 10, 0.2),
        (over > 20, 0.1),
        (F.col("price_trend_pct") < 0, 0.15),
        (discount < 10, 0.1),
        (discount > 20, -0.2),
    ]:
        odds = odds + F.when(condition, F.lit(step)).otherwise(F.lit(0.0))
    odds = odds + (F.col("vendor_relationship_score") - 70) / 100
    return df.withColumn("success_probability", clip(odds, 0.1, 0.95))


def negotiation_risk(df: DataFrame) -> DataFrame:
    signs = [
        (F.col("price_vs_market_pct") < -5, "Already below market", 30),
        (F.col("recommended_discount_pct") > 15, "Aggressive discount", 25),
        (F.col("vendor_relationship_score") < 70, "Weak relationship", 20),
        (F.col("price_trend_pct") < -10, "Price declining trend", 15),
    ]
    score = points(*[(c, p) for c, _, p in signs])
    return df.withColumns(
        {
            "risk_flags": label_text(*[(c, t) for c, t, _ in signs]),
            "risk_score": score,
            "risk_level": F.when(score >= 50, "High").when(score >= 30, "Medium").otherwise("Low"),
        }
    )


def strategy(df: DataFrame, s: NegotiationSettings = DEFAULTS) -> DataFrame:
    odds = F.col("success_probability")
    negotiable = flag((F.col("potential_savings") > 0) & (odds >= 0.3) & (F.col("risk_level") != "High"))
    out = df.withColumn("is_negotiable", negotiable)
    # Strategy texts.
    text = (
        F.when(
            ~F.col("is_negotiable"),
            F.lit("Not recommended for negotiation. Accept current price or seek alternatives."),
        )
        .when(
            odds >= 0.7,
            F.concat(
                F.lit("Start with aggressive offer at "),
                currency(F.col("aggressive_offer")),
                F.lit(". High success probability."),
            ),
        )
        .when(
            odds >= 0.4,
            F.concat(
                F.lit("Start with conservative offer at "),
                currency(F.col("conservative_offer")),
                F.lit(f". Negotiate gradually over {s.max_rounds} rounds."),
            ),
        )
        .otherwise(
            F.lit(
                "Limited negotiation potential. Focus on non-price terms (payment, delivery). "
                f"Maximum discount: {s.min_discount_pct:g}%"
            )
        )
    )
    approach = last_match(
        "Conservative Negotiation",
        (odds >= 0.5, "Standard Negotiation"),
        (odds >= 0.7, "Aggressive Negotiation"),
        (~F.col("is_negotiable"), "No Negotiation"),
    )
    return out.withColumns({"strategy": text, "recommended_approach": approach})


def analyze(df: DataFrame, s: NegotiationSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    chain = counter_offers(price_position(df, defaults), s)
    return strategy(negotiation_risk(success_odds(chain)), s)


def market_benchmark(df: DataFrame) -> DataFrame:
    price = F.col("current_price")
    spread = F.try_divide(F.max(price) - F.min(price), F.avg(price)) * 100
    base = [
        F.avg(price).alias("market_average"),
        F.stddev_pop(price).alias("market_std"),
        F.min(price).alias("lowest_price"),
        F.max(price).alias("highest_price"),
        spread.alias("price_range_pct"),
    ]
    return group_quantiles(df, "current_price", {"market_median": 0.5}, None, base)


def result(detail: DataFrame) -> DataFrame:
    return detail.agg(
        F.count("*").alias("total_vendors"),
        F.count_if("is_negotiable").alias("negotiable_vendors"),
        F.sum("potential_savings").alias("total_potential_savings"),
        F.avg("recommended_discount_pct").alias("average_discount_achievable"),
        F.count_if(F.col("success_probability") >= 0.7).alias("high_success_probability"),
    )


# Recommendation texts.
RULES = [
    Rule(
        "high_value", "High", "is_negotiable AND potential_savings > _q75",
        id_col="vendor_id", amount="potential_savings", top=3, top_by=("-potential_savings",), top_only=True,
        message="💰 TOP PRIORITY: Negotiate with {count} vendors for potential savings of {amount}",
    ),
    Rule(
        "quick_wins", "Medium", "success_probability >= 0.7D AND is_negotiable", id_col="vendor_id",
        message="✅ QUICK WINS: {count} vendors with high success probability (≥70%)",
    ),
    Rule(
        "risk_warning", "Warning", "risk_level = 'High'", id_col="vendor_id",
        message="⚠️  CAUTION: {count} vendors flagged as HIGH RISK - Consider alternative strategies",
    ),
    Rule(
        "market_insight", "Info", "above_market", mean="price_vs_market_pct",
        message="📊 MARKET INSIGHT: {count} vendors priced {mean:1}% above market - Strong negotiation leverage",
    ),
]


def recommendations(detail: DataFrame) -> DataFrame:
    q75 = group_quantiles(detail, "potential_savings", {"_q75": 0.75}, None)
    return recommend(with_scalars(detail, q75), RULES)
