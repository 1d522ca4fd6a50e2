"""Change orders: validity, cost, timeline and budget impact, approval routing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import flag, has, label_text, last_match, require, share_pct, with_defaults
from bidloom.operators.recommend import Rule

REQUIRED = ("change_order_id", "contract_id", "change_cost")


@dataclass(frozen=True)
class ChangeSettings:
    cost_variance_pct: float = 10
    time_variance_pct: float = 15
    auto_approve: float = 500_000
    manager_limit: float = 2_000_000
    director_limit: float = 10_000_000


DEFAULTS = ChangeSettings()


def validate(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    require(df, *REQUIRED)
    out = with_defaults(df, defaults).withColumn(
        "validation_errors",
        label_text((F.col("change_cost") <= 0, "Invalid cost"), (F.col("contract_id").isNull(), "Missing contract ID")),
    )
    return out.withColumn("is_valid", F.col("validation_errors") == "")


def cost_impact(df: DataFrame, s: ChangeSettings = DEFAULTS) -> DataFrame:
    cost, original = F.col("change_cost"), F.col("original_contract_value")
    out = df if has(df, "cumulative_changes") else df.withColumn("cumulative_changes", cost)
    variance = share_pct(cost, original)
    return out.withColumns(
        {
            "cost_variance_pct": variance,
            "new_contract_value": original + cost,
            "cumulative_variance_pct": share_pct(F.col("cumulative_changes"), original),
            "significant_cost_impact": flag(variance > s.cost_variance_pct),
        }
    )


def timeline_impact(df: DataFrame, s: ChangeSettings = DEFAULTS) -> DataFrame:
    extra, original = F.col("timeline_extension_days"), F.col("original_timeline_days")
    variance = share_pct(extra, original)
    return df.withColumns(
        {
            "timeline_variance_pct": variance,
            "new_timeline_days": original + extra,
            "significant_timeline_impact": flag(variance > s.time_variance_pct),
        }
    )


def budget_impact(df: DataFrame) -> DataFrame:
    used = share_pct(F.col("new_contract_value"), F.col("project_budget"))
    return df.withColumns(
        {
            "budget_utilization_pct": used,
            "budget_overrun": flag(used > 100),
            "remaining_budget": F.col("project_budget") - F.col("new_contract_value"),
        }
    )


def route(df: DataFrame, s: ChangeSettings = DEFAULTS) -> DataFrame:
    cost, valid, overrun = F.col("change_cost"), F.col("is_valid"), F.col("budget_overrun")
    by_cost, by_time = F.col("cost_variance_pct"), F.col("timeline_variance_pct")
    automatic = (cost <= s.auto_approve) & valid & ~overrun
    manager = (cost > s.auto_approve) & (cost <= s.manager_limit) & ~overrun
    director = ((cost > s.manager_limit) & (cost <= s.director_limit)) | F.col("significant_cost_impact")
    board = (cost > s.director_limit) | overrun
    return df.withColumns(
        {
            "impact_level": last_match(
                "Low",
                ((by_cost > 5) | (by_time > 10), "Medium"),
                ((by_cost > 15) | (by_time > 20) | overrun, "High"),
            ),
            "approval_status": last_match(
                "Pending",
                (automatic, "Auto-Approved"),
                (manager | director | board, "Review Required"),
                (~valid, "Rejected"),
            ),
            "approval_level": last_match(
                "Manager", (automatic, "System"), (manager, "Manager"), (director, "Director"), (board, "Board")
            ),
        }
    )


def analyze(df: DataFrame, s: ChangeSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    return route(budget_impact(timeline_impact(cost_impact(validate(df, defaults), s), s)), s)


def most_common_reason(detail: DataFrame) -> DataFrame:
    """Most frequent reason, ties to the smallest; 'N/A' without any."""
    sizes = detail.where(F.col("change_reason").isNotNull()).groupBy("change_reason").agg(F.count("*").alias("n"))
    # the smallest (-n, reason) is the most frequent reason, then the first by name
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("change_reason").alias("reason")))
    return sizes.agg(F.coalesce(best.getField("reason"), F.lit("N/A")).alias("most_common_reason"))


def summary(detail: DataFrame) -> DataFrame:
    """Figures of all change orders, rolled up from those per reason."""
    mean_of = {"average_cost_variance": "cost_variance_pct", "average_timeline_extension": "timeline_extension_days"}
    automatic = F.count_if(F.col("approval_status") == "Auto-Approved")
    by_reason = detail.groupBy("change_reason").agg(
        F.count("*").alias("_n"),
        automatic.alias("_automatic"),
        F.sum("change_cost").alias("_cost"),
        F.count_if("budget_overrun").alias("_overrun"),
        *[F.sum(c).alias(f"_sum_{c}") for c in mean_of.values()],
        *[F.count(c).alias(f"_count_{c}") for c in mean_of.values()],
    )
    # the smallest (-n, reason) is the most frequent reason, then the first by name
    best = F.min(F.when(F.col("change_reason").isNotNull(), F.struct((-F.col("_n")).alias("n"), "change_reason")))
    means = [
        F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_count_{c}")).cast("double").alias(out) for out, c in mean_of.items()
    ]
    return by_reason.agg(
        F.sum("_cost").alias("total_cost_impact"),
        *means,
        F.coalesce(F.sum("_overrun"), F.lit(0)).alias("budget_overrun_count"),
        F.coalesce(share_pct(F.sum("_automatic"), F.sum("_n")), F.lit(0.0)).alias("auto_approval_rate"),
        F.coalesce(best.getField("change_reason"), F.lit("N/A")).alias("most_common_reason"),
    )


def result(detail: DataFrame) -> DataFrame:
    status = F.col("approval_status")
    return detail.agg(
        F.count("*").alias("total_change_orders"),
        F.count_if(status == "Auto-Approved").alias("approved_count"),
        F.count_if(status == "Review Required").alias("review_required"),
        F.count_if(status == "Rejected").alias("rejected_count"),
        F.sum("change_cost").alias("total_cost_impact"),
        F.avg("cost_variance_pct").alias("average_cost_variance"),
        F.count_if(F.col("impact_level") == "High").alias("high_impact_changes"),
    )


# Recommendation texts.
RULES = [
    Rule(
        "high_impact", "Critical", "impact_level = 'High'", id_col="change_order_id", amount="change_cost",
        message=(
            "🚨 CRITICAL: {count} high-impact change orders worth {amount} - Requires senior management review"
        ),
    ),
    Rule(
        "budget_overrun", "High", "budget_overrun", id_col="change_order_id",
        message="⚠️  WARNING: {count} change orders cause budget overruns - Immediate action required",
    ),
    Rule(
        "auto_approved", "Info", "approval_status = 'Auto-Approved'", id_col="change_order_id",
        amount="change_cost",
        message="✅ {count} change orders auto-approved - Total: {amount}",
    ),
    Rule(
        "timeline_impact", "Medium", "significant_timeline_impact", id_col="change_order_id",
        mean="timeline_extension_days",
        message="⏱️  {count} change orders impact timeline - Avg extension: {mean:0} days",
    ),
]
