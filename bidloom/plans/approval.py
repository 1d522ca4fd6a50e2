"""Vendor development: scoring and approval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import last_match, require, share_pct, with_defaults
from bidloom.operators.quantiles import group_quantiles

REQUIRED = ("vendor_id", "vendor_name")


@dataclass(frozen=True)
class ApprovalSettings:
    financial: float = 0.30
    compliance: float = 0.25
    performance: float = 0.25
    delivery: float = 0.20
    approve_at: float = 80
    min_compliance: float = 60
    min_financial: float = 50
    reject_below: float = 60


DEFAULTS = ApprovalSettings()


def final_scores(df: DataFrame, s: ApprovalSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    require(df, *REQUIRED)
    mix = (
        F.col("financial_score") * s.financial
        + F.col("compliance_score") * s.compliance
        + F.col("performance_score") * s.performance
        + F.col("delivery_score") * s.delivery
    )
    return with_defaults(df, defaults).withColumn("final_score", mix)


def approve(df: DataFrame, s: ApprovalSettings = DEFAULTS) -> DataFrame:
    status = last_match(
        "pending",
        (F.col("final_score") >= s.approve_at, "approved"),
        (F.col("compliance_score") < s.min_compliance, "rejected"),
        (F.col("financial_score") < s.min_financial, "rejected"),
        (F.col("final_score") < s.reject_below, "rejected"),
    )
    return df.withColumns({"status": status, "confidence": F.col("final_score") / 100})


def assess(df: DataFrame, s: ApprovalSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    return approve(final_scores(df, s, defaults), s)


def statistics(detail: DataFrame) -> DataFrame:
    n = F.count("*")
    approved = F.count_if(F.col("status") == "approved")
    counts = [
        n.alias("total_vendors"),
        approved.alias("approved_count"),
        F.count_if(F.col("status") == "rejected").alias("rejected_count"),
        F.count_if(F.col("status") == "pending").alias("pending_count"),
        F.coalesce(share_pct(approved, n), F.lit(0.0)).alias("approval_rate"),
        F.avg("final_score").alias("average_score"),
        F.stddev_samp("final_score").alias("std_score"),
    ]
    return group_quantiles(detail, "final_score", {"median_score": 0.5}, also=counts)


def top_vendors(detail: DataFrame, k: int = 5) -> DataFrame:
    ordered = detail.orderBy(F.desc_nulls_last("final_score"), "vendor_id").limit(k)
    return ordered.select("vendor_id", "vendor_name", "final_score", "status")
