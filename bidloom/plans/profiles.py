"""Joins of master data with the tables that refer to it.

Many-sided tables are aggregated to one row per key before the join, so a key
with very many rows is combined in partial aggregates and nothing fans out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.plans.shortlist import category
from bidloom.sources.staging import attach


def vendor_profile(vendors: DataFrame, contracts: DataFrame, projects: DataFrame, scores: DataFrame) -> DataFrame:
    """Vendor row with contract and project figures and the predictive scores."""
    key = ["vendor_id"]
    by_contract = contracts.groupBy("vendor_id").agg(
        F.count("*").alias("n_contracts"),
        F.sum("contract_value").alias("contract_total"),
        F.max("end_date").alias("last_contract_end"),
    )
    by_project = projects.groupBy("vendor_id").agg(
        F.count("*").alias("n_projects"),
        F.sum("project_value").alias("project_total"),
        F.avg("performance_rating").alias("mean_rating"),
    )
    out = attach(attach(vendors, by_contract, key, "by-contract"), by_project, key, "by-project")
    out = out.fillna(0, subset=["n_contracts", "n_projects"])
    return out.join(scores, key, "left")


def awarded_bids(bids: DataFrame, vendors: DataFrame, negotiations: DataFrame) -> DataFrame:
    """Awarded bids with vendor details and the vendor's negotiation figures."""
    by_vendor = negotiations.groupBy("vendor_id").agg(
        F.count("*").alias("n_negotiations"),
        F.max(F.struct("negotiation_date", "negotiation_id", "negotiated_price", "savings_percentage")).alias("_last"),
    )
    latest = by_vendor.select(
        "vendor_id",
        "n_negotiations",
        F.col("_last.negotiation_id").alias("negotiation_id"),
        F.col("_last.negotiated_price").alias("negotiated_price"),
        F.col("_last.savings_percentage").alias("savings_percentage"),
    )
    awarded = bids.where(F.col("status") == "AWARDED")
    return attach(awarded.join(vendors, "vendor_id"), latest, ["vendor_id"], "negotiations")


def change_with_contract(change_orders: DataFrame, contracts: DataFrame) -> DataFrame:
    """Change orders next to the contract they amend; contract ids are unique."""
    return change_orders.join(contracts, "contract_id")


def vendor_scorecard(vendors: DataFrame, scores: DataFrame) -> DataFrame:
    """The vendor's scores, their mean as overall rating, and the rating band."""
    joined = vendors.join(scores, "vendor_id", "left")
    rating = (F.col("quality_score") + F.col("delivery_score") + F.col("compliance_score")) / 3
    return joined.withColumn("overall_rating", rating).select(
        "vendor_id",
        "overall_rating",
        "quality_score",
        "delivery_score",
        "compliance_score",
        "risk_score",
        F.upper(category(F.col("overall_rating"))).alias("rating"),
    )


# The master fields an approval run may overwrite.
UPDATED_FIELDS = ["status", "empanelment_tier", "registration_date"]


#: what orders the changes of one vendor
CHANGE_ORDER = ["changed_at", "change_id"]


def latest_changes(changes: DataFrame, fields: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per vendor: of each field the last value given, as if the changes came one after another."""
    place = F.struct(*[F.col(c) for c in order or CHANGE_ORDER])
    given = [F.max_by(f, F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields or UPDATED_FIELDS]
    return changes.groupBy("vendor_id").agg(*given)


def update_master(
    master: DataFrame, changes: DataFrame, fields: list[str] | None = None, order: list[str] | None = None
) -> DataFrame:
    """New snapshot of the master: the last given new value replaces the old one.

    Changes are ordered by ``order``, (timestamp, id) unless given; where the
    table has no such columns a vendor has one change at most. Changes of
    vendors that the master lacks have no effect, and no master row is doubled.
    """
    fields = fields or UPDATED_FIELDS
    order = [c for c in order or CHANGE_ORDER if c in changes.columns] or fields
    fresh = latest_changes(changes, fields, order).select("vendor_id", *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = master.join(fresh, "vendor_id", "left")
    return joined.withColumns({f: F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f in fields}).drop(
        *[f"_new_{f}" for f in fields]
    )
