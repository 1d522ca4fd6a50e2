"""Records: age, retention, archival, audit and version compliance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import flag, label_text, require, round_scaled, share_pct, with_defaults
from bidloom.operators.recommend import Rule

REQUIRED = ("record_id", "document_type")

# Years a document type is kept.
RETENTION_YEARS = {
    "Contract": 7,
    "Invoice": 7,
    "Purchase Order": 5,
    "RFQ Response": 3,
    "Vendor Agreement": 7,
    "Change Order": 5,
}


@dataclass(frozen=True)
class RecordSettings:
    retention: dict = field(default_factory=lambda: dict(RETENTION_YEARS))
    default_years: int = 7
    archive_after_days: int = 365
    high_priority_days: int = 730
    important_accesses: int = 20


DEFAULTS = RecordSettings()


def index(df: DataFrame, as_of: str, defaults: dict | None = None) -> DataFrame:
    require(df, *REQUIRED)
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date("creation_date"))
    out = with_defaults(df, defaults).withColumn("age_days", age)
    out = out.withColumn("age_years", round_scaled(F.col("age_days") / 365, 1))
    tags = F.concat_ws(
        ",",
        "document_type",
        "document_status",
        F.concat(F.lit("age_"), F.col("age_years").cast("int").cast("string"), F.lit("y")),
    )
    return out.withColumn("search_tags", tags)


def retention(df: DataFrame, s: RecordSettings = DEFAULTS) -> DataFrame:
    years = F
    for kind, kept in s.retention.items():
        years = years.when(F.col("document_type") == kind, F.lit(kept))
    out = df.withColumn("retention_period_years", years.otherwise(F.lit(s.default_years)))
    limit = F.col("retention_period_years")
    return out.withColumns(
        {
            "within_retention": flag(F.col("age_years") <= limit),
            "retention_expired": flag(F.col("age_years") > limit),
            "days_until_expiry": F.when(
                F.col("age_days").isNotNull(), F.greatest(limit * 365 - F.col("age_days"), F.lit(0))
            ),
        }
    )


def archival(df: DataFrame, s: RecordSettings = DEFAULTS) -> DataFrame:
    old = flag(F.col("age_days") > s.archive_after_days)
    candidate = old & F.col("within_retention") & flag(F.col("document_status") == "Active")
    out = df.withColumns({"archival_candidate": candidate, "deletion_candidate": F.col("retention_expired")})
    priority = (
        F.when(~F.col("archival_candidate"), "None")
        .when(F.col("age_days") > s.high_priority_days, "High")
        .otherwise("Medium")
    )
    return out.withColumn("archival_priority", priority)


def audit(df: DataFrame, as_of: str, s: RecordSettings = DEFAULTS) -> DataFrame:
    return df.withColumns(
        {
            "days_since_access": F.datediff(F.to_date(F.lit(as_of)), F.to_date("last_access_date")),
            "high_importance": flag(F.col("access_count") > s.important_accesses),
        }
    )


def version_check(df: DataFrame) -> DataFrame:
    within, pending = F.col("within_retention"), flag(F.col("document_status") == "Pending")
    latest = F.coalesce(F.col("is_latest_version"), F.lit(False))
    return df.withColumns(
        {
            "is_compliant": within & latest & ~pending,
            "compliance_issues": label_text(
                (~within, "Retention expired"), (~latest, "Outdated version"), (pending, "Pending status")
            ),
        }
    )


def analyze(df: DataFrame, as_of: str, s: RecordSettings = DEFAULTS, defaults: dict | None = None) -> DataFrame:
    kept = archival(retention(index(df, as_of, defaults), s), s)
    return version_check(audit(kept, as_of, s))


def _rate(condition: Column) -> Column:
    return F.coalesce(share_pct(F.count_if(condition), F.count("*")), F.lit(0.0))


def summary(detail: DataFrame) -> DataFrame:
    status = F.col("document_status")
    archivable = F.count_if("archival_candidate")
    potential = F.coalesce(F.try_divide(archivable, F.count("*")) * 100, F.lit(0.0)).cast("int").cast("string")
    return detail.agg(
        F.count("*").alias("total_records"),
        F.count_if(status == "Active").alias("status_active"),
        F.count_if(status == "Archived").alias("status_archived"),
        F.count_if(status == "Pending").alias("status_pending"),
        _rate(F.col("is_compliant")).alias("compliance_rate"),
        F.avg("age_years").alias("average_age_years"),
        archivable.alias("archival_candidates"),
        F.count_if("deletion_candidate").alias("deletion_candidates"),
        F.concat(potential, F.lit("%")).alias("storage_optimization_potential"),
    )


def by_type(detail: DataFrame) -> DataFrame:
    return detail.where(F.col("document_type").isNotNull()).groupBy("document_type").agg(F.count("*").alias("n_records"))


def result(detail: DataFrame) -> DataFrame:
    return detail.agg(
        F.count("*").alias("total_records"),
        F.count_if("is_compliant").alias("compliant_records"),
        F.count_if(~F.col("is_compliant")).alias("non_compliant"),
        F.count_if("archival_candidate").alias("archival_candidates"),
        F.count_if("deletion_candidate").alias("records_to_delete"),
        _rate(F.col("is_compliant")).alias("compliance_rate"),
    )


def _first_ten(name: str, priority: str, when: str, message: str, action: str) -> Rule:
    return Rule(name, priority, when, id_col="record_id", top=10, message=message, action=action)


# Recommendation texts.
RULES = [
    _first_ten(
        "archival", "Medium", "archival_candidate",
        "📦 ARCHIVAL: {count} records ready for archival - Free up active storage",
        "Move to archival storage system",
    ),
    _first_ten(
        "deletion", "High", "deletion_candidate",
        "🗑️  DELETION: {count} records past retention period - Delete per policy",
        "Schedule for secure deletion after legal review",
    ),
    _first_ten(
        "compliance", "High", "NOT is_compliant",
        "⚠️  COMPLIANCE: {count} records have compliance issues - Immediate action required",
        "Review and update to latest version or proper status",
    ),
    _first_ten(
        "version_update", "Medium", "NOT coalesce(is_latest_version, false)",
        "🔄 VERSION: {count} records need version update",
        "Update to latest version and archive old versions",
    ),
]
