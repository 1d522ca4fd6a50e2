"""Purchase-order and contract documents as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.expr import flag, has, label_list, require
from bidloom.operators.ordering import row_positions

REQUIRED = ("vendor_id", "vendor_name", "amount")

# Default texts of the generated documents.
DEFAULT_ITEMS = "Supply of materials as per RFQ"
PENALTY_TEXT = "Penalty @ 0.5% per week delay"
TERMINATION_TEXT = "Termination with 30 days notice"
WARRANTY_TEXT = "12 months warranty"
LIABILITY_TEXT = "Limited to contract value"
PO_FIELDS = ["po_number", "vendor_id", "vendor_name", "amount", "payment_terms"]
CONTRACT_FIELDS = ["contract_number", "vendor_id", "vendor_name", "contract_value"]


@dataclass(frozen=True)
class DocumentSettings:
    small_invoice: float = 50_000
    medium_invoice: float = 500_000
    large_invoice: float = 5_000_000
    critical_invoice: float = 5_000_000
    delivery_days: int = 30
    contract_days: int = 365


DEFAULTS = DocumentSettings()


def _payment_days(s: DocumentSettings) -> Column:
    return F.when(F.col("amount") < s.small_invoice, "15").when(F.col("amount") < s.medium_invoice, "30").otherwise("45")


def _number(prefix: str, as_of: Column) -> Column:
    digits = F.col("_seq").cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.lit(prefix), F.date_format(as_of, "yyyyMMdd"), F.lit("-"), padded)


def numbered(df: DataFrame, order: list) -> DataFrame:
    """Rows with the sequence number that document numbers use, counted in ``order``."""
    require(df, *REQUIRED)
    return row_positions(df, order, "_seq")


def purchase_orders(rows: DataFrame, as_of: str, s: DocumentSettings = DEFAULTS) -> DataFrame:
    """``rows`` come from ``numbered``."""
    today = F.to_date(F.lit(as_of))
    items = F.col("items") if has(rows, "items") else F.lit(DEFAULT_ITEMS)
    return rows.select(
        F.lit("po").alias("doc_type"),
        _number("PO-", today).alias("po_number"),
        "vendor_id",
        "vendor_name",
        F.col("amount").cast("double").alias("amount"),
        today.alias("date"),
        F.date_add(today, s.delivery_days).alias("delivery_date"),
        F.concat(_payment_days(s), F.lit(" days")).alias("payment_terms"),
        items.alias("items"),
        flag(F.col("amount") > s.critical_invoice).alias("requires_approval"),
    )


def contracts(rows: DataFrame, as_of: str, s: DocumentSettings = DEFAULTS) -> DataFrame:
    today = F.to_date(F.lit(as_of))
    level = (
        F.when(F.col("amount") > s.critical_invoice, "Board")
        .when(F.col("amount") > s.large_invoice, "Director")
        .otherwise("Manager")
    )
    return rows.select(
        F.lit("contract").alias("doc_type"),
        _number("CONT-", today).alias("contract_number"),
        "vendor_id",
        "vendor_name",
        F.col("amount").cast("double").alias("contract_value"),
        today.alias("start_date"),
        F.date_add(today, s.contract_days).alias("end_date"),
        F.concat(F.lit("Payment within "), _payment_days(s), F.lit(" days")).alias("payment_clause"),
        F.lit(PENALTY_TEXT).alias("penalty_clause"),
        F.lit(TERMINATION_TEXT).alias("termination_clause"),
        F.lit(WARRANTY_TEXT).alias("warranty_clause"),
        F.lit(LIABILITY_TEXT).alias("liability_clause"),
        F.lit(True).alias("gcc_compliant"),
        F.lit(True).alias("scc_included"),
        level.alias("approval_level"),
    )


def both(rows: DataFrame, as_of: str, s: DocumentSettings = DEFAULTS) -> DataFrame:
    return purchase_orders(rows, as_of, s).unionByName(contracts(rows, as_of, s), allowMissingColumns=True)


def validate(docs: DataFrame) -> DataFrame:
    """Required fields and a positive amount, by the type of each row."""

    def errors(fields: list[str], amount: str) -> Column:
        missing = [(F.col(f).isNull() if f in docs.columns else F.lit(True), f"Missing {f}") for f in fields]
        positive = [(F.col(amount) <= 0, "Invalid amount")] if amount in docs.columns else []
        return label_list(*missing, *positive)

    found = F.when(F.col("doc_type") == "po", errors(PO_FIELDS, "amount")).otherwise(
        errors(CONTRACT_FIELDS, "contract_value")
    )
    out = docs.withColumn("validation_errors", found)
    return out.withColumn("is_valid", F.size("validation_errors") == 0)


def _value(docs: DataFrame) -> Column:
    return F.coalesce(*[F.col(c) for c in ("amount", "contract_value") if c in docs.columns])


def statistics(docs: DataFrame, s: DocumentSettings = DEFAULTS) -> DataFrame:
    value = _value(docs)
    return docs.agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total_value"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("average_value"),
        F.coalesce(F.max(value), F.lit(0.0)).alias("max_value"),
        F.coalesce(F.min(value), F.lit(0.0)).alias("min_value"),
        F.count_if(value > s.critical_invoice).alias("high_value_count"),
    )


def batch_result(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("total_documents"),
        F.count_if("is_valid").alias("valid_documents"),
        F.count_if(~F.col("is_valid")).alias("invalid_documents"),
    )
