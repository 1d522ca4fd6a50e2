"""Whole-table normalisation of the well-known date, money and score columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.functions.expr import clip
from bidloom.functions.text import currency_to_double, parse_date

# Column names that carry dates, money and 0-100 scores.
DATE_COLUMNS = ["registration_date", "delivery_date", "contract_date", "last_evaluation_date", "completion_date"]
MONEY_COLUMNS = ["contract_value", "quoted_price", "total_cost", "annual_turnover_cr", "invoice_amount"]
SCORE_COLUMNS = ["quality_score", "delivery_score", "compliance_score", "price_competitiveness", "overall_score"]


def normalize_data(df: DataFrame) -> DataFrame:
    """Normalise whichever of the known columns the table has."""
    types = {f.name: f.dataType for f in df.schema}
    changed = {}
    for name in DATE_COLUMNS:
        if name in types:
            text = isinstance(types[name], T.StringType)
            changed[name] = parse_date(F.col(name)) if text else F.to_date(name)
    for name in MONEY_COLUMNS:
        if name in types:
            text = isinstance(types[name], T.StringType)
            changed[name] = (
                currency_to_double(F.col(name)) if text else F.coalesce(F.col(name).cast("double"), F.lit(0.0))
            )
    for name in SCORE_COLUMNS:
        if name in types:
            changed[name] = clip(F.col(name).try_cast("double"), 0, 100)
    return df.withColumns(changed) if changed else df
