"""Render table columns as report text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import formats

STYLES: dict[str, Callable[[Column], Column]] = {
    "currency": formats.currency,
    "usd": lambda c: formats.currency(c, "USD"),
    "compact": formats.currency_compact,
    "compact_usd": lambda c: formats.currency_compact(c, "USD"),
    "percentage": formats.percentage,
    "confidence": formats.confidence,
    "number": formats.western_number,
    "large_number": formats.large_number,
    "list": formats.list_text,
    **{f"date_{name}": (lambda c, n=name: formats.date_text(c, n)) for name in formats.DATE_STYLES},
}


def render(df: DataFrame, styles: dict[str, str | Callable[[Column], Column]]) -> DataFrame:
    """Replace each named column by its text; a style is a name or a column function."""
    shaped = {
        name: (STYLES[style] if isinstance(style, str) else style)(F.col(name)) for name, style in styles.items()
    }
    return df.withColumns(shaped)
