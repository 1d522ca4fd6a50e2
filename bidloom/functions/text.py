"""Text, amount and date cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven accepted date formats, tried in this order.
DATE_FORMATS = ["d-M-yyyy", "d/M/yyyy", "yyyy-M-d", "yyyy/M/d", "d-MMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy"]

# Shape check per format: keeps a lenient parser from taking another layout.
_DATE_SHAPES = [
    r"^\d{1,2}-\d{1,2}-\d{4}$",
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{4}-\d{1,2}-\d{1,2}$",
    r"^\d{4}/\d{1,2}/\d{1,2}$",
    r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    r"^\d{1,2} [A-Za-z]+ \d{4}$",
    r"^[A-Za-z]+ \d{1,2}, \d{4}$",
]
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(value: Column) -> Column:
    """Drop all leading and trailing whitespace, line breaks included."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _squeeze(value: Column) -> Column:
    """Blank-line runs to one, space runs to one, ASCII only."""
    lines = F.regexp_replace(value, r"(?U)\n\s*\n", "\n\n")
    spaces = F.regexp_replace(lines, r"[ \t]+", " ")
    return F.regexp_replace(spaces, r"[^\x00-\x7F]+", "")


def clean_text(value: Column) -> Column:
    """Normalised ASCII text; the symbols ®©™ go with the non-ASCII step."""
    unix = F.regexp_replace(_squeeze(value), r"\r\n?", "\n")
    return F.coalesce(strip(unix), F.lit(""))


def clean_ocr_text(value: Column) -> Column:
    """As ``clean_text``, but line endings inside the text stay as scanned."""
    return F.coalesce(strip(_squeeze(value)), F.lit(""))


def currency_to_double(value: Column) -> Column:
    """'₹2,50,000' to 250000.0; anything unreadable or missing is 0."""
    bare = strip(F.regexp_replace(value.cast("string"), r"₹|Rs\.|,", ""))
    readable = F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
    return F.coalesce(readable, F.lit(0.0))


def parse_date(value: Column) -> Column:
    """The first accepted format that reads the text as a real date, else null."""
    text = strip(value.cast("string"))
    tries = [
        F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(form))))
        for form, shape in zip(DATE_FORMATS, _DATE_SHAPES, strict=True)
    ]
    return F.coalesce(*tries)
