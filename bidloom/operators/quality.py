"""Data-quality checks that run over whole tables.

Row checks return a reason column that is null where the value is fine, and
``violations`` turns several of them into one long table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import patterns as P
from bidloom.sources.staging import stage_table


def has_rows(df: DataFrame, minimum: int = 1) -> bool:
    """True when at least ``minimum`` rows exist; reads no further than that."""
    return df.limit(minimum).count() >= minimum


# ---- whole-column figures ---------------------------------------------------

def _long(df: DataFrame, aggregates: dict[str, Column], out: str) -> DataFrame:
    """One aggregate pass, then one row per column."""
    wide = df.agg(*[value.cast("bigint").alias(name) for name, value in aggregates.items()])
    entries = [F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias(out)) for name in aggregates]
    return wide.select(F.inline(F.array(*entries)))


def null_counts(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Nulls per column; a required column with nulls is an error, another a warning."""
    required = required or []
    counts = _long(df, {c: F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns}, "n_null")
    level = F.when(F.col("n_null") == 0, "ok").when(F.col("column").isin(required), "error").otherwise("warning")
    return counts.withColumn("level", level)


def non_numeric_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values per column that are present but do not read as a number."""
    checks = {c: F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()) for c in columns}
    return _long(df, checks, "n_bad")


def duplicate_key_counts(df: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """Rows after the first per key value; missing keys count as one value."""
    keys = [c for c in (candidates or P.KEY_COLUMNS) if c in df.columns]
    parts = []
    for key in keys:
        sizes = df.groupBy(key).agg(F.count("*").alias("n"))
        parts.append(
            sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates")).select(
                F.lit(key).alias("column"), "n_duplicates"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def format_report(df: DataFrame, row_number: str, rules: dict[str, str], shown: int = 5) -> DataFrame:
    """Values breaking a pattern: how many, and the first few row numbers."""
    tried = [
        F.struct(F.lit(c).alias("column"), format_reason(F.col(c), pattern).isNotNull().alias("bad"))
        for c, pattern in rules.items()
    ]
    # one scan finds all broken values; counts and first rows come from them
    bad = df.select(F.col(row_number).alias("_row"), F.inline(F.array(*tried))).where("bad").select("column", "_row")
    bad = stage_table(bad, "format-report")
    counts = bad.groupBy("column").agg(F.count("*").alias("n_bad"))
    # the planner cuts each partition to the first rows of a column before they move
    place = F.row_number().over(Window.partitionBy("column").orderBy("_row"))
    first = bad.withColumn("_place", place).where(F.col("_place") <= shown)
    rows = first.groupBy("column").agg(F.sort_array(F.collect_list("_row")).alias("first_rows"))
    columns = df.sparkSession.createDataFrame([(c,) for c in rules], "column string")
    found = columns.join(counts.join(rows, "column"), "column", "left")
    n_bad = F.coalesce("n_bad", F.lit(0))
    return found.select(
        "column",
        n_bad.alias("n_bad"),
        F.coalesce("first_rows", F.array().cast(rows.schema["first_rows"].dataType)).alias("first_rows"),
        F.greatest(n_bad - shown, F.lit(0)).alias("n_more"),
    )


# ---- row checks: null when fine, otherwise the reason -----------------------

def format_reason(value: Column, pattern: str) -> Column:
    """Anchored at the start only, as a prefix match; missing values are skipped."""
    return F.when(~value.cast("string").rlike(f"^(?:{pattern})"), F.lit("format"))


def numeric_reason(
    value: Column,
    minimum: float | None = None,
    maximum: float | None = None,
    allow_negative: bool = True,
    allow_zero: bool = True,
) -> Column:
    number = value.cast("double")
    reason = F.when(number.isNull() | F.isnan(number), F.lit("missing"))
    if not allow_negative:
        reason = reason.when(number < 0, F.lit("negative"))
    if not allow_zero:
        reason = reason.when(number == 0, F.lit("zero"))
    if minimum is not None:
        reason = reason.when(number < minimum, F.lit("below minimum"))
    if maximum is not None:
        reason = reason.when(number > maximum, F.lit("above maximum"))
    return reason


def percentage_reason(value: Column) -> Column:
    return numeric_reason(value, minimum=0, maximum=100, allow_negative=False)


def date_reason(text: Column, form: str = "yyyy-MM-dd", earliest: str | None = None, latest: str | None = None) -> Column:
    parsed = F.to_date(F.try_to_timestamp(text, F.lit(form)))
    reason = F.when(parsed.isNull(), F.lit("unreadable"))
    if earliest:
        reason = reason.when(parsed < F.to_date(F.lit(earliest)), F.lit("too early"))
    if latest:
        reason = reason.when(parsed > F.to_date(F.lit(latest)), F.lit("too late"))
    return reason


def date_order_reason(start: Column, end: Column, allow_same_day: bool = True) -> Column:
    wrong = end < start if allow_same_day else end <= start
    return F.when(wrong, F.lit("end before start"))


def email_reason(value: Column) -> Column:
    return F.when(value.isNull() | ~value.rlike(P.STRICT_EMAIL), F.lit("email"))


def phone_reason(value: Column, country: Column) -> Column:
    digits = F.regexp_replace(value, P.PHONE_SEPARATORS, "")
    good = F
    for code, pattern in P.PHONE_BY_COUNTRY.items():
        good = good.when(country == code, digits.rlike(pattern))
    good = good.otherwise(digits.rlike(P.PHONE_ELSEWHERE))
    return F.when(value.isNull() | ~good, F.lit("phone"))


def amount_reason(value: Column, minimum: float = 0, maximum: float | None = None) -> Column:
    return numeric_reason(value, minimum=minimum, maximum=maximum, allow_negative=False)


def currency_warning(code: Column) -> Column:
    return F.when(~code.isin(P.KNOWN_CURRENCIES), F.lit("unlisted currency"))


# ---- violation tables -------------------------------------------------------

@dataclass(frozen=True)
class Check:
    name: str
    column: str
    reason: Column


def violations(df: DataFrame, row_key: str, checks: list[Check]) -> DataFrame:
    """One row per broken check: (check, column, row_key, value, reason)."""
    found = [
        F.struct(
            F.lit(c.name).alias("check"),
            F.lit(c.column).alias("column"),
            F.col(row_key).cast("string").alias("row_key"),
            F.col(c.column).cast("string").alias("value"),
            c.reason.alias("reason"),
        )
        for c in checks
    ]
    return df.select(F.inline(F.array(*found))).where(F.col("reason").isNotNull())


def check_summary(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row per check: (check, column, n_rows, n_bad), in one pass."""
    wide = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(c.reason.isNotNull()).alias(f"bad_{i}") for i, c in enumerate(checks)],
    )
    rows = [
        F.struct(
            F.lit(c.name).alias("check"),
            F.lit(c.column).alias("column"),
            F.col("n_rows").alias("n_rows"),
            F.col(f"bad_{i}").alias("n_bad"),
        )
        for i, c in enumerate(checks)
    ]
    return wide.select(F.inline(F.array(*rows)))
