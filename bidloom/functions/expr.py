"""Small column helpers shared by every operator.

They fix the null rules once: a comparison with a missing value is false, a
clip keeps a missing value missing, and a division by zero gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """A boolean that is false where the condition is unknown."""
    return F.coalesce(condition, F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    bounded = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def pct_over(value: Column, base: Column) -> Column:
    """Percentage by which ``value`` lies above ``base``."""
    return F.try_divide(value - base, base) * 100


def share_pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def round_scaled(value: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value, as array libraries do it."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def points(*scored: tuple[Column, float]) -> Column:
    """Sum of the points whose condition holds."""
    return reduce(
        lambda total, pair: total + F.when(pair[0], F.lit(pair[1])).otherwise(F.lit(type(pair[1])(0))),
        scored[1:],
        F.when(scored[0][0], F.lit(scored[0][1])).otherwise(F.lit(type(scored[0][1])(0))),
    )


def count_true(*conditions: Column) -> Column:
    return points(*[(condition, 1) for condition in conditions])


def any_true(*conditions: Column) -> Column:
    return reduce(lambda left, right: left | right, [flag(c) for c in conditions])


def label_list(*labelled: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    # removal by value stays in generated code, a lambda filter would not
    return F.array_remove(F.array(*[F.when(cond, F.lit(text)).otherwise(F.lit("")) for cond, text in labelled]), "")


def label_text(*labelled: tuple[Column, str | Column]) -> Column:
    """The labels whose condition holds, joined with '; '."""
    return F.concat_ws(
        "; ",
        *[F.when(cond, text if isinstance(text, Column) else F.lit(text)) for cond, text in labelled],
    )


def band(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first step whose lower bound the value reaches."""
    chain = F
    for bound, name in steps:
        chain = chain.when(value >= F.lit(bound), F.lit(name))
    return chain.otherwise(F.lit(otherwise))


def last_match(default: Column | str, *rules: tuple[Column, str]) -> Column:
    """Ordered overwrite rules: the last one that holds decides."""
    chain = F
    for condition, name in reversed(rules):
        chain = chain.when(condition, F.lit(name))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def has(df: DataFrame, *names: str) -> bool:
    return all(name in df.columns for name in names)


def require(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def with_defaults(df: DataFrame, defaults: dict | None) -> DataFrame:
    """A stage's input: NaN as missing, absent optional columns as the caller's literals (never random)."""
    df = nan_to_null(df)
    absent = {name: F.lit(value) for name, value in (defaults or {}).items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn floating NaN into null, so that later comparisons treat it as missing."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    fixed = {name: F.when(~F.isnan(name), F.col(name)) for name in floats}
    return df.withColumns(fixed) if fixed else df
