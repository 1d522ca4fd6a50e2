"""Report text for amounts, percentages, dates, numbers and lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency symbols and date styles of the rendered reports.
CURRENCY_SYMBOLS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£", "AED": "AED "}
COMPACT_SYMBOLS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£"}
DATE_STYLES = {
    "standard": "dd-MMM-yyyy",
    "short": "dd/MM/yyyy",
    "long": "d MMMM yyyy",
    "iso": "yyyy-MM-dd",
    "datetime": "dd-MMM-yyyy HH:mm",
}
COMPACT_STEPS = {
    "INR": [(1e7, "Cr"), (1e5, "L"), (1e3, "K")],
    "western": [(1e9, "B"), (1e6, "M"), (1e3, "K")],
}


def _symbol(currency: Column | str, table: dict[str, str]) -> Column:
    if isinstance(currency, str):
        return F.lit(table.get(currency, currency + " "))
    chain = F
    for code, mark in table.items():
        chain = chain.when(currency == code, F.lit(mark))
    return chain.otherwise(F.concat(currency, F.lit(" ")))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rounded(fraction: Column, scale: float) -> Column:
    """``fraction * scale`` to the nearest whole number, ties to even, judged before the product is rounded.

    Only a product that comes out as a tie can lie on its other side; what it lost
    is the sum of the exact products of the fraction's two halves.
    """
    product = fraction * scale
    large = fraction * F.lit(134217729.0)
    high = large - (large - fraction)
    lost = (high * scale - product) + (fraction - high) * scale
    below = F.floor(product).cast("double")
    tie = product - below == 0.5
    return F.when(tie & (lost > 0), below + 1).when(tie & (lost < 0), below).otherwise(F.rint(product))


def fixed_text(value: Column, decimals: int) -> Column:
    """Plain digits with a fixed number of decimals (at most 7), rounded as the exact value is.

    Whole part and fraction are rounded apart, since a fraction is exact.
    """
    size = F.abs(value.cast("double"))
    sign = F.when(value < 0, "-").otherwise("")
    if decimals == 0:
        return F.concat(sign, F.format_string("%.0f", F.rint(size)))
    scale = float(10**decimals)

    def digits(size: Column, units: Column) -> Column:
        whole = F.floor(size) + F.floor(units / scale)
        rest = F.lpad((units % scale).cast("bigint").cast("string"), decimals, "0")
        return F.concat(whole.cast("string"), F.lit("."), rest)

    # both are named, since the code of a repeated expression outgrows what the JVM compiles
    text = _named(size, lambda s: _named(s - F.floor(s), lambda f: _named(_rounded(f, scale), lambda u: digits(s, u))))
    return F.concat(sign, text)


def _grouped(text: Column, decimals: int, rest: str) -> Column:
    """Commas before each run of ``rest`` digits that ends the whole part."""
    end = r"\." if decimals else "$"
    return F.regexp_replace(text, rf"(\d)(?={rest}{end})", "$1,")


def indian_number(value: Column, decimals: int = 2) -> Column:
    """12,34,567.00: the last three digits, then pairs."""
    return F.when(value.isNotNull(), _grouped(fixed_text(value, decimals), decimals, r"(\d\d)+\d"))


def western_number(value: Column, decimals: int = 0, separators: bool = True) -> Column:
    text = fixed_text(value, decimals)
    return F.when(value.isNotNull(), _grouped(text, decimals, r"(\d\d\d)+") if separators else text)


def currency(value: Column, code: Column | str = "INR", decimals: int = 2, symbol: bool = True) -> Column:
    mark = _symbol(code, CURRENCY_SYMBOLS) if symbol else F.lit("")
    if isinstance(code, str):
        number = indian_number(value, decimals) if code == "INR" else western_number(value, decimals)
    else:
        number = F.when(code == "INR", indian_number(value, decimals)).otherwise(western_number(value, decimals))
    return F.concat(mark, number)


def _suffixed(value: Column, steps: list[tuple[float, str]], decimals: int, plain: int) -> Column:
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for size, suffix in steps:
        chain = chain.when(value >= size, F.concat(fixed_text(value / F.lit(size), decimals), F.lit(suffix)))
    return chain.otherwise(fixed_text(value, plain))


def currency_compact(value: Column, code: str = "INR") -> Column:
    steps = COMPACT_STEPS.get(code, COMPACT_STEPS["western"])
    return F.concat(_symbol(code, COMPACT_SYMBOLS), _suffixed(value, steps, 2, 2))


def percentage(value: Column, decimals: int = 2, symbol: bool = True) -> Column:
    text = F.when(value.isNotNull(), fixed_text(value, decimals))
    return F.concat(text, F.lit("%")) if symbol else text


def confidence(score: Column) -> Column:
    name = F.when(score >= 0.8, "High").when(score >= 0.6, "Medium").otherwise("Low")
    return F.when(score.isNotNull(), F.concat(name, F.lit(" ("), fixed_text(F.rint(score * 100), 0), F.lit("%)")))


def date_text(value: Column, style: str = "standard") -> Column:
    return F.date_format(value, DATE_STYLES.get(style, DATE_STYLES["standard"]))


def date_range(start: Column, end: Column, style: str = "standard") -> Column:
    return F.concat(date_text(start, style), F.lit(" to "), date_text(end, style))


def large_number(value: Column) -> Column:
    return _suffixed(value, COMPACT_STEPS["western"], 1, 0)


def list_text(items: Column, max_items: int = 10, delimiter: str = ", ") -> Column:
    shown = F.array_join(F.slice(items, 1, max_items), delimiter)
    total = F.size(items)
    return F.when(
        total > max_items, F.concat(shown, F.lit("... ("), total.cast("string"), F.lit(" total)"))
    ).otherwise(shown)
