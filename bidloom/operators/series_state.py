"""Forecasts of series that grow: a small state per series, extended by what is new.

The state of a stretch of points holds their number, the sums that a straight
line needs, the last values, and exponential smoothing as the map it makes of the
level before it (``level -> weight * level + shift``). States of neighbouring
stretches compose, so adding a month reads that month and the stored states only,
and gives what all points together give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.operators.forecast import ALPHA, METHODS, MIN_POINTS, WINDOW, next_dates
from bidloom.operators.ordering import row_positions
from bidloom.sources.staging import stage_table

#: columns of a state besides the series
FIELDS = ["n", "first_ts", "last_ts", "first", "tail", "sum", "place_sum", "weight", "shift", "weight_before", "shift_before"]


def summarize(
    df: DataFrame, series: str = "series_id", ts: str = "ts", value: str = "value", alpha: float = ALPHA
) -> DataFrame:
    """One state for each series of the points given. Points without a value count as none.

    The order is that of ``ts``, then value. Positions come from a distributed
    layout, so a series may hold any share of the rows.
    """
    points = df.select(series, F.to_date(ts).alias("_ts"), F.col(value).cast("double").alias("_x"))
    points = stage_table(points.where(F.col("_x").isNotNull() & F.col("_ts").isNotNull()), "series-points")
    sizes = stage_table(points.groupBy(series).agg(F.count("*").alias("_n")), "series-sizes")
    placed = row_positions(points, [F.col("_ts"), F.col("_x")], "_pos", [series]).join(sizes, series)
    n, i, x = F.col("_n"), F.col("_pos") - 1, F.col("_x")
    share = lambda length: F.lit(alpha) * F.pow(F.lit(1 - alpha), length - 1 - i)
    last = F.array_sort(F.collect_list(F.when(i >= n - WINDOW, F.struct(i.alias("i"), x.alias("x"))))).getField("x")
    return placed.groupBy(series).agg(
        F.count("*").alias("n"), F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"),
        F.max(F.when(i == 0, x)).alias("first"), last.alias("tail"),
        F.sum("_x").alias("sum"), F.sum(i * x).alias("place_sum"),
        F.max(F.pow(F.lit(1 - alpha), n)).alias("weight"), F.sum(share(n) * x).alias("shift"),
        F.max(F.pow(F.lit(1 - alpha), n - 1)).alias("weight_before"),
        F.coalesce(F.sum(F.when(i < n - 1, share(n - 1) * x)), F.lit(0.0)).alias("shift_before"),
    )


def compose(earlier: DataFrame, later: DataFrame, series: str = "series_id") -> DataFrame:
    """States of both stretches together; every series' later points come after its earlier ones."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    both = {
        "n": a("n") + b("n"),
        "first_ts": a("first_ts"),
        "last_ts": b("last_ts"),
        "first": a("first"),
        "tail": F.slice(F.concat(a("tail"), b("tail")), -F.least(F.lit(WINDOW), F.size(a("tail")) + F.size(b("tail"))), WINDOW),
        "sum": a("sum") + b("sum"),
        "place_sum": a("place_sum") + b("place_sum") + a("n") * b("sum"),
        "weight": a("weight") * b("weight"),
        "shift": b("weight") * a("shift") + b("shift"),
        "weight_before": a("weight") * b("weight_before"),
        "shift_before": b("weight_before") * a("shift") + b("shift_before"),
    }
    late = F.raise_error(F.concat(F.lit("points before the stored ones in series "), F.col(f"a.{series}").cast("string")))
    met = earlier.alias("a").join(later.alias("b"), F.col(f"a.{series}") == F.col(f"b.{series}"), "full")

    def field(name: str, value: Column) -> Column:
        alone = F.when(b("n").isNull(), a(name)).when(a("n").isNull(), b(name))
        if name == "last_ts":
            alone = alone.when(b("first_ts") <= a("last_ts"), late.cast("date"))
        return alone.otherwise(value).alias(name)

    return met.select(F.coalesce(a(series), b(series)).alias(series), *[field(name, both[name]) for name in FIELDS])


def extend(
    state: DataFrame, points: DataFrame, series: str = "series_id", ts: str = "ts", value: str = "value", alpha: float = ALPHA
) -> DataFrame:
    """Stored states and the points that came since; a point not after its series' last one is an error."""
    return compose(state, summarize(points, series, ts, value, alpha), series)


def forecast_from(
    state: DataFrame, periods: int = 12, method: str = "moving_average", freq: str = "month_end", series: str = "series_id"
) -> DataFrame:
    """(series, step, ts, forecast, method, last_value) as ``forecast.forecast`` gives for all points."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    n = F.col("n").cast("double")
    places, squares = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    if method == "moving_average":
        level, slope = F.aggregate("tail", F.lit(0.0), lambda t, x: t + x) / F.size("tail"), F.lit(0.0)
    elif method == "linear_trend":
        slope = (n * F.col("place_sum") - places * F.col("sum")) / (n * squares - places * places)
        level = F.col("sum") / n + slope * ((n - 1) / 2)
    else:
        # the first point stands for the level before it
        level = F.col("weight") * F.col("first") + F.col("shift")
        slope = level - (F.col("weight_before") * F.col("first") + F.col("shift_before"))
    step = F.col("step")
    fitted = state.where(F.col("n") >= MIN_POINTS).select(
        series, "last_ts", level.alias("_level"), slope.alias("_slope"), F.element_at("tail", -1).alias("last_value")
    )
    return fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).select(
        series, "step", next_dates(F.col("last_ts"), step, freq).alias("ts"),
        (F.col("_level") + F.col("_slope") * step).alias("forecast"), F.lit(method).alias("method"), "last_value",
    )
