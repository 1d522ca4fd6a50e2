"""Forecasts per series from a long table (series_id, ts, value).

Positions inside a series come from a distributed layout, so one series may
hold any share of the rows; every forecast is then a plain aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.operators.ordering import row_positions
from bidloom.sources.staging import stage_table

MIN_POINTS = 3
WINDOW = 3
ALPHA = 0.3
METHODS = ("moving_average", "linear_trend", "exponential_smoothing")


def series_sizes(df: DataFrame, series: str = "series_id") -> DataFrame:
    return df.groupBy(series).agg(F.count("*").alias("n_points"))


def short_series(df: DataFrame, series: str = "series_id") -> DataFrame:
    """Series with too few points to forecast."""
    return series_sizes(df, series).where(F.col("n_points") < MIN_POINTS)


#: months in one step of a calendar frequency
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
#: gaps in days that are taken for one step
_GAPS = {"day": (0.0, 2.0), "week": (5.0, 9.0), "month": (26.0, 33.0), "quarter": (80.0, 100.0), "year": (340.0, 390.0)}
FREQUENCIES = ("day", "week", *[f"{unit}_{side}" for unit in _MONTHS for side in ("start", "end")])


def _period_end(day: Column, unit: str) -> Column:
    return F.last_day(F.add_months(F.trunc(day, unit), _MONTHS[unit] - 1))


def next_dates(last: Column, step: Column, freq: str) -> Column:
    if freq == "day":
        return F.date_add(last, step)
    if freq == "week":
        return F.date_add(last, step * 7)
    unit, _, side = freq.partition("_")
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency: {freq}")
    if side == "start":
        return F.add_months(F.trunc(last, unit), step * _MONTHS[unit])
    # the first period end after the last point, then one per period
    ahead = F.when(last == _period_end(last, unit), step).otherwise(step - 1)
    return _period_end(F.add_months(F.trunc(last, unit), ahead * _MONTHS[unit]), unit)


def infer_frequency(df: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """(series, frequency): from the most frequent gap of each series, the shorter one of two as frequent.

    A calendar frequency is that of period starts if all points are first days of a
    month, else of period ends. Null where no frequency has such a gap.
    """
    # one row a day at most: a series is as long as its calendar, however many points it has
    days = df.select(series, F.to_date(ts).alias("_ts")).where("_ts is not null").distinct()
    before = F.lag("_ts").over(Window.partitionBy(series).orderBy("_ts"))
    gaps = days.withColumn("_gap", F.datediff("_ts", before))
    counted = gaps.groupBy(series, "_gap").agg(
        F.count("*").alias("_n"), F.bool_and(F.dayofmonth("_ts") == 1).alias("_starts")
    )
    usual = F.min(F.when(F.col("_gap").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_gap").alias("gap"))))
    found = counted.groupBy(series).agg(usual.getField("gap").alias("_gap"), F.bool_and("_starts").alias("_starts"))
    chain = F
    for unit, (low, high) in _GAPS.items():
        side = F.when(F.col("_starts"), f"{unit}_start").otherwise(f"{unit}_end")
        chain = chain.when(F.col("_gap").between(low, high), side if unit in _MONTHS else F.lit(unit))
    return found.select(series, chain.alias("frequency"))


def forecast(
    df: DataFrame,
    periods: int = 12,
    method: str = "moving_average",
    freq: str = "month_end",
    series: str = "series_id",
    ts: str = "ts",
    value: str = "value",
    alpha: float = ALPHA,
) -> DataFrame:
    """(series, step, ts, forecast, method, last_value) for ``periods`` steps ahead.

    ``freq`` is one of ``FREQUENCIES``, or ``infer`` for that of each series.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if dict(df.dtypes)[ts] not in ("date", "timestamp", "timestamp_ntz"):
        raise ValueError(f"{ts} must be a date or timestamp")
    points = df.select(series, F.to_date(ts).alias("_ts"), F.col(value).cast("double").alias("_x"))
    sizes = stage_table(series_sizes(points, series), "series-sizes")
    placed = row_positions(points, [F.col("_ts"), F.col("_x")], "_pos", [series])
    placed = placed.join(sizes.where(F.col("n_points") >= MIN_POINTS), series)
    n, i, x = F.col("n_points"), F.col("_pos") - 1, F.col("_x")

    def smoothed(length: Column) -> Column:
        # closed form of the recursion s_i = a*x_i + (1-a)*s_(i-1), s_0 = x_0
        weight = F.when(i == 0, F.pow(F.lit(1 - alpha), length - 1)).otherwise(
            F.lit(alpha) * F.pow(F.lit(1 - alpha), length - 1 - i)
        )
        return F.sum(F.when(i < length, weight * x))

    fits = {
        "moving_average": [F.avg(F.when(i >= n - WINDOW, x)).alias("_level"), F.lit(0.0).alias("_slope")],
        "linear_trend": [F.regr_intercept(x, i).alias("_at_zero"), F.regr_slope(x, i).alias("_slope")],
        "exponential_smoothing": [smoothed(n).alias("_level"), smoothed(n - 1).alias("_before")],
    }[method]
    fitted = placed.groupBy(series).agg(
        F.max("_ts").alias("_last_ts"),
        F.max("n_points").alias("_n"),
        F.max(F.struct("_pos", "_x")).getField("_x").alias("last_value"),
        *fits,
    )
    if method == "linear_trend":
        fitted = fitted.withColumn("_level", F.col("_at_zero") + F.col("_slope") * (F.col("_n") - 1))
    if method == "exponential_smoothing":
        fitted = fitted.withColumn("_slope", F.col("_level") - F.col("_before"))
    step = F.col("step")
    if freq == "infer":
        fitted = fitted.join(infer_frequency(df, series, ts), series, "left")
        dates = F
        for name in FREQUENCIES:
            dates = dates.when(F.col("frequency") == name, next_dates(F.col("_last_ts"), step, name))
    else:
        dates = next_dates(F.col("_last_ts"), step, freq)
    return fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).select(
        series,
        "step",
        dates.alias("ts"),
        (F.col("_level") + F.col("_slope") * step).alias("forecast"),
        F.lit(method).alias("method"),
        "last_value",
    )


def forecast_result(rows: DataFrame, series: str = "series_id") -> DataFrame:
    """One row per series: method, horizon, last known and first and last forecast value."""
    return rows.groupBy(series).agg(
        F.max("method").alias("method"),
        F.max("step").alias("periods"),
        F.max("last_value").alias("last_historical_value"),
        F.min_by("forecast", "step").alias("first_forecast_value"),
        F.max_by("forecast", "step").alias("last_forecast_value"),
    )
