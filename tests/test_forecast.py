import calendar
import datetime as dt

import pytest

from bidloom.operators import forecast, series_state


def _series(spark, values, name="s"):
    def month_end(i):
        y, m = 2024 + i // 12, i % 12 + 1
        return dt.date(y, m, calendar.monthrange(y, m)[1])

    return spark.createDataFrame([(name, month_end(i), float(v)) for i, v in enumerate(values)], "series_id string, ts date, value double")


def _values(df):
    return [r["forecast"] for r in df.orderBy("step").collect()]


def test_moving_average(spark):
    df = _series(spark, [100, 105, 103, 108, 110, 107, 112, 115, 113, 118, 120, 117])
    assert _values(forecast.forecast(df, 6)) == pytest.approx([355 / 3] * 6)


def test_linear_trend_and_month_ends(spark):
    out = forecast.forecast(_series(spark, range(100, 160, 5)), 6, "linear_trend")
    assert _values(out) == pytest.approx([160, 165, 170, 175, 180, 185])
    assert [r["ts"] for r in out.orderBy("step").collect()][:2] == [dt.date(2025, 1, 31), dt.date(2025, 2, 28)]
    last = forecast.forecast_result(out).first()
    assert (last["first_forecast_value"], last["last_forecast_value"], last["last_historical_value"]) == pytest.approx((160, 185, 155))


def test_smoothing_equals_the_recursion(spark):
    data = [3, 9, 4, 4, 12, 7, 1]
    levels = [float(data[0])]
    for x in data[1:]:
        levels.append(0.3 * x + 0.7 * levels[-1])
    want = [levels[-1] + (levels[-1] - levels[-2]) * h for h in range(1, 5)]
    assert _values(forecast.forecast(_series(spark, data), 4, "exponential_smoothing")) == pytest.approx(want)


def test_short_series_and_bad_arguments(spark):
    df = _series(spark, [1, 2, 3]).unionByName(_series(spark, [1, 2], "short"))
    assert {r["series_id"] for r in forecast.forecast(df, 2).collect()} == {"s"}
    assert [tuple(r) for r in forecast.short_series(df).collect()] == [("short", 2)]
    with pytest.raises(ValueError):
        forecast.forecast(df, 2, "other")
    with pytest.raises(ValueError):
        forecast.forecast(df.withColumn("ts", df.ts.cast("string")), 2)


@pytest.mark.parametrize("method", forecast.METHODS)
def test_states_grow_as_the_whole_series(spark, method):
    data = [3, 9, 4, 4, 12, 7, 1, 30, 2.5, 8, 8, 41, 0, -3]
    df = _series(spark, data).unionByName(_series(spark, data[::-1][:5], "t"))
    cut = df.where("ts < date '2024-03-01'"), df.where("ts >= date '2024-03-01' and ts < date '2024-11-01'"), df.where("ts >= date '2024-11-01'")
    state = series_state.summarize(cut[0])
    for more in cut[1:]:
        state = series_state.extend(state, more)
    got = {(r.series_id, r.step): (r.forecast, r.ts, r.last_value) for r in series_state.forecast_from(state, 3, method).collect()}
    want = {(r.series_id, r.step): (r.forecast, r.ts, r.last_value) for r in forecast.forecast(df, 3, method).collect()}
    assert got.keys() == want.keys()
    for key, (value, *rest) in want.items():
        assert got[key][0] == pytest.approx(value, rel=1e-9, abs=1e-9) and list(got[key][1:]) == rest


def test_points_that_come_late_are_an_error(spark):
    df = _series(spark, [1, 2, 3, 4])
    state = series_state.summarize(df)
    with pytest.raises(Exception, match="before the stored ones"):
        series_state.extend(state, df.where("ts = date '2024-04-30'")).collect()
