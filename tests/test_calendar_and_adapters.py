"""Lags that count periods, long lag tables, forecast tables of every shape, sparse convolution."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.calendar import recent
from panelcast.operators.joins import lagged_long, with_period_total
from panelcast.operators.project import convolve_sparse, replay_last
from panelcast.operators.windows import (
    at_lag,
    difference,
    growth,
    lag_or,
    recent_level,
    rolling,
    rolling_centred,
)
from panelcast.schema import PERIOD, SERIES
from panelcast.sources.adapters import ForecastShape, adapt_forecast, null_periods

START = dt.date(2022, 1, 3)


def week(k):
    return START + dt.timedelta(days=7 * k)


@pytest.fixture(scope="module")
def gappy(spark):
    """Two series with missing weeks, one with a stored null."""
    rng = np.random.default_rng(2)
    cells = {("a", k): float(rng.integers(1, 20)) for k in range(40) if rng.random() < 0.6}
    cells |= {("b", 3): 4.0, ("b", 4): None, ("b", 9): 2.0}
    rows = [(s, week(k), x) for (s, k), x in cells.items()]
    return cells, spark.createDataFrame(rows, "series string, period date, x double").repartition(3)


def _got(df):
    return {(r[SERIES], (r[PERIOD] - START).days // 7): r["v"] for r in df.collect()}


def test_calendar_lags_miss_missing_weeks(gappy):
    cells, df = gappy
    out = {k: _got(df.select(SERIES, PERIOD, at_lag("x", k, 7).alias("v"))) for k in (1, 2, -1)}
    for k, got in out.items():
        assert got == {(s, t): cells.get((s, t - k)) for s, t in cells}
    change = _got(df.select(SERIES, PERIOD, difference("x", step_days=7).alias("v")))
    rate = _got(df.select(SERIES, PERIOD, growth("x", step_days=7).alias("v")))
    default = _got(df.select(SERIES, PERIOD, lag_or("x", 2, -1.0, step_days=7).alias("v")))
    start = {s: min(t for u, t in cells if u == s) for s in ("a", "b")}
    for (s, t), x in cells.items():
        p = cells.get((s, t - 1))
        assert change[s, t] == (None if x is None or p is None else x - p)
        assert rate[s, t] == (None if x is None or p is None else pytest.approx((x - p) / p))
        assert default[s, t] == (-1.0 if t - start[s] < 2 else cells.get((s, t - 2)))


def test_calendar_frames_need_all_their_weeks(gappy):
    cells, df = gappy
    mean = _got(df.select(SERIES, PERIOD, rolling("x", 3, complete=True, step_days=7).alias("v")))
    part = _got(df.select(SERIES, PERIOD, rolling("x", 3, F.sum, step_days=7).alias("v")))
    around = _got(df.select(SERIES, PERIOD, rolling_centred("x", step_days=7).alias("v")))
    for s, t in cells:
        last = [cells.get((s, t - k)) for k in range(3)]
        known = [x for x in last if x is not None]
        assert part[s, t] == (sum(known) if known else None)
        assert mean[s, t] == (pytest.approx(sum(known) / 3) if len(known) == 3 else None)
        near = [cells.get((s, t + k)) for k in (-1, 0, 1)]
        assert around[s, t] == (None if None in near else pytest.approx(sum(near) / 3))


def test_recent_weeks_and_replays(gappy):
    cells, df = gappy
    end = {s: max(t for u, t in cells if u == s) for s in ("a", "b")}
    late = {(s, t) for s, t in cells if t > end[s] - 5}
    assert {(r[SERIES], (r[PERIOD] - START).days // 7) for r in recent(df, 5, step_days=7).collect()} == late
    level = {r[SERIES]: r["x"] for r in recent_level(df, ["x"], 6, step_days=7).collect()}
    for s in ("a", "b"):
        known = [x for (u, t), x in cells.items() if u == s and t > end[s] - 6 and x is not None]
        assert level[s] == pytest.approx(np.mean(known))
    got = {(r[SERIES], r["h"]): (r[PERIOD], r["x"]) for r in replay_last(df, 8, ["x"]).collect()}
    assert got == {(s, h): (week(end[s] + h), cells.get((s, end[s] + h - 8))) for s in end for h in range(1, 9)}


def test_long_lags_and_totals(gappy):
    cells, df = gappy
    got = {(r[SERIES], (r[PERIOD] - START).days // 7, r["k"]): r["x"] for r in lagged_long(df, "x", 4).collect()}
    assert got == {(s, t, k): cells[s, t - k] for s, t in cells for k in range(5) if (s, t - k) in cells}
    plan = lagged_long(df, "x", 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    total = _got(with_period_total(df, "x", "v").drop("x"))
    assert total == {(s, t): sum(x for (_, u), x in cells.items() if u == t and x is not None) if any(x is not None for (_, u), x in cells.items() if u == t) else None for s, t in cells}


def test_sparse_convolution_keeps_series_without_weights(spark, gappy):
    cells, df = gappy
    weights = spark.createDataFrame([("a", [0.5, 0.0, 0.25])], "series string, weights array<double>")
    got = _got(convolve_sparse(df, weights, "x", "v"))
    want = {}
    for (s, t), x in cells.items():
        if s == "a":
            for k, w in ((0, 0.5), (2, 0.25)):
                want[s, t + k] = want.get((s, t + k), 0.0) + w * x
        else:
            want[s, t] = None
    assert got == pytest.approx(want)


def test_forecast_tables_of_every_shape(spark):
    weeks = [week(k) for k in range(5)]
    calendar = spark.createDataFrame([(w,) for w in weeks], "period date")
    running = spark.createDataFrame([(w, float((k + 1) ** 2), 1.0) for k, w in enumerate(weeks)] + [(None, 7.0, 2.0)], "`Week` date, `Total` double, `Low` double").repartition(4)
    out = adapt_forecast(running, ForecastShape("run", "Total", period="Week", cumulative=True, bounds=(("lo80", "Low"),))).collect()
    assert {r[PERIOD]: (r["forecast"], r["lo80"]) for r in out} == {w: (2.0 * k + 1, 1.0) for k, w in enumerate(weeks)} | {None: (7.0, 2.0)}
    undated = spark.createDataFrame([(k + 1, float(k)) for k in range(5)], "step int, mean double")
    out = adapt_forecast(undated, ForecastShape("vector", "mean", ordinal="step"), calendar).collect()
    assert {r[PERIOD]: r["forecast"] for r in out} == {w: float(k) for k, w in enumerate(weeks)}
    parts = spark.createDataFrame([(w, float(k)) for k in (1, 2) for w in weeks], "d date, v double")
    out = adapt_forecast(parts, ForecastShape("sum", "v", period="d", additive=True)).collect()
    assert all(r["forecast"] == 3.0 for r in out) and len(out) == 5
    lost = adapt_forecast(undated.withColumn("d", F.lit(None).cast("date")), ForecastShape("lost", "mean", period="d"))
    assert [(r["model"], r["n"]) for r in null_periods(lost).collect()] == [("lost", 5)]
