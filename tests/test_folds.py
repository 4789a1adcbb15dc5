"""Folds by prefix statistics against models fitted to each fold's rows one by one."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.calendar import expanding_folds
from panelcast.operators.evaluate import backtest
from panelcast.operators.fit import nnls_stack
from panelcast.operators.folds import (
    convolution,
    delay_weights,
    fold_panel,
    last_value,
    prefix_backtest,
    recent_mean,
    smoothing,
    trend_line,
)
from panelcast.schema import PERIOD, SERIES

START = dt.date(2021, 1, 4)
LENGTHS = {"long": 60, "mid": 22, "short": 9, "tiny": 7, "one": 1}


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(6)
    rows = [
        (s, START + dt.timedelta(days=7 * k), float(rng.integers(0, 30)), float(rng.integers(0, 12)))
        for s, n in LENGTHS.items()
        for k in range(n)
    ]
    return spark.createDataFrame(rows, "series string, period date, x double, y double").repartition(3).cache()


def _series(panel):
    for s, g in panel.toPandas().sort_values([SERIES, PERIOD]).groupby(SERIES):
        yield s, g["x"].to_numpy(), g["y"].to_numpy()


def _cuts(n, n_folds=4):
    return {f: te for f in range(1, n_folds + 1) if (te := n - 2 * n_folds + f - 1) > 0}


def _by(df, value="forecast"):
    return {(r[SERIES], r["fold"], r[PERIOD]): r[value] for r in df.collect()}


def _week(k):
    return START + dt.timedelta(days=7 * k)


def test_tests_and_cuts_are_those_of_expanding_folds(panel):
    folds = fold_panel(panel, "y", 4, 5)
    long = expanding_folds(panel, 4, 5)
    want = {(r[SERIES], r["fold"], r[PERIOD]): r["y"] for r in long.filter("role = 'test'").collect()}
    assert _by(folds.tests(), "actual") == want and want
    sums = folds.sums({"s": F.col("y")}).collect()
    trained = long.filter("role = 'train'").groupBy(SERIES, "fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    assert {(r[SERIES], r["fold"], r["n"], r["s"]) for r in sums} == {(r[SERIES], r["fold"], r["n"], r["s"]) for r in trained}


def _brute(kind, x, y, te, h):
    y = y[:te]
    if kind == "walk":
        return y[-1]
    if kind == "mean":
        return y[-4:].mean()
    if kind == "trend":
        t = np.arange(1, te + 1)
        b = ((t - t.mean()) @ (y - y.mean())) / ((t - t.mean()) @ (t - t.mean())) if te > 1 else 0.0
        return y.mean() + b * (te + h - t.mean())
    best = None
    for a in (0.1, 0.3, 0.5):
        level, sse = y[0], 0.0
        for v in y[1:]:
            sse += (v - level) ** 2
            level += a * (v - level)
        if best is None or sse < best[0]:
            best = sse, level
    return best[1]


@pytest.mark.parametrize(
    "kind, forecaster",
    [("walk", last_value), ("mean", recent_mean), ("trend", trend_line), ("smooth", lambda f: smoothing(f, [0.5, 0.1, 0.3]))],
)
def test_forecasts_equal_fits_on_each_folds_rows(panel, kind, forecaster):
    got = _by(forecaster(fold_panel(panel, "y", 4, 3)))
    want = {
        (s, f, _week(te + h - 1)): pytest.approx(_brute(kind, x, y, te, h), abs=1e-9)
        for s, x, y in _series(panel)
        for f, te in _cuts(len(y)).items()
        for h in (1, 2, 3)
    }
    assert got == want


def _weights(x, y, te, lag):
    if te <= lag + 4 or not x[:te].sum() or not y[:te].sum():
        return np.zeros(lag + 1)
    a = np.column_stack([x[lag - k : te - k] for k in range(lag + 1)])
    w = nnls_stack((a.T @ a)[None], (a.T @ y[lag:te])[None])[0][0]
    return w / max(1.0, w.sum())


def test_weights_see_training_rows_only(panel):
    folds = fold_panel(panel, "y", 4, 6)
    got = {(r[SERIES], r["fold"]): r["weights"] for r in delay_weights(folds, "x", 3).collect()}
    flow = _by(convolution(folds, "x", 3))
    want, flows = {}, {}
    for s, x, y in _series(panel):
        for f, te in _cuts(len(y)).items():
            w = _weights(x, y, te, 3)
            want[s, f] = pytest.approx(list(w), abs=1e-8)
            ahead = np.concatenate((np.zeros(3), x[:te], np.full(6, x[max(0, te - 4) : te].mean())))
            for h in range(1, 7):
                at = 3 + te + h - 1
                flows[s, f, _week(te + h - 1)] = pytest.approx(sum(w[k] * ahead[at - k] for k in range(4)), abs=1e-8)
    assert got == want and flow == flows


def test_rows_without_forecast_are_counted(panel):
    folds = fold_panel(panel, "y", 4, 3)
    skips = lambda f: last_value(f).filter("series <> 'long'")
    got = {(r["model"], r["fold"]): (r["n_forecasts"], r["n_missing"]) for r in prefix_backtest(folds, {"all": last_value, "some": skips}).collect()}
    for f in range(1, 5):
        n, missing = got["all", f]
        assert missing == 0 and got["some", f] == (n, 3)


def test_both_backtests_agree(panel):
    def walk(train, keys):
        last = train.groupBy(*keys).agg(F.max_by("y", PERIOD).alias("forecast"), F.max(PERIOD).alias("_p"))
        return last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn(PERIOD, F.date_add("_p", F.col("h") * 7))

    a = backtest(expanding_folds(panel, 4, 5), {"walk": walk}, "y").collect()
    b = prefix_backtest(fold_panel(panel, "y", 4, 5), {"walk": last_value}).collect()
    key = lambda r: (r["fold"], r["n_forecasts"], r["n_missing"], round(r["mae"], 9), round(r["rmse"], 9))
    assert sorted(map(key, a)) == sorted(map(key, b))
