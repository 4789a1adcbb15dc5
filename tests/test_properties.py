"""Invariants and brute-force comparisons on small fixtures."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.aggregate import exact_quantiles, with_total_rows
from panelcast.operators.calendar import densify, densify_within, expanding_folds, horizon, recent
from panelcast.operators.fit import (
    dispersion,
    fit_boosted,
    fit_delay_weights,
    fit_linear,
    fit_smoothing,
    nnls_gram,
    predict_linear,
    smoothing_fitted,
)
from panelcast.operators.joins import lagged_long
from panelcast.operators.paths import FIVE, bootstrap_paths, draw, summarise_paths
from panelcast.operators.project import (
    apportion,
    cap_outflow,
    convolve,
    convolve_sparse,
    extend,
    hazards,
    smooth_weights,
)
from panelcast.operators.windows import decumulate, interpolate, ordered, running_total
from panelcast.schema import PERIOD, SERIES, STAGES

START = dt.date(2022, 1, 3)


def week(i):
    return START + dt.timedelta(days=7 * i)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


# --- calendars and windows ----------------------------------------------------


def test_interpolation_is_exact_on_lines(spark):
    rows = [("a", week(i), 3.0 * i + 1 if i % 4 else None) for i in range(1, 21)]
    df = frame(spark, rows, "series string, period date, x double")
    out = interpolate(df, ["x"]).orderBy(PERIOD).collect()
    for i, r in enumerate(out, start=1):
        if i == 20:  # trailing gap
            assert r["x"] is None
        else:
            assert r["x"] == pytest.approx(3.0 * i + 1)


def test_decumulate_undoes_running_total(spark, weekly):
    running = weekly.withColumn("arrivals", running_total("arrivals"))
    back = by_key(decumulate(running, "arrivals"), SERIES, PERIOD)
    for key, r in by_key(weekly, SERIES, PERIOD).items():
        assert back[key]["arrivals"] == r["arrivals"]


def test_densify_matches_brute_force(spark):
    rows = [("a", week(2), 1.0), ("a", week(5), 2.0), ("b", week(0), 3.0), ("c", week(7), 4.0)]
    df = frame(spark, rows, "series string, period date, x double")
    have = {(s, p): x for s, p, x in rows}
    full = by_key(densify(df, 7, ["x"]), SERIES, PERIOD)
    assert set(full) == {(s, week(i)) for s in "abc" for i in range(8)}
    assert all(r["x"] == have.get(k) for k, r in full.items())
    own = by_key(densify_within(df, 7, ["x"], fill=0.0), SERIES, PERIOD)
    assert set(own) == {("a", week(i)) for i in (2, 3, 4, 5)} | {("b", week(0)), ("c", week(7))}
    assert all(r["x"] == have.get(k, 0.0) for k, r in own.items())


def test_off_grid_period_is_an_error(spark):
    rows = [("a", week(0), 1.0), ("a", week(1) + dt.timedelta(days=1), 2.0), ("a", week(3), 2.0)]
    df = frame(spark, rows, "series string, period date, x double")
    for fill in (densify, densify_within):
        with pytest.raises(Exception, match="off the calendar grid"):
            fill(df, 7, ["x"]).collect()


def test_folds_match_definition(spark, weekly):
    out = expanding_folds(weekly, n_folds=4, max_horizon=5)
    counts = by_key(out.groupBy(SERIES, "fold", "role").count(), SERIES, "fold", "role")
    for s, f in itertools.product("abc", range(1, 5)):
        train = 40 - 8 + f - 1
        assert counts[(s, f, "train")]["count"] == train
        assert counts[(s, f, "test")]["count"] == min(5, 40 - train)


def test_lag_join_follows_dates_not_rows(spark):
    rows = [("a", week(0), 1.0), ("a", week(2), 2.0), ("a", week(3), 3.0)]
    df = frame(spark, rows, "series string, period date, x double")
    got = {(r[PERIOD], r["k"]): r["x"] for r in lagged_long(df, "x", 2).collect()}
    assert got == {
        (week(0), 0): 1.0,
        (week(2), 0): 2.0,
        (week(2), 2): 1.0,
        (week(3), 0): 3.0,
        (week(3), 1): 2.0,
    }


# --- quantiles -----------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_quantiles_with_a_hot_group(spark, partitions):
    rng = np.random.default_rng(1)
    values = {
        "hot": np.concatenate([np.full(3000, 7.0), rng.normal(0, 1e6, 4000)]),
        "cold": rng.integers(0, 5, 50).astype(float),
        "one": np.array([4.5]),
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("cold", None)]
    df = frame(spark, rows, "g string, x double").repartition(partitions)
    probs = {"p0": 0.0, "p10": 0.1, "p33": 0.333, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = by_key(exact_quantiles(df, ["g"], "x", probs), "g")
    for k, vs in values.items():
        for name, p in probs.items():
            assert got[(k,)][name] == pytest.approx(np.quantile(vs, p), rel=1e-12)


def test_exact_quantiles_without_keys(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    row = exact_quantiles(df, [], "x", {"m": 0.5, "q": 0.2505}).first()
    assert (row["m"], row["q"]) == (500.0, pytest.approx(250.5))


# --- regression and smoothing -----------------------------------------------------


def _design(spark, collinear=False):
    rng = np.random.default_rng(2)
    rows = []
    for s in ("a", "b"):
        for i in range(60):
            x1, x2 = rng.normal(1000, 5), rng.normal()
            x3 = 2 * x1 - x2 if collinear else rng.normal()
            rows.append((s, week(i), float(3 + 0.5 * x1 - 2 * x2 + x3 + rng.normal(0, 0.1)), x1, x2, x3))
    return frame(spark, rows, "series string, period date, y double, x1 double, x2 double, x3 double")


@pytest.mark.parametrize("map_side", [False, True])
def test_linear_fit_matches_lstsq(spark, map_side):
    df = _design(spark)
    got = by_key(fit_linear(df, "y", ["x1", "x2", "x3"], map_side=map_side), SERIES)
    pdf = df.toPandas()
    for s, g in pdf.groupby("series"):
        a = np.column_stack([np.ones(len(g)), g[["x1", "x2", "x3"]]])
        beta, *_ = np.linalg.lstsq(a, g["y"], rcond=None)
        r = got[(s,)]
        assert [r["intercept"], *r["coef"]] == pytest.approx(list(beta), rel=1e-6)
        assert r["sse"] == pytest.approx(((g["y"] - a @ beta) ** 2).sum(), rel=1e-6)


def test_collinear_regressors_still_predict(spark):
    df = _design(spark, collinear=True)
    fit = fit_linear(df, "y", ["x1", "x2", "x3"])
    out = predict_linear(df, fit, ["x1", "x2", "x3"]).toPandas()
    for _, g in out.groupby("series"):
        a = np.column_stack([np.ones(len(g)), g[["x1", "x2"]]])
        beta, *_ = np.linalg.lstsq(a, g["y"], rcond=None)
        assert np.allclose(g["prediction"], a @ beta, atol=1e-5)


def test_smoothing_matches_loop(spark, weekly):
    alphas = [0.2, 0.5, 0.8]
    first = by_key(fit_smoothing(weekly, "arrivals", alphas), SERIES)
    free = by_key(fit_smoothing(weekly, "arrivals", alphas, start="optimal"), SERIES)
    fits = by_key(smoothing_fitted(weekly, "arrivals", fit_smoothing(weekly, "arrivals", alphas)), SERIES, PERIOD)
    for s, g in weekly.toPandas().sort_values(PERIOD).groupby(SERIES):
        y, dates = g["arrivals"].to_numpy(), list(g[PERIOD])

        def run(alpha, level, ys):
            sse, path = 0.0, []
            for v in ys:
                path.append(level)
                sse += (v - level) ** 2
                level += alpha * (v - level)
            return sse, level, path

        sse, level, alpha = min((*run(a, y[0], y[1:])[:2], a) for a in alphas)
        assert first[(s,)]["alpha"] == alpha
        assert first[(s,)]["level"] == pytest.approx(level)
        assert first[(s,)]["sse"] == pytest.approx(sse)
        for date, value in zip(dates[1:], run(alpha, y[0], y[1:])[2], strict=True):
            assert fits[(s, date)]["fitted"] == pytest.approx(value)
        grid = np.linspace(y.min() - 20, y.max() + 20, 4001)
        brute = min(run(a, l0, y)[0] for a in alphas for l0 in grid)
        assert free[(s,)]["sse"] <= brute + 1e-6
        assert free[(s,)]["sse"] == pytest.approx(brute, rel=1e-3)


def test_smoothing_handles_unequal_lengths(spark):
    rows = [("long", week(i), float(i % 5)) for i in range(30)] + [("short", week(0), 9.0)]
    df = frame(spark, rows, "series string, period date, x double")
    got = by_key(fit_smoothing(df, "x", [0.3, 0.6]), SERIES)
    assert (got[("short",)]["level"], got[("short",)]["sse"], got[("short",)]["n"]) == (9.0, 0.0, 1)
    assert got[("long",)]["n"] == 30


def test_boosting_beats_the_mean(spark):
    rows = [(week(i), "a", float(i), float((i % 7) ** 2)) for i in range(120)]
    df = frame(spark, rows, "period date, series string, x double, y double")
    df = df.withColumn("x", F.col("x") % 7)
    out = fit_boosted(df, "y", ["x"], rounds=10).transform(df)
    mse = out.select(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert mse < 0.25 * df.select(F.var_pop("y")).first()[0]


# --- delay weights -----------------------------------------------------------------


def _brute_nnls(g, r):
    best, best_cost = np.zeros(len(r)), 0.0
    for size in range(1, len(r) + 1):
        for at in itertools.combinations(range(len(r)), size):
            z = np.linalg.lstsq(g[np.ix_(at, at)], r[list(at)], rcond=None)[0]
            if (z < 0).any():
                continue
            w = np.zeros(len(r))
            w[list(at)] = z
            cost = 0.5 * w @ g @ w - r @ w
            if cost < best_cost - 1e-12:
                best, best_cost = w, cost
    return best


@pytest.mark.parametrize("seed", range(12))
def test_nnls_matches_all_subsets(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(12, 5)) + rng.normal()
    y = rng.normal(size=12) * 3
    g, r = a.T @ a, a.T @ y
    w = nnls_gram(g, r)
    assert np.allclose(w, _brute_nnls(g, r), atol=1e-7)
    gradient = g @ w - r
    assert (w >= 0).all() and (gradient >= -1e-6).all() and abs(gradient @ w) < 1e-6


def _delay_rows(spark, weekly):
    """Downstream that follows upstream with known weights .5, .3, .1."""
    w = ordered()
    x = F.col("applications")
    y = 0.5 * x + 0.3 * F.coalesce(F.lag(x, 1).over(w), F.lit(0.0)) + 0.1 * F.coalesce(
        F.lag(x, 2).over(w), F.lit(0.0)
    )
    return weekly.withColumn("arrivals", y)


def test_delay_weights_recover_truth(spark, weekly):
    fits = fit_delay_weights(_delay_rows(spark, weekly), "applications", "arrivals", 4)
    for r in fits.collect():
        assert r["weights"] == pytest.approx([0.5, 0.3, 0.1, 0, 0], abs=1e-8)


def test_delay_weights_match_brute_force(spark, weekly):
    got = by_key(fit_delay_weights(weekly, "visas_issued", "arrivals", 3, cap=None), SERIES)
    capped = by_key(fit_delay_weights(weekly, "visas_issued", "arrivals", 3, cap=0.4), SERIES)
    for s, g in weekly.toPandas().sort_values(PERIOD).groupby(SERIES):
        x, y = g["visas_issued"].to_numpy(), g["arrivals"].to_numpy()
        a = np.column_stack([x[3 - k : len(x) - k] for k in range(4)])
        want = _brute_nnls(a.T @ a, a.T @ y[3:])
        assert got[(s,)]["weights"] == pytest.approx(list(want), abs=1e-8)
        assert sum(capped[(s,)]["weights"]) <= 0.4 + 1e-12
        scale = min(1.0, 0.4 / want.sum())
        assert capped[(s,)]["weights"] == pytest.approx(list(want * scale), abs=1e-8)


def test_delay_weights_fall_back_to_zero(spark):
    rows = [("short", week(i), 5.0, 3.0) for i in range(8)]
    rows += [("silent", week(i), 0.0, 3.0) for i in range(30)]
    df = frame(spark, rows, "series string, period date, x double, y double")
    out = by_key(fit_delay_weights(df, "x", "y", 6), SERIES)
    assert out[("short",)]["weights"] == [0.0] * 7
    assert out[("silent",)]["weights"] == [0.0] * 7
    shrunk = by_key(fit_delay_weights(df, "x", "y", 20, cap=0.999, shrink=True), SERIES)
    assert len(shrunk[("short",)]["weights"]) == 21
    assert sum(shrunk[("short",)]["weights"]) == pytest.approx(0.6)
    assert shrunk[("short",)]["weights"][7:] == [0.0] * 14
    two = df.filter((F.col(SERIES) == "short") & (F.col(PERIOD) < F.lit(week(2))))
    assert fit_delay_weights(two, "x", "y", 3, shrink=True).first()["weights"] == [0.6, 0, 0, 0]


def test_convolution_forms_agree(spark, weekly):
    arrays = weekly.select(SERIES).distinct().withColumn(
        "weights", F.array(*[F.lit(v) for v in (0.5, 0.0, 0.25)])
    )
    dense = by_key(convolve(weekly, arrays, "applications", 2, "e"), SERIES, PERIOD)
    sparse = by_key(convolve_sparse(weekly, arrays, "applications", "e"), SERIES, PERIOD)
    for key, r in dense.items():
        assert r["e"] == pytest.approx(sparse[key]["e"] if key in sparse else 0.0)


def _weights(spark, values):
    rows = [("a", k, float(w)) for k, w in enumerate(values)]
    return frame(spark, rows, "series string, k int, w double")


@pytest.mark.parametrize("values", [(0.4, 0.3, 0.2), (0.0, 0.5, 0.5), (1.0, 0.0), (0.2,)])
def test_hazards_give_the_weights_back(spark, values):
    alive = 1.0
    for r in hazards(_weights(spark, values)).orderBy("k").collect():
        assert 0 <= r["hazard"] <= 1
        assert alive * r["hazard"] == pytest.approx(r["w"])
        alive *= 1 - r["hazard"]


def test_hazards_of_weights_above_one(spark):
    got = [r["hazard"] for r in hazards(_weights(spark, (0.8, 0.7, 0.3))).orderBy("k").collect()]
    assert got == [pytest.approx(0.8), 1.0, 0.0]


def test_smoothing_keeps_sum_and_ends(spark):
    values = (0.5, 0.0, 0.3, 0.1)
    got = [r["w"] for r in smooth_weights(_weights(spark, values)).orderBy("k").collect()]
    assert sum(got) == pytest.approx(sum(values))
    raw = [0.5, 0.8 / 3, 0.4 / 3, 0.1]
    assert got == pytest.approx([v * 0.9 / sum(raw) for v in raw])
    assert [r["w"] for r in smooth_weights(_weights(spark, (0.4, 0.1))).collect()] == [0.4, 0.1]


@pytest.mark.parametrize("target", [0, 1, 7, 1000])
def test_apportionment_adds_up(spark, target):
    rng = np.random.default_rng(target)
    rows = [(s, k, float(v), target) for s in "ab" for k, v in enumerate(rng.random(9) - 0.1)]
    df = frame(spark, rows, "series string, k int, share double, target int")
    out = apportion(df, "share", "target", "k")
    assert {r[0]: r[1] for r in out.groupBy(SERIES).agg(F.sum("units")).collect()} == {
        "a": target,
        "b": target,
    }
    assert out.filter(F.col("units") < 0).count() == 0


def test_apportionment_of_nothing(spark):
    df = frame(spark, [("a", 0, 0.0, 5), ("a", 1, None, 5)], "series string, k int, share double, target int")
    assert [r["units"] for r in apportion(df, "share", "target", "k").collect()] == [0, 0]


def test_cap_matches_loop(spark, weekly):
    got = by_key(cap_outflow(weekly, "arrivals", "visas_issued", 3.0), SERIES, PERIOD)
    for s, g in weekly.toPandas().sort_values(PERIOD).groupby(SERIES):
        stock = 3.0
        for _, r in g.iterrows():
            out = min(r["arrivals"], stock + r["visas_issued"])
            stock += r["visas_issued"] - out
            assert got[(s, r[PERIOD])]["capped"] == pytest.approx(out)


def test_extend_carries_the_last_row(spark, weekly):
    out = extend(weekly, 3, {"applications": F.col("applications")})
    last = by_key(recent(weekly, 1), SERIES)
    future = out.filter("h > 0").collect()
    assert len(future) == 9 and out.count() == 129
    for r in future:
        assert r["applications"] == last[(r[SERIES],)]["applications"]
        assert r["arrivals"] is None
        assert r[PERIOD] == last[(r[SERIES],)][PERIOD] + dt.timedelta(days=7 * r["h"])


# --- paths -----------------------------------------------------------------------------


def test_bootstrap_is_stable_under_repartitioning(spark, weekly):
    forecast = horizon(weekly, 4).withColumn("forecast", F.lit(20.0))
    residuals = weekly.select(SERIES, PERIOD, (F.col("arrivals") - 15).alias("residual"))
    runs = [
        by_key(
            bootstrap_paths(forecast.repartition(n), residuals.repartition(n), 25, seed=3),
            SERIES, "sim", "h",
        )
        for n in (1, 16)
    ]
    assert len(runs[0]) == 3 * 25 * 4
    assert {k: r["value"] for k, r in runs[0].items()} == {k: r["value"] for k, r in runs[1].items()}
    blocked = by_key(
        bootstrap_paths(forecast, residuals, 25, seed=3, blocks=4), SERIES, "sim", "h"
    )
    assert {k: r["value"] for k, r in blocked.items()} == {k: r["value"] for k, r in runs[0].items()}
    other = by_key(bootstrap_paths(forecast, residuals, 25, seed=4), SERIES, "sim", "h")
    assert any(other[k]["value"] != runs[0][k]["value"] for k in other)


def test_path_quantiles_agree_and_are_ordered(spark, weekly):
    paths = weekly.withColumnsRenamed({"arrivals": "value", "series": "sim"}).withColumn(
        SERIES, F.lit("s")
    )
    keys = (SERIES,)
    one = summarise_paths(paths, FIVE, keys).first().asDict()
    other = summarise_paths(paths, FIVE, keys, bounded=False).first().asDict()
    assert one == pytest.approx(other)
    got = [one[q] for q in FIVE]
    assert got == sorted(got)


def test_draws_are_spread_evenly(spark):
    df = spark.range(20000).select(
        draw(F.lit("x"), F.col("id") % 200, F.floor(F.col("id") / 200), 1, F.lit(20)).alias("i")
    )
    counts = [r["count"] for r in df.groupBy("i").count().collect()]
    assert len(counts) == 20 and min(counts) > 850 and max(counts) < 1150


def test_total_rows_are_sums(spark, weekly):
    rows = with_total_rows(weekly).collect()
    total = {r[PERIOD]: r for r in rows if r[SERIES] == "TOTAL"}
    for p, t in total.items():
        parts = [r for r in rows if r[PERIOD] == p and r[SERIES] != "TOTAL"]
        assert len(parts) == 3
        assert all(t[s] == sum(r[s] for r in parts) for s in STAGES)


def test_dispersion_guards(spark):
    rows = [("few", week(i), 5.0, 4.0) for i in range(5)]
    rows += [("even", week(i), 4.0, 4.0) for i in range(30)]
    rows += [("wild", week(i), float(20 * (i % 2)), 10.0) for i in range(30)]
    out = by_key(
        dispersion(frame(spark, rows, "series string, period date, y double, m double"), "y", "m"), SERIES
    )
    assert out[("few",)]["theta"] is None and out[("even",)]["theta"] is None
    assert out[("wild",)]["theta"] == pytest.approx(30 * 100 / (30 * 90))


