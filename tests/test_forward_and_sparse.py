"""Forward autoregression, moments from stored cells only, and delay weights with a certificate."""

import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.calendar import densify
from panelcast.operators.fit import (
    fit_autoregression,
    fit_delay_weights,
    fit_delay_weights_sparse,
    fit_linear,
    fit_linear_sparse,
    nnls_stack,
)
from panelcast.operators.moments import lag_products
from panelcast.operators.project import extend, project_autoregression
from panelcast.operators.windows import ordered, rolling, trend
from panelcast.schema import PERIOD, SERIES
from panelcast.sources.tables import materialise

START = dt.date(2020, 1, 6)
PANEL = "series string, period date, applications double, visas_issued double, arrivals double"


def week(k):
    return START + dt.timedelta(days=7 * k)


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    rows = [("edge", week(0), 2.0, 1.0, 3.0), ("edge", week(59), 1.0, 4.0, 2.0), ("nulls", week(5), None, 2.0, None)]
    for s in range(12):
        for k in sorted(rng.choice(60, rng.integers(1, 50), replace=False).tolist()):
            rows.append((f"s{s}", week(k), *map(float, rng.integers(0, 9, 3))))
    return materialise(spark.createDataFrame(rows, PANEL).repartition(3))


def limits(cells):
    return cells.select(F.min(PERIOD)).scalar(), cells.select(F.max(PERIOD)).scalar()


def test_products_are_those_of_the_dense_panel(cells):
    terms = [("arrivals", 0), ("applications", 3), ("visas_issued", 1), ("applications", 0), ("arrivals", 2)]
    for first in (None, 7):
        got = {r[SERIES]: r for r in lag_products(cells, terms, *limits(cells), trend=True, first=first).collect()}
        dense = densify(cells, fill=0.0).na.fill(0.0).toPandas().sort_values([SERIES, PERIOD])
        assert set(got) == set(dense[SERIES])
        for s, g in dense.groupby(SERIES):
            start = first or 3
            columns = [g[c].to_numpy()[start - k : len(g) - k] for c, k in terms]
            columns.append(np.arange(start, len(g)) + 1.0)
            r = got[s]
            assert (r["n"], r["rows"]) == (60 - start, 60) and r["_all_applications"] == g["applications"].sum()
            for i in range(len(columns)):
                assert r[f"_t{i}"] == columns[i].sum()
                for j in range(i, len(columns)):
                    assert r[f"_p{i}_{j}"] == columns[i] @ columns[j], (s, i, j)


def test_sparse_fit_equals_dense_fit(cells):
    dense = densify(cells, fill=0.0).na.fill(0.0)
    w = ordered()
    rows = dense.withColumns({"x": F.lag("applications", 2).over(w), "z": F.lag("arrivals").over(w), "t": trend().cast("double")})
    want = {r[SERIES]: r for r in fit_linear(rows, "arrivals", ["x", "z", "t"]).collect()}
    sparse = fit_linear_sparse(cells, "arrivals", [("applications", 2), ("arrivals", 1)], *limits(cells), trend=True)
    got = {r[SERIES]: r for r in sparse.collect()}
    assert set(got) == set(want)
    for s, r in want.items():
        assert got[s]["n"] == r["n"] == 58
        assert got[s]["coef"] == pytest.approx(r["coef"], abs=1e-9)
        assert (got[s]["intercept"], got[s]["sse"]) == pytest.approx((r["intercept"], r["sse"]), abs=1e-8)


def test_sparse_plan_makes_no_empty_cells(cells):
    plan = fit_linear_sparse(cells, "arrivals", [("applications", 1)], *limits(cells))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "sequence" not in plan


def test_sparse_delay_weights_equal_dense_ones(cells):
    dense = densify(cells, fill=0.0).na.fill(0.0)
    for lag in (0, 4):
        want = {r[SERIES]: r for r in fit_delay_weights(dense, "applications", "arrivals", lag).collect()}
        got = {r[SERIES]: r for r in fit_delay_weights_sparse(cells, "applications", "arrivals", *limits(cells), lag).collect()}
        assert set(got) == set(want)
        for s, r in want.items():
            assert got[s]["weights"] == pytest.approx(r["weights"], abs=1e-9) and got[s]["status"] == r["status"]
            assert r["kkt"] is None or r["kkt"] < 1e-8
    assert got["nulls"]["status"] == "no signal" and got["nulls"]["weights"] == [0.0] * 5


def _least_cost(g, r):
    best = 0.0
    for n in range(1, len(r) + 1):
        for at in combinations(range(len(r)), n):
            z = np.linalg.lstsq(g[np.ix_(at, at)], r[list(at)], rcond=None)[0]
            if (z >= -1e-12).all():
                best = min(best, 0.5 * z @ g[np.ix_(at, at)] @ z - r[list(at)] @ z)
    return best


def test_stacked_weights_are_optimal():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(60, 9, 5)) + rng.normal(size=(60, 1, 1))
    a[:10, :, 3] = a[:10, :, 1]  # rank-deficient systems
    a[10:14] = 0.0
    y = rng.normal(size=(60, 9)) * 2
    g, r = np.einsum("bti,btj->bij", a, a), np.einsum("bti,bt->bi", a, y)
    w, kkt, settled = nnls_stack(g, r)
    assert settled.all() and (w >= 0).all() and kkt.max() < 1e-7
    for k in range(60):
        assert 0.5 * w[k] @ g[k] @ w[k] - r[k] @ w[k] == pytest.approx(_least_cost(g[k], r[k]), abs=1e-6)
        assert w[k] == pytest.approx(nnls_stack(g[k : k + 1], r[k : k + 1])[0][0], abs=1e-9)  # neighbours do not matter


def test_forward_autoregression_feeds_itself_back(spark, cells):
    history = densify(cells, fill=0.0).na.fill(0.0)
    inputs = {"applications": [1, 3], "visas_issued": [2]}
    model, _, _ = fit_autoregression(history, "arrivals", inputs, p=3)
    rows = extend(history, 5, {"applications": rolling("applications", 4), "visas_issued": F.col("visas_issued")})
    out = project_autoregression(rows, model.filter("series <> 's1'"), "arrivals", inputs, p=3).collect()
    fits = {r[SERIES]: r for r in model.collect()}
    want = {}
    for s, g in rows.toPandas().sort_values([SERIES, PERIOD]).groupby(SERIES):
        y, a, v = (g[c].to_numpy(dtype=float).copy() for c in ("arrivals", "applications", "visas_issued"))
        b = fits[s]["coef"]
        for t in range(60, 65):
            x = [y[t - 1], y[t - 2], y[t - 3], a[t - 1], a[t - 3], v[t - 2]]
            y[t] = fits[s]["intercept"] + float(np.dot(b, x))
            want[s, t - 59] = (week(t), None if s == "s1" else pytest.approx(y[t], abs=1e-7))
    assert {(r[SERIES], r["h"]): (r[PERIOD], r["forecast"]) for r in out} == want


def test_forward_autoregression_needs_its_past(spark):
    rows = [("short", week(0), 1.0), ("gap", week(0), 4.0), ("gap", week(1), None), ("gap", week(2), 3.0)]
    history = spark.createDataFrame(rows, "series string, period date, arrivals double")
    model = spark.createDataFrame([("short", 1.0, [0.5, 0.5]), ("gap", 1.0, [0.5, 0.5])], "series string, intercept double, coef array<double>")
    out = project_autoregression(extend(history, 2, {}), model, "arrivals", p=2).collect()
    assert len(out) == 4 and all(r["forecast"] is None for r in out)
