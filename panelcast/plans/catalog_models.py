"""Queries for fitting and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators.calendar import DAY, WEEK, densify_within, horizon
from panelcast.operators.fit import (
    beta_moments,
    candidate_fits,
    choose_by_aicc,
    dispersion,
    fit_autoregression,
    fit_boosted,
    fit_delay_weights,
    fit_delay_weights_sparse,
    fit_line,
    fit_linear,
    fit_linear_sparse,
    fit_pooled,
    fit_smoothing,
    flat_forecast,
    predict_linear,
    smoothing_fitted,
    weight_rows,
)
from panelcast.operators.project import (
    apportion,
    bands,
    cap_weights,
    cap_outflow,
    cascade,
    convolve,
    convolve_sparse,
    decaying,
    delay_distribution,
    ensemble,
    extend,
    hazards,
    lag_ratio_projection,
    log_residuals,
    opening_cohorts,
    project_autoregression,
    regression_feedback,
    replay_last,
    smooth_weights,
    stacked_regression,
    stock_flow,
    weight_summary,
)
from panelcast.operators.trees import fit_trees, predict_trees
from panelcast.operators.windows import (
    backlog,
    lag_columns,
    ordered,
    recent_level,
    rolling,
    stack,
    trend,
    with_stock,
)
from panelcast.plans.catalog_tables import WALK_SQL, walk_forecast, walk_of
from panelcast.plans.panels import (
    CUTOFF,
    EVENTS_SQL,
    ORDERS_SQL,
    PARTS_SQL,
    WEIGHTS_SQL,
    dense_orders,
    dense_parts,
    dense_sql,
    events_panel,
    line_weights,
    orders_panel,
    parts_cells,
    parts_panel,
    table,
    weight_arrays,
    written_panel,
)
from panelcast.plans.registry import query, r, rounded, rs
from panelcast.schema import PERIOD, SERIES, STAGES
from panelcast.sources.tables import materialise

_BY = "PARTITION BY series ORDER BY period"
_W = f"OVER ({_BY})"


def two_regressor_sql(src: str, y: str, x1: str, x2: str, name: str, key: str = "series") -> str:
    """Closed-form least squares with two regressors and an intercept per key."""
    group, select = (f"GROUP BY {key}", f"{key}, ") if key else ("", "")
    return f"""
{name}_rows AS (SELECT * FROM {src} WHERE {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL),
{name}_m AS (SELECT {select}count(*) AS n, avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2,
  var_pop({x1}) AS s11, var_pop({x2}) AS s22, covar_pop({x1}, {x2}) AS s12,
  covar_pop({x1}, {y}) AS s1y, covar_pop({x2}, {y}) AS s2y, var_pop({y}) AS syy
  FROM {name}_rows {group}),
{name} AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (syy - b1 * s1y - b2 * s2y) AS sse FROM (
  SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
    (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM {name}_m))"""


_LAGGED = f"""lagged AS (SELECT *, lag(visas_issued) {_W} AS v1, lag(visas_issued, 2) {_W} AS v2,
  lag(arrivals) {_W} AS a1, row_number() {_W} AS t FROM po)"""


def _lagged(spark, d):
    w = ordered()
    return orders_panel(spark, d).withColumns(
        {
            "v1": F.lag("visas_issued").over(w),
            "v2": F.lag("visas_issued", 2).over(w),
            "a1": F.lag("arrivals").over(w),
            "t": trend().cast("double"),
        }
    )


def _cells(spark, d, y, terms):
    cells, low, high = parts_cells(spark, d)
    return cells, y, terms, low, high


# --- regressions ------------------------------------------------------------------


@query(
    "pooled_regression_m1",
    f"""WITH {ORDERS_SQL}, {_LAGGED}, {two_regressor_sql("lagged", "arrivals", "v1", "a1", "fit", "")}
    SELECT series, period, {r("b0 + b1 * v1 + b2 * a1", "prediction")} FROM lagged, fit
    WHERE v1 IS NOT NULL AND a1 IS NOT NULL""",
)
def _(spark, d):
    rows = _lagged(spark, d)
    model = fit_pooled(rows, "arrivals", ["v1", "a1"])
    return rounded(model.transform(rows).select(SERIES, PERIOD, "prediction"))


@query(
    "pooled_moment_regression_m1",
    f"""WITH {ORDERS_SQL}, {_LAGGED}, {two_regressor_sql("lagged", "arrivals", "v1", "a1", "fit", "")}
    SELECT series, period, {r("b0 + b1 * v1 + b2 * a1", "prediction")} FROM lagged, fit""",
)
def _(spark, d):
    rows = _lagged(spark, d)
    model = fit_linear(rows, "arrivals", ["v1", "a1"], keys=())
    fitted = predict_linear(rows, model, ["v1", "a1"], keys=())
    return rounded(fitted.select(SERIES, PERIOD, "prediction"))


@query(
    "series_line_m2",
    f"""WITH {PARTS_SQL}, {dense_sql("px", "dense")}, l AS (SELECT series, arrivals,
      lag(applications) {_W} AS x FROM dense)
    SELECT series, {r("regr_slope(arrivals, x)", "slope")},
      {r("regr_intercept(arrivals, x)", "intercept")}, {r("regr_r2(arrivals, x)", "r2")},
      regr_count(arrivals, x) AS n FROM l GROUP BY series""",
)
def _(spark, d):
    dense = dense_parts(spark, d)
    lagged = dense.withColumn("x", F.lag("applications").over(ordered()))
    return rounded(fit_line(lagged, "arrivals", "x"))


@query(
    "series_regression_m2",
    f"""WITH {PARTS_SQL}, {dense_sql("px", "dense")}, l AS (SELECT series, arrivals,
      lag(applications) {_W} AS x, row_number() {_W} AS t FROM dense),
    {two_regressor_sql("l", "arrivals", "x", "t", "fit")}
    SELECT series, n, {r("b0", "intercept")}, {r("b1", "b_lag")}, {r("b2", "b_trend")},
      {r("sse", "sse", 5)} FROM fit""",
)
def _(spark, d):
    fit = fit_linear_sparse(*_cells(spark, d, "arrivals", [("applications", 1)]), trend=True)
    return rounded(
        fit.select(
            SERIES,
            "n",
            "intercept",
            F.col("coef")[0].alias("b_lag"),
            F.col("coef")[1].alias("b_trend"),
            F.round("sse", 5).alias("sse"),
        )
    )


@query("boosted_trees_m3")
def _(spark, d):
    xs = ["v1", "v2", "a1", "t"]
    rows = _lagged(spark, d)
    model = fit_boosted(rows, "arrivals", xs)
    return model.transform(rows).select(SERIES, PERIOD, "arrivals", "prediction")


_TREE_XS = ["v1", "v2", "a1", "t"]


def stump_sql(src: str, y: str, xs: list[str], name: str) -> str:
    """The best single cut of residuals *y* over all features, and what is left after 0.1 of its leaves."""
    values = " UNION ALL ".join(f"SELECT {i} AS feature, {x}::DOUBLE AS value, {y} AS r FROM {src} WHERE {x} IS NOT NULL" for i, x in enumerate(xs))
    value = "CASE feature " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    return f"""
{name}_v AS (SELECT feature, value, count(*) AS n, sum(r) AS r FROM ({values}) GROUP BY 1, 2),
{name}_c AS (SELECT *, sum(n) OVER w AS nl, sum(r) OVER w AS rl, sum(n) OVER (PARTITION BY feature) AS nn,
  sum(r) OVER (PARTITION BY feature) AS rr FROM {name}_v WINDOW w AS (PARTITION BY feature ORDER BY value)),
{name}_g AS (SELECT feature, value AS threshold, round(rl * rl / nl + (rr - rl) * (rr - rl) / (nn - nl) - rr * rr / nn, 9) AS gain
  FROM {name}_c WHERE nl < nn),
{name}_b AS (SELECT * FROM {name}_g WHERE gain > 0 ORDER BY gain DESC, feature, threshold LIMIT 1),
{name}_s AS (SELECT s.*, coalesce({value} <= threshold, false) AS goes_left FROM {src} s, {name}_b),
{name} AS (SELECT * EXCLUDE ({y}, goes_left), {y} - 0.1::DOUBLE * avg({y}) OVER (PARTITION BY goes_left) AS {y} FROM {name}_s)"""


@query(
    "boosted_stumps_m3",
    f"""WITH {ORDERS_SQL}, {_LAGGED}, r0 AS (SELECT series, period, arrivals, v1, v2, a1, t,
      arrivals - avg(arrivals) OVER () AS r FROM lagged), {stump_sql("r0", "r", _TREE_XS, "s1")},
    {stump_sql("s1", "r", _TREE_XS, "s2")}
    SELECT series, period, {r("arrivals - r", "prediction")} FROM s2""",
)
def _(spark, d):
    rows = materialise(_lagged(spark, d))
    model = fit_trees(rows, "arrivals", _TREE_XS, rounds=2, depth=1)
    return rounded(predict_trees(rows, model, _TREE_XS, 2, 1).select(SERIES, PERIOD, "prediction"))


@query("boosted_forecast_m3")
def _(spark, d):
    history = dense_orders(spark, d).filter(F.col(PERIOD) <= F.lit(CUTOFF))
    ahead = extend(history, 13, {"visas_issued": rolling("visas_issued", 4), "applications": rolling("applications", 4)})
    features = lag_columns(["visas_issued", "applications"], [1, 2]) | {"t": trend().cast("double")}
    rows = materialise(ahead.withColumns(features))
    xs = [c for c in features]
    model = fit_boosted(rows.filter("h = 0"), "arrivals", xs)
    return model.transform(rows.filter("h > 0")).select(SERIES, "h", PERIOD, "prediction")


_BOUNDS = ("forecast", "lo80", "hi80", "lo95", "hi95")


@query(
    "random_walk_bands_m4",
    f"WITH {ORDERS_SQL}, {WALK_SQL} SELECT series, h, period, {rs(*_BOUNDS)} FROM walk",
)
def _(spark, d):
    return rounded(walk_forecast(spark, d))


_ALPHAS = tuple(round(0.1 * i, 1) for i in range(1, 10))

SMOOTH_SQL = f"""
sm_n AS (SELECT series, period, arrivals AS y, row_number() {_W} AS i FROM po),
sm_a AS (SELECT unnest({list(_ALPHAS)})::DOUBLE AS alpha),
sm_r AS (
  SELECT series, alpha, 1::BIGINT AS i, y AS level, 0::DOUBLE AS sse FROM sm_n, sm_a WHERE i = 1
  UNION ALL
  SELECT f.series, alpha, n.i, level + alpha * (y - level), sse + (y - level) * (y - level)
  FROM sm_r f JOIN sm_n n ON n.series = f.series AND n.i = f.i + 1),
sm_end AS (SELECT series, max(i) AS n FROM sm_n GROUP BY series),
smooth AS (SELECT series, alpha, level, sse, n FROM (
  SELECT f.*, n, row_number() OVER (PARTITION BY f.series ORDER BY sse, alpha) AS best
  FROM sm_r f JOIN sm_end e ON e.series = f.series AND e.n = f.i) WHERE best = 1)"""


@query(
    "smoothing_grid_m5",
    f"""WITH RECURSIVE {ORDERS_SQL}, {SMOOTH_SQL}
    SELECT series, CAST(h AS INTEGER) AS h, alpha, {r("level", "forecast")}, {r("sse", "sse", 4)} FROM smooth, range(1, 14) AS g(h)""",
)
def _(spark, d):
    panel = written_panel(spark, d)
    fit = fit_smoothing(panel, "arrivals", _ALPHAS)
    flat = flat_forecast(fit, panel, 13)
    return rounded(
        flat.join(fit.select(SERIES, "alpha", F.round("sse", 4).alias("sse")), SERIES).select(
            SERIES, "h", "alpha", "forecast", "sse"
        )
    )


@query(
    "smoothing_free_start_m5",
    f"""WITH {PARTS_SQL}, {dense_sql("px", "dense")}, ys AS (SELECT series, list(applications ORDER BY period) AS y FROM dense GROUP BY series),
    al AS (SELECT unnest({list(_ALPHAS)})::DOUBLE AS alpha),
    st AS (SELECT series, alpha, len(y) AS n, list_reduce(list_prepend([0, 1, 0, 0, 0]::DOUBLE[], list_transform(y, lambda v: [v])),
      lambda s, x: [s[1] + alpha * (x[1] - s[1]), s[2] * (1 - alpha), s[3] + (x[1] - s[1]) * (x[1] - s[1]),
                    s[4] + (x[1] - s[1]) * s[2], s[5] + s[2] * s[2]]) AS s FROM ys, al),
    fit AS (SELECT series, alpha, n, s[1] + s[2] * s[4] / s[5] AS level, s[3] - s[4] * s[4] / s[5] AS sse FROM st)
    SELECT series, alpha, {r("level")}, {r("sse")}, n FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY sse, alpha) AS k
      FROM fit) WHERE k = 1""",
)
def _(spark, d):
    dense = dense_parts(spark, d)
    return rounded(fit_smoothing(dense, "applications", _ALPHAS, start="optimal"))


@query(
    "autoregression_with_inputs_m6",
    f"""WITH {ORDERS_SQL}, {_LAGGED}, {two_regressor_sql("lagged", "arrivals", "a1", "v1", "fit")}
    SELECT l.series, l.period, {r("b0 + b1 * a1 + b2 * v1", "prediction")}
    FROM lagged l JOIN fit ON fit.series = l.series""",
)
def _(spark, d):
    model, design, xs = fit_autoregression(
        orders_panel(spark, d), "arrivals", {"visas_issued": [1]}, p=1
    )
    return rounded(predict_linear(design, model, xs).select(SERIES, PERIOD, "prediction"))


_LONG_TERMS = [
    *(("arrivals", k) for k in (1, 2)),
    *(("visas_issued", k) for k in (1, 2, 3, 4)),
    *(("applications", k) for k in (1, 2)),
]


def elimination_sql(src: str, y: str, xs: list[str], name: str, tol: float = 1e-9) -> str:
    """Least squares on any number of regressors: one CTE for each pivot of the covariances.

    Row *i* holds what is left of regressor i after those before it; a regressor of which nothing is
    left counts for nothing.  Back substitution then gives the coefficients.
    """
    p, cols = len(xs), [y, *xs]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    g = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    rows = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    n = "count(*)"
    first = [
        f"({n} * sum({cols[i]} * {cols[j]}) - sum({cols[i]}) * sum({cols[j]})) / ({n} * {n})::DOUBLE AS {g(i, j)}"
        for i, j in pairs
    ]
    means = [f"avg({c}) AS m{i}" for i, c in enumerate(cols)]
    out = [
        f"{name}_0 AS (SELECT series, {n} AS n, {', '.join([*means, *first])} FROM {src} WHERE {rows} GROUP BY series)",
        f"{name}_s AS (SELECT *, {', '.join(f'{g(k, k)} AS s{k}' for k in range(1, p + 1))} FROM {name}_0)",
    ]
    last = f"{name}_s"
    for k in range(1, p + 1):
        rest = [(i, j) for i, j in pairs if (i == 0 or i > k) and (j == 0 or j > k)]
        kept = "".join(f", {g(k, i)} AS r{k}_{i}" for i in [0, *range(k + 1, p + 1)])
        old = "".join(f", r{q}_{i}" for q in range(1, k) for i in [0, *range(q + 1, p + 1)])
        pivots = "".join(f", d{q}" for q in range(1, k))
        live = f"{g(k, k)} > {tol}::DOUBLE * s{k}"
        sweep = ", ".join(f"{g(i, j)} - CASE WHEN {live} THEN {g(i, k)} * {g(k, j)} / {g(k, k)} ELSE 0 END AS {g(i, j)}" for i, j in rest)
        stay = ", ".join([f"m{i}" for i in range(p + 1)] + [f"s{q}" for q in range(1, p + 1)])
        out.append(f"{name}_{k} AS (SELECT series, n, {stay}{pivots}{old}{kept}, CASE WHEN {live} THEN {g(k, k)} END AS d{k}, {sweep} FROM {last})")
        last = f"{name}_{k}"
    for k in range(p, 0, -1):
        after = "".join(f" - r{k}_{i} * b{i}" for i in range(k + 1, p + 1))
        out.append(f"{name}_b{k} AS (SELECT *, CASE WHEN d{k} IS NULL THEN 0 ELSE (r{k}_0{after}) / d{k} END AS b{k} FROM {last})")
        last = f"{name}_b{k}"
    level = "".join(f" - b{i} * m{i}" for i in range(1, p + 1))
    full = " AND ".join(f"d{k} IS NOT NULL" for k in range(1, p + 1))
    out.append(f"{name} AS (SELECT *, m0{level} AS b0, greatest(0, n * g0_0) AS sse, {full} AS regular FROM {last})")
    return ",\n".join(out)


_LONG_SQL_TERMS = ", ".join(f"lag({c}, {k}) {_W} AS x{i}" for i, (c, k) in enumerate(_LONG_TERMS))


@query(
    "autoregression_long_m6",
    f"""WITH {PARTS_SQL}, {dense_sql("px", "dense")}, l AS (SELECT series, arrivals AS y, {_LONG_SQL_TERMS} FROM dense),
    {elimination_sql("l", "y", [f"x{i}" for i in range(len(_LONG_TERMS))], "fit")}
    SELECT series, n, {r("b0", "intercept", 5)}, {r("sse", "sse", 5)} FROM fit""",
)
def _(spark, d):
    model = fit_linear_sparse(*_cells(spark, d, "arrivals", _LONG_TERMS))
    return rounded(model.select(SERIES, "n", "intercept", "sse"), 5)


#: AR(2) of the dense orders panel up to the cutoff, rolled forward: ``roll`` has series, h, e and y.
AR_SQL = f"""hist AS (SELECT * FROM dense WHERE period <= DATE '{CUTOFF}'),
    l AS (SELECT *, lag(arrivals) {_W} AS y1, lag(arrivals, 2) {_W} AS y2 FROM hist),
    {two_regressor_sql("l", "arrivals", "y1", "y2", "fit")},
    roll AS (SELECT f.series, 1 AS h, max(l.period) AS e, arg_max(l.arrivals, l.period) AS p1, arg_max(y1, l.period) AS p2,
        any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
        any_value(b0) + any_value(b1) * arg_max(l.arrivals, l.period) + any_value(b2) * arg_max(y1, l.period) AS y
      FROM fit f JOIN l ON l.series = f.series GROUP BY f.series
      UNION ALL SELECT series, h + 1, e, y, p1, b0, b1, b2, b0 + b1 * y + b2 * p1 FROM roll WHERE h < 13)"""


def autoregression_forecast(history):
    model, _, _ = fit_autoregression(history, "arrivals", p=2)
    return project_autoregression(extend(history, 13, {}), model, "arrivals", p=2)


@query(
    "autoregression_forecast_m6",
    f"""WITH RECURSIVE {ORDERS_SQL}, {dense_sql("po", "dense")}, {AR_SQL}
    SELECT series, h, e + CAST(h * 7 AS INTEGER) AS period, {r("y", "forecast")} FROM roll""",
)
def _(spark, d):
    return rounded(autoregression_forecast(dense_orders(spark, d).filter(F.col(PERIOD) <= F.lit(CUTOFF))))


@query(
    "autoregression_inputs_forecast_m6",
    f"""WITH RECURSIVE {ORDERS_SQL}, {dense_sql("po", "dense")}, hist AS (SELECT * FROM dense WHERE period <= DATE '{CUTOFF}'),
    l AS (SELECT *, lag(arrivals) {_W} AS a1, lag(visas_issued) {_W} AS v1,
      avg(visas_issued) OVER ({_BY} ROWS 3 PRECEDING) AS ahead FROM hist),
    {two_regressor_sql("l", "arrivals", "a1", "v1", "fit")},
    last AS (SELECT series, max(period) AS e, arg_max(arrivals, period) AS y, arg_max(visas_issued, period) AS v,
      arg_max(ahead, period) AS ahead FROM l GROUP BY series),
    roll AS (SELECT f.series, 1 AS h, e, ahead, b0, b1, b2, b0 + b1 * y + b2 * v AS y FROM fit f JOIN last ON last.series = f.series
      UNION ALL SELECT series, h + 1, e, ahead, b0, b1, b2, b0 + b1 * y + b2 * ahead FROM roll WHERE h < 13)
    SELECT series, h, e + CAST(h * 7 AS INTEGER) AS period, {r("y", "forecast")} FROM roll""",
)
def _(spark, d):
    history = dense_orders(spark, d).filter(F.col(PERIOD) <= F.lit(CUTOFF))
    inputs = {"visas_issued": [1]}
    model, _, _ = fit_autoregression(history, "arrivals", inputs, p=1)
    rows = extend(history, 13, {"visas_issued": rolling("visas_issued", 4)})
    return rounded(project_autoregression(rows, model, "arrivals", inputs, p=1))


@query(
    "model_choice_aicc_m7",
    f"""WITH {ORDERS_SQL}, s AS (SELECT series, arrivals AS y, row_number() {_W} AS t,
      arrivals - lag(arrivals) {_W} AS dy FROM po),
    c AS (SELECT series, 'mean' AS model, var_pop(y) * count(y) AS sse, count(y) AS n, 2 AS k
        FROM s GROUP BY series
      UNION ALL SELECT series, 'random_walk', sum(dy * dy), count(dy), 1 FROM s GROUP BY series
      UNION ALL SELECT series, 'trend', regr_syy(y, t) - regr_r2(y, t) * regr_syy(y, t), count(y), 3
        FROM s GROUP BY series),
    sc AS (SELECT series, model, n * ln(sse / n) + 2 * k + (2 * k * (k + 1))::DOUBLE / (n - k - 1) AS aicc
      FROM c WHERE sse > 0 AND n - k - 1 > 0)
    SELECT series, model, {r("aicc")} FROM (SELECT *, row_number() OVER (PARTITION BY series
      ORDER BY aicc, model) AS i FROM sc) WHERE i = 1""",
)
def _(spark, d):
    return rounded(choose_by_aicc(candidate_fits(orders_panel(spark, d), "arrivals")))


# --- delay weights -------------------------------------------------------------------


@query(
    "delay_weights_two_lags_m8",
    f"""WITH {PARTS_SQL}, {dense_sql("px", "dense")}, l AS (SELECT series, arrivals AS y,
      applications AS x0, lag(applications) {_W} AS x1 FROM dense),
    g AS (SELECT series, sum(x0 * x0) AS g00, sum(x0 * x1) AS g01, sum(x1 * x1) AS g11,
      sum(x0 * y) AS r0, sum(x1 * y) AS r1 FROM l WHERE x1 IS NOT NULL GROUP BY series),
    sums AS (SELECT series, count(*) AS n, sum(applications) AS sx, sum(arrivals) AS sy
      FROM dense GROUP BY series),
    f AS (SELECT *, g00 * g11 - g01 * g01 AS det, (g11 * r0 - g01 * r1) / nullif(g00 * g11 - g01 * g01, 0) AS f0,
      (g00 * r1 - g01 * r0) / nullif(g00 * g11 - g01 * g01, 0) AS f1 FROM g),
    c AS (SELECT f.series, n, sx, sy,
      CASE WHEN f0 > 0 AND f1 > 0 THEN f0
           WHEN r0 * r0 / g00 >= r1 * r1 / g11 THEN r0 / g00 ELSE 0 END AS u0,
      CASE WHEN f0 > 0 AND f1 > 0 THEN f1
           WHEN r0 * r0 / g00 >= r1 * r1 / g11 THEN 0 ELSE r1 / g11 END AS u1
      FROM f JOIN sums ON sums.series = f.series)
    SELECT series, CAST(k AS INTEGER) AS k, {r('''CASE WHEN n <= 5 OR sx = 0 OR sy = 0 THEN 0
        ELSE CASE k WHEN 0 THEN u0 ELSE u1 END / greatest(u0 + u1, 1) END''', "w")}
    FROM c, range(0, 2) AS t(k)""",
)
def _(spark, d):
    cells, low, high = parts_cells(spark, d)
    return rounded(weight_rows(fit_delay_weights_sparse(cells, "applications", "arrivals", low, high, 1)))


def nonnegative_sql(src: str, y: str, xs: list[str], name: str, sweeps: int = 250) -> str:
    """Non-negative least squares without intercept by sweeps of coordinate descent."""
    p = range(len(xs))
    g = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    sums = [f"sum({xs[i]} * {xs[j]}) AS {g(i, j)}" for i in p for j in range(i, len(xs))]
    sums += [f"sum({x} * {y}) AS r{i}" for i, x in enumerate(xs)]
    step = f"SELECT * FROM {name}_w"
    for k in p:
        rest = " + ".join(f"{g(k, j)} * w{j}" for j in p if j != k)
        step = f"SELECT * REPLACE (CASE WHEN {g(k, k)} > 0 THEN greatest(0, (r{k} - ({rest})) / {g(k, k)}) ELSE 0 END AS w{k}) FROM ({step})"
    return f"""
{name}_g AS (SELECT series, {", ".join(sums)} FROM {src} GROUP BY series),
{name}_w AS (SELECT *, 0 AS sweep, {", ".join(f"0::DOUBLE AS w{k}" for k in p)} FROM {name}_g
  UNION ALL SELECT * REPLACE (sweep + 1 AS sweep) FROM ({step}) WHERE sweep < {sweeps}),
{name} AS (SELECT * FROM {name}_w WHERE sweep = {sweeps})"""


_SIX = ", ".join(f"w{k}" for k in range(7))


@query(
    "delay_weights_m8",
    f"""WITH RECURSIVE {PARTS_SQL}, {dense_sql("px", "dense")}, l AS (SELECT series, arrivals AS y,
      {", ".join(f"lag(visas_issued, {k}) {_W} AS x{k}" for k in range(7))} FROM dense),
    full_rows AS (SELECT * FROM l WHERE x6 IS NOT NULL), {nonnegative_sql("full_rows", "y", [f"x{k}" for k in range(7)], "fit")},
    sums AS (SELECT series, count(*) AS n, sum(visas_issued) AS sx, sum(arrivals) AS sy FROM dense GROUP BY series),
    u AS (SELECT fit.*, n, sx, sy, greatest(1, {_SIX.replace(",", " +")}) AS total
      FROM fit JOIN sums ON sums.series = fit.series)
    SELECT series, CAST(k AS INTEGER) AS k,
      {r(f"CASE WHEN n <= 10 OR sx = 0 OR sy = 0 THEN 0 ELSE [{_SIX}][k + 1] / total END", "w", 9)}
    FROM u, range(0, 7) AS t(k)""",
)
def _(spark, d):
    cells, low, high = parts_cells(spark, d)
    return rounded(weight_rows(fit_delay_weights_sparse(cells, "visas_issued", "arrivals", low, high, 6)), 9)


@query("delay_weights_shrunk_m8")
def _(spark, d):
    fits = fit_delay_weights(
        densify_within(events_panel(spark, d), DAY, fill=0.0), "visas_issued", "arrivals", 26, cap=0.999, shrink=True
    )
    return rounded(weight_rows(fits))


@query(
    "weight_diagnostics_m9",
    f"""WITH {WEIGHTS_SQL} SELECT series, {r("sum(w)", "conversion")},
      {r("sum(k * w) / sum(w)", "mean_delay")} FROM weights GROUP BY series""",
)
def _(spark, d):
    return rounded(weight_summary(line_weights(spark, d)))


@query(
    "delay_distribution_m9",
    f"""WITH {WEIGHTS_SQL} SELECT series, CAST(k AS INTEGER) AS k,
      {r("w / sum(w) OVER (PARTITION BY series)", "share")} FROM weights""",
)
def _(spark, d):
    return rounded(delay_distribution(line_weights(spark, d)).select(SERIES, "k", "share"))


_K = "OVER (PARTITION BY series ORDER BY k)"


@query(
    "smoothed_weights_m10",
    f"""WITH {WEIGHTS_SQL}, s AS (SELECT series, k, w,
      CASE WHEN lag(w) {_K} IS NULL OR lead(w) {_K} IS NULL THEN w
           ELSE (lag(w) {_K} + w + lead(w) {_K}) / 3 END AS v FROM weights)
    SELECT series, CAST(k AS INTEGER) AS k, {r('''v * sum(w) OVER (PARTITION BY series)
      / sum(v) OVER (PARTITION BY series)''', "w")} FROM s""",
)
def _(spark, d):
    return rounded(smooth_weights(line_weights(spark, d)))


@query(
    "smoothed_capped_weights_m10",
    f"""WITH {WEIGHTS_SQL}, d AS (SELECT series, k, 2 * w AS w FROM weights),
    s AS (SELECT series, k, w, CASE WHEN lag(w) {_K} IS NULL OR lead(w) {_K} IS NULL THEN w
           ELSE (lag(w) {_K} + w + lead(w) {_K}) / 3 END AS v FROM d),
    t AS (SELECT series, k, v * sum(w) OVER (PARTITION BY series) / sum(v) OVER (PARTITION BY series)
      AS w FROM s)
    SELECT series, CAST(k AS INTEGER) AS k,
      {r("w * least(1, 0.999::DOUBLE / sum(w) OVER (PARTITION BY series))", "w")} FROM t""",
)
def _(spark, d):
    doubled = line_weights(spark, d).withColumn("w", F.col("w") * 2)
    return rounded(cap_weights(smooth_weights(doubled), 0.999))


@query(
    "hazards_m11",
    f"""WITH {WEIGHTS_SQL} SELECT series, CAST(k AS INTEGER) AS k,
      {r(f'''least(1, greatest(0, w / (1 - (sum(w) {_K} - w))))''', "hazard")} FROM weights""",
)
def _(spark, d):
    return rounded(hazards(line_weights(spark, d)).select(SERIES, "k", "hazard"))


_APPORTION_SQL = """
{name}_y AS (SELECT *, greatest(x, 0) * (target / sum(greatest(x, 0)) OVER (PARTITION BY series)) AS y FROM {src}),
{name}_f AS (SELECT *, floor(y) AS base, row_number() OVER (PARTITION BY series
  ORDER BY y - floor(y) DESC, {by}) AS rank FROM {name}_y),
{name} AS (SELECT *, CAST(CASE WHEN target <= 0 THEN 0 ELSE base + CASE WHEN rank <= target
  - sum(base) OVER (PARTITION BY series) THEN 1 ELSE 0 END END AS BIGINT) AS units FROM {name}_f)"""


@query(
    "opening_cohorts_m12",
    f"""WITH {ORDERS_SQL}, {WEIGHTS_SQL},
    b AS (SELECT series, round_even(greatest(0, sum(applications - arrivals)), 0) AS target FROM po
      GROUP BY series),
    ranked AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS age,
      applications AS a FROM po),
    surv AS (SELECT series, k AS age, greatest(0, 1 - (sum(w) {_K} - w)) AS s FROM weights),
    raw AS (SELECT ranked.series, ranked.age, a * s AS x, target FROM ranked
      JOIN surv ON surv.series = ranked.series AND surv.age = ranked.age AND surv.age >= 1
      JOIN b ON b.series = ranked.series), {_APPORTION_SQL.format(name="ap", src="raw", by="age")}
    SELECT series, CAST(age AS INTEGER) AS age, units FROM ap""",
)
def _(spark, d):
    return opening_cohorts(
        orders_panel(spark, d), line_weights(spark, d), "applications", "arrivals"
    )


@query(
    "apportionment_m13",
    f"""WITH src AS (SELECT CAST(l_suppkey AS VARCHAR) AS series, l_linenumber, sum(l_quantity) AS x,
      1009 AS target FROM lineitem GROUP BY 1, 2),
    {_APPORTION_SQL.format(name="ap", src="src", by="l_linenumber")}
    SELECT series, l_linenumber, units FROM ap""",
)
def _(spark, d):
    shares = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias(SERIES), "l_linenumber")
        .agg(F.sum("l_quantity").alias("x"))
        .withColumn("target", F.lit(1009))
    )
    return apportion(shares, "x", "target", "l_linenumber").select(SERIES, "l_linenumber", "units")


# --- projection ------------------------------------------------------------------------

_EXTENDED = f"""hist AS (SELECT *, 0 AS h FROM po WHERE period <= DATE '{CUTOFF}'),
ends AS (SELECT series, max(period) AS last FROM hist GROUP BY series),
m4 AS (SELECT series, avg(applications) AS level FROM (SELECT *, row_number() OVER (
  PARTITION BY series ORDER BY period DESC) AS i FROM hist) WHERE i <= 4 GROUP BY series),
ext AS (SELECT period, series, applications, visas_issued, arrivals, CAST(h AS INTEGER) AS h FROM hist
  UNION ALL SELECT last + CAST(g.h * 7 AS INTEGER), ends.series, level, NULL, NULL, CAST(g.h AS INTEGER)
  FROM ends JOIN m4 ON m4.series = ends.series, range(1, 14) AS g(h))"""


def _extended(spark, d, h=13):
    history = written_panel(spark, d).filter(F.col(PERIOD) <= F.lit(CUTOFF))
    return extend(history, h, {"applications": rolling("applications", 4)})


def _lag_sum(col: str, n: int = 7) -> str:
    return " + ".join(f"coalesce(w{k} * lag({col}, {k}) {_W}, 0)" for k in range(n))


_WIDE_W = "ww AS (SELECT series, " + ", ".join(
    f"max(CASE WHEN k = {k} THEN w END) AS w{k}" for k in range(7)
) + " FROM weights GROUP BY series)"


@query(
    "convolution_cascade_m14",
    f"""WITH {ORDERS_SQL}, {WEIGHTS_SQL}, {_WIDE_W}, {_EXTENDED},
    c1 AS (SELECT ext.series, period, h, applications,
      CASE WHEN h = 0 THEN visas_issued ELSE greatest(0, {_lag_sum("applications").replace("PARTITION BY series", "PARTITION BY ext.series")}) END AS v,
      arrivals FROM ext JOIN ww ON ww.series = ext.series),
    c2 AS (SELECT c1.series, period, h, v,
      CASE WHEN h = 0 THEN arrivals ELSE greatest(0, {_lag_sum("v").replace("PARTITION BY series", "PARTITION BY c1.series")}) END AS a
      FROM c1 JOIN ww ON ww.series = c1.series)
    SELECT series, period, h, {r("v", "visas_issued")}, {r("a", "arrivals")} FROM c2 WHERE h > 0""",
)
def _(spark, d):
    w = weight_arrays(line_weights(spark, d))
    out = cascade(_extended(spark, d), w, w, (6, 6), STAGES)
    return rounded(
        out.filter(F.col("h") > 0).select(SERIES, PERIOD, "h", "visas_issued", "arrivals")
    )


@query(
    "sparse_convolution_m14",
    f"""WITH {PARTS_SQL}, k AS (SELECT unnest(range(0, 3)) AS k),
    w AS (SELECT series, k, CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0.125 END::DOUBLE AS w
      FROM (SELECT DISTINCT series FROM px), k)
    SELECT px.series, period + CAST(k * 7 AS INTEGER) AS period, {r("sum(w * arrivals)", "expected")}
    FROM px JOIN w ON w.series = px.series WHERE arrivals <> 0 GROUP BY 1, 2""",
)
def _(spark, d):
    panel = written_panel(spark, d, parts_panel)
    weights = panel.select(SERIES).distinct().withColumn(
        "weights", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.125))
    )
    return rounded(convolve_sparse(panel, weights, "arrivals", "expected"))


@query(
    "lag_ratio_projection_m15",
    f"""WITH {ORDERS_SQL}, q AS (SELECT series, period, visas_issued,
      lead(arrivals, 1) {_W} / nullif(visas_issued, 0) AS r1,
      lead(arrivals, 2) {_W} / nullif(visas_issued, 0) AS r2,
      lead(arrivals, 3) {_W} / nullif(visas_issued, 0) AS r3 FROM po),
    s AS (SELECT series, avg(r1) AS lag1, avg(r2) AS lag2, avg(r3) AS lag3,
      arg_max(visas_issued, period) AS last, max(period) AS e FROM q GROUP BY series)
    SELECT series, e + CAST(h * 7 AS INTEGER) AS period, {rs("lag1", "lag2", "lag3")},
      {r("last * (lag1 + lag2 + lag3) / 3", "forecast")} FROM s, range(1, 13) AS g(h)""",
)
def _(spark, d):
    panel = written_panel(spark, d)
    fit = lag_ratio_projection(panel, "visas_issued", "arrivals")
    grid = horizon(panel, 12)
    return rounded(
        grid.join(fit, SERIES).select(
            SERIES, PERIOD, "lag1", "lag2", "lag3", F.col("per_period").alias("forecast")
        )
    )


# the stock-flow inputs: mean of the last four orders counts, steady rates by series
_FLOW_SQL = f"""{_EXTENDED},
st AS (SELECT series, greatest(0, sum(applications - visas_issued)) AS app_backlog,
  greatest(0, sum(visas_issued - arrivals)) AS visa_stock, sum(visas_issued) / sum(applications) / 4 AS q,
  sum(arrivals) / sum(visas_issued) / 4 AS p FROM hist GROUP BY series),
flow AS (
  SELECT ext.series, ext.h, period, applications, q * (app_backlog + applications) AS issued,
    (1 - q) * (app_backlog + applications) AS s1,
    p * (visa_stock + q * (app_backlog + applications)) AS arrived,
    (1 - p) * (visa_stock + q * (app_backlog + applications)) AS s2
  FROM ext JOIN st ON st.series = ext.series WHERE ext.h = 1
  UNION ALL
  SELECT ext.series, ext.h, ext.period, ext.applications, q * (s1 + ext.applications),
    (1 - q) * (s1 + ext.applications), p * (s2 + q * (s1 + ext.applications)),
    (1 - p) * (s2 + q * (s1 + ext.applications))
  FROM flow JOIN ext ON ext.series = flow.series AND ext.h = flow.h + 1
  JOIN st ON st.series = flow.series)"""


def _flow_inputs(spark, d):
    history = written_panel(spark, d).filter(F.col(PERIOD) <= F.lit(CUTOFF))
    state = history.groupBy(SERIES).agg(
        F.greatest(F.lit(0.0), F.sum(F.col("applications") - F.col("visas_issued"))).alias(
            "app_backlog"
        ),
        F.greatest(F.lit(0.0), F.sum(F.col("visas_issued") - F.col("arrivals"))).alias("visa_stock"),
        (F.sum("visas_issued") / F.sum("applications") / 4).alias("issue_rate"),
        (F.sum("arrivals") / F.sum("visas_issued") / 4).alias("arrival_rate"),
    )
    future = _extended(spark, d).filter(F.col("h") > 0).select(SERIES, PERIOD, "applications")
    inputs = future.join(state.select(SERIES, "issue_rate", "arrival_rate"), SERIES)
    return inputs, state.select(SERIES, "app_backlog", "visa_stock")


@query(
    "stock_flow_m16",
    f"""WITH RECURSIVE {ORDERS_SQL}, {_FLOW_SQL} SELECT series, period, {r("applications")},
      {r("issued", "visas_issued")}, {r("arrived", "arrivals")}, {r("s1", "app_backlog")},
      {r("s2", "visa_stock")} FROM flow""",
)
def _(spark, d):
    return rounded(stock_flow(*_flow_inputs(spark, d)))


@query(
    "regression_feedback_m17",
    f"""WITH RECURSIVE {ORDERS_SQL}, {_EXTENDED},
    bk AS (SELECT *, sum(visas_issued - arrivals) {_W} AS backlog FROM hist),
    l AS (SELECT *, lag(backlog) {_W} AS b1x, lag(visas_issued) {_W} AS i1 FROM bk),
    {two_regressor_sql("l", "arrivals", "b1x", "i1", "fit")},
    last AS (SELECT series, arg_max(backlog, period) AS backlog, arg_max(visas_issued, period) AS issued,
      max(period) AS e FROM bk GROUP BY series),
    roll AS (SELECT fit.series, 1 AS h, e, issued, b0 + b1 * backlog + b2 * issued AS y,
        backlog + issued - (b0 + b1 * backlog + b2 * issued) AS stock
      FROM fit JOIN last ON last.series = fit.series
      UNION ALL SELECT roll.series, h + 1, e, issued, b0 + b1 * stock + b2 * issued,
        stock + issued - (b0 + b1 * stock + b2 * issued)
      FROM roll JOIN fit ON fit.series = roll.series WHERE h < 13)
    SELECT series, e + CAST(h * 7 AS INTEGER) AS period, {r("y", "forecast")}, {r("stock", "backlog", 5)}
    FROM roll""",
)
def _(spark, d):
    w = ordered()
    history = written_panel(spark, d).filter(F.col(PERIOD) <= F.lit(CUTOFF))
    history = history.withColumn("backlog", backlog("visas_issued", "arrivals"))
    rows = history.withColumns(
        {"b1x": F.lag("backlog").over(w), "i1": F.lag("visas_issued").over(w)}
    )
    model = fit_linear(rows, "arrivals", ["b1x", "i1"])
    state = history.groupBy(SERIES).agg(F.max_by("backlog", PERIOD).alias("backlog"))
    future = extend(
        history.select(SERIES, PERIOD, "visas_issued"), 13, {"visas_issued": F.col("visas_issued")}
    )
    future = future.withColumn("i1", F.lag("visas_issued").over(w)).filter(F.col("h") > 0)
    out = regression_feedback(future, model, state, "visas_issued", ["i1"])
    return rounded(out.withColumn("backlog", F.round("backlog", 5)))


@query(
    "feasibility_cap_m18",
    f"""WITH RECURSIVE {ORDERS_SQL}, n AS (SELECT *, row_number() {_W} AS i FROM po),
    cap AS (SELECT series, period, i, least(arrivals, 10 + visas_issued) AS capped,
        10 + visas_issued - least(arrivals, 10 + visas_issued) AS stock FROM n WHERE i = 1
      UNION ALL SELECT n.series, n.period, n.i, least(arrivals, stock + visas_issued),
        stock + visas_issued - least(arrivals, stock + visas_issued)
      FROM cap JOIN n ON n.series = cap.series AND n.i = cap.i + 1)
    SELECT series, period, {r("capped")} FROM cap""",
)
def _(spark, d):
    capped = cap_outflow(orders_panel(spark, d), "arrivals", "visas_issued", 10.0)
    return rounded(capped.select(SERIES, PERIOD, "capped"))


@query(
    "future_features_m19",
    f"""WITH {ORDERS_SQL}, {_EXTENDED}, filled AS (SELECT e.series, e.period, e.h, e.applications,
      coalesce(e.visas_issued, l.v) AS visas_issued, row_number() OVER (PARTITION BY e.series
        ORDER BY e.period) AS trend
      FROM ext e JOIN (SELECT series, arg_max(visas_issued, period) AS v FROM hist GROUP BY series) l
        ON l.series = e.series)
    , f AS (SELECT series, period, h, CAST(trend AS INTEGER) AS trend, {r("applications")}, {", ".join(f"lag(visas_issued, {k}) {_W} AS visas_issued_lag{k}" for k in (1, 2, 3))}
    FROM filled) SELECT * FROM f WHERE h > 0""",
)
def _(spark, d):
    history = written_panel(spark, d).filter(F.col(PERIOD) <= F.lit(CUTOFF))
    future = extend(
        history,
        13,
        {"applications": rolling("applications", 4), "visas_issued": F.col("visas_issued")},
    )
    features = future.withColumns(
        lag_columns(["visas_issued"], [1, 2, 3]) | {"trend": trend()}
    )
    return rounded(features.filter(F.col("h") > 0).drop("arrivals", "visas_issued"))


@query(
    "replayed_features_m19",
    f"""WITH {PARTS_SQL}, e AS (SELECT series, max(period) AS e FROM px GROUP BY series)
    SELECT e.series, CAST(h AS INTEGER) AS h, e + CAST(h * 7 AS INTEGER) AS period, applications, arrivals
    FROM e CROSS JOIN range(1, 13) AS g(h) LEFT JOIN px ON px.series = e.series AND px.period = e + CAST((h - 12) * 7 AS INTEGER)""",
)
def _(spark, d):
    return replay_last(parts_panel(spark, d), 12, ["applications", "arrivals"])


@query(
    "decaying_projection_m20",
    f"""WITH {PARTS_SQL}, {dense_sql("px", "dense", 7, None)}, k AS (SELECT *, max(CASE WHEN arrivals IS NOT NULL THEN period END)
      OVER (PARTITION BY series) AS e FROM dense),
    l AS (SELECT series, avg(applications) AS level, max(e) AS e FROM (
      SELECT *, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS i FROM k WHERE period <= e) WHERE i <= 8 GROUP BY series)
    SELECT series, CAST(h AS INTEGER) AS h, e + CAST(h * 7 AS INTEGER) AS period,
      {r("level * exp(-0.01::DOUBLE * h)", "forecast")} FROM l, range(1, 13) AS g(h)""",
)
def _(spark, d):
    panel = written_panel(spark, d, parts_panel)
    level = recent_level(panel, ["applications"], 8, step_days=WEEK).withColumnRenamed("applications", "level")
    flat = flat_forecast(level, panel, 12)
    return rounded(flat.withColumn("forecast", decaying(F.col("forecast"), F.col("h"), 0.01)))


_MIX = {"walk": 0.2, "mean4": 0.55, "flat": 0.25, "unused": 0.0}

_LONG_SQL = f"""{WALK_SQL},
mean4 AS (SELECT series, avg(arrivals) AS x FROM (SELECT *, row_number() OVER (PARTITION BY series
  ORDER BY period DESC) AS i FROM tr) WHERE i <= 4 GROUP BY series),
flat AS (SELECT series, avg(arrivals) AS x FROM tr GROUP BY series),
fc AS (SELECT 'walk' AS model, series, period, forecast FROM walk
  UNION ALL SELECT 'mean4', w.series, period, x FROM walk w JOIN mean4 m ON m.series = w.series
  UNION ALL SELECT 'flat', w.series, period, x FROM walk w JOIN flat m ON m.series = w.series)"""


def long_forecasts(panel):
    """Three simple forecasters on a panel as (model, series, period, forecast)."""
    train = panel.filter(F.col(PERIOD) <= F.lit(CUTOFF))
    mean4 = recent_level(train, ["arrivals"], 4).withColumnRenamed("arrivals", "level")
    overall = train.groupBy(SERIES).agg(F.avg("arrivals").alias("level"))
    return stack(
        {
            "walk": walk_of(panel).select(SERIES, PERIOD, "forecast"),
            "mean4": flat_forecast(mean4, train, 13).drop("h"),
            "flat": flat_forecast(overall, train, 13).drop("h"),
        },
        "model",
    )


@query(
    "weighted_ensemble_m21",
    f"""WITH {ORDERS_SQL}, {_LONG_SQL} SELECT series, period, 'mix' AS model,
      {r("sum(forecast * CASE model WHEN 'walk' THEN 0.2 WHEN 'mean4' THEN 0.55 ELSE 0.25 END::DOUBLE)",
         "forecast")} FROM fc GROUP BY series, period""",
)
def _(spark, d):
    return rounded(ensemble(long_forecasts(written_panel(spark, d)), _MIX, "mix", keys=(SERIES, PERIOD)))


@query(
    "equal_weight_ensemble_m21",
    f"""WITH {ORDERS_SQL}, {_LONG_SQL} SELECT series, period, 'ensemble' AS model,
      {r("sum(forecast) / count(*)", "forecast")} FROM fc GROUP BY series, period""",
)
def _(spark, d):
    return rounded(ensemble(long_forecasts(written_panel(spark, d)), keys=(SERIES, PERIOD)))


@query(
    "percentage_bands_m22",
    f"""WITH {ORDERS_SQL}, {WALK_SQL} SELECT series, period, forecast,
      round_even(forecast * 0.75::DOUBLE, 0) AS lower, round_even(forecast * 1.25::DOUBLE, 0) AS upper
      FROM walk""",
)
def _(spark, d):
    walk = walk_forecast(spark, d).select(SERIES, PERIOD, "forecast")
    return walk.withColumns(bands(F.col("forecast"), 0.75, 1.25))


@query(
    "beta_moments_m23",
    f"""WITH {EVENTS_SQL}, x AS (SELECT series, CASE WHEN visas_issued > 0 AND arrivals > 0
        AND arrivals < visas_issued THEN arrivals / visas_issued END AS r FROM pe),
    m AS (SELECT series, count(r) AS n, avg(r) AS m, var_samp(r) AS v FROM x GROUP BY series),
    c AS (SELECT *, m * (1 - m) / nullif(v, 0) - 1 AS c FROM m)
    SELECT series, n, {r("CASE WHEN n >= 5 AND v > 0 AND c > 0 THEN m * c ELSE 2 END", "alpha")},
      {r("CASE WHEN n >= 5 AND v > 0 AND c > 0 THEN (1 - m) * c ELSE 2 END", "beta")} FROM c""",
)
def _(spark, d):
    rates = events_panel(spark, d).withColumn("rate", F.try_divide("arrivals", "visas_issued"))
    return rounded(beta_moments(rates, "rate"))


@query(
    "dispersion_m24",
    f"""WITH {PARTS_SQL}, {dense_sql("px", "dense")}, f AS (SELECT series, arrivals AS y,
      greatest(avg(arrivals) OVER ({_BY} ROWS 7 PRECEDING), 0.000001::DOUBLE) AS mu FROM dense)
    SELECT series, count(*) AS n, {r('''CASE WHEN count(*) >= 20 AND sum((y - mu) * (y - mu) - mu) > 0
      THEN sum(mu * mu) / sum((y - mu) * (y - mu) - mu) END''', "theta", 3)} FROM f GROUP BY series""",
)
def _(spark, d):
    dense = dense_parts(spark, d)
    fitted = dense.withColumn("mu", rolling("arrivals", 8))
    out = dispersion(fitted, "arrivals", "mu")
    return rounded(out, 3)


@query(
    "log_residuals_m25",
    f"""WITH {ORDERS_SQL}, {WEIGHTS_SQL}, {_WIDE_W}, y AS (SELECT po.series, period, visas_issued AS v,
      {_lag_sum("applications").replace("PARTITION BY series", "PARTITION BY po.series")} AS fit
      FROM po JOIN ww ON ww.series = po.series),
    l AS (SELECT series, period, ln((v + 1) / (fit + 1)) AS x FROM y)
    SELECT series, period, {r("x - avg(x) OVER (PARTITION BY series)", "residual")} FROM l""",
)
def _(spark, d):
    fitted = convolve(
        orders_panel(spark, d), weight_arrays(line_weights(spark, d)), "applications", 6, "fit"
    )
    return rounded(
        log_residuals(fitted, "visas_issued", "fit").select(SERIES, PERIOD, "residual")
    )


@query(
    "stacked_regression_m26",
    f"""WITH RECURSIVE {ORDERS_SQL}, {SMOOTH_SQL},
    fitted AS (SELECT n.series, n.period, f.level AS fitted FROM sm_r f
      JOIN smooth s ON s.series = f.series AND s.alpha = f.alpha
      JOIN sm_n n ON n.series = f.series AND n.i = f.i + 1),
    {_LAGGED}, j AS (SELECT l.*, fitted FROM lagged l JOIN fitted f
      ON f.series = l.series AND f.period = l.period),
    {two_regressor_sql("j", "arrivals", "fitted", "v1", "fit")}
    SELECT j.series, j.period, {r("b0 + b1 * fitted + b2 * v1", "prediction")}
    FROM j JOIN fit ON fit.series = j.series""",
)
def _(spark, d):
    panel = materialise(_lagged(spark, d))
    first = fit_smoothing(panel, "arrivals", _ALPHAS)
    fitted = smoothing_fitted(panel, "arrivals", first)
    out = stacked_regression(panel, fitted, "arrivals", ["v1"])
    return rounded(out.select(SERIES, PERIOD, "prediction"))


@query(
    "backlog_state_rates_m16",
    f"""WITH {ORDERS_SQL}, b AS (SELECT *, sum(applications - visas_issued) {_W} AS bal FROM po),
    o AS (SELECT *, greatest(0, -min(bal) OVER (PARTITION BY series)) + bal AS stock_end FROM b)
    SELECT series, max(period) AS period, arg_max(stock_end, period) AS stock_end FROM o GROUP BY series""",
)
def _(spark, d):
    stock = with_stock(orders_panel(spark, d), "applications", "visas_issued", "stock")
    state = F.max_by(F.struct(PERIOD, "stock_end"), PERIOD).alias("s")
    return stock.groupBy(SERIES).agg(state).select(SERIES, "s.*")
