"""Queries for path ensembles and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators.calendar import recent
from panelcast.operators.evaluate import (
    accuracy,
    mase_scale,
    metrics,
    over_horizon,
    scoreboard,
    with_errors,
)
from panelcast.operators.aggregate import TOTAL
from panelcast.operators.fit import flat_forecast, random_walk
from panelcast.operators.folds import (
    convolution,
    fold_panel,
    last_value,
    prefix_backtest,
    recent_mean,
    smoothing,
    trend_line,
)
from panelcast.operators.forecaster import delay_forecast, delay_paths
from panelcast.operators.paths import (
    FIVE,
    OUTER,
    TAILS,
    bootstrap_paths,
    horizon_paths,
    scenario_paths,
    summarise_paths,
    total_paths,
)
from panelcast.operators.project import log_residuals
from panelcast.operators.windows import difference, recent_level, rolling
from panelcast.plans.catalog_models import (
    _LONG_SQL,
    _SIX,
    AR_SQL,
    autoregression_forecast,
    long_forecasts,
    nonnegative_sql,
)
from panelcast.plans.catalog_tables import WALK_SQL, walk_of
from panelcast.plans.panels import (
    CUTOFF,
    ORDERS_SQL,
    PARTS_SQL,
    PATHS_SQL,
    dense_orders,
    dense_sql,
    event_paths,
    parts_panel,
    table,
    written_panel,
)
from panelcast.plans.registry import query, r, rounded, rs
from panelcast.schema import PERIOD, SERIES
from panelcast.sources.adapters import ForecastShape, adapt_forecast
from panelcast.sources.tables import materialise

_BY = "PARTITION BY series ORDER BY period"
_W = f"OVER ({_BY})"
_N_SIMS = 100



def _draw_sql(seed: int, n: str = "n", of: str = "w") -> str:
    return f"CAST('0x' || substr(md5({of}.series || '|' || s || '|' || {of}.h || '|{seed}'), 1, 15) AS BIGINT) % {n}"


_BOOT_SQL = f"""{WALK_SQL},
pool AS (SELECT series, list(d ORDER BY period) AS p, count(*) AS n FROM tr_d WHERE d IS NOT NULL
  GROUP BY series),
boot AS (SELECT w.series, CAST(s AS INTEGER) AS sim, w.h, w.period, greatest(0, w.forecast + p[{_draw_sql(42)} + 1]) AS value
  FROM walk w JOIN pool ON pool.series = w.series, range(1, {_N_SIMS + 1}) AS g(s))"""


def _boot(spark, d):
    panel = written_panel(spark, d)
    train = panel.filter(F.col(PERIOD) <= F.lit(CUTOFF))
    residuals = train.select(SERIES, PERIOD, difference("arrivals").alias("residual"))
    return bootstrap_paths(walk_of(panel), residuals, _N_SIMS, seed=42)


@query(
    "bootstrap_paths_b1",
    f"WITH {ORDERS_SQL}, {_BOOT_SQL} SELECT series, sim, h, period, {r('value')} FROM boot",
)
def _(spark, d):
    return rounded(_boot(spark, d))


@query(
    "resampled_levels_b1",
    f"""WITH {ORDERS_SQL}, {WALK_SQL}, rec AS (SELECT *, row_number() OVER (PARTITION BY series
      ORDER BY period DESC) AS i FROM tr),
    pool AS (SELECT series, list(arrivals ORDER BY period) AS p, count(*) AS n FROM rec WHERE i <= 12
      GROUP BY series)
    SELECT w.series, CAST(s AS INTEGER) AS sim, w.h, w.period, p[{_draw_sql(7)} + 1] AS value
    FROM walk w JOIN pool ON pool.series = w.series, range(1, {_N_SIMS + 1}) AS g(s)""",
)
def _(spark, d):
    panel = written_panel(spark, d)
    train = panel.filter(F.col(PERIOD) <= F.lit(CUTOFF))
    levels = recent(train, 12).select(SERIES, PERIOD, F.col("arrivals").alias("residual"))
    return bootstrap_paths(walk_of(panel), levels, _N_SIMS, seed=7, mode="level")


@query(
    "multiplied_paths_b1",
    f"""WITH {PARTS_SQL}, tr AS (SELECT *, avg(applications) OVER ({_BY} ROWS 3 PRECEDING) AS mu,
        row_number() OVER (PARTITION BY series ORDER BY period DESC) AS i FROM px WHERE period <= DATE '{CUTOFF}'),
    late AS (SELECT *, ln((applications + 1) / (mu + 1)) AS x FROM tr WHERE i <= 20),
    res AS (SELECT *, x - avg(x) OVER (PARTITION BY series) AS residual FROM late),
    pool AS (SELECT series, list(residual ORDER BY period) AS p, count(*) AS n,
      list(applications ORDER BY period) FILTER (WHERE i <= 12) AS q FROM res GROUP BY series),
    w AS (SELECT series, CAST(h AS INTEGER) AS h, e + CAST(h * 7 AS INTEGER) AS period, forecast FROM (
      SELECT series, max(period) AS e, arg_max(applications, period) AS forecast FROM tr GROUP BY series), range(1, 5) AS g(h)),
    v AS (SELECT w.series, CAST(s AS INTEGER) AS sim, w.h, w.period, CASE WHEN n >= 20 THEN forecast * exp(p[{_draw_sql(5)} + 1])
      ELSE q[{_draw_sql(5, "len(q)")} + 1] END AS value FROM w JOIN pool ON pool.series = w.series, range(1, 6) AS g(s))
    SELECT series, sim, h, period, {r("greatest(0, value)", "value")} FROM v""",
)
def _(spark, d):
    train = materialise(parts_panel(spark, d).filter(F.col(PERIOD) <= F.lit(CUTOFF)))
    fitted = recent(train.withColumn("mu", rolling("applications", 4)), 20)
    residuals = log_residuals(fitted, "applications", "mu").select(SERIES, PERIOD, "residual")
    levels = recent(train, 12).select(SERIES, PERIOD, F.col("applications").alias("level"))
    walk = random_walk(train, "applications", 4)
    paths = bootstrap_paths(walk, residuals, 5, seed=5, mode="multiply", fallback=levels, min_residuals=20)
    return rounded(paths)


def _q(probs: dict[str, float], value: str = "value") -> str:
    return ", ".join(r(f"quantile_cont({value}, {p})", n) for n, p in probs.items())


_FORECAST_SQL = f"""{dense_sql("po", "dense")},
    hist AS (SELECT *, row_number() {_W} AS t FROM dense WHERE period <= DATE '{CUTOFF}'),
    fr1 AS (SELECT * FROM (SELECT series, visas_issued AS y, {", ".join(f"lag(applications, {k}) {_W} AS x{k}" for k in range(3))}
      FROM hist) WHERE x2 IS NOT NULL),
    fr2 AS (SELECT * FROM (SELECT series, arrivals AS y, {", ".join(f"lag(visas_issued, {k}) {_W} AS x{k}" for k in range(7))}
      FROM hist) WHERE x6 IS NOT NULL),
    {nonnegative_sql("fr1", "y", ["x0", "x1", "x2"], "f1", 1500)},
    {nonnegative_sql("fr2", "y", [f"x{k}" for k in range(7)], "f2", 2500)},
    sums AS (SELECT series, count(*) AS n, sum(applications) AS sa, sum(visas_issued) AS sv, sum(arrivals) AS sr FROM hist GROUP BY series),
    k1 AS (SELECT s.series, [CASE WHEN n > 6 AND sa <> 0 AND sv <> 0 THEN coalesce(x, 0) / greatest(1, w0 + w1 + w2) ELSE 0 END
      FOR x IN [w0, w1, w2]] AS w FROM sums s LEFT JOIN f1 ON f1.series = s.series),
    k2 AS (SELECT s.series, [CASE WHEN n > 10 AND sv <> 0 AND sr <> 0 THEN coalesce(x, 0) / greatest(1, {_SIX.replace(",", " +")}) ELSE 0 END
      FOR x IN [{_SIX}]] AS w FROM sums s LEFT JOIN f2 ON f2.series = s.series),
    last AS (SELECT series, max(t) AS t, max(period) AS e, avg(CASE WHEN back <= 4 THEN applications END) AS ahead FROM (
      SELECT *, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS back FROM hist) GROUP BY series),
    ext AS (SELECT series, t, 0 AS h, period, applications, visas_issued, arrivals FROM hist UNION ALL
      SELECT series, t + h, h, e + CAST(h * 7 AS INTEGER), ahead, NULL, NULL FROM last, range(1, 14) AS g(h)),
    c1 AS (SELECT a.series, a.t, greatest(0, sum(w[k + 1] * b.applications)) AS y FROM ext a JOIN k1 ON k1.series = a.series, range(0, 3) AS g(k)
      JOIN ext b ON b.series = a.series AND b.t = a.t - k GROUP BY 1, 2),
    iss AS (SELECT ext.*, CASE WHEN h = 0 THEN visas_issued ELSE y END AS v FROM ext JOIN c1 ON c1.series = ext.series AND c1.t = ext.t),
    c2 AS (SELECT a.series, a.t, sum(w[k + 1] * b.v) AS y FROM iss a JOIN k2 ON k2.series = a.series, range(0, 7) AS g(k)
      JOIN iss b ON b.series = a.series AND b.t = a.t - k GROUP BY 1, 2),
    pool AS (SELECT hist.series, list(arrivals - y ORDER BY period) AS p, count(*) AS n FROM hist JOIN c2 ON c2.series = hist.series
      AND c2.t = hist.t WHERE hist.t > 6 GROUP BY hist.series),
    w AS (SELECT ext.series, CAST(h AS INTEGER) AS h, period, greatest(0, y) AS forecast FROM ext JOIN c2 ON c2.series = ext.series
      AND c2.t = ext.t WHERE h > 0),
    path AS (SELECT w.series, CAST(s AS INTEGER) AS sim, w.period, greatest(0, forecast + p[{_draw_sql(11)} + 1]) AS value
      FROM w JOIN pool ON pool.series = w.series, range(1, 201) AS g(s)),
    every AS (SELECT * FROM path UNION ALL SELECT '{TOTAL}', sim, period, sum(value) FROM path GROUP BY sim, period)"""


@query(
    "delay_forecast_m14",
    f"""WITH RECURSIVE {ORDERS_SQL}, {_FORECAST_SQL} SELECT series, period, {r("avg(value)", "mean", 4)},
      {", ".join(r(f"quantile_cont(value, {p})", n, 4) for n, p in OUTER.items())} FROM every GROUP BY series, period""",
)
def _(spark, d):
    history = materialise(dense_orders(spark, d).filter(F.col(PERIOD) <= F.lit(CUTOFF)))
    paths = materialise(delay_paths(history, 13, (2, 6), 4, 200, seed=11))
    return rounded(delay_forecast(paths), 4)


@query(
    "path_summary_b2",
    f"""WITH {PATHS_SQL} SELECT series, period, {r("avg(value)", "mean")}, {_q(OUTER)}
    FROM paths GROUP BY series, period""",
)
def _(spark, d):
    return rounded(summarise_paths(event_paths(spark, d)))


@query(
    "bootstrap_summary_b2",
    f"""WITH {ORDERS_SQL}, {_BOOT_SQL} SELECT series, period, {r("avg(value)", "mean")}, {_q(TAILS)}
    FROM boot GROUP BY series, period""",
)
def _(spark, d):
    return rounded(summarise_paths(_boot(spark, d), TAILS))


@query(
    "coherent_total_b3",
    f"""WITH {PATHS_SQL}, t AS (SELECT sim, period, sum(value) AS value FROM paths GROUP BY 1, 2)
    SELECT period, {r("avg(value)", "mean")}, {_q(FIVE)} FROM t GROUP BY period""",
)
def _(spark, d):
    return rounded(summarise_paths(total_paths(event_paths(spark, d)), FIVE, keys=(PERIOD,)))


@query(
    "horizon_total_paths_b4",
    f"""WITH {PATHS_SQL}, t AS (SELECT series, sim, sum(value) AS value FROM paths GROUP BY 1, 2)
    SELECT series, {r("avg(value)", "mean")}, {_q(FIVE)} FROM t GROUP BY series""",
)
def _(spark, d):
    totals = horizon_paths(event_paths(spark, d), (SERIES, "sim"))
    return rounded(summarise_paths(totals, FIVE, keys=(SERIES,)))


def _sim_rates(spark, d):
    """Daily events of each path and the shares of them that are views and purchases, aggregated once."""
    hit = lambda kind: F.count_if(F.col("event_type") == kind) / (F.count(F.lit(1)) + 1)
    return materialise(
        table(spark, d, "events")
        .groupBy(
            (F.col("user_id") % 5).cast("string").alias(SERIES),
            (F.col("user_id") % 50).cast("int").alias("sim"),
            F.to_date("ts").alias(PERIOD),
        )
        .agg(
            hit("view").alias("issue_rate"),
            hit("purchase").alias("arrival_rate"),
            F.count(F.lit(1)).cast("double").alias("n"),
        )
    )


_SCENARIO_SQL = """
e AS (SELECT CAST(user_id % 5 AS VARCHAR) AS series, CAST(user_id % 50 AS INTEGER) AS sim,
  CAST(ts AS DATE) AS period, count(*)::DOUBLE AS n,
  count(*) FILTER (WHERE event_type = 'view') / (count(*) + 1)::DOUBLE AS q,
  count(*) FILTER (WHERE event_type = 'purchase') / (count(*) + 1)::DOUBLE AS p
  FROM events GROUP BY 1, 2, 3),
s AS (SELECT series, sum(n) / 997 AS app_backlog, sum(n) / 1999 AS visa_stock FROM e GROUP BY series),
o AS (SELECT *, row_number() OVER (PARTITION BY series, sim ORDER BY period) AS i FROM e),
roll AS (
  SELECT o.series, sim, period, i, n, q * (app_backlog + n) AS out1,
    (1 - q) * (app_backlog + n) AS s1, p * (visa_stock + q * (app_backlog + n)) AS out2,
    (1 - p) * (visa_stock + q * (app_backlog + n)) AS s2
  FROM o JOIN s ON s.series = o.series WHERE i = 1
  UNION ALL
  SELECT o.series, o.sim, o.period, o.i, o.n, q * (s1 + o.n), (1 - q) * (s1 + o.n),
    p * (s2 + q * (s1 + o.n)), (1 - p) * (s2 + q * (s1 + o.n))
  FROM roll JOIN o ON o.series = roll.series AND o.sim = roll.sim AND o.i = roll.i + 1)"""


@query(
    "scenario_paths_b5",
    f"""WITH RECURSIVE {_SCENARIO_SQL} SELECT series, sim, period, n AS applications,
      {r("out1", "visas_issued", 9)}, {r("out2", "arrivals", 9)}, {r("s1", "app_backlog", 9)},
      {r("s2", "visa_stock", 9)} FROM roll""",
)
def _(spark, d):
    keys = [SERIES, "sim", PERIOD]
    rates = _sim_rates(spark, d)
    inflow = rates.select(*keys, F.col("n").alias("applications"))
    state = rates.groupBy(SERIES).agg(
        # odd divisors, so that no stock is a short decimal that could sit on a rounding tie
        (F.sum("n") / 997).alias("app_backlog"),
        (F.sum("n") / 1999).alias("visa_stock"),
    )
    return rounded(scenario_paths(inflow, rates.select(*keys, "issue_rate"), rates.select(*keys, "arrival_rate"), state), 9)


# --- evaluation ------------------------------------------------------------------------

_JOINED = """joined AS (SELECT fc.*, po.arrivals AS actual FROM fc
  LEFT JOIN po ON po.series = fc.series AND po.period = fc.period)"""

_ERRORS = """errors AS (SELECT *, forecast - actual AS error, abs(forecast - actual) AS abs_error,
  (forecast - actual) * (forecast - actual) AS sq_error,
  CASE WHEN actual <> 0 THEN abs(forecast - actual) / abs(actual) * 100 END AS ape FROM {src})"""

_METRICS = """count(*) AS n_forecasts, avg(abs_error) AS mae, sqrt(avg(sq_error)) AS rmse,
  avg(error) AS bias, avg(ape) AS mape"""


def _actuals(panel):
    return panel.select(SERIES, PERIOD, F.col("arrivals").alias("actual"))


def _joined(panel):
    return long_forecasts(panel).join(_actuals(panel), [SERIES, PERIOD], "left")


@query(
    "error_columns_e1",
    f"""WITH {ORDERS_SQL}, {_LONG_SQL}, {_JOINED}, {_ERRORS.format(src="joined")}
    SELECT model, series, period, {rs("error", "abs_error", "sq_error", "ape")} FROM errors""",
)
def _(spark, d):
    errors = with_errors(_joined(written_panel(spark, d)))
    return rounded(errors.drop("forecast", "actual"))


@query(
    "metrics_per_model_e2",
    f"""WITH {ORDERS_SQL}, {_LONG_SQL}, {_JOINED}, {_ERRORS.format(src="joined")},
    m AS (SELECT model, {_METRICS} FROM errors GROUP BY model)
    SELECT model, n_forecasts, {rs("mae", "rmse", "bias", "mape")} FROM m""",
)
def _(spark, d):
    return rounded(metrics(with_errors(_joined(written_panel(spark, d)))))


@query(
    "whole_horizon_e3",
    f"""WITH {ORDERS_SQL}, {_LONG_SQL}, {_JOINED},
    t AS (SELECT model, series, CASE WHEN count(*) = count(forecast) THEN sum(forecast) END AS forecast,
      CASE WHEN count(*) = count(actual) THEN sum(actual) END AS actual FROM joined GROUP BY 1, 2),
    {_ERRORS.format(src="t")}, m AS (SELECT model, {_METRICS} FROM errors GROUP BY model)
    SELECT model, n_forecasts, {rs("mae", "rmse", "bias", "mape")} FROM m""",
)
def _(spark, d):
    totals = over_horizon(_joined(written_panel(spark, d)), ("model", SERIES))
    return rounded(metrics(with_errors(totals)))


@query(
    "hold_out_accuracy_e4",
    f"""WITH {ORDERS_SQL}, {_LONG_SQL}, {_JOINED}, sc AS (SELECT series, avg(abs(d)) AS s FROM tr_d
      GROUP BY series),
    m AS (SELECT model, j.series, avg(actual - forecast) AS me,
      sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse, avg(abs(actual - forecast)) AS mae,
      avg((actual - forecast) / nullif(actual, 0) * 100) AS mpe,
      avg(abs((actual - forecast) / nullif(actual, 0) * 100)) AS mape FROM joined j GROUP BY 1, 2)
    SELECT model, m.series, {rs("me", "rmse", "mae", "mpe", "mape")}, {r("mae / s", "mase")}
    FROM m JOIN sc ON sc.series = m.series""",
)
def _(spark, d):
    panel = written_panel(spark, d)
    scale = mase_scale(panel.filter(F.col(PERIOD) <= F.lit(CUTOFF)), "arrivals")
    return rounded(accuracy(_joined(panel), scale, ("model", SERIES)))


@query(
    "rolling_origin_backtest_e5",
    f"""WITH RECURSIVE {ORDERS_SQL}, {dense_sql("po", "dense")},
    num AS (SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY series) AS n FROM dense),
    folds AS (SELECT num.*, CAST(f AS INTEGER) AS fold, n - 8 + f - 1 AS te FROM num,
      range(1, 5) AS g(f) WHERE i <= n - 8 + f - 1 + 13 AND n - 8 + f - 1 > 0),
    tr AS (SELECT *, te - i + 1 AS back FROM folds WHERE i <= te),
    te AS (SELECT series, fold, period, arrivals AS actual FROM folds WHERE i > te),
    lv AS (SELECT series, fold, max(period) AS last, arg_max(arrivals, i) AS walk,
      avg(CASE WHEN back <= 4 THEN arrivals END) AS mean4,
      avg(CASE WHEN back <= 4 THEN applications END) AS apps4, regr_slope(arrivals, i) AS b,
      regr_intercept(arrivals, i) AS a, max(i) AS t FROM tr GROUP BY 1, 2),
    alphas AS (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS alpha),
    sm AS (SELECT series, fold, te, alpha, i, arrivals AS level, 0::DOUBLE AS sse FROM tr, alphas WHERE i = 1
      UNION ALL SELECT sm.series, sm.fold, sm.te, alpha, tr.i, level + alpha * (arrivals - level),
        sse + (arrivals - level) * (arrivals - level)
      FROM sm JOIN tr ON tr.series = sm.series AND tr.fold = sm.fold AND tr.i = sm.i + 1),
    best AS (SELECT series, fold, level FROM (SELECT *, row_number() OVER (PARTITION BY series, fold
      ORDER BY sse, alpha) AS k FROM sm WHERE i = te) WHERE k = 1),
    lagged AS (SELECT series || '#' || fold AS series, arrivals AS y, i, applications AS x0,
      {", ".join(f"lag(applications, {k}) OVER (PARTITION BY series, fold ORDER BY i) AS x{k}" for k in range(1, 7))} FROM tr),
    full_rows AS (SELECT * FROM lagged WHERE i > 6), {nonnegative_sql("full_rows", "y", [f"x{k}" for k in range(7)], "fit", 2500)},
    size AS (SELECT series, fold, count(*) AS n, sum(applications) AS sx, sum(arrivals) AS sy FROM tr GROUP BY 1, 2),
    wide_w AS (SELECT s.series, s.fold, [CASE WHEN n > 10 AND sx <> 0 AND sy <> 0 THEN coalesce(x, 0) / greatest(1, {_SIX.replace(",", " +")})
      ELSE 0 END FOR x IN [{_SIX}]] AS w FROM size s LEFT JOIN fit ON fit.series = s.series || '#' || s.fold),
    apps AS (SELECT series, fold, i, applications AS x FROM tr UNION ALL
      SELECT lv.series, lv.fold, t + h, apps4 FROM lv, range(1, 14) AS g(h)),
    conv AS (SELECT a.series, a.fold, a.i, sum(wide_w.w[k + 1] * b.x) AS y
      FROM apps a JOIN wide_w ON wide_w.series = a.series AND wide_w.fold = a.fold, range(0, 7) AS g(k)
      JOIN apps b ON b.series = a.series AND b.fold = a.fold AND b.i = a.i - k GROUP BY 1, 2, 3),
    fc AS (SELECT lv.*, CAST(h AS INTEGER) AS h, last + CAST(h * 7 AS INTEGER) AS period, level
      FROM lv JOIN best ON best.series = lv.series AND best.fold = lv.fold, range(1, 14) AS g(h)),
    long AS (SELECT 'walk' AS model, series, fold, period, walk AS forecast FROM fc
      UNION ALL SELECT 'mean4', series, fold, period, mean4 FROM fc
      UNION ALL SELECT 'smoothing', series, fold, period, level FROM fc
      UNION ALL SELECT 'trend', series, fold, period, a + b * (t + h) FROM fc
      UNION ALL SELECT 'convolution', fc.series, fc.fold, period, y FROM fc JOIN conv
        ON conv.series = fc.series AND conv.fold = fc.fold AND conv.i = fc.t + fc.h),
    models AS (SELECT unnest(['walk', 'mean4', 'smoothing', 'trend', 'convolution']) AS model),
    joined AS (SELECT m.model, te.*, forecast FROM te CROSS JOIN models m LEFT JOIN long ON long.series = te.series
      AND long.fold = te.fold AND long.period = te.period AND long.model = m.model), {_ERRORS.format(src="joined")},
    m AS (SELECT model, fold, {_METRICS}, count(*) - count(forecast) AS n_missing FROM errors GROUP BY model, fold)
    SELECT model, fold, n_forecasts, {rs("mae", "rmse", "bias", "mape", digits=5)}, n_missing FROM m""",
)
def _(spark, d):
    folds = fold_panel(materialise(dense_orders(spark, d)), "arrivals", 4, 13)
    forecasters = {
        "walk": last_value,
        "mean4": recent_mean,
        "smoothing": lambda f: smoothing(f, [0.1, 0.3, 0.5]),
        "trend": trend_line,
        "convolution": lambda f: convolution(f, "applications", 6),
    }
    return rounded(prefix_backtest(folds, forecasters), 5)


def _scores_sql(src: str) -> str:
    return f"""{_JOINED.replace("FROM fc", f"FROM {src} fc")}, {_ERRORS.format(src="joined")},
t AS (SELECT model, series, CASE WHEN count(*) = count(forecast) THEN sum(forecast) END AS forecast,
  CASE WHEN count(*) = count(actual) THEN sum(actual) END AS actual FROM joined GROUP BY 1, 2),
{_ERRORS.replace("errors AS", "t_errors AS").format(src="t")},
m AS (SELECT 'period' AS scope, model, {_METRICS} FROM errors GROUP BY model
  UNION ALL SELECT 'horizon', model, {_METRICS} FROM t_errors GROUP BY model)
SELECT scope, model, n_forecasts, {rs("mae", "rmse", "bias", "mape")},
  CAST(row_number() OVER (PARTITION BY scope ORDER BY mae ASC NULLS LAST, model) AS INTEGER) AS rank
FROM m"""


@query("scoreboard_of_series_e6", f"WITH {ORDERS_SQL}, {_LONG_SQL}, {_scores_sql('fc')}")
def _(spark, d):
    panel = written_panel(spark, d)
    return rounded(scoreboard([long_forecasts(panel)], _actuals(panel), keys=(SERIES,)))


def forecast_tables(panel):
    """Six forecasters of the weekly total, each in a table of its own shape: (table, how it is written).

    Dated, undated, a running total, several rows a date (twice), and one whose dates are lost.
    """
    history = panel.filter(F.col(PERIOD) <= F.lit(CUTOFF))
    total = materialise(history.groupBy(PERIOD).agg(F.sum("arrivals").alias("arrivals")).withColumn(SERIES, F.lit(TOTAL)))
    walk = random_walk(total, "arrivals", 13).select(F.col(PERIOD).alias("Week ending"), F.col("forecast").alias("Point"), "lo80", "hi80")
    mean4 = flat_forecast(recent_level(total, ["arrivals"], 4), total, 13, "arrivals")
    overall = flat_forecast(total.groupBy(SERIES).agg(F.avg("arrivals").alias("level")), total, 13)
    level8 = flat_forecast(recent_level(history, ["arrivals"], 8), history, 13, "arrivals")
    lost = walk.select(F.lit(None).cast("date").alias("data"), "Point")
    return [
        (walk, ForecastShape("walk", "Point", period="Week ending", bounds=(("lo80", "lo80"), ("hi80", "hi80")))),
        (mean4.select("h", F.col("forecast").alias("mean")), ForecastShape("mean4", "mean", ordinal="h")),
        (
            overall.select(F.col(PERIOD).alias("Week"), (F.col("forecast") * F.col("h")).alias("Total")),
            ForecastShape("running", "Total", period="Week", cumulative=True),
        ),
        (level8.withColumnRenamed("forecast", "Expected"), ForecastShape("by_series", "Expected", period=PERIOD, additive=True)),
        (autoregression_forecast(history), ForecastShape("autoregression", "forecast", period=PERIOD, additive=True)),
        (lost, ForecastShape("lost_dates", "Point", period="data")),
    ]


_TABLES_SQL = f"""{dense_sql("po", "dense")}, {AR_SQL},
    tot AS (SELECT period, sum(arrivals) AS y FROM hist GROUP BY period),
    st AS (SELECT arg_max(y, period) AS walk, max(period) AS e, avg(y) AS level FROM tot),
    m4 AS (SELECT avg(y) AS m FROM (SELECT y FROM tot ORDER BY period DESC LIMIT 4)),
    m8 AS (SELECT sum(m) AS m FROM (SELECT avg(arrivals) AS m FROM (SELECT *, row_number() OVER (PARTITION BY series
      ORDER BY period DESC) AS i FROM hist) WHERE i <= 8 GROUP BY series)),
    hs AS (SELECT CAST(h AS INTEGER) AS h, e + CAST(h * 7 AS INTEGER) AS period, walk, level FROM st, range(1, 14) AS g(h)),
    fc AS (SELECT 'walk' AS model, period, walk AS forecast FROM hs
      UNION ALL SELECT 'mean4', period, m FROM hs, m4
      UNION ALL SELECT 'running', period, level FROM hs
      UNION ALL SELECT 'by_series', period, m FROM hs, m8
      UNION ALL SELECT 'autoregression', e + CAST(h * 7 AS INTEGER), sum(y) FROM roll GROUP BY 2
      UNION ALL SELECT 'lost_dates', NULL, walk FROM hs),
    joined AS (SELECT fc.*, actual FROM fc LEFT JOIN (SELECT period, sum(arrivals) AS actual FROM dense GROUP BY period) a
      ON a.period = fc.period)"""


@query(
    "scoreboard_e6",
    f"""WITH RECURSIVE {ORDERS_SQL}, {_TABLES_SQL}, {_ERRORS.format(src="joined")},
    t AS (SELECT model, CASE WHEN count(*) = count(forecast) THEN sum(forecast) END AS forecast,
      CASE WHEN count(*) = count(actual) THEN sum(actual) END AS actual FROM joined GROUP BY model),
    {_ERRORS.replace("errors AS", "t_errors AS").format(src="t")},
    m AS (SELECT 'period' AS scope, model, {_METRICS} FROM errors GROUP BY model
      UNION ALL SELECT 'horizon', model, {_METRICS} FROM t_errors GROUP BY model)
    SELECT scope, model, n_forecasts, {rs("mae", "rmse", "bias", "mape")},
      CAST(row_number() OVER (PARTITION BY scope ORDER BY mae ASC NULLS LAST, model) AS INTEGER) AS rank
    FROM m""",
)
def _(spark, d):
    panel = materialise(dense_orders(spark, d))
    weeks = panel.filter(F.col(PERIOD) > F.lit(CUTOFF)).select(PERIOD).distinct()
    adapted = [adapt_forecast(table, shape, weeks) for table, shape in forecast_tables(panel)]
    actual = panel.groupBy(PERIOD).agg(F.sum("arrivals").alias("actual"))
    return rounded(scoreboard(adapted, actual))


@query(
    "scoreboard_common_horizon_e6",
    f"""WITH {ORDERS_SQL}, {_LONG_SQL},
    cut AS (SELECT * FROM fc WHERE model <> 'flat' OR period <= DATE '{CUTOFF}' + 56),
    shared AS (SELECT series, period FROM cut GROUP BY 1, 2
      HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM cut)),
    kept AS (SELECT cut.* FROM cut SEMI JOIN shared USING (series, period)),
    {_scores_sql("kept")}""",
)
def _(spark, d):
    panel = written_panel(spark, d)
    forecasts = long_forecasts(panel)
    short = F.col(PERIOD) <= F.date_add(F.lit(CUTOFF), 56)
    cut = [forecasts.filter((F.col("model") != "flat") | short)]
    return rounded(scoreboard(cut, _actuals(panel), common_horizon=True, keys=(SERIES,)))


