"""Queries for window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.exprs import ratio
from panelcast.operators.calendar import DAY, WEEK, densify
from panelcast.operators.windows import (
    backlog,
    conversion,
    decumulate,
    difference,
    forward_fill,
    growth,
    interpolate,
    lag_columns,
    lag_composite,
    lag_composite_or_mean,
    lag_or,
    lead,
    ordered,
    rolling,
    rolling_centred,
    running_total,
    series_mean,
    trend,
    with_stock,
)
from panelcast.plans.panels import (
    EVENTS_SQL,
    ORDERS_SQL,
    PARTS_SQL,
    dense_sql,
    events_panel,
    orders_panel,
    parts_panel,
    written_panel,
)
from panelcast.plans.registry import query, r, rounded
from panelcast.schema import PERIOD, SERIES, STAGES

_BY = "PARTITION BY series ORDER BY period"
_W = f"OVER ({_BY})"
_LAGS = (1, 2, 3, 4)
#: Twins of calendar lags: lags over the dense calendar, of which the stored rows are kept.
_DENSE_PARTS = dense_sql("px", "dense", 7, None)
_DENSE_EVENTS = dense_sql("pe", "dense", 1, None)


@query(
    "many_lags_w1",
    f"WITH {PARTS_SQL}, {_DENSE_PARTS}, l AS (SELECT *, "
    + ", ".join(f"lag({c}, {k}) {_W} AS {c}_lag{k}" for c in STAGES for k in _LAGS)
    + " FROM dense) SELECT * EXCLUDE (applications, visas_issued, arrivals) FROM l WHERE applications IS NOT NULL",
)
def _(spark, d):
    lags = lag_columns(STAGES, _LAGS, step_days=WEEK)
    return parts_panel(spark, d).withColumns(lags).drop(*STAGES)


@query(
    "named_lags_d4",
    f"WITH {ORDERS_SQL} SELECT series, period, "
    + ", ".join(f"lag({c}, {k}) {_W} AS lag_{k}_{c}" for c in STAGES for k in range(1, 9))
    + " FROM po",
)
def _(spark, d):
    lags = lag_columns(STAGES, range(1, 9), "lag_{k}_{col}")
    return orders_panel(spark, d).withColumns(lags).drop(*STAGES)


@query(
    "lag_with_default_w2",
    f"""WITH {EVENTS_SQL}, {_DENSE_EVENTS}, n AS (SELECT *, lag(visas_issued, 2) {_W} AS v2, lag(arrivals) {_W} AS a1,
      avg(arrivals) OVER (PARTITION BY series) AS m,
      period - min(CASE WHEN arrivals IS NOT NULL THEN period END) OVER (PARTITION BY series) AS i FROM dense)
    SELECT series, period, CASE WHEN i < 2 THEN 0 ELSE v2 END AS zero,
      {r("CASE WHEN i < 1 THEN m ELSE a1 END", "own_mean")} FROM n WHERE arrivals IS NOT NULL""",
)
def _(spark, d):
    return rounded(
        events_panel(spark, d).select(
            SERIES,
            PERIOD,
            lag_or("visas_issued", 2, 0.0, step_days=DAY).alias("zero"),
            lag_or("arrivals", 1, series_mean("arrivals"), step_days=DAY).alias("own_mean"),
        )
    )


@query(
    "lead_w3",
    f"WITH {ORDERS_SQL} SELECT series, period, lead(arrivals, 3) {_W} AS ahead3 FROM po",
)
def _(spark, d):
    return orders_panel(spark, d).select(SERIES, PERIOD, lead("arrivals", 3).alias("ahead3"))


@query(
    "first_difference_w4",
    f"""WITH {PARTS_SQL}, {_DENSE_PARTS}, l AS (SELECT *, applications - lag(applications) {_W} AS change FROM dense)
    SELECT series, period, change FROM l WHERE applications IS NOT NULL""",
)
def _(spark, d):
    change = difference("applications", step_days=WEEK).alias("change")
    return parts_panel(spark, d).select(SERIES, PERIOD, change)


@query(
    "growth_rate_w5",
    f"""WITH {EVENTS_SQL}, {_DENSE_EVENTS}, l AS (SELECT *, lag(arrivals) {_W} AS p FROM dense) SELECT series, period,
      {r("CASE WHEN p > 0 THEN (arrivals - p) / p WHEN p IS NOT NULL THEN 0 END", "growth")} FROM l
    WHERE arrivals IS NOT NULL""",
)
def _(spark, d):
    return rounded(
        events_panel(spark, d).select(SERIES, PERIOD, growth("arrivals", step_days=DAY).alias("growth"))
    )


@query(
    "running_total_w6",
    f"WITH {ORDERS_SQL} SELECT series, period, sum(arrivals) {_W} AS so_far FROM po",
)
def _(spark, d):
    return orders_panel(spark, d).select(SERIES, PERIOD, running_total("arrivals").alias("so_far"))


@query(
    "backlog_w7",
    f"""WITH {ORDERS_SQL} SELECT series, period,
      sum(applications - visas_issued) {_W} AS waiting,
      sum(visas_issued) {_W} - sum(arrivals) {_W} AS issued_stock FROM po""",
)
def _(spark, d):
    return orders_panel(spark, d).select(
        SERIES,
        PERIOD,
        backlog("applications", "visas_issued").alias("waiting"),
        backlog("visas_issued", "arrivals").alias("issued_stock"),
    )


@query(
    "stock_with_opening_balance_w8",
    f"""WITH {PARTS_SQL}, b AS (SELECT *, sum(visas_issued - arrivals) {_W} AS bal FROM px),
    o AS (SELECT *, greatest(0, -min(bal) OVER (PARTITION BY series)) AS opening FROM b)
    SELECT series, period, opening + bal AS stock_end,
      coalesce(lag(opening + bal) {_W}, opening) AS stock_start,
      coalesce(lag(opening + bal) {_W}, opening) + visas_issued AS stock_available FROM o""",
)
def _(spark, d):
    return with_stock(parts_panel(spark, d), "visas_issued", "arrivals", "stock").drop(*STAGES)


@query(
    "rolling_partial_w9",
    f"""WITH {ORDERS_SQL} SELECT series, period,
      sum(visas_issued) OVER ({_BY} ROWS 3 PRECEDING) AS sum4,
      {r(f"avg(arrivals) OVER ({_BY} ROWS 7 PRECEDING)", "mean8")} FROM po""",
)
def _(spark, d):
    return rounded(
        orders_panel(spark, d).select(
            SERIES,
            PERIOD,
            rolling("visas_issued", 4, F.sum).alias("sum4"),
            rolling("arrivals", 8).alias("mean8"),
        )
    )


@query(
    "rolling_complete_w10",
    f"""WITH {PARTS_SQL}, {_DENSE_PARTS}, l AS (SELECT *, count(applications) OVER ({_BY} ROWS 3 PRECEDING) AS n,
      avg(applications) OVER ({_BY} ROWS 3 PRECEDING) AS m FROM dense)
    SELECT series, period, {r("CASE WHEN n = 4 THEN m END", "mean4")} FROM l WHERE applications IS NOT NULL""",
)
def _(spark, d):
    return rounded(
        parts_panel(spark, d).select(
            SERIES, PERIOD, rolling("applications", 4, complete=True, step_days=WEEK).alias("mean4")
        )
    )


@query(
    "rolling_centred_w11",
    f"""WITH {EVENTS_SQL}, {_DENSE_EVENTS}, l AS (SELECT *, lag(arrivals) {_W} AS p, lead(arrivals) {_W} AS q FROM dense)
    SELECT series, period, {r("(p + arrivals + q) / 3", "mean3")} FROM l WHERE arrivals IS NOT NULL""",
)
def _(spark, d):
    return rounded(
        events_panel(spark, d).select(SERIES, PERIOD, rolling_centred("arrivals", step_days=DAY).alias("mean3"))
    )


_GAPPY = f"""gappy AS (SELECT series, period, row_number() {_W} AS i, visas_issued,
  CASE WHEN visas_issued % 3 <> 0 THEN visas_issued END AS x FROM po)"""


def _gappy(spark, d):
    return orders_panel(spark, d).select(
        SERIES,
        PERIOD,
        F.when(F.col("visas_issued") % 3 != 0, F.col("visas_issued")).alias("x"),
    )


@query(
    "linear_interpolation_w12",
    f"""WITH {ORDERS_SQL}, {_GAPPY},
    k AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) {_W} AS ia,
      min(CASE WHEN x IS NOT NULL THEN i END) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND
        UNBOUNDED FOLLOWING) AS ib FROM gappy)
    SELECT k.series, k.period, {r("coalesce(k.x, a.x + (k.i - k.ia) * (b.x - a.x) / (k.ib - k.ia))", "x")}
    FROM k LEFT JOIN gappy a ON a.series = k.series AND a.i = k.ia
    LEFT JOIN gappy b ON b.series = k.series AND b.i = k.ib""",
)
def _(spark, d):
    return rounded(interpolate(_gappy(spark, d), ["x"]))


@query(
    "forward_fill_w13",
    f"""WITH {ORDERS_SQL}, {_GAPPY}
    SELECT series, period, last_value(x IGNORE NULLS) {_W} AS x FROM gappy""",
)
def _(spark, d):
    return _gappy(spark, d).withColumn("x", forward_fill("x"))


@query(
    "densify_and_impute_w13",
    f"""WITH {EVENTS_SQL}, {dense_sql("pe", "dense", 1, None)},
    n AS (SELECT series, period, arrivals AS x, row_number() {_W} AS i FROM dense),
    k AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) {_W} AS ia,
      min(CASE WHEN x IS NOT NULL THEN i END) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND
        UNBOUNDED FOLLOWING) AS ib FROM n),
    f AS (SELECT k.series, k.period,
      coalesce(k.x, a.x + (k.i - k.ia) * (b.x - a.x) / (k.ib - k.ia)) AS x
      FROM k LEFT JOIN n a ON a.series = k.series AND a.i = k.ia
      LEFT JOIN n b ON b.series = k.series AND b.i = k.ib)
    SELECT series, period, {r(f"coalesce(last_value(x IGNORE NULLS) {_W}, 0)", "arrivals")} FROM f""",
)
def _(spark, d):
    dense = densify(written_panel(spark, d, events_panel), 1, ["arrivals"])
    filled = interpolate(dense, ["arrivals"]).withColumn("arrivals", forward_fill("arrivals"))
    return rounded(filled.na.fill(0.0, ["arrivals"]))


@query("decumulate_w14", f"WITH {ORDERS_SQL} SELECT series, period, arrivals FROM po")
def _(spark, d):
    running = orders_panel(spark, d).select(
        SERIES, PERIOD, running_total("arrivals").alias("arrivals")
    )
    return decumulate(running, "arrivals")


_FLOW = {2: 0.25, 3: 0.45, 6: 0.3}


@query(
    "lag_composite_w15",
    f"""WITH {ORDERS_SQL}, m AS (SELECT *, row_number() {_W} AS i,
      avg(visas_issued) OVER (PARTITION BY series) AS mean FROM po)
    SELECT series, period,
      {r(" + ".join(f"lag(visas_issued, {k}) {_W} * {x}::DOUBLE" for k, x in _FLOW.items()), "flow")},
      {r(" + ".join(f"CASE WHEN i <= {k} THEN mean ELSE lag(visas_issued, {k}) {_W} END * {x}::DOUBLE"
                    for k, x in _FLOW.items()), "flow_or_mean")} FROM m""",
)
def _(spark, d):
    return rounded(
        orders_panel(spark, d).select(
            SERIES,
            PERIOD,
            lag_composite("visas_issued", _FLOW).alias("flow"),
            lag_composite_or_mean("visas_issued", _FLOW).alias("flow_or_mean"),
        )
    )


@query(
    "trend_index_w16",
    f"""WITH {PARTS_SQL} SELECT series, period, CAST(row_number() {_W} AS INTEGER) AS trend,
      CAST(power(row_number() {_W}, 2) AS INTEGER) AS trend_sq FROM px""",
)
def _(spark, d):
    return parts_panel(spark, d).select(
        SERIES, PERIOD, trend().alias("trend"), (trend() * trend()).alias("trend_sq")
    )


@query(
    "cross_lag_conversion_w18",
    f"""WITH {ORDERS_SQL}, l AS (SELECT *, lag(visas_issued, 2) {_W} AS v2, lag(arrivals) {_W} AS a1,
      lag(sum_v - sum_a) {_W} AS stock1 FROM (SELECT *, sum(visas_issued) {_W} AS sum_v,
        sum(arrivals) {_W} AS sum_a FROM po))
    SELECT series, period, {r("CASE WHEN v2 > 0 THEN arrivals / v2 END", "rate")},
      {r("CASE WHEN v2 > 0 THEN a1 / v2 END", "rate_lag1")},
      {r("CASE WHEN stock1 > 0 THEN arrivals / stock1 END", "per_stock")} FROM l""",
)
def _(spark, d):
    w = ordered()
    df = orders_panel(spark, d).withColumn("stock", backlog("visas_issued", "arrivals"))
    return rounded(
        df.select(
            SERIES,
            PERIOD,
            conversion("arrivals", "visas_issued", 2).alias("rate"),
            ratio(F.lag("arrivals").over(w), F.lag("visas_issued", 2).over(w)).alias("rate_lag1"),
            conversion("arrivals", "stock", 1).alias("per_stock"),
        )
    )
