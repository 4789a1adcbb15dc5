"""Queries for joins, aggregates, pivots, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators.aggregate import (
    exact_quantiles,
    group_quantiles,
    horizon_totals,
    last_state,
    period_totals,
    with_total_rows,
)
from panelcast.operators.calendar import DAY, WEEK, period_grid, recent
from panelcast.operators.evaluate import leaderboard
from panelcast.operators.fit import random_walk
from panelcast.operators.joins import (
    in_periods,
    join_all,
    lagged_long,
    natural_left_join,
    not_in_periods,
    positional_join,
    with_period_total,
)
from panelcast.operators.reshape import pivot_series, row_totals, to_long
from panelcast.operators.windows import at_lag, first_rows, ordered, recent_level, stack
from panelcast.plans.panels import (
    CUTOFF,
    EVENTS_SQL,
    ORDERS_SQL,
    PARTS_SQL,
    PRIORITIES,
    dense_sql,
    events_panel,
    orders_panel,
    parts_panel,
    table,
    written_panel,
)
from panelcast.plans.registry import query, r, rounded
from panelcast.schema import PERIOD, SERIES, STAGES

_COLS = "period, series, applications, visas_issued, arrivals"
_W = "OVER (PARTITION BY series ORDER BY period)"

# --- forecasts used by several queries: random walk from the cutoff ----------------

WALK_SQL = f"""
tr AS (SELECT * FROM po WHERE period <= DATE '{CUTOFF}'),
tr_d AS (SELECT *, arrivals - lag(arrivals) {_W} AS d FROM tr),
walk_state AS (SELECT series, arg_max(arrivals, period) AS forecast, sqrt(avg(d * d)) AS sigma,
  max(period) AS last FROM tr_d GROUP BY series),
walk AS (SELECT series, CAST(h AS INTEGER) AS h, last + CAST(h * 7 AS INTEGER) AS period, forecast,
  forecast - 1.2815515655446004::DOUBLE * sigma * sqrt(h) AS lo80,
  forecast + 1.2815515655446004::DOUBLE * sigma * sqrt(h) AS hi80,
  forecast - 1.959963984540054::DOUBLE * sigma * sqrt(h) AS lo95,
  forecast + 1.959963984540054::DOUBLE * sigma * sqrt(h) AS hi95
  FROM walk_state, range(1, 14) AS g(h))"""


def walk_of(panel, h=13):
    return random_walk(panel.filter(F.col(PERIOD) <= F.lit(CUTOFF)), "arrivals", h)


def walk_forecast(spark, d, h=13):
    return walk_of(orders_panel(spark, d), h)


# --- joins --------------------------------------------------------------------------


@query(
    "forecast_to_actual_j1",
    f"""WITH {ORDERS_SQL}, {WALK_SQL} SELECT w.series, w.period, w.forecast, po.arrivals AS actual
    FROM walk w LEFT JOIN po ON po.series = w.series AND po.period = w.period""",
)
def _(spark, d):
    panel = written_panel(spark, d)
    actual = panel.select(SERIES, PERIOD, F.col("arrivals").alias("actual"))
    forecast = walk_of(panel).select(SERIES, PERIOD, "forecast")
    return forecast.join(actual, [SERIES, PERIOD], "left")


@query(
    "natural_left_join_j2",
    f"""WITH {EVENTS_SQL}, b AS (SELECT min(period) AS lo, max(period) AS hi FROM pe),
    grid AS (SELECT series, CAST(d AS DATE) AS period FROM (SELECT DISTINCT series FROM pe),
      (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM b))
    SELECT grid.series, grid.period, applications, visas_issued, arrivals
    FROM grid LEFT JOIN pe ON pe.series = grid.series AND pe.period = grid.period""",
)
def _(spark, d):
    panel = written_panel(spark, d, events_panel)
    return natural_left_join(period_grid(panel, 1), panel)


def _per_sim(spark, d, kind, name):
    events = table(spark, d, "events").filter(F.col("event_type") == kind)
    return events.groupBy(
        (F.col("user_id") % 10).cast("string").alias(SERIES),
        (F.col("user_id") % 50).cast("int").alias("sim"),
        F.to_date("ts").alias(PERIOD),
    ).agg(F.count(F.lit(1)).alias(name))


def _per_sim_sql(kind: str, name: str) -> str:
    return f"""{name}_t AS (SELECT CAST(user_id % 10 AS VARCHAR) AS series,
      CAST(user_id % 50 AS INTEGER) AS sim, CAST(ts AS DATE) AS period, count(*) AS {name}
      FROM events WHERE event_type = '{kind}' GROUP BY 1, 2, 3)"""


@query(
    "multiway_left_join_j3",
    f"""WITH {_per_sim_sql("signup", "a")}, {_per_sim_sql("view", "b")}, {_per_sim_sql("purchase", "c")}
    SELECT a_t.series, a_t.sim, a_t.period, a, b, c FROM a_t
    LEFT JOIN b_t ON a_t.series = b_t.series AND a_t.sim = b_t.sim AND a_t.period = b_t.period
    LEFT JOIN c_t ON a_t.series = c_t.series AND a_t.sim = c_t.sim AND a_t.period = c_t.period""",
)
def _(spark, d):
    tables = [
        _per_sim(spark, d, k, n) for k, n in (("signup", "a"), ("view", "b"), ("purchase", "c"))
    ]
    return join_all(tables, [SERIES, "sim", PERIOD])


@query(
    "small_dimension_join_j4",
    f"""WITH {PARTS_SQL}, m AS (SELECT series, avg(applications) AS level FROM px GROUP BY series)
    SELECT px.series, period, applications, {r("applications / level", "relative")}
    FROM px JOIN m ON m.series = px.series""",
)
def _(spark, d):
    panel = parts_panel(spark, d)
    level = panel.groupBy(SERIES).agg(F.avg("applications").alias("level"))
    return rounded(
        panel.join(level, SERIES).select(
            SERIES,
            PERIOD,
            "applications",
            F.try_divide("applications", "level").alias("relative"),
        )
    )


@query(
    "series_period_grid_j5",
    f"""WITH {EVENTS_SQL}, b AS (SELECT min(period) AS lo, max(period) AS hi FROM pe)
    SELECT series, CAST(d AS DATE) AS period FROM (SELECT DISTINCT series FROM pe),
      (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM b)""",
)
def _(spark, d):
    return period_grid(written_panel(spark, d, events_panel), 1)


@query(
    "positional_join_j6",
    f"""WITH {ORDERS_SQL}, {WALK_SQL}, v AS (SELECT series, h, forecast FROM walk WHERE h <= 12),
    cal AS (SELECT period, row_number() OVER (ORDER BY period) AS h FROM
      (SELECT DISTINCT period FROM po WHERE period > DATE '{CUTOFF}'))
    SELECT v.series, CAST(v.h AS INTEGER) AS step, cal.period, v.forecast
    FROM v JOIN cal ON v.h = cal.h""",
)
def _(spark, d):
    panel = written_panel(spark, d)
    undated = walk_of(panel, 12).select(SERIES, F.col("h").alias("step"), "forecast")
    calendar = panel.filter(F.col(PERIOD) > F.lit(CUTOFF))
    return positional_join(undated, calendar)


_QUIET = "quiet AS (SELECT period FROM po GROUP BY period HAVING sum(arrivals) < sum(visas_issued))"


def _quiet(panel):
    totals = panel.groupBy(PERIOD).agg(F.sum("arrivals").alias("a"), F.sum("visas_issued").alias("v"))
    return totals.filter(F.col("a") < F.col("v"))


@query(
    "rows_in_periods_j7",
    f"WITH {ORDERS_SQL}, {_QUIET} SELECT {_COLS} FROM po WHERE period IN (SELECT period FROM quiet)",
)
def _(spark, d):
    panel = written_panel(spark, d)
    return in_periods(panel, _quiet(panel))


@query(
    "rows_not_in_periods_j8",
    f"WITH {ORDERS_SQL}, {_QUIET} SELECT {_COLS} FROM po WHERE period NOT IN (SELECT period FROM quiet)",
)
def _(spark, d):
    panel = written_panel(spark, d)
    return not_in_periods(panel, _quiet(panel))


@query(
    "detail_to_period_total_j9",
    f"""WITH {PARTS_SQL} SELECT series, period, applications,
      CAST(sum(applications) OVER (PARTITION BY period) AS DOUBLE) AS total FROM px""",
)
def _(spark, d):
    joined = with_period_total(written_panel(spark, d, parts_panel), "applications", "total")
    return joined.select(SERIES, PERIOD, "applications", "total")


@query(
    "period_offset_self_join_j10",
    f"""WITH {PARTS_SQL} SELECT a.series, a.period, CAST(k AS INTEGER) AS k, b.applications AS x
    FROM px a, range(0, 7) AS g(k) JOIN px b
      ON b.series = a.series AND b.period = a.period - CAST(k * 7 AS INTEGER)""",
)
def _(spark, d):
    return lagged_long(parts_panel(spark, d), "applications", 6)


# --- aggregates -----------------------------------------------------------------------


@query(
    "grouped_sums_a1",
    f"""WITH {PARTS_SQL} SELECT period, sum(applications) AS applications,
      sum(visas_issued) AS visas_issued, sum(arrivals) AS arrivals FROM px GROUP BY period""",
)
def _(spark, d):
    return period_totals(parts_panel(spark, d))


@query(
    "null_strict_sum_a2",
    f"""WITH {EVENTS_SQL}, {dense_sql("pe", "dense", 1, None)}, f AS (SELECT series, lag(arrivals) {_W} AS x, visas_issued AS y FROM dense)
    SELECT series, CASE WHEN count(*) = count(x) THEN sum(x) END AS x, sum(y) AS y FROM f WHERE y IS NOT NULL
    GROUP BY series""",
)
def _(spark, d):
    f = events_panel(spark, d).select(
        SERIES, at_lag("arrivals", 1, DAY).alias("x"), F.col("visas_issued").alias("y")
    )
    return period_totals(f, ["x", "y"], [SERIES], strict=True)


@query(
    "null_skipping_stats_a3",
    f"""WITH {EVENTS_SQL}, f AS (SELECT series, arrivals / nullif(visas_issued, 0) AS x FROM pe)
    SELECT series, count(*) AS n, count(x) AS n_known, {r("avg(x)", "mean")}, {r("min(x)", "low")},
      {r("max(x)", "high")} FROM f GROUP BY series""",
)
def _(spark, d):
    f = events_panel(spark, d).withColumn("x", F.try_divide("arrivals", "visas_issued"))
    return rounded(
        f.groupBy(SERIES).agg(
            F.count(F.lit(1)).alias("n"),
            F.count("x").alias("n_known"),
            F.avg("x").alias("mean"),
            F.min("x").alias("low"),
            F.max("x").alias("high"),
        )
    )


_PROBS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


@query(
    "quantiles_of_hot_groups_a4",
    "SELECT l_returnflag, "
    + ", ".join(r(f"quantile_cont(l_extendedprice, {p})", n) for n, p in _PROBS.items())
    + " FROM lineitem GROUP BY l_returnflag",
)
def _(spark, d):
    return rounded(
        exact_quantiles(
            table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"),
            ["l_returnflag"],
            "l_extendedprice",
            _PROBS,
        )
    )


@query(
    "quantiles_of_series_a4",
    f"WITH {ORDERS_SQL} SELECT series, "
    + ", ".join(r(f"quantile_cont(arrivals, {p})", n) for n, p in _PROBS.items())
    + f", {r('median(visas_issued)', 'issued_median')} FROM po GROUP BY series",
)
def _(spark, d):
    return rounded(
        group_quantiles(
            orders_panel(spark, d),
            [SERIES],
            "arrivals",
            _PROBS,
            [F.median("visas_issued").alias("issued_median")],
        )
    )


_WIDE = {s: label for s, label in PRIORITIES.items()}
_WIDE_SQL = ", ".join(
    f"coalesce(sum(CASE WHEN series = '{s}' THEN {v} END), 0) AS {v}_{label}"
    for v in STAGES
    for s, label in PRIORITIES.items()
)


@query("pivot_zero_fill_a5", f"WITH {ORDERS_SQL} SELECT period, {_WIDE_SQL} FROM po GROUP BY period")
def _(spark, d):
    return pivot_series(orders_panel(spark, d), _WIDE)


@query(
    "pivot_mean_of_duplicates_a6",
    "SELECT CAST(o_orderdate AS DATE) AS period, "
    + ", ".join(
        r(f"avg(CASE WHEN o_orderstatus = '{s}' THEN round(o_totalprice * 100) END)", f"price_{n}", 4)
        for s, n in (("F", "closed"), ("O", "open"), ("P", "pending"))
    )
    + " FROM orders GROUP BY 1",
)
def _(spark, d):
    daily = table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias(PERIOD),
        F.col("o_orderstatus").alias(SERIES),
        F.round(F.col("o_totalprice") * 100).alias("price"),
    )
    labels = {"F": "closed", "O": "open", "P": "pending"}
    return rounded(pivot_series(daily, labels, ["price"], fill=None, how=F.avg), 4)


@query(
    "wide_to_long_a7",
    f"WITH {ORDERS_SQL} "
    + " UNION ALL ".join(f"SELECT series, period, '{s}' AS stage, {s} AS value FROM po" for s in STAGES),
)
def _(spark, d):
    return to_long(orders_panel(spark, d), [SERIES, PERIOD], STAGES, "stage")


@query(
    "row_totals_by_prefix_a8",
    f"""WITH {ORDERS_SQL} SELECT period, sum(applications) AS applications_total,
      sum(arrivals) AS arrivals_total FROM po GROUP BY period""",
)
def _(spark, d):
    wide = pivot_series(orders_panel(spark, d), _WIDE, ["applications", "arrivals"])
    totals = row_totals(wide, ["applications", "arrivals"])
    return totals.select(PERIOD, "applications_total", "arrivals_total")


@query(
    "series_and_total_rows_a9",
    f"""WITH {ORDERS_SQL} SELECT period, series, applications, visas_issued, arrivals FROM po
    UNION ALL SELECT period, 'TOTAL', sum(applications), sum(visas_issued), sum(arrivals)
    FROM po GROUP BY period""",
)
def _(spark, d):
    return with_total_rows(orders_panel(spark, d))


@query(
    "last_state_a10",
    f"""WITH {PARTS_SQL} SELECT series, max(period) AS period, arg_max(applications, period)
      AS applications, arg_max(arrivals, period) AS arrivals FROM px GROUP BY series""",
)
def _(spark, d):
    return last_state(parts_panel(spark, d), ["applications", "arrivals"])


@query(
    "distinct_counts_a11",
    f"""WITH {PARTS_SQL} SELECT count(DISTINCT series) AS n_series, count(DISTINCT period) AS n_periods,
      count(*) AS n_rows FROM px""",
)
def _(spark, d):
    return parts_panel(spark, d).agg(
        F.count_distinct(SERIES).alias("n_series"),
        F.count_distinct(PERIOD).alias("n_periods"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@query(
    "horizon_totals_a12",
    f"""WITH {ORDERS_SQL}, {WALK_SQL} SELECT series, {r("sum(forecast)", "forecast", 4)},
      {r("sum(lo80)", "lo80", 4)}, {r("sum(hi80)", "hi80", 4)} FROM walk GROUP BY series""",
)
def _(spark, d):
    return rounded(
        horizon_totals(walk_forecast(spark, d), ["forecast", "lo80", "hi80"], [SERIES]), 4
    )


# --- ordering and set operations -------------------------------------------------------


@query(
    "multi_key_order_l1",
    f"WITH {ORDERS_SQL} SELECT {_COLS} FROM po ORDER BY series, period DESC",
)
def _(spark, d):
    return orders_panel(spark, d).orderBy(SERIES, F.col(PERIOD).desc())


@query(
    "first_rows_per_group_l2",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_returnflag
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS i FROM lineitem) WHERE i <= 20""",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    by = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"]
    return first_rows(lines, 20, by, ["l_returnflag"])


@query(
    "top_one_per_group_l3",
    f"""WITH {PARTS_SQL} SELECT series, period, applications FROM (
      SELECT *, row_number() OVER (PARTITION BY series ORDER BY applications DESC, period DESC) AS i
      FROM px) WHERE i = 1""",
)
def _(spark, d):
    best = F.max_by(F.struct(PERIOD, "applications"), F.struct("applications", PERIOD))
    return parts_panel(spark, d).groupBy(SERIES).agg(best.alias("s")).select(SERIES, "s.*")


@query(
    "leaderboard_order_l4",
    """WITH m AS (SELECT CAST(l_partkey AS VARCHAR) AS scope, l_returnflag || l_linestatus AS model,
      avg(CASE WHEN l_returnflag <> 'A' THEN abs(l_quantity - 25) END) AS mae FROM lineitem GROUP BY 1, 2)
    SELECT model, scope, """
    + r("mae")
    + """, CAST(row_number() OVER (PARTITION BY scope ORDER BY mae ASC NULLS LAST, model) AS INTEGER)
      AS rank FROM m""",
)
def _(spark, d):
    distance = F.when(F.col("l_returnflag") != "A", F.abs(F.col("l_quantity") - 25))
    scores = (
        table(spark, d, "lineitem")
        .groupBy(
            F.col("l_partkey").cast("string").alias("scope"),
            F.concat("l_returnflag", "l_linestatus").alias("model"),
        )
        .agg(F.avg(distance).alias("mae"))
    )
    return rounded(leaderboard(scores))


@query(
    "union_by_name_u1",
    f"""WITH {ORDERS_SQL}, {EVENTS_SQL}
    SELECT 'orders' AS source, period, series, applications, NULL::DOUBLE AS arrivals FROM po
    UNION ALL SELECT 'events', period, series, NULL, arrivals FROM pe""",
)
def _(spark, d):
    a = orders_panel(spark, d).select(PERIOD, SERIES, "applications")
    b = events_panel(spark, d).select("arrivals", SERIES, PERIOD)
    return stack({"orders": a, "events": b}, "source")


@query(
    "history_and_forecast_u2",
    f"""WITH {ORDERS_SQL}, {WALK_SQL}
    SELECT series, period, arrivals AS value, 'history' AS type FROM tr
    UNION ALL SELECT series, period, forecast, 'forecast' FROM walk""",
)
def _(spark, d):
    history = orders_panel(spark, d).filter(F.col(PERIOD) <= F.lit(CUTOFF))
    return stack(
        {
            "history": history.select(SERIES, PERIOD, F.col("arrivals").alias("value")),
            "forecast": walk_forecast(spark, d).select(
                SERIES, PERIOD, F.col("forecast").alias("value")
            ),
        }
    )


# --- function surface ---------------------------------------------------------------------


@query(
    "composed_transforms_d1",
    f"""WITH {EVENTS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period DESC)
      AS i FROM pe) SELECT period, sum(arrivals) AS arrivals FROM l WHERE i <= 10 GROUP BY period""",
)
def _(spark, d):
    return (
        events_panel(spark, d)
        .transform(recent, n=10)
        .transform(period_totals, values=["arrivals"])
    )


@query(
    "table_function_per_group_d2",
    f"""WITH {EVENTS_SQL}, x AS (SELECT *, row_number() {_W} AS i,
        sum(applications) OVER (PARTITION BY series ORDER BY period) AS c,
        sum(applications) OVER (PARTITION BY series) AS t FROM pe)
    SELECT series, count(*) AS n_rows, min(CASE WHEN c * 2 >= t THEN period END) AS half_date
    FROM x GROUP BY series""",
)
def _(spark, d):
    import pandas as pd

    def half_point(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        reached = pdf["applications"].cumsum() * 2 >= pdf["applications"].sum()
        return pd.DataFrame(
            {
                "series": [pdf["series"].iloc[0]],
                "n_rows": [len(pdf)],
                "half_date": [pdf.loc[reached, "period"].iloc[0]],
            }
        )

    # one series' periods per call: bounded by the calendar
    cells = events_panel(spark, d).select(SERIES, PERIOD, "applications")
    return cells.groupBy(SERIES).applyInPandas(
        half_point, "series string, n_rows long, half_date date"
    )


@query(
    "recent_level_w17",
    f"""WITH {PARTS_SQL}, {dense_sql("px", "dense", 7, None)}, k AS (SELECT *, max(CASE WHEN arrivals IS NOT NULL THEN period END)
      OVER (PARTITION BY series) AS e FROM dense),
    l AS (SELECT * EXCLUDE (arrivals), CASE WHEN period = e THEN arrivals END AS arrivals,
      row_number() OVER (PARTITION BY series ORDER BY period DESC) AS i FROM k WHERE period <= e)
    SELECT series, {r("avg(CASE WHEN i <= 4 THEN applications END)", "mean4")},
      {r("median(CASE WHEN i <= 4 THEN visas_issued END)", "median4")},
      {r("arg_max(arrivals, period)", "last")} FROM l GROUP BY series""",
)
def _(spark, d):
    panel = written_panel(spark, d, parts_panel)
    mean = recent_level(panel, ["applications"], 4, step_days=WEEK).withColumnRenamed("applications", "mean4")
    median = recent_level(panel, ["visas_issued"], 4, "median", step_days=WEEK).withColumnRenamed(
        "visas_issued", "median4"
    )
    last = recent_level(panel, ["arrivals"], how="last").withColumnRenamed("arrivals", "last")
    return rounded(mean.join(median, SERIES).join(last, SERIES))


