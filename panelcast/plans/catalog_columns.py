"""Queries for projections, filters, scalar rules, calendars and splits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelcast.functions.exprs import (
    clamp,
    clip_low,
    expm1_floor,
    inv_logit,
    log1p_floor,
    logit,
    propensity,
    ratio,
    recode,
    recode_like,
)
from panelcast.functions.weeks import (
    iso_week,
    iso_year,
    simple_week,
    sunday_week,
    week_index,
    week_start,
)
from panelcast.operators.calendar import (
    DAY,
    WEEK,
    densify,
    densify_within,
    expanding_folds,
    hold_out_fraction,
    hold_out_last,
    horizon,
    merge_cells,
    recent,
    split_at,
)
from panelcast.operators.reshape import (
    across,
    composition_share,
    drop_incomplete,
    fill_numeric,
    one_hot,
    relocate,
    screen_features,
)
from panelcast.operators.windows import at_lag, lag_columns, ordered, stack, with_stock
from panelcast.plans.panels import (
    CUTOFF,
    EVENTS_SQL,
    ORDERS_SQL,
    PARTS_SQL,
    dense_sql,
    events_panel,
    orders_panel,
    parts_panel,
    table,
    written_panel,
)
from panelcast.plans.registry import query, r, rounded, rs
from panelcast.schema import PANEL_SCHEMA, PERIOD, SERIES, STAGES

_COLS = "period, series, applications, visas_issued, arrivals"
_W = "OVER (PARTITION BY series ORDER BY period)"

# --- projections and filters --------------------------------------------------


@query(
    "rename_and_relocate_p1",
    f"WITH {ORDERS_SQL} SELECT series AS type, period AS week, visas_issued AS issued, arrivals FROM po",
)
def _(spark, d):
    df = orders_panel(spark, d).withColumnsRenamed(
        {"series": "type", "period": "week", "visas_issued": "issued"}
    )
    return relocate(df.drop("applications"), "type", "week")


@query(
    "regex_row_filter_p2",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    WHERE regexp_matches(o_orderpriority, 'URGENT|HIGH|^5') AND o_orderstatus = 'F'""",
)
def _(spark, d):
    return (
        table(spark, d, "orders")
        .filter(F.col("o_orderpriority").rlike("URGENT|HIGH|^5"))
        .filter(F.col("o_orderstatus") == "F")
        .select("o_orderkey", "o_orderpriority", "o_totalprice")
    )


@query(
    "recode_with_default_p3",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'bld' WHEN 'FURNITURE' THEN 'furn'
           WHEN 'MACHINERY' THEN 'mach' ELSE c_mktsegment END AS short,
      CASE WHEN c_mktsegment LIKE 'H%' THEN 'home' WHEN c_mktsegment LIKE '%MOBILE'
           THEN 'car' ELSE 'trade' END AS kind FROM customer""",
)
def _(spark, d):
    short = {"BUILDING": "bld", "FURNITURE": "furn", "MACHINERY": "mach"}
    return table(spark, d, "customer").select(
        "c_custkey",
        recode("c_mktsegment", short).alias("short"),
        recode_like("c_mktsegment", [("^H", "home"), ("MOBILE$", "car")], "trade").alias("kind"),
    )


@query(
    "null_to_constant_p4",
    f"""WITH {EVENTS_SQL}, {dense_sql("pe", "dense", 1, None)}, l AS (SELECT *, coalesce(lag(arrivals) {_W}, 0) AS arrivals_lag1,
      coalesce(lag(visas_issued, 2) {_W}, 0) AS visas_issued_lag2 FROM dense)
    SELECT series, period, arrivals_lag1, visas_issued_lag2 FROM l WHERE arrivals IS NOT NULL""",
)
def _(spark, d):
    df = events_panel(spark, d).select(
        SERIES,
        PERIOD,
        at_lag("arrivals", 1, DAY).alias("arrivals_lag1"),
        at_lag("visas_issued", 2, DAY).alias("visas_issued_lag2"),
    )
    return fill_numeric(df, 0)


@query(
    "clip_and_clamp_p5",
    f"""SELECT c_custkey, {r("greatest(c_acctbal, 0)", "floor0")},
      {r("least(greatest(c_acctbal / 10000, 0.05), 0.9)", "clamped")} FROM customer""",
)
def _(spark, d):
    return rounded(
        table(spark, d, "customer").select(
            "c_custkey",
            clip_low("c_acctbal").alias("floor0"),
            clamp(F.col("c_acctbal") / 10000, 0.05, 0.9).alias("clamped"),
        )
    )


@query(
    "type_normalisation_p6",
    """SELECT CAST(o_orderkey AS VARCHAR) AS series, CAST(o_orderdate AS DATE) AS period,
      CAST(o_custkey AS DOUBLE) AS amount, TRY_CAST(o_orderpriority[1:1] AS INTEGER) AS level,
      TRY_CAST(o_orderstatus AS INTEGER) AS bad FROM orders""",
)
def _(spark, d):
    raw = table(spark, d, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_custkey").cast("string").alias("amount"),
        F.substring("o_orderpriority", 1, 1).alias("level"),
        "o_orderstatus",
    )
    return raw.select(
        F.col("o_orderkey").cast("string").alias("series"),
        F.to_date("day").alias("period"),
        F.col("amount").try_cast("double").alias("amount"),
        F.col("level").try_cast("int").alias("level"),
        F.col("o_orderstatus").try_cast("int").alias("bad"),
    )


@query(
    "drop_incomplete_rows_p7",
    f"""WITH {EVENTS_SQL}, {dense_sql("pe", "dense", 1, None)}, f AS (SELECT series, period,
      arrivals / nullif(visas_issued, 0) AS rate, lag(arrivals) {_W} AS lag1 FROM dense)
    SELECT series, period, {rs("rate", "lag1")} FROM f WHERE rate IS NOT NULL AND lag1 IS NOT NULL""",
)
def _(spark, d):
    df = events_panel(spark, d).select(
        SERIES,
        PERIOD,
        F.try_divide("arrivals", "visas_issued").alias("rate"),
        at_lag("arrivals", 1, DAY).alias("lag1"),
    )
    return rounded(drop_incomplete(df, ["rate", "lag1"]))


@query(
    "one_hot_columns_p8",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_signup,
      CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_view,
      CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_purchase FROM events""",
)
def _(spark, d):
    kinds = {f"is_{k}": k for k in ("signup", "view", "purchase")}
    return one_hot(table(spark, d, "events"), "event_type", kinds).select("event_id", *kinds)


@query(
    "feature_screen_p9",
    f"""WITH {EVENTS_SQL}, {dense_sql("pe", "dense", 1, None)}, l AS (SELECT *, coalesce(lag(applications) {_W}, 0) AS applications_lag1,
      coalesce(lag(arrivals) {_W}, 0) AS arrivals_lag1 FROM dense)
    SELECT series, period, applications_lag1, arrivals_lag1 FROM l WHERE arrivals IS NOT NULL""",
)
def _(spark, d):
    df = (
        events_panel(spark, d)
        .withColumns(lag_columns(["applications", "arrivals"], [1], step_days=DAY))
        .withColumns({"constant": F.lit(1.0), "empty": F.lit(None).cast("double")})
        .select(SERIES, PERIOD, "applications_lag1", "arrivals_lag1", "constant", "empty")
    )
    candidates = ["applications_lag1", "arrivals_lag1", "constant", "empty"]
    return screen_features(df, candidates)[0]


@query(
    "safe_ratios_p10",
    f"""WITH {EVENTS_SQL} SELECT series, period,
      {r("CASE WHEN applications > 0 THEN visas_issued / applications END", "or_null")},
      {r("CASE WHEN applications > 0 THEN visas_issued / applications ELSE 0 END", "or_zero")},
      {r("visas_issued / (applications + 1)", "plus_one")},
      {r("visas_issued / greatest(applications, 1)", "floor_one")} FROM pe""",
)
def _(spark, d):
    kinds = {"or_null": "null", "or_zero": "zero", "plus_one": "plus_one", "floor_one": "floor_one"}
    return rounded(
        events_panel(spark, d).select(
            SERIES,
            PERIOD,
            *[ratio("visas_issued", "applications", k).alias(n) for n, k in kinds.items()],
        )
    )


@query(
    "composition_share_p11",
    f"""WITH {ORDERS_SQL}, t AS (SELECT period, sum(visas_issued) AS total FROM po GROUP BY period)
    SELECT series, po.period, {r("CASE WHEN total > 0 THEN visas_issued / total END", "share")}
    FROM po JOIN t ON po.period = t.period""",
)
def _(spark, d):
    return rounded(
        composition_share(written_panel(spark, d), "visas_issued").select(SERIES, PERIOD, "share")
    )


def _stock_sql(inflow: str, outflow: str, src: str = "po") -> str:
    return f"""bal AS (SELECT *, sum({inflow} - {outflow}) OVER (PARTITION BY series ORDER BY period) AS b
      FROM {src}),
    opened AS (SELECT *, greatest(0, -min(b) OVER (PARTITION BY series)) AS opening FROM bal),
    stock AS (SELECT *, opening + b AS stock_end,
      coalesce(lag(opening + b) {_W}, opening) AS stock_start FROM opened)"""


@query(
    "smoothed_propensity_p12",
    f"""WITH {ORDERS_SQL}, {_stock_sql("applications", "visas_issued")},
    p AS (SELECT series, period, least(greatest((visas_issued + 0.5::DOUBLE) /
      (stock_start + applications + 1), 0.0001::DOUBLE), 1 - 0.0001::DOUBLE) AS rate FROM stock)
    SELECT series, period, {r("rate", digits=9)}, {r("ln(rate / (1 - rate))", "rate_logit", 9)},
      {r("1 / (1 + exp(-ln(rate / (1 - rate))))", "back", 9)} FROM p""",
)
def _(spark, d):
    stock = with_stock(orders_panel(spark, d), "applications", "visas_issued", "stock")
    df = stock.withColumn("rate", propensity("visas_issued", "stock_available"))
    df = df.withColumn("rate_logit", logit("rate"))
    return rounded(
        df.select(SERIES, PERIOD, "rate", "rate_logit", inv_logit("rate_logit").alias("back")), 9
    )


@query(
    "log_scale_p13",
    f"""SELECT c_custkey, {r("ln(1 + greatest(c_acctbal, 0))", "on_log")},
      {r("greatest(exp(c_acctbal / 10000) - 1, 0)", "off_log")} FROM customer""",
)
def _(spark, d):
    return rounded(
        table(spark, d, "customer").select(
            "c_custkey",
            log1p_floor("c_acctbal").alias("on_log"),
            expm1_floor(F.col("c_acctbal") / 10000).alias("off_log"),
        )
    )


@query(
    "stage_gaps_p14",
    f"""WITH {ORDERS_SQL} SELECT series, period, applications - visas_issued AS gap,
      {r("visas_issued / nullif(arrivals, 0)", "issued_per_arrival")} FROM po""",
)
def _(spark, d):
    return rounded(
        orders_panel(spark, d).select(
            SERIES,
            PERIOD,
            (F.col("applications") - F.col("visas_issued")).alias("gap"),
            F.try_divide("visas_issued", "arrivals").alias("issued_per_arrival"),
        )
    )


@query(
    "across_columns_d3",
    f"WITH {ORDERS_SQL} SELECT series, period, "
    + ", ".join(f"{r(f'ln(1 + {c})', f'log_{c}')}" for c in STAGES)
    + " FROM po",
)
def _(spark, d):
    df = across(orders_panel(spark, d), STAGES, F.log1p, "log_{col}")
    return rounded(df.drop(*STAGES))


# --- week numbers ---------------------------------------------------------------

_SIMPLE = "((dayofyear({d}) - 1) // 7 + 1)"


def _simple(d: str) -> str:
    return _SIMPLE.format(d=d)


@query(
    "continuous_week_index_t1",
    f"""SELECT o_orderpriority AS series,
      CAST({_simple("o_orderdate")} + 52 * (year(o_orderdate) - 1995) AS INTEGER) AS week,
      count(*) AS n FROM orders GROUP BY 1, 2""",
)
def _(spark, d):
    return (
        table(spark, d, "orders")
        .groupBy(
            F.col("o_orderpriority").alias(SERIES),
            week_index(F.to_date("o_orderdate"), 1995).alias("week"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "week_number_variants_t2",
    f"""WITH days AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
    SELECT day, n, CAST({_simple("day")} AS INTEGER) AS simple,
      CAST(strftime(day, '%U') AS INTEGER) AS sunday, CAST(weekofyear(day) AS INTEGER) AS iso,
      CAST(isoyear(day) AS INTEGER) AS iso_year, CAST(month(day) AS INTEGER) AS month,
      CAST(quarter(day) AS INTEGER) AS quarter FROM days""",
)
def _(spark, d):
    days = (
        table(spark, d, "orders")
        .groupBy(F.to_date("o_orderdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return days.select(
        "day",
        "n",
        simple_week("day").alias("simple"),
        sunday_week("day").alias("sunday"),
        iso_week("day").alias("iso"),
        iso_year("day").cast("int").alias("iso_year"),
        F.month("day").alias("month"),
        F.quarter("day").alias("quarter"),
    )


@query(
    "week_index_to_date_t3",
    f"""WITH x AS (SELECT CAST({_simple("o_orderdate")} + 52 * (year(o_orderdate) - 1995)
      AS INTEGER) AS week, count(*) AS n FROM orders GROUP BY 1)
    SELECT week, n, DATE '1995-01-02' + CAST((week - 1) * 7 AS INTEGER) AS period FROM x""",
)
def _(spark, d):
    return (
        table(spark, d, "orders")
        .groupBy(week_index(F.to_date("o_orderdate"), 1995).alias("week"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(PERIOD, week_start("week", dt.date(1995, 1, 2)))
    )


@query(
    "horizon_calendar_t4",
    f"""WITH {PARTS_SQL}, e AS (SELECT series, max(period) AS last FROM px GROUP BY series)
    SELECT series, CAST(h AS INTEGER) AS h, last + CAST(h * 7 AS INTEGER) AS period
    FROM e, range(1, 14) AS g(h)""",
)
def _(spark, d):
    return horizon(parts_panel(spark, d), 13)


# --- splits -----------------------------------------------------------------------


@query(
    "date_cutoff_split_t5",
    f"""WITH {ORDERS_SQL} SELECT {_COLS}, CASE WHEN period <= DATE '{CUTOFF}' THEN 'train'
      ELSE 'test' END AS role FROM po""",
)
def _(spark, d):
    train, test = split_at(written_panel(spark, d), CUTOFF)
    return stack({"train": train, "test": test}, "role")


_NUMBERED = f"""num AS (SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY series) AS n
  FROM {{src}})"""


@query(
    "last_periods_hold_out_t6",
    f"""WITH {EVENTS_SQL}, {_NUMBERED.format(src="pe")}
    SELECT {_COLS}, CASE WHEN i > n - 5 THEN 'test' ELSE 'train' END AS role FROM num""",
)
def _(spark, d):
    return hold_out_last(events_panel(spark, d), 5)


@query(
    "fraction_hold_out_t7",
    f"""WITH {EVENTS_SQL}, {_NUMBERED.format(src="pe")}
    SELECT {_COLS}, CASE WHEN i <= round_even(0.8::DOUBLE * n, 0) THEN 'train' ELSE 'test' END AS role
    FROM num""",
)
def _(spark, d):
    return hold_out_fraction(events_panel(spark, d), 0.8)


FOLDS_SQL = f"""folds AS (
  SELECT num.*, CAST(f AS INTEGER) AS fold,
    CASE WHEN i <= n - 8 + f - 1 THEN 'train' ELSE 'test' END AS role
  FROM num, range(1, 5) AS g(f) WHERE n - 8 + f - 1 > 0 AND i <= n - 8 + f - 1 + 13)"""


@query(
    "expanding_folds_t8",
    f"""WITH {EVENTS_SQL}, {_NUMBERED.format(src="pe")}, {FOLDS_SQL}
    SELECT {_COLS}, fold, role FROM folds""",
)
def _(spark, d):
    return expanding_folds(events_panel(spark, d), 4, 13)


@query(
    "recent_window_t9",
    f"""WITH {PARTS_SQL}, {dense_sql("px", "dense", 7, None)}, k AS (SELECT *, max(CASE WHEN arrivals IS NOT NULL THEN period END)
      OVER (PARTITION BY series) AS e FROM dense),
    i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS i FROM k WHERE period <= e)
    SELECT {_COLS} FROM i WHERE i <= 12 AND arrivals IS NOT NULL""",
)
def _(spark, d):
    return recent(parts_panel(spark, d), 12, step_days=WEEK)


# --- grids -------------------------------------------------------------------------


@query(
    "global_grid_nulls_g1",
    f"WITH {EVENTS_SQL}, {dense_sql('pe', 'dense', 1, None)} SELECT {_COLS} FROM dense",
)
def _(spark, d):
    return densify(written_panel(spark, d, events_panel), DAY)


@query(
    "sparse_grid_summary_g1",
    f"""WITH {PARTS_SQL}, {dense_sql('px', 'dense', 7, None)}
    SELECT series, count(*) AS n_periods, count(applications) AS n_known, min(period) AS first,
      max(period) AS last, sum(applications) AS applications FROM dense GROUP BY series""",
)
def _(spark, d):
    return (
        densify(written_panel(spark, d, parts_panel))
        .groupBy(SERIES)
        .agg(
            F.count(F.lit(1)).alias("n_periods"),
            F.count("applications").alias("n_known"),
            F.min(PERIOD).alias("first"),
            F.max(PERIOD).alias("last"),
            F.sum("applications").alias("applications"),
        )
    )


@query(
    "global_grid_zeros_g2",
    f"""WITH {EVENTS_SQL}, doubled AS (SELECT * FROM pe UNION ALL SELECT * FROM pe),
    merged AS (SELECT series, period, sum(applications) AS applications,
      sum(visas_issued) AS visas_issued, sum(arrivals) AS arrivals FROM doubled GROUP BY 1, 2),
    {dense_sql("merged", "dense", 1)} SELECT {_COLS} FROM dense""",
)
def _(spark, d):
    once = written_panel(spark, d, events_panel)
    return densify(merge_cells(once.unionByName(once)), DAY, fill=0.0)


@query(
    "own_range_gaps_g3",
    f"""WITH {EVENTS_SQL}, ends AS (SELECT series, min(period) AS lo, max(period) AS hi FROM pe
      GROUP BY series),
    grid AS (SELECT series, CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP,
      INTERVAL 1 DAY)) AS DATE) AS period FROM ends)
    SELECT g.series, g.period, p.applications, p.visas_issued, p.arrivals
    FROM grid g LEFT JOIN pe p ON p.series = g.series AND p.period = g.period""",
)
def _(spark, d):
    return densify_within(events_panel(spark, d), DAY)


# the declared schema is the contract of every panel above
assert set(PANEL_SCHEMA.names) == {PERIOD, SERIES, *STAGES}
