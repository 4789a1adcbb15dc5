"""Panels built from the star-schema and event tables, with the same shapes in SQL.

* orders panel: series = order priority, weekly; orders placed, lines shipped with status
  F, lines shipped with return flag R.
* events panel: series = user, daily; signup, view and purchase events.
* parts panel: series = part, weekly; lines shipped, status F, return flag R.  Many short,
  sparse series: the stress shape.
* path table: series = event type, sim = one of 50 user groups, daily sums in cents.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.weeks import day, monday
from panelcast.operators.calendar import densify
from panelcast.schema import PERIOD, SERIES
from panelcast.sources.panel import Fact, build_panel
from panelcast.sources.tables import materialise

CUTOFF = dt.date(2001, 1, 1)
N_PATHS = 50

PRIORITIES = {
    "1-URGENT": "urgent",
    "2-HIGH": "high",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "none",
    "5-LOW": "low",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    # select the columns that are needed before the join; both sides shuffle on the order
    # key unless the planner measures one of them as small
    lines = table(spark, sf_dir, "lineitem")
    shipped = lines.select("l_orderkey", "l_shipdate", "l_linestatus", "l_returnflag").join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey"
    )
    return build_panel(
        [
            Fact(
                orders.select("o_orderpriority", "o_orderdate"),
                "o_orderpriority",
                monday("o_orderdate"),
                {"applications": F.lit(True)},
            ),
            Fact(
                shipped,
                "o_orderpriority",
                monday("l_shipdate"),
                {
                    "visas_issued": F.col("l_linestatus") == "F",
                    "arrivals": F.col("l_returnflag") == "R",
                },
            ),
        ]
    )


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return build_panel(
        [
            Fact(
                table(spark, sf_dir, "events"),
                "user_id",
                day("ts"),
                {
                    "applications": kind == "signup",
                    "visas_issued": kind == "view",
                    "arrivals": kind == "purchase",
                },
            )
        ]
    )


def parts_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_panel(
        [
            Fact(
                table(spark, sf_dir, "lineitem"),
                "l_partkey",
                monday("l_shipdate"),
                {
                    "applications": F.lit(True),
                    "visas_issued": F.col("l_linestatus") == "F",
                    "arrivals": F.col("l_returnflag") == "R",
                },
            )
        ]
    )


def written_panel(spark: SparkSession, sf_dir: str, build=orders_panel) -> DataFrame:
    """A panel written once, for queries that use it several times.

    Each use prunes and filters the panel in its own way, so the planner could not share
    the fact scans and joins among them; the written panel is many orders smaller than
    the facts.
    """
    return materialise(build(spark, sf_dir))


def dense_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts panel with zeros in its empty weeks: the dense stress shape."""
    return densify(written_panel(spark, sf_dir, parts_panel), fill=0.0)


def dense_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders panel with zeros in its empty weeks."""
    return densify(written_panel(spark, sf_dir), fill=0.0)


def parts_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """The stored cells of the parts panel, and the first and last week of its calendar."""
    cells = written_panel(spark, sf_dir, parts_panel)
    return cells, cells.select(F.min(PERIOD)).scalar(), cells.select(F.max(PERIOD)).scalar()


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias(SERIES),
            (F.col("user_id") % N_PATHS).cast("int").alias("sim"),
            day("ts").alias(PERIOD),
        )
        # whole cents: exact sums, the same in any order of addition
        .agg(F.sum(F.round(F.col("value") * 100)).alias("value"))
    )


def line_weights(spark: SparkSession, sf_dir: str, share: float = 0.9) -> DataFrame:
    """Delay weights (series, k, w) out of the data: quantity by line number, Σw = *share*."""
    orders = table(spark, sf_dir, "orders")
    by_line = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_quantity")
        .join(
            orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey"
        )
        .groupBy(F.col("o_orderpriority").alias(SERIES), (F.col("l_linenumber") - 1).alias("k"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    total = by_line.groupBy(SERIES).agg(F.sum("q").alias("t"))
    return by_line.join(total, SERIES).select(
        SERIES, "k", (F.col("q") / F.col("t") * share).alias("w")
    )


def weight_arrays(weights: DataFrame) -> DataFrame:
    """(series, k, w) → (series, weights array): w stands at place k, zeros between."""
    packed = F.map_from_entries(F.collect_list(F.struct("k", "w")))
    return weights.groupBy(SERIES).agg(packed.alias("_w"), F.max("k").alias("_k")).select(
        SERIES,
        F.transform(
            F.sequence(F.lit(0).cast("int"), F.col("_k").cast("int")),
            lambda k: F.coalesce(F.element_at("_w", k), F.lit(0.0)),
        ).alias("weights"),
    )


# --- the same tables in SQL ---------------------------------------------------

_STAGES_SQL = (
    "CAST(sum(a) AS DOUBLE) AS applications, CAST(sum(v) AS DOUBLE) AS visas_issued, "
    "CAST(sum(r) AS DOUBLE) AS arrivals"
)

ORDERS_SQL = f"""
po_facts AS (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS period, o_orderpriority AS series,
         1 AS a, 0 AS v, 0 AS r FROM orders
  UNION ALL
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE), o_orderpriority, 0,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
po AS (SELECT period, series, {_STAGES_SQL} FROM po_facts GROUP BY period, series)"""

EVENTS_SQL = f"""
pe_facts AS (
  SELECT CAST(ts AS DATE) AS period, CAST(user_id AS VARCHAR) AS series,
         CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS a,
         CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS v,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS r FROM events),
pe AS (SELECT period, series, {_STAGES_SQL} FROM pe_facts GROUP BY period, series)"""

PARTS_SQL = f"""
px_facts AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS period,
         CAST(l_partkey AS VARCHAR) AS series, 1 AS a,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS v,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r FROM lineitem),
px AS (SELECT period, series, {_STAGES_SQL} FROM px_facts GROUP BY period, series)"""

PATHS_SQL = f"""
paths AS (
  SELECT event_type AS series, CAST(user_id % {N_PATHS} AS INTEGER) AS sim,
         CAST(ts AS DATE) AS period, sum(round(value * 100)) AS value
  FROM events GROUP BY 1, 2, 3)"""

WEIGHTS_SQL = """
by_line AS (
  SELECT o_orderpriority AS series, l_linenumber - 1 AS k, sum(l_quantity) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
weights AS (
  SELECT series, k, q / sum(q) OVER (PARTITION BY series) * 0.9::DOUBLE AS w FROM by_line)"""


def dense_sql(source: str, name: str, step: int = 7, fill: str | None = "0") -> str:
    """CTE that densifies a panel over its global range."""
    cells = ", ".join(
        f"coalesce(p.{c}, {fill}) AS {c}" if fill is not None else f"p.{c} AS {c}"
        for c in ("applications", "visas_issued", "arrivals")
    )
    return f"""
{name}_bounds AS (SELECT min(period) AS lo, max(period) AS hi FROM {source}),
{name}_grid AS (
  SELECT s.series, CAST(g.d AS DATE) AS period
  FROM (SELECT DISTINCT series FROM {source}) s,
       (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL {step} DAY)) AS d
        FROM {name}_bounds) g),
{name} AS (
  SELECT g.series, g.period, {cells}
  FROM {name}_grid g LEFT JOIN {source} p ON p.series = g.series AND p.period = g.period)"""
