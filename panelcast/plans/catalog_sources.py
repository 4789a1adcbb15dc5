"""Queries for sources, sinks, contracts and text blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators.aggregate import profile
from panelcast.operators.ranges import running_sums
from panelcast.operators.windows import running_total, trend
from panelcast.plans.panels import (
    CUTOFF,
    EVENTS_SQL,
    ORDERS_SQL,
    PARTS_SQL,
    PATHS_SQL,
    event_paths,
    events_panel,
    orders_panel,
    parts_panel,
    table,
    written_panel,
)
from panelcast.plans.registry import query, r, rounded
from panelcast.schema import PANEL_SCHEMA, PERIOD, SERIES
from panelcast.sources.adapters import ForecastShape, adapt_forecast, null_periods
from panelcast.sources.panel import contract_violations
from panelcast.sources.tables import read_csv, round_trip, shared_dir, write_table
from panelcast.sources.text import PARAGRAPH, explode_blocks, joined_blocks

_COLS = "period, series, applications, visas_issued, arrivals"


@query("typed_csv_scan_s1", f"WITH {ORDERS_SQL} SELECT {_COLS} FROM po")
def _(spark, d):
    path = shared_dir(spark)
    write_table(orders_panel(spark, d), path, "csv")
    return read_csv(spark, path, PANEL_SCHEMA)


@query("partitioned_table_sink_s2", f"WITH {EVENTS_SQL} SELECT {_COLS} FROM pe")
def _(spark, d):
    return round_trip(events_panel(spark, d), partition_by=["period"])


@query(
    "path_round_trip_s3",
    f"WITH {PATHS_SQL} SELECT series, sim, period, {r('value', digits=4)} FROM paths",
)
def _(spark, d):
    return rounded(round_trip(event_paths(spark, d), partition_by=["series"]), 4)


@query(
    "forecast_adapters_s4",
    f"""WITH {ORDERS_SQL}, late AS (SELECT * FROM po WHERE period > DATE '{CUTOFF}')
    SELECT 'dated' AS model, series, period, visas_issued AS forecast FROM late
    UNION ALL SELECT 'running', series, period, arrivals FROM late
    UNION ALL SELECT 'undated', series, period, applications FROM late
    UNION ALL SELECT 'summed', NULL, period, sum(visas_issued) FROM late GROUP BY period
    UNION ALL SELECT 'summed_running', NULL, period, sum(arrivals) FROM late GROUP BY period""",
)
def _(spark, d):
    late = written_panel(spark, d).filter(F.col(PERIOD) > F.lit(CUTOFF))
    dated = late.withColumnsRenamed({PERIOD: "Week ending", "visas_issued": "Issued.total"})
    running = late.withColumn("so_far", running_total("arrivals"))
    undated = late.select(SERIES, "applications", trend().alias("step"))
    total = late.groupBy(PERIOD).agg(F.sum("arrivals").alias("n"))
    # one vector without series: weekly totals, then their running total over the weeks
    so_far = running_sums(total, [], [PERIOD], ["n"]).select(F.col(PERIOD).alias("Week"), F.col("n_upto").alias("Running"))
    parts = [
        adapt_forecast(
            dated, ForecastShape("dated", "Issued.total", period="Week ending", series=SERIES)
        ),
        adapt_forecast(
            running,
            ForecastShape("running", "so_far", period=PERIOD, series=SERIES, cumulative=True),
        ),
        adapt_forecast(
            undated,
            ForecastShape("undated", "applications", ordinal="step", series=SERIES),
            late.select(SERIES, PERIOD),
        ),
        adapt_forecast(
            late, ForecastShape("summed", "visas_issued", period=PERIOD, additive=True)
        ),
        adapt_forecast(
            so_far, ForecastShape("summed_running", "Running", period="Week", cumulative=True)
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@query(
    "null_date_check_s4",
    f"""WITH {ORDERS_SQL}
    SELECT series AS model, count(*) AS n FROM po WHERE applications = 0 GROUP BY series""",
)
def _(spark, d):
    broken = orders_panel(spark, d).select(
        F.col("series").alias("model"),
        F.when(F.col("applications") != 0, F.col(PERIOD)).alias(PERIOD),
    )
    return null_periods(broken)


@query("orders_panel_s5", f"WITH {ORDERS_SQL} SELECT {_COLS} FROM po")
def _(spark, d):
    return orders_panel(spark, d)


@query("events_panel_s5", f"WITH {EVENTS_SQL} SELECT {_COLS} FROM pe")
def _(spark, d):
    return events_panel(spark, d)


@query("parts_panel_s5", f"WITH {PARTS_SQL} SELECT {_COLS} FROM px")
def _(spark, d):
    return parts_panel(spark, d)


@query(
    "panel_contract_s6",
    """WITH rows AS (SELECT CAST(user_id % 97 AS VARCHAR) AS series,
        CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS period,
        CASE WHEN event_type <> 'click' THEN value END AS arrivals FROM events),
    cells AS (SELECT series, period, count(*) AS n, count(*) - count(arrivals) AS nulls
              FROM rows GROUP BY 1, 2),
    per AS (SELECT series, coalesce(sum(CASE WHEN period IS NULL THEN n END), 0) AS np,
                   count(*) FILTER (WHERE n > 1 AND period IS NOT NULL) AS dup,
                   count(period) AS periods, sum(nulls) AS na FROM cells GROUP BY 1)
    SELECT 'null_period' AS "check", series, CAST(np AS BIGINT) AS n FROM per WHERE np > 0
    UNION ALL SELECT 'duplicate_key', series, CAST(dup AS BIGINT) FROM per WHERE dup > 0
    UNION ALL SELECT 'null_arrivals', series, CAST(na AS BIGINT) FROM per WHERE na > 0
    UNION ALL SELECT 'short_history', series, CAST(periods AS BIGINT) FROM per WHERE periods < 30
    UNION ALL SELECT 'missing_column:visas_issued', NULL, 0""",
)
def _(spark, d):
    rows = table(spark, d, "events").select(
        (F.col("user_id") % 97).cast("string").alias("series"),
        F.when(F.col("event_type") != "error", F.to_date("ts")).alias("period"),
        F.when(F.col("event_type") != "click", F.col("value")).alias("arrivals"),
    )
    required = {
        "series": "string",
        "period": "date",
        "visas_issued": "double",
        "arrivals": "double",
    }
    return contract_violations(rows, required, min_periods=30)


_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "numeric_profile_s7",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS nulls,
        {r(f"min({c})", "min")}, {r(f"quantile_cont({c}, 0.25)", "q25")},
        {r(f"quantile_cont({c}, 0.5)", "median")}, {r(f"quantile_cont({c}, 0.75)", "q75")},
        {r(f"max({c})", "max")}, {r(f"avg({c})", "mean", 4)} FROM lineitem"""
        for c in _PROFILED
    ),
)
def _(spark, d):
    out = profile(table(spark, d, "lineitem"), _PROFILED)
    return rounded(out.withColumn("mean", F.round("mean", 4)))


# (?s) lets the dot cross lines in the checking engine, as [\s\S] does here
_SQL_BLOCK = r"(?s)<p>(.*?)</p>"
_SQL_BLOCKS = (
    rf"list_transform(regexp_extract_all(html, '{_SQL_BLOCK}', 1), "
    r"lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
)


@query(
    "text_blocks_joined_s8",
    rf"""WITH b AS (SELECT page_id, html, {_SQL_BLOCKS} AS bs FROM pages)
    SELECT page_id, CASE WHEN len(bs) = 0 THEN html
           ELSE array_to_string(bs, chr(10) || chr(10)) END AS content FROM b""",
)
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", joined_blocks("html", PARAGRAPH).alias("content")
    )


@query(
    "text_blocks_exploded_s8",
    rf"""WITH b AS (SELECT page_id, {_SQL_BLOCKS} AS bs FROM pages)
    SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, bs[i] AS block
    FROM b, unnest(range(1, len(bs) + 1)) AS t(i)""",
)
def _(spark, d):
    return explode_blocks(
        table(spark, d, "pages").select("page_id", "html"), "html", PARAGRAPH
    )


