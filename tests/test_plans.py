"""What the plans must look like, whatever the data size."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelcast.operators.calendar import densify
from panelcast.operators.fit import fit_linear, lagged_design
from panelcast.operators.windows import first_rows
from panelcast.plans.catalog import QUERIES
from panelcast.plans.panels import orders_panel, table

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="driver tables are absent")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_are_pruned_and_filtered_at_the_scan(spark):
    plan = orders_panel(spark, SF_DIR)._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "l_shipdate" in x)
    schema = scan.split("ReadSchema:")[1]
    assert "l_extendedprice" not in schema and "l_tax" not in schema
    assert "l_linestatus" in scan.split("PushedFilters")[1]


def test_panel_features_share_one_exchange(spark):
    """Gap filling, lags, centring and the products of a fit all run on one exchange by series."""
    cells = table(spark, SF_DIR, "lineitem").select(
        F.col("l_partkey").cast("string").alias("series"),
        F.to_date("l_shipdate").alias("period"),
        F.lit(1.0).alias("applications"),
        F.lit(1.0).alias("visas_issued"),
        F.lit(1.0).alias("arrivals"),
    )
    design, xs = lagged_design(densify(cells, 1, fill=0.0), "arrivals", {"applications": [1, 2]}, 2)
    main = plan_of(fit_linear(design, "arrivals", xs))
    assert main.count("Exchange hashpartitioning") == 1


def test_first_rows_limit_groups_before_the_shuffle(spark):
    rows = table(spark, SF_DIR, "lineitem").select("l_returnflag", "l_extendedprice")
    plan = plan_of(first_rows(rows, 3, ["l_extendedprice"], ["l_returnflag"]))
    assert "WindowGroupLimit" in plan


def test_aggregates_combine_before_the_shuffle(spark):
    plan = plan_of(orders_panel(spark, SF_DIR))
    assert "partial_sum" in plan


@pytest.mark.parametrize(
    "name",
    ["date_cutoff_split_t5", "forecast_to_actual_j1", "positional_join_j6", "recent_level_w17", "lag_ratio_projection_m15",
     "stock_flow_m16", "regression_feedback_m17", "decaying_projection_m20", "stacked_regression_m26"],
)
def test_facts_are_read_for_one_written_panel(spark, name):
    """Queries that use a panel several times write it once: their own plans scan no fact table."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    facts = [x for x in plan.splitlines() if "Relation" in x and ("l_shipdate" in x or "o_orderdate" in x)]
    assert not facts, facts
