"""The dense calendar is dealt by its own size, not by that of its stored cells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.operators.calendar import TASK_CELLS, densify
from panelcast.plans.catalog import QUERIES
from panelcast.schema import SERIES

START, SERIES_N, WEEKS = dt.date(1990, 1, 1), 3000, 1000


def _days(spark):
    """Two lines of each part: one in a week of its own, one at an end of the calendar."""
    parts = spark.range(SERIES_N).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    week = F.when(F.col("i") == 0, F.col("id") % WEEKS).otherwise((F.col("id") % 2) * (WEEKS - 1)).cast("int")
    return parts.select("id", F.date_add(F.lit(START), week * 7).alias("day"))


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lines"))
    _days(spark).select(
        F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("day").cast("timestamp").alias("l_shipdate"),
        F.lit("F").alias("l_linestatus"), F.lit("R").alias("l_returnflag"),
    ).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_no_task_makes_much_more_than_its_cells(spark):
    cells = _days(spark).distinct().select(F.col("id").cast("string").alias(SERIES), F.col("day").alias("period"), F.lit(1.0).alias("x"))
    made = [r["count"] for r in densify(cells, 7, ["x"], fill=0.0).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == SERIES_N * WEEKS
    assert max(made) <= 1.2 * TASK_CELLS


def test_a_small_calendar_is_left_to_the_planner(spark, weekly):
    assert "REPARTITION" not in densify(weekly)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["smoothing_free_start_m5", "series_line_m2", "dispersion_m24"])
def test_fits_run_in_as_many_tasks_as_their_calendar_needs(spark, lines, name):
    out = QUERIES[name](spark, lines)
    assert out.rdd.getNumPartitions() >= SERIES_N * WEEKS // TASK_CELLS
    assert out.count() == SERIES_N and out.agg(F.min("n"), F.max("n")).first()[0] >= WEEKS - 1
