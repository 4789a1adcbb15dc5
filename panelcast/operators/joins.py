"""Equi-joins of panels, forecasts and calendars.

No broadcast hints but for totals of one row a period, which the calendar bounds: which side is
small depends on the data, and the adaptive planner picks a broadcast from the measured size of a
finished stage and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.calendar import WEEK
from panelcast.operators.windows import by_day
from panelcast.schema import PERIOD, SERIES


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the two tables share no column")
    return left.join(right, shared, "left")


def join_all(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left join many tables on the same keys; the first exchange serves all of them."""
    return reduce(lambda a, b: a.join(b, list(on), "left"), tables)


def positional_join(
    forecast: DataFrame, calendar: DataFrame, left_ordinal: str = "step", keys: Sequence[str] = ()
) -> DataFrame:
    """Date an undated vector: its n-th step takes the n-th distinct period (per key).

    The shorter side decides how many rows come out.  The distinct periods are collected
    map-side into one sorted array, which is never longer than the calendar.
    """
    periods = F.sort_array(F.collect_set(PERIOD)).alias("_p")
    ordinals = (
        calendar.groupBy(*keys)
        .agg(periods)
        .select(*keys, F.posexplode("_p").alias("_i", PERIOD))
        .withColumn(left_ordinal, F.col("_i") + 1)
        .drop("_i")
    )
    return forecast.join(ordinals, [*keys, left_ordinal])


def in_periods(df: DataFrame, periods: DataFrame) -> DataFrame:
    return df.join(periods.select(PERIOD).distinct(), PERIOD, "left_semi")


def not_in_periods(df: DataFrame, periods: DataFrame) -> DataFrame:
    return df.join(periods.select(PERIOD).distinct(), PERIOD, "left_anti")


def with_period_total(df: DataFrame, value: str, total: str) -> DataFrame:
    """Attach the total over all series of the row's period.

    Aggregate and join back rather than a window by period: a window would sort all
    series of one period in one task, the aggregate shrinks them map-side.  The totals are one row
    a period, so the calendar bounds what is sent to every task, and the panel itself does not move.
    *df* is read twice: pass a written panel.
    """
    totals = df.groupBy(PERIOD).agg(F.sum(value).alias(total))
    return df.join(F.broadcast(totals), PERIOD)


def lagged_long(
    df: DataFrame, value: str, max_lag: int, step_days: int = WEEK, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Long lag table (keys, period, k, value at period − k·step) for periods of *df*.

    A frame over day numbers finds the rows that a period can look back to, so it is right on panels
    with gaps, where a row-based lag is not, and the panel moves once however many lags there are.
    """
    day = F.unix_date(PERIOD)
    back = by_day(keys).rangeBetween(-max_lag * step_days, 0)
    seen = F.collect_list(F.struct(day.alias("d"), F.col(value).alias("x"))).over(back)
    rows = df.select(*keys, PERIOD, seen.alias("_s")).select(*keys, PERIOD, F.explode("_s").alias("_s"))
    age = F.unix_date(PERIOD) - F.col("_s.d")
    return rows.filter(age % step_days == 0).select(*keys, PERIOD, (age / step_days).cast("int").alias("k"), F.col("_s.x").alias("x"))
