"""Map forecast tables of any shape onto (model, period, forecast)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.joins import positional_join
from panelcast.operators.ranges import previous
from panelcast.operators.windows import decumulate
from panelcast.schema import PERIOD, SERIES


@dataclass(frozen=True)
class ForecastShape:
    """How one model writes its forecasts.

    ``period`` names the date column; leave it out for an undated vector, whose
    ``ordinal`` column then says which step a row is.  ``series`` names the series column
    of a forecast that has one.  ``cumulative`` marks running totals, ``additive`` a table
    with several rows per date that are to be summed.  ``bounds`` maps
    lo80/hi80/lo95/hi95 to columns.
    """

    model: str
    value: str
    period: str | None = None
    ordinal: str | None = None
    series: str | None = None
    cumulative: bool = False
    additive: bool = False
    bounds: tuple[tuple[str, str], ...] = ()


def _increments(df: DataFrame) -> DataFrame:
    """Running totals → increments for a single vector of any length: each range of periods goes on
    from the last value of the range before.  A row without a period stays as it is."""
    dated = previous(df.filter(F.col(PERIOD).isNotNull()), [], [PERIOD], "forecast", "_before")
    steps = dated.withColumn("forecast", F.col("forecast") - F.coalesce("_before", F.lit(0.0))).drop("_before")
    return steps.unionByName(df.filter(F.col(PERIOD).isNull()))


def adapt_forecast(
    df: DataFrame, shape: ForecastShape, calendar: DataFrame | None = None
) -> DataFrame:
    """Normalise one forecast table to (model, [series,] period, forecast, bounds).

    *calendar* (period, and series where the shape has one) dates an undated vector.
    """
    keys = [SERIES] if shape.series else []
    bound_names = [dst for dst, _ in shape.bounds]
    cols = [F.col(f"`{shape.series}`").cast("string").alias(SERIES)] if shape.series else []
    cols.append(F.col(f"`{shape.value}`").cast("double").alias("forecast"))
    cols += [F.col(f"`{src}`").cast("double").alias(dst) for dst, src in shape.bounds]
    if shape.period is not None:
        out = df.select(F.col(f"`{shape.period}`").cast("date").alias(PERIOD), *cols)
    else:
        if shape.ordinal is None or calendar is None:
            raise ValueError("an undated forecast needs an ordinal column and a calendar")
        undated = df.select(F.col(f"`{shape.ordinal}`").cast("int").alias("step"), *cols)
        out = positional_join(undated, calendar, "step", keys).drop("step")
    if shape.additive:
        out = out.groupBy(*keys, PERIOD).agg(F.sum("forecast").alias("forecast"))
        bound_names = []
    if shape.cumulative:
        out = (
            decumulate(out, "forecast", keys)
            if keys
            else _increments(out)
        )
    return out.select(F.lit(shape.model).alias("model"), *keys, PERIOD, "forecast", *bound_names)


def null_periods(df: DataFrame) -> DataFrame:
    """Models whose rows lack a date, with the number of such rows (empty when sound)."""
    return (
        df.groupBy("model")
        .agg(F.count_if(F.col(PERIOD).isNull()).alias("n"))
        .filter(F.col("n") > 0)
    )
