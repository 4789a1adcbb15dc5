"""From event-level facts to one row per (series, period)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.exprs import ColumnLike, _col
from panelcast.schema import PERIOD, SERIES, STAGES


@dataclass(frozen=True)
class Fact:
    """One fact table: how a row maps to a series, a period and amounts per stage.

    A stage maps to a boolean column (rows are counted) or a numeric column (summed).
    """

    table: DataFrame
    series: ColumnLike
    period: Column
    stages: Mapping[str, Column]


def _amount(c: Column, df: DataFrame) -> Column:
    kind = df.select(c.alias("c")).schema["c"].dataType.typeName()
    return F.when(c, 1.0).otherwise(0.0) if kind == "boolean" else c.cast("double")


def build_panel(facts: Sequence[Fact], stages: Sequence[str] = STAGES) -> DataFrame:
    """Count or sum every fact into its (series, period) cell; absent stages are 0.

    Every fact row opens its cell, also one that feeds no stage: such a cell holds zeros.
    A caller that wants fewer cells filters the table.  Each fact table is scanned once
    however many stages it feeds, and all facts meet in a single aggregate: the map side
    collapses every task's rows to one per cell, so a hot series adds cells, not rows, to
    the shuffle.
    """
    parts = []
    for fact in facts:
        rows = fact.table
        parts.append(
            rows.select(
                fact.period.alias(PERIOD),
                _col(fact.series).cast("string").alias(SERIES),
                *[
                    (_amount(fact.stages[s], rows) if s in fact.stages else F.lit(0.0)).alias(s)
                    for s in stages
                ],
            )
        )
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(PERIOD, SERIES)
        .agg(*[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in stages])
    )


def contract_violations(
    df: DataFrame,
    required: Mapping[str, str],
    series: str = SERIES,
    period: str = PERIOD,
    min_periods: int = 1,
) -> DataFrame:
    """One row (check, series, n) per broken rule; an empty result means the panel is sound.

    *required* maps column names to type names.  A column that is absent or of another
    type is reported with series NULL and n = 0.  Rows with a null or unparsable period,
    null stage values, repeated (series, period) keys and short histories are counted
    per series.
    """
    spark = df.sparkSession
    have = {f.name: f.dataType.typeName() for f in df.schema.fields}
    broken = [
        (("missing_column:" if c not in have else "wrong_type:") + c, None, 0)
        for c, kind in required.items()
        if have.get(c) != kind
    ]
    static = spark.createDataFrame(broken, "check string, series string, n long")
    if series not in have or period not in have:
        return static
    stages = [c for c in required if c in have and c not in (series, period)]
    # cells first: a series with a third of all rows is collapsed map-side
    cells = df.groupBy(series, period).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(s).isNull()).alias(f"null_{s}") for s in stages],
    )
    per_series = cells.groupBy(F.col(series).alias("series")).agg(
        F.coalesce(F.sum(F.when(F.col(period).isNull(), F.col("rows"))), F.lit(0)).alias(
            "null_period"
        ),
        F.count_if((F.col("rows") > 1) & F.col(period).isNotNull()).alias("duplicate_key"),
        F.count(period).alias("periods"),
        *[F.sum(f"null_{s}").alias(f"null_{s}") for s in stages],
    )
    checks = {"null_period": F.col("null_period"), "duplicate_key": F.col("duplicate_key")}
    checks |= {f"null_{s}": F.col(f"null_{s}") for s in stages}
    found = [
        F.struct(F.lit(name).alias("check"), n.cast("long").alias("n"), (n > 0).alias("bad"))
        for name, n in checks.items()
    ] + [
        F.struct(
            F.lit("short_history").alias("check"),
            F.col("periods").cast("long").alias("n"),
            (F.col("periods") < min_periods).alias("bad"),
        )
    ]
    return (
        per_series.select(F.col("series").cast("string"), F.inline(F.array(*found)))
        .filter("bad")
        .select("check", "series", "n")
        .unionByName(static)
    )
