"""Pivots, unpivots, row totals, feature screening and other column-wise shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelcast.functions.exprs import all_of, indicator, is_finite, ratio, total_of
from panelcast.operators.joins import with_period_total
from panelcast.schema import PERIOD, SERIES, STAGES


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in exclude
    ]


def relocate(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def fill_numeric(df: DataFrame, value: float = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """Null → constant on the given (default: all) numeric columns."""
    return df.na.fill(value, subset=list(columns or numeric_columns(df)))


def across(df: DataFrame, columns: Sequence[str], fn, name: str = "{col}") -> DataFrame:
    """Apply one column function to many columns in a single projection."""
    return df.withColumns({name.format(col=c): fn(F.col(c)) for c in columns})


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows where a column is null, NaN or infinite."""
    return df.filter(all_of([is_finite(c) for c in columns or numeric_columns(df)]))


def one_hot(df: DataFrame, column: str, values: dict[str, object]) -> DataFrame:
    """0/1 columns; *values* maps the new column name to the category."""
    return df.withColumns({name: indicator(column, v) for name, v in values.items()})


def screen_features(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Drop feature columns that are all null or constant, fill the rest with 0.

    Returns the table and the kept names; pass them as *keep* to shape a second table
    the same way.  The statistics are one global aggregate with one row of state.
    """
    if keep is None:
        stats = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
        keep = [c for c in columns if stats[c] is not None and stats[c] > 0]
    keep = list(keep)
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, *keep).na.fill(0, subset=keep), keep


def pivot_series(
    df: DataFrame,
    series_values: dict[str, str],
    values: Sequence[str] = STAGES,
    index: Sequence[str] = (PERIOD,),
    fill: float | None = 0,
    how=F.sum,
) -> DataFrame:
    """One row per period, columns ``{value}_{label}``; *series_values* maps series to label.

    Written as conditional aggregates over a known list, so nothing scans the data for
    categories and the map side reduces to one row per period.  *how* resolves
    duplicates; *fill* None keeps absent cells null.
    """
    cells = [
        how(F.when(F.col(SERIES) == s, F.col(v))).alias(f"{v}_{label}")
        for v in values
        for s, label in series_values.items()
    ]
    out = df.groupBy(*index).agg(*cells)
    return out if fill is None else out.na.fill(fill)


def row_totals(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Add ``{prefix}_total``: the sum of all columns that start with ``{prefix}_``."""
    return df.withColumns(
        {
            f"{p}_total": total_of([c for c in df.columns if c.startswith(f"{p}_")])
            for p in prefixes
        }
    )


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def composition_share(
    df: DataFrame, value: str, name: str = "share", on_zero: str = "null"
) -> DataFrame:
    """Each series' share of its period's total."""
    joined = with_period_total(df, value, "_total")
    return joined.withColumn(name, ratio(value, "_total", on_zero)).drop("_total")


def share_of(columns: dict[str, str], total: str, on_zero: str = "plus_one") -> dict[str, Column]:
    """Share columns in wide form: {new name: part column} over one total column."""
    return {name: ratio(c, total, on_zero) for name, c in columns.items()}
