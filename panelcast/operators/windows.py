"""Window features per series, all over ``partitionBy(series).orderBy(period)``.

Build several of them in one ``withColumns``: features with the same partitioning share
one exchange and one sort.  Rows are periods, so a partition is at most the calendar.

Lags count rows, which is right on a dense panel.  With *step_days* they count periods of the calendar
instead: a frame over day numbers finds the row exactly k steps before, and a missing period is a
missing lag.  That needs no densified panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from panelcast.functions.exprs import ColumnLike, _col, ratio
from panelcast.schema import PERIOD, SERIES


def ordered(keys: Sequence[str] = (SERIES,), by: str = PERIOD) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def whole(keys: Sequence[str] = (SERIES,)) -> WindowSpec:
    return Window.partitionBy(*keys)


def by_day(keys: Sequence[str] = (SERIES,)) -> WindowSpec:
    """Rows of a series by day number, for frames that count days."""
    return Window.partitionBy(*keys).orderBy(F.unix_date(PERIOD))


def at_lag(c: ColumnLike, k: int, step_days: int, keys: Sequence[str] = (SERIES,)) -> Column:
    """The value exactly *k* steps of the calendar before (after, if negative); null where there is no row."""
    return F.max(_col(c)).over(by_day(keys).rangeBetween(-k * step_days, -k * step_days))


def lag_columns(
    columns: Sequence[str],
    lags: Sequence[int],
    name: str = "{col}_lag{k}",
    w: WindowSpec | None = None,
    step_days: int | None = None,
) -> dict[str, Column]:
    """Lags of many columns; *name* may use {col} and {k}."""
    w = w or ordered()
    lag = (lambda c, k: at_lag(c, k, step_days)) if step_days else (lambda c, k: F.lag(c, k).over(w))
    return {name.format(col=c, k=k): lag(c, k) for c in columns for k in lags}


def lag_or(
    c: ColumnLike, k: int, default: ColumnLike | float, w: WindowSpec | None = None, step_days: int | None = None
) -> Column:
    """Lag with a default for the first k rows or periods only (a stored null stays null)."""
    w = w or ordered()
    d = F.lit(default) if isinstance(default, (int, float)) else _col(default)
    if step_days:
        age = F.unix_date(PERIOD) - F.min(F.unix_date(PERIOD)).over(whole())
        return F.when(age < k * step_days, d).otherwise(at_lag(c, k, step_days))
    return F.when(F.row_number().over(w) <= k, d).otherwise(F.lag(_col(c), k).over(w))


def series_mean(c: ColumnLike, keys: Sequence[str] = (SERIES,)) -> Column:
    return F.avg(_col(c)).over(whole(keys))


def lead(c: ColumnLike, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(_col(c), k).over(w or ordered())


def difference(c: ColumnLike, k: int = 1, w: WindowSpec | None = None, step_days: int | None = None) -> Column:
    c = _col(c)
    return c - (at_lag(c, k, step_days) if step_days else F.lag(c, k).over(w or ordered()))


def growth(c: ColumnLike, w: WindowSpec | None = None, step_days: int | None = None) -> Column:
    """Relative change; 0 where the previous value is not positive, null where there is none."""
    c = _col(c)
    previous = at_lag(c, 1, step_days) if step_days else F.lag(c).over(w or ordered())
    return ratio(c - previous, previous, "zero")


def running_total(c: ColumnLike, w: WindowSpec | None = None) -> Column:
    w = (w or ordered()).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(_col(c)).over(w)


def backlog(inflow: ColumnLike, outflow: ColumnLike, w: WindowSpec | None = None) -> Column:
    """Running inflow minus running outflow, nulls counted as 0."""
    zero = F.lit(0.0)
    return running_total(F.coalesce(_col(inflow), zero) - F.coalesce(_col(outflow), zero), w)


def with_stock(
    df: DataFrame, inflow: str, outflow: str, prefix: str, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Stock that never goes below zero, with the smallest opening balance that ensures it.

    Adds ``{prefix}_start``, ``{prefix}_end`` and ``{prefix}_available`` (start + inflow).
    """
    w = ordered(keys)
    return (
        df.withColumn("_balance", running_total(F.col(inflow) - F.col(outflow), w))
        .withColumn(
            "_opening", F.greatest(F.lit(0.0), -F.min("_balance").over(whole(keys)))
        )
        .withColumn(f"{prefix}_end", F.col("_opening") + F.col("_balance"))
        .withColumn(
            f"{prefix}_start", F.col(f"{prefix}_end") - F.col(inflow) + F.col(outflow)
        )
        .withColumn(f"{prefix}_available", F.col(f"{prefix}_start") + F.col(inflow))
        .drop("_balance", "_opening")
    )


def rolling(
    c: ColumnLike,
    n: int,
    how=F.avg,
    complete: bool = False,
    w: WindowSpec | None = None,
    step_days: int | None = None,
) -> Column:
    """Aggregate of the last n rows or periods; with *complete*, null unless they hold n values."""
    c = _col(c)
    if step_days:
        frame = by_day().rangeBetween(-(n - 1) * step_days, 0)
    else:
        frame = (w or ordered()).rowsBetween(-(n - 1), 0)
    out = how(c).over(frame)
    return F.when(F.count(c).over(frame) == n, out) if complete else out


def rolling_centred(
    c: ColumnLike, n: int = 3, w: WindowSpec | None = None, step_days: int | None = None
) -> Column:
    """Mean over n rows or periods around the row (n odd), null where one of them is missing."""
    c, half = _col(c), n // 2
    if step_days:
        frame = by_day().rangeBetween(-half * step_days, half * step_days)
    else:
        frame = (w or ordered()).rowsBetween(-half, half)
    return F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))


def interpolate(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Linear interpolation of inner gaps by row distance; leading and trailing nulls stay."""
    w = ordered(keys)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # "first known value ahead" as a running last in reverse order: linear, where a frame
    # to unboundedFollowing would rescan the rest of the partition for every row
    ahead = (
        Window.partitionBy(*keys)
        .orderBy(F.col(PERIOD).desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    df = df.withColumn("_i", F.row_number().over(w))
    known = {c: F.when(F.col(c).isNotNull(), F.struct("_i", F.col(c).alias("v"))) for c in columns}
    df = df.withColumns(
        {f"_{c}_a": F.last(known[c], ignorenulls=True).over(back) for c in columns}
        | {f"_{c}_b": F.last(known[c], ignorenulls=True).over(ahead) for c in columns}
    )

    def filled(c: str) -> Column:
        a, b = F.col(f"_{c}_a"), F.col(f"_{c}_b")
        slope = F.try_divide(b["v"] - a["v"], b["_i"] - a["_i"])
        return F.coalesce(F.col(c), a["v"] + (F.col("_i") - a["_i"]) * slope)

    helpers = ["_i", *[f"_{c}_{s}" for c in columns for s in "ab"]]
    return df.withColumns({c: filled(c) for c in columns}).drop(*helpers)


def forward_fill(c: ColumnLike, w: WindowSpec | None = None) -> Column:
    w = (w or ordered()).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(_col(c), ignorenulls=True).over(w)


def decumulate(df: DataFrame, value: str, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Running totals back to increments; the first value stays."""
    return df.withColumn(value, F.col(value) - lag_or(value, 1, 0.0, ordered(keys)))


def lag_composite(c: ColumnLike, weights: dict[int, float], w: WindowSpec | None = None) -> Column:
    """Σ weight · lag_k; null while any of the lags is missing."""
    w = w or ordered()
    terms = [F.lag(_col(c), k).over(w) * F.lit(float(x)) for k, x in weights.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def lag_composite_or_mean(
    c: ColumnLike, weights: dict[int, float], keys: Sequence[str] = (SERIES,)
) -> Column:
    """The same composite where a missing lag takes the series mean."""
    out = F.lit(0.0)
    for k, x in weights.items():
        out = out + lag_or(c, k, series_mean(c, keys), ordered(keys)) * F.lit(float(x))
    return out


def trend(w: WindowSpec | None = None) -> Column:
    return F.row_number().over(w or ordered())


def conversion(num: ColumnLike, den: ColumnLike, k: int, w: WindowSpec | None = None) -> Column:
    """num_t / den_{t−k}, null where the denominator is not positive."""
    return ratio(num, F.lag(_col(den), k).over(w or ordered()))


def recent_level(
    df: DataFrame,
    columns: Sequence[str],
    n: int = 4,
    how: str = "mean",
    keys: Sequence[str] = (SERIES,),
    step_days: int | None = None,
) -> DataFrame:
    """Per series: mean or median of the last n rows or periods, or the last value, of each column."""
    if how == "last":
        newest = F.max_by(F.struct(*columns), PERIOD).alias("s")
        return df.groupBy(*keys).agg(newest).select(*keys, "s.*")
    fn = {"mean": F.avg, "median": F.median}[how]
    if step_days:
        late = F.col(PERIOD) > F.date_sub(F.max(PERIOD).over(whole(keys)), n * step_days)
        return df.withColumn("_late", late).filter("_late").groupBy(*keys).agg(*[fn(c).alias(c) for c in columns])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(PERIOD).desc()))
    return (
        df.withColumn("_rank", rank)
        .filter(F.col("_rank") <= n)
        .groupBy(*keys)
        .agg(*[fn(c).alias(c) for c in columns])
    )


def first_rows(
    df: DataFrame, n: int, by: Sequence[Column | str], keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """The first n rows of each group in the given order.

    Spark turns the rank filter into a per-task group limit below the shuffle, so a hot
    group sends n rows per task, not all of them.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def stack(tables: dict[str, DataFrame], label: str = "type") -> DataFrame:
    """Union by name (absent columns null) with the table's name in *label*."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
