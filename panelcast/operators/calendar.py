"""Calendars, grids, gap filling and train/test splits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.schema import PERIOD, SERIES, STAGES

WEEK = 7
DAY = 1
#: Cells of the calendar that one task makes, about; a sort of them takes some 100 MB.
TASK_CELLS = 1_000_000


def _every(step_days: int) -> Column:
    return F.expr(f"interval {int(step_days)} days")


def _newest_first(keys: Sequence[str], period: str = PERIOD):
    return Window.partitionBy(*keys).orderBy(F.col(period).desc())


def _oldest_first(keys: Sequence[str], period: str = PERIOD):
    return Window.partitionBy(*keys).orderBy(period)


# --- grids ------------------------------------------------------------------


def _range(df: DataFrame, since: dt.date | None, until: dt.date | None) -> tuple[Column, Column]:
    """First and last period as columns: the given dates or scalar subqueries."""
    low = F.lit(since) if since is not None else df.select(F.min(PERIOD)).scalar()
    high = F.lit(until) if until is not None else df.select(F.max(PERIOD)).scalar()
    return low, high


def period_grid(
    df: DataFrame,
    step_days: int = WEEK,
    keys: Sequence[str] = (SERIES,),
    since: dt.date | None = None,
    until: dt.date | None = None,
) -> DataFrame:
    """Every key combination × every period of the global range.

    The range enters as two scalar subqueries, so no join is needed: each key row
    explodes its own sequence.
    """
    low, high = _range(df, since, until)
    return (
        df.select(*keys)
        .distinct()
        .select(*keys, F.explode(F.sequence(low, high, _every(step_days))).alias(PERIOD))
    )


def _fill_between(
    df: DataFrame,
    start: Column,
    end: Column,
    step_days: int,
    values: Sequence[str],
    fill: float | None,
) -> DataFrame:
    out = (
        df.withColumns({"_from": start, "_to": end})
        .withColumn("_cell", F.explode(F.sequence("_from", "_to", _every(step_days))))
        .select(
            SERIES,
            F.col("_cell").alias(PERIOD),
            *[F.when(F.col("_cell") == F.col(PERIOD), F.col(v)).alias(v) for v in values],
        )
    )
    return out if fill is None else out.na.fill(fill, subset=list(values))


def _on_grid(period: Column, origin: Column, step_days: int) -> Column:
    """The period itself; an error where it is not a whole number of steps from *origin*."""
    off = F.pmod(F.datediff(period, origin), F.lit(step_days)) != 0
    return F.when(off, F.raise_error(F.lit("period off the calendar grid")).cast("date")).otherwise(
        period
    )


def merge_cells(df: DataFrame, values: Sequence[str] = STAGES) -> DataFrame:
    """Sum repeated (series, period) rows; the map side shrinks them before the shuffle."""
    return df.groupBy(SERIES, PERIOD).agg(*[F.sum(v).alias(v) for v in values])


def _dealt(df: DataFrame, step_days: int, since: dt.date | None, until: dt.date | None) -> DataFrame:
    """*df* by series over enough tasks for its dense calendar.

    The stored cells say little about that: the adaptive planner would put all series whose cells
    are small together into one task, however long their calendar.  A small calendar is left to it.
    """
    low, high = F.min(PERIOD), F.max(PERIOD)
    low = low if since is None else F.least(F.lit(since), low)
    high = high if until is None else F.greatest(F.lit(until), high)
    # null is a series like others
    series = F.approx_count_distinct(SERIES) + 1
    cells = df.agg((series * (F.floor(F.datediff(high, low) / step_days) + 1)).alias("n")).first()["n"] or 0
    if cells <= TASK_CELLS:
        return df
    tasks = max(-(-cells // TASK_CELLS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, SERIES)


def densify(
    df: DataFrame,
    step_days: int = WEEK,
    values: Sequence[str] = STAGES,
    fill: float | None = None,
    since: dt.date | None = None,
    until: dt.date | None = None,
) -> DataFrame:
    """One row per series and period of the global range; absent cells are null or *fill*.

    Expects one row per cell (see ``merge_cells``).  The number of series and, without *since*
    and *until*, the range are read from the data first, so pass a written panel rather than
    one that would aggregate its facts twice.  Each row explodes the gap up to the
    next row, the first and last one reach to the ends of the range, which come in as
    scalar subqueries: one exchange by series, which every later per-series window
    reuses, and no grid join.  The exchange has a task for each TASK_CELLS cells of the dense
    calendar, so what is sorted or collected of them in a task stays the same at any size.
    """
    low, high = _range(df, since, until)
    df = _dealt(df, step_days, since, until)
    w = _oldest_first((SERIES,))
    own = _on_grid(F.col(PERIOD), low, step_days)
    start = F.when(F.lag(PERIOD).over(w).isNull(), F.least(low, own)).otherwise(own)
    end = F.coalesce(F.date_sub(F.lead(PERIOD).over(w), step_days), F.greatest(high, own))
    return _fill_between(df, start, end, step_days, values, fill)


def densify_within(
    df: DataFrame,
    step_days: int = WEEK,
    values: Sequence[str] = STAGES,
    fill: float | None = None,
) -> DataFrame:
    """Fill gaps between each series' own first and last period (same plan as ``densify``)."""
    w = _oldest_first((SERIES,))
    own = _on_grid(F.col(PERIOD), F.coalesce(F.lag(PERIOD).over(w), F.col(PERIOD)), step_days)
    end = F.coalesce(F.date_sub(F.lead(PERIOD).over(w), step_days), own)
    return _fill_between(df, own, end, step_days, values, fill)


def horizon(
    df: DataFrame, h: int, step_days: int = WEEK, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """The next *h* periods after each key's last one: (keys, h, period)."""
    last = df.groupBy(*keys).agg(F.max(PERIOD).alias("_last"))
    return last.select(
        *keys, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("h"), "_last"
    ).select(*keys, "h", F.date_add("_last", F.col("h") * step_days).alias(PERIOD))


# --- splits -----------------------------------------------------------------


def split_at(df: DataFrame, cutoff: dt.date) -> tuple[DataFrame, DataFrame]:
    """Rows up to and including *cutoff*, and rows after it."""
    return df.filter(F.col(PERIOD) <= F.lit(cutoff)), df.filter(F.col(PERIOD) > F.lit(cutoff))


def hold_out_last(df: DataFrame, n: int, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Label the last *n* periods of each series ``test`` and the rest ``train``."""
    rank = F.row_number().over(_newest_first(keys))
    return df.withColumn("role", F.when(rank <= n, "test").otherwise("train"))


def hold_out_fraction(
    df: DataFrame, train_share: float = 0.8, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Label the first share of each series' rows ``train`` (count rounded half-even)."""
    rank = F.row_number().over(_oldest_first(keys))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn(
        "role", F.when(rank <= F.bround(F.lit(train_share) * n), "train").otherwise("test")
    )


def recent(df: DataFrame, n: int, keys: Sequence[str] = (SERIES,), step_days: int | None = None) -> DataFrame:
    """Only the last *n* rows of each series or, with *step_days*, those of its last *n* periods."""
    if step_days:
        last = F.max(PERIOD).over(Window.partitionBy(*keys))
        return df.withColumn("_from", F.date_sub(last, n * step_days)).filter(F.col(PERIOD) > F.col("_from")).drop("_from")
    return (
        df.withColumn("_rank", F.row_number().over(_newest_first(keys)))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def expanding_folds(
    df: DataFrame, n_folds: int = 4, max_horizon: int = 13, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Rolling-origin folds in long form (fold, role, rows).

    With n rows in a series, fold f trains on the first ``n - 2·n_folds + f - 1`` rows
    and tests on the next rows, at most *max_horizon* of them.  A row joins every fold
    it takes part in by exploding its own range of fold numbers.
    """
    i = F.row_number().over(_oldest_first(keys))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    numbered = df.withColumn("_i", i).withColumn("_base", n - 2 * n_folds - 1)
    train_end = F.col("_base") + F.col("fold")
    return (
        numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
        .filter((train_end > 0) & (F.col("_i") <= train_end + max_horizon))
        .withColumn("role", F.when(F.col("_i") <= train_end, "train").otherwise("test"))
        .drop("_i", "_base")
    )
