"""Week numbering and period arithmetic on dates (integer arithmetic, no time zones)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.functions.exprs import ColumnLike, _col


def monday(c: ColumnLike) -> Column:
    """Monday on or before the date."""
    d = F.to_date(_col(c))
    return F.date_sub(d, F.weekday(d))


def day(c: ColumnLike) -> Column:
    return F.to_date(_col(c))


def simple_week(c: ColumnLike) -> Column:
    """Complete seven-day blocks since 1 January, plus one (1..53)."""
    return (F.floor((F.dayofyear(_col(c)) - 1) / 7) + 1).cast("int")


def sunday_week(c: ColumnLike) -> Column:
    """Week of the year counted from the first Sunday (0..53)."""
    c = _col(c)
    return F.floor((F.dayofyear(c) - 1 + 7 - (F.dayofweek(c) - 1)) / 7).cast("int")


def iso_week(c: ColumnLike) -> Column:
    return F.weekofyear(_col(c))


def iso_year(c: ColumnLike) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _col(c))


def week_index(c: ColumnLike, base_year: int) -> Column:
    """Week number that runs on across years; 31 December (week 53) shares the next year's week 1."""
    c = _col(c)
    return (simple_week(c) + 52 * (F.year(c) - base_year)).cast("int")


def week_start(index: ColumnLike, anchor: dt.date) -> Column:
    """Date of week *index* when week 1 starts on *anchor*."""
    return F.date_add(F.lit(anchor), ((_col(index) - 1) * 7).cast("int"))
