"""Sums and lag products of a zero-filled calendar, taken from its non-zero cells alone.

A panel whose cells are mostly absent has lag products Σ_t x_{t−i}·y_{t−j} with few terms: only pairs
of stored cells at most the longest lag apart give any.  A range window finds for each stored cell the
earlier ones it can meet, zero cells count in closed form, and so do the sums of a trend.  The empty
cells of the calendar are never made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.operators.calendar import WEEK
from panelcast.schema import PERIOD, SERIES

#: A regressor: a column at a lag.
Term = tuple[str, int]


def _total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def cell_pairs(
    cells: DataFrame, columns: Sequence[str], reach: int, low: Column, step_days: int = WEEK, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Each stored cell with itself and every earlier one of its key at most *reach* steps before.

    (keys, _at place in the calendar, _d distance, the later cell's columns, and the earlier one's as
    ``_e_`` columns).  A cell meets at most reach + 1 others, whatever the length of the series.
    """
    place = (F.datediff(PERIOD, low) / step_days).cast("int")
    stored = cells.select(*keys, place.alias("_at"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    before = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-reach, 0)
    met = stored.withColumn("_e", F.collect_list(F.struct("_at", *columns)).over(before)).withColumn("_e", F.explode("_e"))
    return met.select(*keys, "_at", (F.col("_at") - F.col("_e._at")).alias("_d"), *columns, *[F.col(f"_e.{c}").alias(f"_e_{c}") for c in columns])


def lag_products(
    cells: DataFrame,
    terms: Sequence[Term],
    low: Column,
    high: Column,
    trend: bool = False,
    first: int | None = None,
    step_days: int = WEEK,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Sums and products of *terms* over the calendar from *low* to *high*: (keys, n, _t{i}, _p{i}_{j}, totals).

    Row t of the calendar counts if all its lags are inside it (or from row *first* on).  With *trend* the
    row number, from 1, is one more term after the others.  ``_all_{column}`` is a column's sum over the
    whole calendar, ``rows`` the length of the calendar.  One exchange by key.
    """
    reach = max(k for _, k in terms)
    start = reach if first is None else first
    columns = list(dict.fromkeys(c for c, _ in terms))
    rows = (F.datediff(high, low) / step_days).cast("int") + 1
    pairs = cell_pairs(cells, columns, reach, low, step_days, keys).withColumn("_rows", rows)
    at, d, own = F.col("_at"), F.col("_d"), F.col("_d") == 0

    def counts(lag: int) -> Column:
        """Whether the later cell, at this lag, falls on a row that counts."""
        return (at + lag >= start) & (at + lag < F.col("_rows"))

    sums = {}
    for i, (a, k) in enumerate(terms):
        sums[f"_t{i}"] = _total(F.when(own & counts(k), F.col(a)))
        for j, (b, m) in enumerate(terms[i:], start=i):
            later, earlier = ((a, k), b) if k <= m else ((b, m), a)
            product = F.col(later[0]) * F.col(f"_e_{earlier}")
            sums[f"_p{i}_{j}"] = _total(F.when((d == abs(k - m)) & counts(later[1]), product))
        if trend:
            sums[f"_p{i}_{len(terms)}"] = _total(F.when(own & counts(k), F.col(a) * (at + k + 1)))
    whole = {f"_all_{c}": _total(F.when(own, F.col(c))) for c in columns}
    out = pairs.groupBy(*keys).agg(F.first("_rows").alias("rows"), *[x.alias(n) for n, x in (sums | whole).items()])
    out = out.withColumn("n", F.greatest(F.lit(0), F.col("rows") - start).cast("long"))
    if trend:  # sums of the row numbers start + 1 … rows and of their squares
        r, s, q = F.col("rows").cast("double"), float(start), len(terms)
        squares = (r * (r + 1) * (2 * r + 1) - s * (s + 1) * (2 * s + 1)) / 6
        out = out.withColumns({f"_t{q}": (r * (r + 1) - s * (s + 1)) / 2, f"_p{q}_{q}": squares})
    return out


def centred(products: DataFrame, p: int, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Means ``_m{i}`` and covariances ``_s{i}_{j}`` of the first *p* terms of ``lag_products``.

    Sums of whole numbers are exact, so the difference n·Σxy − Σx·Σy is taken before the division.
    """
    n = F.col("n").cast("double")
    means = [F.try_divide(F.col(f"_t{i}"), n).alias(f"_m{i}") for i in range(p)]
    cross = [
        F.try_divide(n * F.col(f"_p{i}_{j}") - F.col(f"_t{i}") * F.col(f"_t{j}"), n * n).alias(f"_s{i}_{j}")
        for i in range(p)
        for j in range(i, p)
    ]
    return products.select(*keys, "n", *means, *cross)
