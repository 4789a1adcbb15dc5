"""Rolling-origin folds by prefix statistics: every row is read once, whatever the number of folds.

Fold f of a series with n rows trains on its first n − 2F + f − 1 rows, F the number of folds, as in
``expanding_folds``.  The training rows of all folds are prefixes of one another, so a running statistic
over the series, read off at the last training row of each fold (its cut), is that fold's statistic.
Sums are added up between cuts first and then over the cuts, a handful of rows a series.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelcast.operators.calendar import WEEK
from panelcast.operators.evaluate import score_folds
from panelcast.operators.fit import _packed, _weights_of
from panelcast.operators.windows import ordered, whole
from panelcast.schema import PERIOD, SERIES

FOLD = "fold"


@dataclass(frozen=True)
class Folds:
    """A panel with numbered rows: ``_i`` from 1, and ``_base`` so that fold f ends at row _base + f."""

    rows: DataFrame
    value: str
    n_folds: int
    max_horizon: int
    step_days: int
    keys: tuple[str, ...]

    @property
    def fold_keys(self) -> list[str]:
        return [*self.keys, FOLD]

    @property
    def _fold(self) -> Column:
        return (F.col("_i") - F.col("_base")).cast("int")

    def cuts(self, columns: Mapping[str, Column]) -> DataFrame:
        """(keys, fold, period of the cut, t its row number, *columns*): running expressions at the cuts.

        *columns* may be window expressions over rows up to the current one.
        """
        rows = self.rows.withColumns(dict(columns))
        return rows.filter(self._fold.between(1, self.n_folds)).select(
            *self.keys, self._fold.alias(FOLD), PERIOD, F.col("_i").alias("t"), *columns
        )

    def sums(self, columns: Mapping[str, Column]) -> DataFrame:
        """(keys, fold, n, *columns*): sums of expressions over each fold's training rows.

        Rows are added up by the first fold that trains on them, those few sums along the folds.
        """
        own = F.greatest(F.lit(1), F.lit(1) - F.col("_base"), self._fold)
        parts = self.rows.filter(F.col("_i") <= F.col("_base") + self.n_folds).withColumn(FOLD, own.cast("int"))
        parts = parts.groupBy(*self.fold_keys).agg(
            F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in columns.items()]
        )
        along = Window.partitionBy(*self.keys).orderBy(FOLD).rowsBetween(Window.unboundedPreceding, 0)
        return parts.select(*self.fold_keys, *[F.sum(c).over(along).alias(c) for c in ("n", *columns)])

    def tests(self) -> DataFrame:
        """(keys, fold, period, actual) of the rows after each cut, *max_horizon* at most."""
        fold = F.explode(F.sequence(F.greatest(F.lit(1), F.lit(1) - F.col("_base")), F.lit(self.n_folds)))
        late = self.rows.filter((F.col("_i") > F.col("_base") + 1) & (F.col("_base") + self.n_folds >= 1))
        late = late.withColumn(FOLD, fold)
        after = F.col("_i") - F.col("_base") - F.col(FOLD)
        return late.filter(after.between(1, self.max_horizon)).select(*self.fold_keys, PERIOD, F.col(self.value).alias("actual"))

    def over_horizon(self, cuts: DataFrame, forecast: Callable[[Column], Column]) -> DataFrame:
        """(keys, fold, period, forecast) for the steps after each row of *cuts*."""
        steps = cuts.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(self.max_horizon))))
        return steps.select(
            *self.fold_keys, F.date_add(PERIOD, F.col("h") * self.step_days).alias(PERIOD), forecast(F.col("h")).alias("forecast")
        )


def fold_panel(
    df: DataFrame,
    value: str,
    n_folds: int = 4,
    max_horizon: int = 13,
    step_days: int = WEEK,
    keys: Sequence[str] = (SERIES,),
) -> Folds:
    """Number the rows of *df* for rolling-origin folds.  A series too short for a fold has none of it."""
    n = F.count(F.lit(1)).over(whole(keys))
    rows = df.withColumns({"_i": F.row_number().over(ordered(keys)), "_base": (n - 2 * n_folds - 1).cast("int")})
    return Folds(rows, value, n_folds, max_horizon, step_days, tuple(keys))


# --- forecasters ---------------------------------------------------------------


def last_value(folds: Folds) -> DataFrame:
    return folds.over_horizon(folds.cuts({"_y": F.col(folds.value)}), lambda h: F.col("_y"))


def recent_mean(folds: Folds, n: int = 4) -> DataFrame:
    """Mean of the last *n* training rows."""
    mean = F.avg(folds.value).over(ordered(folds.keys).rowsBetween(1 - n, 0))
    return folds.over_horizon(folds.cuts({"_y": mean}), lambda h: F.col("_y"))


def trend_line(folds: Folds) -> DataFrame:
    """Straight line through the training rows, from its running sums."""
    t, y = F.col("_i").cast("double"), F.col(folds.value)
    known = y.isNotNull()
    sums = folds.sums(
        {
            "_m": F.when(known, 1.0),
            "_t": F.when(known, t),
            "_tt": F.when(known, t * t),
            "_y": y,
            "_ty": t * y,
        }
    )
    m = F.col("_m")
    spread = m * F.col("_tt") - F.col("_t") * F.col("_t")
    # one row, or one place: the mean
    slope = F.when(spread > 0, (m * F.col("_ty") - F.col("_t") * F.col("_y")) / spread).otherwise(F.lit(0.0))
    line = sums.withColumn("_b", slope).withColumn("_a", F.try_divide(F.col("_y") - F.col("_b") * F.col("_t"), m))
    cuts = folds.cuts({}).join(line.select(*folds.fold_keys, "_a", "_b"), folds.fold_keys)
    return folds.over_horizon(cuts, lambda h: F.col("_a") + F.col("_b") * (F.col("t") + h))


_LEVELS = T.ArrayType(T.DoubleType())


def smoothing(folds: Folds, alphas: Sequence[float]) -> DataFrame:
    """Exponential smoothing: the recursion runs once over a series and is read at each cut.

    For each fold the α of the least squared one-step error up to its cut (ties: the smaller one).
    """
    grid = np.array(sorted(float(a) for a in alphas))
    n_folds = folds.n_folds

    @F.pandas_udf(_LEVELS)
    def levels(ys: pd.Series) -> pd.Series:
        out = []
        for y in ys:
            n, level = len(y), np.full(len(grid), y[0])
            sse, found = np.zeros(len(grid)), [None] * n_folds
            first = n - 2 * n_folds  # training rows of the first fold
            for t, v in enumerate(y):
                if t:
                    e = v - level
                    sse += e * e
                    level = level + grid * e
                if 0 <= t + 1 - first < n_folds:
                    found[t + 1 - first] = float(level[sse.argmin()])
            out.append(found)
        return pd.Series(out)

    packed = _packed(folds.rows, folds.value, folds.keys).withColumn("_l", levels("_y"))
    at = packed.select(*folds.keys, F.posexplode("_l").alias("_f", "_y")).select(*folds.keys, (F.col("_f") + 1).alias(FOLD), "_y")
    cuts = folds.cuts({}).join(at, folds.fold_keys, "left")
    return folds.over_horizon(cuts, lambda h: F.col("_y"))


def delay_weights(folds: Folds, upstream: str, max_lag: int = 6, cap: float | None = 1.0, min_extra: int = 4) -> DataFrame:
    """Delay weights of *upstream* on the value, fitted to each fold's training rows: (keys, fold, n, weights, …)."""
    w = ordered(folds.keys)
    zero = F.lit(0.0)
    lagged = folds.rows.withColumns({f"_x{k}": F.lag(upstream, k).over(w) if k else F.col(upstream) for k in range(max_lag + 1)})
    # complete lags only; zero elsewhere, so that products are plain sums
    full = F.col("_i") > max_lag
    rows = lagged.withColumns({f"_x{k}": F.when(full, F.coalesce(F.col(f"_x{k}"), zero)).otherwise(zero) for k in range(max_lag + 1)})
    y = F.coalesce(F.col(folds.value), zero)
    pairs = [(i, j) for i in range(max_lag + 1) for j in range(i, max_lag + 1)]
    products = {f"_g{i}_{j}": F.col(f"_x{i}") * F.col(f"_x{j}") for i, j in pairs}
    products |= {f"_r{k}": F.col(f"_x{k}") * y for k in range(max_lag + 1)} | {"_sx": F.col(upstream), "_sy": F.col(folds.value)}
    sums = Folds(rows, folds.value, folds.n_folds, folds.max_horizon, folds.step_days, folds.keys).sums(products)
    stats = sums.select(
        *folds.fold_keys,
        "n",
        "_sx",
        "_sy",
        F.array(*[F.col(f"_g{i}_{j}") for i, j in pairs]).alias("_gram"),
        F.array(*[F.col(f"_r{k}") for k in range(max_lag + 1)]).alias("_rhs"),
    )
    return _weights_of(stats, max_lag, cap, min_extra, False, folds.fold_keys)


def convolution(folds: Folds, upstream: str, max_lag: int = 6, n_recent: int = 4) -> DataFrame:
    """Upstream values through each fold's own delay weights; the future has the mean of the last rows."""
    w = ordered(folds.keys)
    weights = delay_weights(folds, upstream, max_lag)
    past = F.array(*[F.coalesce(F.lag(upstream, k).over(w), F.lit(0.0)) if k else F.col(upstream) for k in range(max_lag + 1)])
    ahead = F.avg(upstream).over(w.rowsBetween(1 - n_recent, 0))
    cuts = folds.cuts({"_past": past, "_ahead": ahead}).join(weights.select(*folds.fold_keys, "weights"), folds.fold_keys, "left")

    def value(h: Column) -> Column:
        terms = F.transform(
            "weights", lambda v, k: v * F.when(k < h, F.col("_ahead")).otherwise(F.get("_past", (k - h).cast("int")))
        )
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    return folds.over_horizon(cuts, value)


def prefix_backtest(folds: Folds, forecasters: Mapping[str, Callable[[Folds], DataFrame]]) -> DataFrame:
    """Metrics per (model, fold).  Every test row counts for every model: a forecast that a model does not
    give is a missing error of a counted row, and ``n_missing`` says how many there are."""
    parts = [fn(folds).select(*folds.fold_keys, PERIOD, "forecast").withColumn("model", F.lit(name)) for name, fn in forecasters.items()]
    stacked = reduce(DataFrame.unionByName, parts)
    return score_folds(folds.tests(), stacked, list(forecasters), folds.fold_keys)
