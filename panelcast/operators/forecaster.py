"""One forecaster from end to end: fitted delays, a cascade over the horizon, resampled errors, coherent totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.aggregate import TOTAL
from panelcast.operators.calendar import WEEK
from panelcast.operators.fit import fit_delay_weights
from panelcast.operators.paths import OUTER, bootstrap_paths, summarise_paths, total_paths
from panelcast.operators.project import cascade, convolve, extend
from panelcast.operators.windows import ordered, rolling
from panelcast.schema import PERIOD, SERIES, STAGES
from panelcast.sources.tables import materialise


def delay_paths(
    history: DataFrame,
    h: int,
    max_lags: tuple[int, int],
    n_recent: int,
    n_sims: int,
    seed: int,
    stages: Sequence[str] = STAGES,
    step_days: int = WEEK,
) -> DataFrame:
    """Simulated values of the last stage over the horizon: (series, sim, h, period, value).

    *history* is a dense panel, best a written one, as it is read several times.  Stage 1 goes on with the
    mean of its last *n_recent* rows.  Stage 2 follows from stage 1 and stage 3 from stage 2 by delay
    weights fitted to history; a path adds to each step an error of stage 3 on history, drawn with
    *seed*.  A series without signal has weights of 0, so its paths are its own errors.
    """
    a, b, c = stages
    first = fit_delay_weights(history, a, b, max_lags[0]).select(SERIES, "weights")
    second = materialise(fit_delay_weights(history, b, c, max_lags[1]).select(SERIES, "weights"))
    rows = extend(history, h, {a: rolling(a, n_recent)}, step_days)
    forecast = cascade(rows, first, second, max_lags, tuple(stages)).filter(F.col("h") > 0)
    forecast = forecast.select(SERIES, "h", PERIOD, F.col(c).alias("forecast"))
    fitted = convolve(history, second, b, max_lags[1], "_fit").withColumn("_i", F.row_number().over(ordered()))
    residuals = fitted.filter(F.col("_i") > max_lags[1]).select(SERIES, PERIOD, (F.col(c) - F.col("_fit")).alias("residual"))
    return bootstrap_paths(forecast, residuals, n_sims, seed)


def delay_forecast(paths: DataFrame, probs: dict[str, float] = OUTER) -> DataFrame:
    """Mean and quantiles of ``delay_paths`` by series and period, and of their sums over all series."""
    own = summarise_paths(paths, probs)
    total = summarise_paths(total_paths(paths), probs, keys=(PERIOD,)).withColumn(SERIES, F.lit(TOTAL))
    return own.unionByName(total)
