"""Errors, metrics, backtests and the ranked table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.functions.exprs import strict_sum
from panelcast.operators.windows import difference, ordered
from panelcast.schema import PERIOD, SERIES
from panelcast.sources.tables import materialise


def with_errors(df: DataFrame, forecast: str = "forecast", actual: str = "actual") -> DataFrame:
    """Add error, abs_error, sq_error and ape (percent; null where the actual is 0)."""
    error = F.col(forecast) - F.col(actual)
    return df.withColumns(
        {
            "error": error,
            "abs_error": F.abs(error),
            "sq_error": error * error,
            "ape": F.when(
                F.col(actual) != 0, F.try_divide(F.abs(error), F.abs(F.col(actual))) * 100
            ),
        }
    )


def metrics(errors: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Rows, MAE, RMSE, bias and MAPE per key; nulls are skipped, rows are all counted."""
    return errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_forecasts"),
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg("sq_error")).alias("rmse"),
        F.avg("error").alias("bias"),
        F.avg("ape").alias("mape"),
    )


def over_horizon(
    joined: DataFrame,
    keys: Sequence[str] = ("model",),
    forecast: str = "forecast",
    actual: str = "actual",
) -> DataFrame:
    """One row per model: null-strict sums of forecast and actual over the horizon."""
    return joined.groupBy(*keys).agg(
        strict_sum(forecast).alias(forecast), strict_sum(actual).alias(actual)
    )


def leaderboard(scores: DataFrame, by: str = "mae", keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Rank models by a metric inside each scope, nulls last, names break ties."""
    order = Window.partitionBy(*keys).orderBy(F.col(by).asc_nulls_last(), "model")
    return scores.withColumn("rank", F.row_number().over(order))


def accuracy(
    df: DataFrame,
    scale: DataFrame | None = None,
    keys: Sequence[str] = (SERIES,),
    forecast: str = "forecast",
    actual: str = "actual",
) -> DataFrame:
    """Hold-out accuracy: ME, RMSE, MAE, MPE, MAPE and, with *scale*, MASE.

    *scale* holds (keys, mase_scale), see ``mase_scale``.  Errors are actual − forecast.
    """
    e = F.col(actual) - F.col(forecast)
    percent = F.try_divide(e, F.col(actual)) * 100
    out = df.groupBy(*keys).agg(
        F.avg(e).alias("me"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(percent).alias("mpe"),
        F.avg(F.abs(percent)).alias("mape"),
    )
    if scale is None:
        return out
    shared = [k for k in keys if k in scale.columns]
    return (
        out.join(scale, shared, "left")
        .withColumn("mase", F.try_divide("mae", "mase_scale"))
        .drop("mase_scale")
    )


def mase_scale(train: DataFrame, value: str, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Mean absolute one-step difference of the training data."""
    return (
        train.withColumn("_d", F.abs(difference(value, w=ordered(keys))))
        .groupBy(*keys)
        .agg(F.avg("_d").alias("mase_scale"))
    )


def scoreboard(
    forecasts: Sequence[DataFrame],
    actuals: DataFrame,
    common_horizon: bool = False,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Union forecasts, join actuals, score per period and over the horizon, rank.

    *actuals* holds (keys, period, actual).  With *common_horizon* only periods that every
    model forecasts are scored, so that all models are compared on the same rows.
    """
    parts = [f.select("model", *keys, PERIOD, "forecast") for f in forecasts]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if common_horizon:
        stacked = materialise(stacked)  # used three times below
        models = stacked.select(F.count_distinct("model")).scalar()
        shared = (
            stacked.groupBy(*keys, PERIOD)
            .agg(F.count_distinct("model").alias("_m"))
            .filter(F.col("_m") == models)
            .drop("_m")
        )
        stacked = stacked.join(shared, [*keys, PERIOD], "left_semi")
    joined = stacked.join(actuals, [*keys, PERIOD], "left")
    by_period = metrics(with_errors(joined), ("model",)).withColumn("scope", F.lit("period"))
    horizon = metrics(with_errors(over_horizon(joined, ("model", *keys)))).withColumn(
        "scope", F.lit("horizon")
    )
    return leaderboard(by_period.unionByName(horizon))


def backtest(
    folds: DataFrame,
    forecasters: Mapping[str, object],
    value: str,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Score forecasters on rolling-origin folds: metrics per (model, fold).

    *folds* is the long output of ``expanding_folds``.  A forecaster takes the training rows
    and the partition keys (series and fold) and returns (keys, fold, period, forecast);
    all folds of all series run in one job because the fold is just another key.  Every test row counts
    for every model; ``n_missing`` says how many of them a model has no forecast for.  Folds multiply the
    training rows here; where a forecaster can be read off prefix statistics, use ``operators.folds``.
    """
    fold_keys = (*keys, "fold")
    train = folds.filter(F.col("role") == "train")
    test = folds.filter(F.col("role") == "test").select(
        *fold_keys, PERIOD, F.col(value).alias("actual")
    )
    parts = [
        fn(train, fold_keys)
        .select(*fold_keys, PERIOD, "forecast")
        .withColumn("model", F.lit(name))
        for name, fn in forecasters.items()
    ]
    stacked = reduce(DataFrame.unionByName, parts)
    return score_folds(test, stacked, list(forecasters), fold_keys)


def score_folds(tests: DataFrame, stacked: DataFrame, models: Sequence[str], fold_keys: Sequence[str]) -> DataFrame:
    """Metrics per (model, fold), with the number of test rows that a model has no forecast for."""
    asked = tests.withColumn("model", F.explode(F.array(*[F.lit(name) for name in models])))
    joined = asked.join(stacked, [*fold_keys, PERIOD, "model"], "left")
    keys = ["model", "fold"]
    missing = joined.groupBy(*keys).agg(F.count_if(F.col("forecast").isNull()).alias("n_missing"))
    return metrics(with_errors(joined), keys).join(missing, keys)


def metric_columns(digits: int = 6) -> list[Column]:
    """Rounded metric columns for display."""
    return [F.round(c, digits).alias(c) for c in ("mae", "rmse", "bias", "mape")]
