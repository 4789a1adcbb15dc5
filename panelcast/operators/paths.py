"""Ensembles of paths as long tables (series, sim, period, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.aggregate import exact_quantiles, group_quantiles
from panelcast.operators.project import stock_flow
from panelcast.schema import PERIOD, SERIES

# Usual quantile sets.
OUTER = {"q05": 0.05, "q20": 0.20, "q80": 0.80, "q95": 0.95}
TAILS = {"lo95": 0.025, "lo80": 0.10, "median": 0.50, "hi80": 0.90, "hi95": 0.975}
FIVE = {"p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}


def draw(series: Column, sim: Column, h: Column, seed: int, n: Column) -> Column:
    """Pseudo-random index 0..n−1: the leading 60 bits of md5 of the text ``series|sim|h|seed``, modulo n.

    A counter-based draw: it depends on the key values only, so it is the same for any partitioning and
    after a lost task is run again, and any engine with md5 can replay it; ``rand()`` is neither.
    """
    key = F.concat_ws("|", series, sim.cast("string"), h.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % n


def _pool(values: DataFrame, column: str, name: str) -> DataFrame:
    """(series, *name*): a series' values in time order, one entry per period, so bounded by the calendar."""
    entries = F.sort_array(F.collect_list(F.struct(PERIOD, F.col(column).alias("r"))))
    packed = values.filter(F.col(column).isNotNull()).groupBy(SERIES).agg(entries.alias("_p"))
    return packed.select(SERIES, F.transform("_p", lambda s: s["r"]).alias(name))


def bootstrap_paths(
    forecast: DataFrame,
    residuals: DataFrame,
    n_sims: int,
    seed: int = 1,
    mode: str = "add",
    residual: str = "residual",
    blocks: int = 1,
    fallback: DataFrame | None = None,
    min_residuals: int = 1,
) -> DataFrame:
    """Resample residuals around a point forecast: (series, sim, h, period, value ≥ 0).

    *mode* add: point + residual; multiply: point · exp(residual); level: the drawn value
    itself (use recent levels as *residuals*).  A series' residuals travel as one array
    and each path row picks from it: the big table, series × sims × steps, is made by explode
    and never shuffled.  A series with fewer than *min_residuals* draws whole values from its pool in
    *fallback* (series, period, level) instead; without one its paths are there with NULL values.  For few
    series with very many paths, *blocks* > 1 spreads the paths of a series over that many
    partitions before they are made.
    """
    seeds = forecast.join(_pool(residuals, residual, "_pool"), SERIES, "left")
    enough = F.coalesce(F.size("_pool") >= min_residuals, F.lit(False))
    if fallback is not None:
        seeds = seeds.join(_pool(fallback, "level", "_levels"), SERIES, "left")
    else:
        seeds = seeds.withColumn("_levels", F.lit(None).cast("array<double>"))
    seeds = seeds.withColumn("_enough", enough)
    first, last = F.lit(1), F.lit(n_sims)
    if blocks > 1:
        size = -(-n_sims // blocks)
        starts = F.sequence(F.lit(1), F.lit(n_sims), F.lit(size))
        seeds = seeds.withColumn("_from", F.explode(starts)).repartition(SERIES, "_from")
        first, last = F.col("_from"), F.least(F.col("_from") + size - 1, last)
    fan = seeds.withColumn("sim", F.explode(F.sequence(first, last)))

    def drawn(pool: str) -> Column:
        index = draw(F.col(SERIES), F.col("sim"), F.col("h"), seed, F.size(pool).cast("long"))
        return F.get(pool, index.cast("int"))

    pick = drawn("_pool")
    value = {
        "add": F.col("forecast") + pick,
        "multiply": F.col("forecast") * F.exp(pick),
        "level": pick,
    }[mode]
    value = F.when(F.col("_enough"), value).otherwise(drawn("_levels"))
    # greatest() would skip a null
    return fan.withColumn("_v", value).select(
        SERIES, "sim", "h", PERIOD, F.when(F.col("_v") > 0, F.col("_v")).when(F.col("_v").isNotNull(), 0.0).alias("value")
    )


def summarise_paths(
    paths: DataFrame,
    probs: dict[str, float] | None = None,
    keys: Sequence[str] = (SERIES, PERIOD),
    value: str = "value",
    bounded: bool = True,
) -> DataFrame:
    """Mean and exact quantiles over the paths of each key.

    With *bounded* a group (one value per path) is assumed to fit an aggregation buffer;
    otherwise the quantiles come from ``exact_quantiles``, which takes any number of paths.
    """
    probs = probs or OUTER
    mean = F.avg(value).alias("mean")
    if bounded:
        return group_quantiles(paths, keys, value, probs, extra=[mean])
    return paths.groupBy(*keys).agg(mean).join(
        exact_quantiles(paths, keys, value, probs), list(keys), "left"
    )


def total_paths(paths: DataFrame, value: str = "value") -> DataFrame:
    """Sum over series inside each (sim, period), so that the total's quantiles are coherent."""
    return paths.groupBy("sim", PERIOD).agg(F.sum(value).alias(value))


def horizon_paths(paths: DataFrame, keys: Sequence[str] = ("sim",), value: str = "value") -> DataFrame:
    """Sum over the whole horizon inside each path."""
    return paths.groupBy(*keys).agg(F.sum(value).alias(value))


def scenario_paths(
    inflow: DataFrame,
    issue_rate: DataFrame,
    arrival_rate: DataFrame,
    state: DataFrame,
) -> DataFrame:
    """Roll every path's own inputs through the two stocks: (series, sim, period, ...).

    The three inputs are joined on (series, sim, period) and the state on series, then
    folded per path; the path, not the series, is the unit of parallelism.
    """
    keys = [SERIES, "sim", PERIOD]
    inputs = inflow.join(issue_rate, keys, "left").join(arrival_rate, keys, "left")
    return stock_flow(inputs, state, keys=(SERIES, "sim"))
