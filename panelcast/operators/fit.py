"""Per-series model fitting.

The heavy part (moments, lag products, folds) is Spark aggregation; what reaches Python
is one row of sufficient statistics per series, solved in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelcast.functions.exprs import all_of, is_finite
from panelcast.operators.calendar import WEEK, horizon
from panelcast.operators.moments import Term, centred, lag_products
from panelcast.operators.windows import difference, ordered
from panelcast.schema import PERIOD, SERIES, Z80, Z95

# --- least squares ----------------------------------------------------------


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _symmetric(packed: pd.Series, p: int) -> np.ndarray:
    """Stacked p×p matrices of rows of packed upper triangles."""
    out = np.zeros((len(packed), p, p))
    i, j = np.triu_indices(p)
    values = np.array([np.asarray(x, dtype=float) for x in packed]).reshape(len(packed), len(i))
    out[:, i, j] = values
    out[:, j, i] = values
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve_centred(cov: pd.Series, rhs: pd.Series) -> pd.Series:
    """Minimum-norm solution of the rows' centred normal equations (packed upper triangles), all at once."""
    if not len(rhs):
        return pd.Series([], dtype=object)
    b = np.array([np.asarray(x, dtype=float) for x in rhs])
    a = _symmetric(cov, b.shape[1])
    scale = np.sqrt(np.einsum("bii->bi", a))
    scale[scale == 0] = 1.0
    # unit-variance scaling keeps the squared condition number in check
    corr = a / (scale[:, :, None] * scale[:, None, :])
    inverse = np.linalg.pinv(corr, rcond=1e-11, hermitian=True)
    return pd.Series(list((inverse @ (b / scale)[:, :, None])[:, :, 0] / scale))


def _moments_by_window(rows: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Centred products around the key's own mean, taken from a window over the key."""
    means = {f"_m{i}": F.avg(c).over(Window.partitionBy(*keys)) for i, c in enumerate(cols)}
    centred = rows.select(*keys, *cols, *[m.alias(n) for n, m in means.items()]).select(
        *keys,
        *[(F.col(c) - F.col(f"_m{i}")).alias(f"_c{i}") for i, c in enumerate(cols)],
        *means,
    )
    n = F.count(F.lit(1))
    return centred.groupBy(*keys).agg(
        n.alias("n"),
        *[F.first(m).alias(m) for m in means],
        *[
            (F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")) / n).alias(f"_s{i}_{j}")
            for i, j in _pairs(len(cols))
        ],
    )


def _moments_map_side(rows: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """The same moments from ``covar_pop``: partial states merge stably on the map side."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(cols[i], cols[j]).alias(f"_s{i}_{j}") for i, j in _pairs(len(cols))],
    )


def fit_linear(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    keys: Sequence[str] = (SERIES,),
    map_side: bool = False,
) -> DataFrame:
    """Ordinary least squares with intercept per key: (keys, n, intercept, coef, sse, r2).

    Complete rows only.  For series keys, a group is at most the calendar and usually
    partitioned by the lag windows already, so means come from a window and the products
    are plain sums without a further exchange.  With *map_side*, and always without keys,
    the moments are aggregated below the shuffle instead, which suits groups of any size.
    Collinear regressors get the minimum-norm solution instead of an error.
    """
    xs, keys = list(xs), list(keys)
    rows = df.filter(all_of([is_finite(c) for c in [y, *xs]]))
    collect = _moments_map_side if map_side or not keys else _moments_by_window
    return _solved(collect(rows, [y, *xs], keys), len(xs), keys)


def fit_linear_sparse(
    cells: DataFrame,
    y: str,
    terms: Sequence[Term],
    low: Column,
    high: Column,
    trend: bool = False,
    step_days: int = WEEK,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """``fit_linear`` of *y* on lagged columns over a zero-filled calendar, from its stored cells only.

    The same rows as a fit on the densified panel with complete lags, and one exchange by key; *trend*
    adds the row number as the last regressor.  *cells* has one row per key and period at most.
    """
    products = lag_products(cells, [(y, 0), *terms], low, high, trend, step_days=step_days, keys=keys)
    p = len(terms) + int(trend)
    return _solved(centred(products, p + 1, keys), p, list(keys))


def _solved(moments: DataFrame, p: int, keys: list[str]) -> DataFrame:
    """(keys, n, intercept, coef, sse, r2) from means and covariances with the target as column 0."""
    moments = moments.filter(F.col("n") > 0).select(
        *keys,
        "n",
        F.col("_m0").alias("_my"),
        F.array(*[F.col(f"_m{i}") for i in range(1, p + 1)]).alias("_mx"),
        F.array(*[F.col(f"_s{i + 1}_{j + 1}") for i, j in _pairs(p)]).alias("_cov"),
        F.array(*[F.col(f"_s0_{i}") for i in range(1, p + 1)]).alias("_rhs"),
        F.col("_s0_0").alias("_vy"),
    )
    explained = F.aggregate(
        F.zip_with("coef", "_rhs", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    level = F.aggregate(
        F.zip_with("coef", "_mx", lambda a, b: a * b), F.col("_my"), lambda s, v: s - v
    )
    return (
        moments.withColumn("coef", _solve_centred("_cov", "_rhs"))
        .withColumn("intercept", level)
        .withColumn("_explained", explained)
        .withColumn("sse", F.greatest(F.lit(0.0), (F.col("_vy") - F.col("_explained")) * F.col("n")))
        .withColumn("r2", F.try_divide("_explained", "_vy"))
        .select(*keys, "n", "intercept", "coef", "sse", "r2")
    )


def predict_linear(
    df: DataFrame,
    model: DataFrame,
    xs: Sequence[str],
    keys: Sequence[str] = (SERIES,),
    name: str = "prediction",
) -> DataFrame:
    """Attach intercept + Σ coef·x; null where a regressor or the key's fit is missing."""
    fit = model.select(*keys, F.col("intercept").alias("_b0"), F.col("coef").alias("_b"))
    if keys:
        joined = df.join(fit, list(keys), "left")
    else:  # a pooled fit is one row: scalar subqueries, no join
        joined = df.withColumns(
            {"_b0": fit.select("_b0").scalar(), "_b": fit.select("_b").scalar()}
        )
    value = F.col("_b0")
    for i, x in enumerate(xs):
        value = value + F.col("_b")[i] * F.col(x)
    return joined.withColumn(name, value).drop("_b0", "_b")


def fit_line(df: DataFrame, y: str, x: str, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """One-regressor form with built-in aggregates only: (keys, slope, intercept, r2, n)."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def fit_pooled(df: DataFrame, y: str, xs: Sequence[str]):
    """Pooled linear regression through ``pyspark.ml`` (normal equations, one pass)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(xs), outputCol="features", handleInvalid="skip"),
            LinearRegression(labelCol=y, solver="normal", predictionCol="prediction"),
        ]
    ).fit(df.filter(F.col(y).isNotNull()))


def fit_boosted(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    rounds: int = 100,
    depth: int = 3,
    step: float = 0.1,
    seed: int = 7,
):
    """Gradient-boosted trees with squared loss; missing features take the column mean."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = [f"{x}_filled" for x in xs]
    return Pipeline(
        stages=[
            Imputer(inputCols=list(xs), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="features"),
            GBTRegressor(
                labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, lossType="squared"
            ),
        ]
    ).fit(df.filter(F.col(y).isNotNull()))


def lagged_design(
    df: DataFrame,
    y: str,
    exog: dict[str, Sequence[int]],
    p: int,
    keys: Sequence[str] = (SERIES,),
) -> tuple[DataFrame, list[str]]:
    """Own lags 1..p of *y* and the given lags of each exogenous column, in one window pass."""
    w = ordered(keys)
    cols = {f"{y}_lag{k}": F.lag(y, k).over(w) for k in range(1, p + 1)}
    cols |= {f"{c}_lag{k}": F.lag(c, k).over(w) for c, lags in exog.items() for k in lags}
    return df.withColumns(cols), list(cols)


def fit_autoregression(
    df: DataFrame,
    y: str,
    exog: dict[str, Sequence[int]] | None = None,
    p: int = 1,
    keys: Sequence[str] = (SERIES,),
) -> tuple[DataFrame, DataFrame, list[str]]:
    """AR(p) with exogenous lags by least squares per key: (model, design, regressor names)."""
    design, xs = lagged_design(df, y, exog or {}, p, keys)
    return fit_linear(design, y, xs, keys), design, xs


# --- random walk and smoothing ---------------------------------------------


def random_walk(
    df: DataFrame,
    value: str,
    h: int,
    step_days: int = WEEK,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Last value carried forward, bounds ± z·σ·√h with σ² the mean squared difference."""
    steps = df.withColumn("_d", difference(value, w=ordered(keys)))
    state = steps.groupBy(*keys).agg(
        F.max_by(value, PERIOD).alias("forecast"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("sigma"),
        F.max(PERIOD).alias("_last"),
    )
    spread = F.col("sigma") * F.sqrt(F.col("h").cast("double"))
    return (
        state.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
        .withColumn(PERIOD, F.date_add("_last", F.col("h") * step_days))
        .select(
            *keys,
            "h",
            PERIOD,
            "forecast",
            (F.col("forecast") - Z80 * spread).alias("lo80"),
            (F.col("forecast") + Z80 * spread).alias("hi80"),
            (F.col("forecast") - Z95 * spread).alias("lo95"),
            (F.col("forecast") + Z95 * spread).alias("hi95"),
        )
    )


def _packed(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, _t dates, _y values) in time order; one entry per period, so bounded by the calendar."""
    rows = F.sort_array(F.collect_list(F.struct(PERIOD, F.col(value).cast("double").alias("v"))))
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(rows.alias("_rows"))
        .select(*keys, F.col(f"_rows.{PERIOD}").alias("_t"), F.col("_rows.v").alias("_y"))
    )


_CHUNK = 512  # series per numpy block, so that a block stays small for long calendars


def _blocks(ys: pd.Series):
    """Series of an Arrow batch as padded (rows × time) blocks with their lengths."""
    for at in range(0, len(ys), _CHUNK):
        part = ys.iloc[at : at + _CHUNK]
        n = np.array([len(y) for y in part])
        block = np.zeros((len(part), int(n.max(initial=1))))
        for i, y in enumerate(part):
            block[i, : n[i]] = y
        yield block, n


def _smooth_block(block: np.ndarray, n: np.ndarray, alpha: np.ndarray, optimal: bool) -> pd.DataFrame:
    """Best α, final level and squared error of every row of one block.

    The level is carried as a + b·l₀, which is linear in the opening level l₀; with a fixed
    start the same recursion runs with l₀ known.
    """
    rows, periods = block.shape
    al = alpha[None, :]
    start = 0 if optimal else 1
    a = np.zeros((rows, len(alpha))) if optimal else np.repeat(block[:, :1], len(alpha), axis=1)
    b = np.ones_like(a)
    uu, ub, bb = np.zeros_like(a), np.zeros_like(a), np.zeros_like(a)
    for t in range(start, periods):
        live = (n > t)[:, None]
        u = np.where(live, block[:, t : t + 1] - a, 0.0)
        uu += u * u
        if optimal:
            ub += u * b
            bb += np.where(live, b * b, 0.0)
            b = np.where(live, b * (1 - al), b)
        a = a + al * u
    if optimal:
        opening = ub / bb
        level, sse = a + b * opening, uu - ub * opening
    else:
        level, sse = a, uu
    best = np.argmin(sse, axis=1)
    row = np.arange(rows)
    return pd.DataFrame(
        {"alpha": alpha[best], "level": level[row, best], "sse": sse[row, best], "n": n.astype("int64")}
    )


def fit_smoothing(
    df: DataFrame,
    value: str,
    alphas: Sequence[float],
    start: str = "first",
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Simple exponential smoothing over a grid of α: (keys, alpha, level, sse, n), best by SSE.

    ``start="first"`` opens the level at the first value; ``start="optimal"`` at the value
    that minimises the squared one-step errors.  Ties go to the smaller α.  A smoothing
    recursion has no built-in form: a fold over arrays runs interpreted, so whole Arrow
    batches of series take each time step together in numpy.
    """
    if start not in ("first", "optimal"):
        raise ValueError(f"unknown start: {start}")
    grid = np.array(sorted(float(a) for a in alphas))

    @F.pandas_udf("alpha double, level double, sse double, n long")
    def best(ys: pd.Series) -> pd.DataFrame:
        parts = [_smooth_block(b, n, grid, start == "optimal") for b, n in _blocks(ys)]
        return pd.concat(parts, ignore_index=True)

    return _packed(df, value, keys).select(*keys, best("_y").alias("s")).select(*keys, "s.*")


def smoothing_fitted(
    df: DataFrame, value: str, model: DataFrame, keys: Sequence[str] = (SERIES,), name: str = "fitted"
) -> DataFrame:
    """One-step-ahead fitted values of a smoothing model that opened at the first value."""

    @F.pandas_udf("array<double>")
    def fitted(ys: pd.Series, alpha: pd.Series) -> pd.Series:
        out, at = [], 0
        for block, n in _blocks(ys):
            al = alpha.iloc[at : at + len(n)].to_numpy(dtype=float)
            levels = np.empty_like(block)
            level = block[:, 0]
            for t in range(block.shape[1]):
                levels[:, t] = level
                level = level + al * (block[:, t] - level)
            out += [levels[i, 1 : n[i]] for i in range(len(n))]
            at += len(n)
        return pd.Series(out)

    packed = _packed(df, value, keys).join(model.select(*keys, "alpha"), list(keys))
    dates = F.slice("_t", F.lit(2), F.size("_t"))
    pairs = packed.select(*keys, dates.alias("_t"), fitted("_y", "alpha").alias("_f"))
    return pairs.select(*keys, F.inline(F.arrays_zip("_t", "_f"))).withColumnsRenamed(
        {"_t": PERIOD, "_f": name}
    )


def flat_forecast(
    model: DataFrame,
    df: DataFrame,
    h: int,
    level: str = "level",
    step_days: int = WEEK,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """A per-series level repeated over the horizon: (keys, h, period, forecast).

    A series without a level keeps its rows, with a NULL forecast.
    """
    return horizon(df, h, step_days, keys).join(
        model.select(*keys, F.col(level).alias("forecast")), list(keys), "left"
    )


# --- model choice -----------------------------------------------------------


def aicc(sse: Column | str, n: Column | str, k: Column | str) -> Column:
    """Small-sample Akaike criterion of a Gaussian fit; null where n ≤ k + 1."""
    sse, n, k = (F.col(c) if isinstance(c, str) else c for c in (sse, n, k))
    room = n - k - 1
    return F.when(
        (room > 0) & (sse > 0),
        n * F.ln(F.try_divide(sse, n)) + 2 * k + F.try_divide(2 * k * (k + 1), room),
    )


def choose_by_aicc(candidates: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Best candidate per key from rows (keys, model, sse, n, k); ties go to the first name.

    A perfect fit (sse 0 with room for its parameters) comes first; its criterion is NULL.  A
    key without any candidate that can be scored keeps a row with NULL for model and aicc.
    """
    scored = candidates.withColumn("aicc", aicc("sse", "n", "k"))
    perfect = F.coalesce((F.col("sse") == 0) & (F.col("n") - F.col("k") - 1 > 0), F.lit(False))
    usable = perfect | F.col("aicc").isNotNull()
    order = F.when(usable, F.struct((~perfect).alias("later"), "aicc", "model"))
    best = F.min_by(F.struct("model", "aicc"), order).alias("s")
    return scored.groupBy(*keys).agg(best).select(*keys, "s.model", "s.aicc")


def candidate_fits(df: DataFrame, value: str, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Mean, random-walk and linear-trend fits of one column as (keys, model, sse, n, k) rows."""
    w = ordered(keys)
    steps = df.withColumns(
        {"_d": difference(value, w=w), "_t": F.row_number().over(w).cast("double")}
    )
    sums = steps.groupBy(*keys).agg(
        F.count(value).cast("double").alias("_n"),
        (F.var_pop(value) * F.count(value)).alias("_mean"),
        F.sum(F.col("_d") * F.col("_d")).alias("_walk"),
        F.count("_d").cast("double").alias("_nd"),
        (F.regr_syy(value, "_t") - F.regr_r2(value, "_t") * F.regr_syy(value, "_t")).alias("_trend"),
    )

    def row(model: str, sse: str, n: str, k: float) -> Column:
        return F.struct(
            F.lit(model).alias("model"),
            F.col(sse).alias("sse"),
            F.col(n).alias("n"),
            F.lit(k).alias("k"),
        )

    return sums.select(
        *keys,
        F.inline(
            F.array(
                row("mean", "_mean", "_n", 2.0),
                row("random_walk", "_walk", "_nd", 1.0),
                row("trend", "_trend", "_n", 3.0),
            )
        ),
    )


# --- delay weights ----------------------------------------------------------


def nnls_gram(gram: np.ndarray, rhs: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Minimise ½wᵀGw − rᵀw over w ≥ 0 by an active set on the normal equations."""
    w, _, settled = nnls_stack(gram[None], np.asarray(rhs, dtype=float)[None], tol)
    if not settled[0]:
        raise ArithmeticError(f"active set of {len(rhs)} weights did not converge")
    return w[0]


def nnls_stack(gram: np.ndarray, rhs: np.ndarray, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nnls_gram`` for stacked systems at once: weights, the largest violation of the optimality
    conditions relative to the right side, and whether the active set came to rest.

    Each round takes one step of every system that is not done, by one stacked solution; a system that
    does not come to rest keeps its last feasible weights and says so.
    """
    b, p = rhs.shape
    w, passive = np.zeros((b, p)), np.zeros((b, p), bool)
    scale = np.maximum(1.0, np.abs(rhs).max(axis=1, initial=0.0))
    open_, inner = np.ones(b, bool), np.zeros(b, bool)
    for _ in range(30 * p + 30):
        pick = np.flatnonzero(open_ & ~inner)
        if len(pick):  # the weight that would gain most becomes free
            gradient = rhs[pick] - np.einsum("bij,bj->bi", gram[pick], w[pick])
            gradient[passive[pick]] = -np.inf
            j = gradient.argmax(axis=1)
            gains = gradient[np.arange(len(pick)), j] > tol * scale[pick]
            open_[pick[~gains]] = False
            passive[pick[gains], j[gains]] = True
            inner[pick[gains]] = True
        at = np.flatnonzero(inner)
        if not len(at):
            break
        free = passive[at]
        system = gram[at] * (free[:, :, None] & free[:, None, :])
        z = (np.linalg.pinv(system, rcond=1e-13, hermitian=True) @ np.where(free, rhs[at], 0.0)[:, :, None])[:, :, 0]
        z = np.where(free, z, 0.0)
        bad = free & (z <= 0)
        fine = ~bad.any(axis=1)
        w[at[fine]] = z[fine]
        inner[at[fine]] = False
        at, free, z, bad = at[~fine], free[~fine], z[~fine], bad[~fine]
        moving = bad & (w[at] > z)
        step = np.where(moving, w[at] / np.where(moving, w[at] - z, 1.0), np.inf).min(axis=1, initial=np.inf)
        step = np.where(np.isfinite(step), step, 0.0)[:, None]
        moved = w[at] + step * (z - w[at])
        stays = free & (moved > tol * np.maximum(1.0, moved.max(axis=1, initial=0.0))[:, None])
        w[at], passive[at] = np.where(stays, moved, 0.0), stays
        inner[at[~stays.any(axis=1)]] = False
    gradient = rhs - np.einsum("bij,bj->bi", gram, w)
    violation = np.where(w > 0, np.abs(gradient), np.maximum(gradient, 0.0)).max(axis=1, initial=0.0) / scale
    return w, violation, ~open_


_NNLS = T.StructType(
    [
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("kkt", T.DoubleType()),
        T.StructField("settled", T.BooleanType()),
    ]
)


@F.pandas_udf(_NNLS)
def _solve_nnls(gram: pd.Series, rhs: pd.Series) -> pd.DataFrame:
    if not len(rhs):
        return pd.DataFrame({"weights": [], "kkt": [], "settled": []})
    b = np.array([np.asarray(x, dtype=float) for x in rhs])
    w, kkt, settled = nnls_stack(_symmetric(gram, b.shape[1]), b)
    return pd.DataFrame({"weights": list(w), "kkt": kkt, "settled": settled})


def fit_delay_weights(
    df: DataFrame,
    upstream: str,
    downstream: str,
    max_lag: int = 6,
    cap: float | None = 1.0,
    min_extra: int = 4,
    shrink: bool = False,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Non-negative delay weights y_t ≈ Σ w_k·x_{t−k} per series: (keys, n, weights array, status, kkt).

    *kkt* is the largest violation of the optimality conditions relative to the right side, *status*
    one of ``optimal``, ``not settled``, ``no signal`` and ``ratio``; one series never ends the job.

    Lags come from one window, their products from one aggregate over the same
    partitioning, so there is no further exchange; only the (K+1)² system of each series
    reaches Python.  A series with at most K + *min_extra* rows, or without any signal,
    gets zeros; with *shrink* the lags of a short series are cut to n − 2 instead, and one
    or two rows give the plain ratio at lag 0.
    *cap* rescales weights that add to more than it.
    """
    lags = list(range(max_lag + 1))
    w = ordered(keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    lagged = df.withColumns(
        {f"_x{k}": F.lag(upstream, k).over(w) for k in lags}
        | {"_i": F.row_number().over(w), "_n": n}
    )
    used = F.least(F.lit(max_lag), F.greatest(F.lit(0), F.col("_n") - 2)) if shrink else F.lit(max_lag)
    fits = F.col("_i") > used
    # 0 outside the fitted rows and lags, so that the products below are plain sums
    design = lagged.select(
        *keys,
        upstream,
        downstream,
        *[
            F.when(fits & (F.lit(k) <= used), F.coalesce(F.col(f"_x{k}"), F.lit(0.0)))
            .otherwise(0.0)
            .alias(f"_z{k}")
            for k in lags
        ],
    )
    stats = design.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(upstream).alias("_sx"),
        F.sum(downstream).alias("_sy"),
        *[
            F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_g{i}_{j}")
            for i, j in _pairs(max_lag + 1)
        ],
        *[F.sum(F.col(f"_z{k}") * F.coalesce(F.col(downstream), F.lit(0.0))).alias(f"_r{k}") for k in lags],
    )
    stats = stats.select(
        *keys,
        "n",
        "_sx",
        "_sy",
        F.array(*[F.col(f"_g{i}_{j}") for i, j in _pairs(max_lag + 1)]).alias("_gram"),
        F.array(*[F.col(f"_r{k}") for k in lags]).alias("_rhs"),
    )
    return _weights_of(stats, max_lag, cap, min_extra, shrink, keys)


def fit_delay_weights_sparse(
    cells: DataFrame,
    upstream: str,
    downstream: str,
    low: Column,
    high: Column,
    max_lag: int = 6,
    cap: float | None = 1.0,
    min_extra: int = 4,
    step_days: int = WEEK,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """``fit_delay_weights`` over a zero-filled calendar, from its stored cells only."""
    terms = [*((upstream, k) for k in range(max_lag + 1)), (downstream, 0)]
    products = lag_products(cells, terms, low, high, step_days=step_days, keys=keys)
    stats = products.select(
        *keys,
        F.col("rows").cast("long").alias("n"),
        F.col(f"_all_{upstream}").alias("_sx"),
        F.col(f"_all_{downstream}").alias("_sy"),
        F.array(*[F.col(f"_p{i}_{j}") for i, j in _pairs(max_lag + 1)]).alias("_gram"),
        F.array(*[F.col(f"_p{k}_{max_lag + 1}") for k in range(max_lag + 1)]).alias("_rhs"),
    )
    return _weights_of(stats, max_lag, cap, min_extra, False, keys)


def _weights_of(
    stats: DataFrame, max_lag: int, cap: float | None, min_extra: int, shrink: bool, keys: Sequence[str]
) -> DataFrame:
    """(keys, n, weights, status, kkt) from packed products; rules as in ``fit_delay_weights``."""
    enough = F.lit(True) if shrink else F.col("n") > max_lag + min_extra
    signal = enough & (F.col("_sx") != 0) & (F.col("_sy") != 0)
    zeros = F.array_repeat(F.lit(0.0), max_lag + 1)
    weights = F.when(signal, F.col("weights")).otherwise(zeros)
    if shrink:
        # one or two rows: everything at lag 0, as the ratio of the sums
        ratio_only = F.concat(
            F.array(F.greatest(F.lit(0.0), F.try_divide("_sy", "_sx"))),
            F.array_repeat(F.lit(0.0), max_lag),
        )
        weights = F.when((F.col("n") <= 2) & (F.col("_sx") > 0), ratio_only).otherwise(weights)
    solved = stats.withColumn("_fit", _solve_nnls("_gram", "_rhs")).withColumns(
        {
            "weights": F.col("_fit.weights"),
            "kkt": F.when(signal, F.col("_fit.kkt")),
            "status": F.when(~signal, "no signal").when(F.col("_fit.settled"), "optimal").otherwise("not settled"),
        }
    )
    if shrink:
        solved = solved.withColumn("status", F.when((F.col("n") <= 2) & (F.col("_sx") > 0), "ratio").otherwise(F.col("status")))
    solved = solved.withColumn("weights", weights)
    if cap is not None:
        total = F.aggregate("weights", F.lit(0.0), lambda s, v: s + v)
        factor = F.when(total > cap, F.lit(cap) / total).otherwise(1.0)
        solved = solved.withColumn("_f", factor).withColumn(
            "weights", F.transform("weights", lambda v: v * F.col("_f"))
        )
    return solved.select(*keys, "n", "weights", "status", "kkt")


def weight_rows(fits: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """(keys, weights array) → (keys, k, w)."""
    return fits.select(*keys, F.posexplode("weights").alias("k", "w"))


# --- distribution parameters ------------------------------------------------


def beta_moments(df: DataFrame, rate: str, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Beta (alpha, beta) of the rates inside (0, 1) by moments; (2, 2) where they give none."""
    inside = F.when((F.col(rate) > 0) & (F.col(rate) < 1), F.col(rate))
    s = df.groupBy(*keys).agg(
        F.count(inside).alias("n"), F.avg(inside).alias("_m"), F.var_samp(inside).alias("_v")
    )
    common = F.try_divide(F.col("_m") * (1 - F.col("_m")), F.col("_v")) - 1
    s = s.withColumn("_c", common)
    ok = F.coalesce((F.col("n") >= 5) & (F.col("_v") > 0) & (F.col("_c") > 0), F.lit(False))
    return s.select(
        *keys,
        "n",
        F.when(ok, F.col("_m") * F.col("_c")).otherwise(2.0).alias("alpha"),
        F.when(ok, (1 - F.col("_m")) * F.col("_c")).otherwise(2.0).alias("beta"),
    )


def dispersion(
    df: DataFrame, y: str, mu: str, min_rows: int = 20, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Moment estimate of negative-binomial size Σμ²/Σ((y−μ)²−μ); null means Poisson-like."""
    m = F.greatest(F.col(mu), F.lit(1e-6))
    count = F.greatest(F.lit(0.0), F.bround(y))
    usable = F.col(y).isNotNull() & F.col(mu).isNotNull()
    s = df.groupBy(*keys).agg(
        F.count_if(usable).alias("n"),
        F.sum(F.when(usable, m * m)).alias("_num"),
        F.sum(F.when(usable, (count - m) * (count - m) - m)).alias("_den"),
    )
    ok = (F.col("n") >= min_rows) & (F.col("_den") > 0)
    return s.select(*keys, "n", F.when(ok, F.col("_num") / F.col("_den")).alias("theta"))
