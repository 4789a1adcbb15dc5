"""Projection of fitted panels: convolution, stock-flow roll-forward, ensembles, weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.functions.exprs import clamp, clip_low, strict_sum
from panelcast.operators.calendar import WEEK
from panelcast.operators.fit import fit_linear, predict_linear
from panelcast.operators.windows import ordered, whole
from panelcast.schema import PERIOD, SERIES

# --- delay weights as rows (keys, k, w) -------------------------------------


def _by_lag(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("k")


def weight_summary(weights: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Overall conversion Σw and mean delay Σk·w / Σw."""
    return weights.groupBy(*keys).agg(
        F.sum("w").alias("conversion"),
        F.try_divide(F.sum(F.col("k") * F.col("w")), F.sum("w")).alias("mean_delay"),
    )


def delay_distribution(weights: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Weights as shares of their sum (unchanged where the sum is not positive)."""
    total = F.sum("w").over(whole(keys))
    return weights.withColumn(
        "share", F.when(total > 0, F.col("w") / total).otherwise(F.col("w"))
    )


def smooth_weights(weights: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Three-point moving average that keeps the ends, the sign and the sum."""
    w = _by_lag(keys)
    around = w.rowsBetween(-1, 1)
    n = F.count(F.lit(1)).over(whole(keys))
    centred = F.when(F.count("w").over(around) == 3, F.avg("w").over(around)).otherwise(F.col("w"))
    raw = weights.withColumn("_s", F.when(n < 3, F.col("w")).otherwise(clip_low(centred)))
    before, after = F.sum("w").over(whole(keys)), F.sum("_s").over(whole(keys))
    scaled = F.when(after > 0, F.col("_s") * before / after).otherwise(F.col("_s"))
    return raw.withColumn("w", scaled).drop("_s")


def cap_weights(
    weights: DataFrame, cap: float = 0.999, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Scale weights down so that they add to at most *cap*."""
    total = F.sum("w").over(whole(keys))
    return weights.withColumn(
        "w", F.when(total > cap, F.col("w") * cap / total).otherwise(F.col("w"))
    )


def hazards(weights: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Chance of the event at age k given none before: w_k / (1 − Σ_{j<k} w_j), inside [0, 1]."""
    earlier = F.coalesce(
        F.sum("w").over(_by_lag(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    remain = 1 - earlier
    return weights.withColumn(
        "hazard",
        F.when(remain <= 1e-12, F.lit(0.0)).otherwise(clamp(F.try_divide("w", remain), 0.0, 1.0)),
    )


def apportion(
    df: DataFrame,
    share: str,
    target: str,
    by: str,
    keys: Sequence[str] = (SERIES,),
    name: str = "units",
) -> DataFrame:
    """Non-negative shares → whole numbers that add up to *target* per group.

    Largest remainders first, ties by *by*.  Groups are small by design (one row per age
    or category).  A target or share total that is not positive gives zeros.
    """
    x = df.withColumn("_x", clip_low(F.coalesce(F.col(share), F.lit(0.0))))
    total = F.sum("_x").over(whole(keys))
    exact = F.when(
        (total > 0) & (F.col(target) > 0), F.col("_x") * F.try_divide(F.col(target), total)
    ).otherwise(0.0)
    x = x.withColumn("_y", exact).withColumn("_base", F.floor("_y"))
    left = F.col(target) - F.sum("_base").over(whole(keys))
    rank = F.row_number().over(
        Window.partitionBy(*keys).orderBy((F.col("_y") - F.col("_base")).desc(), by)
    )
    extra = F.when((total > 0) & (F.col(target) > 0) & (rank <= left), 1).otherwise(0)
    return x.withColumn(name, (F.col("_base") + extra).cast("long")).drop("_x", "_y", "_base")


def opening_cohorts(
    panel: DataFrame,
    weights: DataFrame,
    inflow: str,
    outflow: str,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Waiting units by age at the start of the projection: (keys, age, units).

    Age a ≥ 1 holds the inflow of the a-th last period times the share still waiting,
    1 − Σ_{j<a} w_j; all ages are then scaled to the observed backlog in whole units.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(PERIOD).desc())
    n = panel.withColumns(
        {
            "age": F.row_number().over(newest),
            "_backlog": F.bround(
                F.greatest(
                    F.lit(0.0),
                    F.sum(F.col(inflow) - F.col(outflow)).over(whole(keys)),
                )
            ),
        }
    ).select(*keys, "age", F.col(inflow).alias("_x"), "_backlog")
    waiting = 1 - F.sum("w").over(_by_lag(keys).rowsBetween(Window.unboundedPreceding, -1))
    survival = weights.select(
        *keys, F.col("k").alias("age"), clip_low(waiting).alias("_s")
    ).filter(F.col("age") >= 1)
    cohorts = n.join(survival, [*keys, "age"]).withColumn("_raw", F.col("_x") * F.col("_s"))
    return apportion(cohorts, "_raw", "_backlog", "age", keys).select(*keys, "age", "units")


# --- projection over history ⊎ future ---------------------------------------


def extend(
    df: DataFrame,
    h: int,
    carry: Mapping[str, Column],
    step_days: int = WEEK,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Append *h* future periods per series; column ``h`` is 0 on history.

    *carry* maps a column to the value its future rows take, evaluated on the last
    history row (window expressions such as a rolling mean are fine); other columns
    become null.  The last row explodes into the horizon, so history and future stay in
    one exchange by series.
    """
    w = ordered(keys)
    values = [c for c in df.columns if c not in (*keys, PERIOD)]
    last = F.lead(PERIOD).over(w).isNull()
    steps = F.when(last, F.sequence(F.lit(0), F.lit(h))).otherwise(F.array(F.lit(0)))
    out = df.withColumns({f"_next_{c}": e for c, e in carry.items()} | {"_steps": steps})
    out = out.withColumn("h", F.explode("_steps"))
    return out.select(
        *keys,
        F.date_add(PERIOD, F.col("h") * step_days).alias(PERIOD),
        "h",
        *[
            F.when(F.col("h") == 0, F.col(c))
            .otherwise(F.col(f"_next_{c}") if c in carry else F.lit(None))
            .alias(c)
            for c in values
        ],
    )


def replay_last(
    df: DataFrame, h: int, columns: Sequence[str], step_days: int = WEEK, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Future periods that repeat the last *h* ones of the calendar: (keys, h, period, columns).

    Step k takes the values of *h* steps before it, null where that period has no row.
    """
    end = F.max(PERIOD).over(whole(keys))
    late = df.withColumn("_end", end).withColumn("_k", h - F.datediff("_end", PERIOD) / step_days)
    late = late.filter(F.col("_k") > 0)
    at = F.map_from_entries(F.collect_list(F.struct(F.col("_k").cast("int"), F.struct(*columns))))
    packed = late.groupBy(*keys).agg(F.first("_end").alias("_end"), at.alias("_at"))
    steps = packed.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h)))).withColumn("_v", F.try_element_at("_at", F.col("h")))
    return steps.select(
        *keys, "h", F.date_add("_end", F.col("h") * step_days).alias(PERIOD), *[F.col(f"_v.{c}").alias(c) for c in columns]
    )


def convolve(
    df: DataFrame,
    weights: DataFrame,
    x: str,
    max_lag: int,
    name: str,
    keys: Sequence[str] = (SERIES,),
    weight_keys: Sequence[str] | None = None,
) -> DataFrame:
    """ŷ_t = Σ_k w_k·x_{t−k} on a dense panel, lags before the start counted as 0.

    *weights* holds one array per key (or per *weight_keys*, a part of the keys).  Lags come
    from one window, so the panel is not multiplied by the number of lags.  An array longer
    than *max_lag* + 1 is an error; a row without weights gets NULL.
    """
    w = ordered(keys)
    on = list(weight_keys or keys)
    long = F.raise_error(F.lit(f"convolve: weights beyond lag {max_lag}")).cast("array<double>")
    packed = F.when(F.size("weights") > max_lag + 1, long).otherwise(F.col("weights"))
    joined = df.join(weights.select(*on, packed.alias("_w")), on, "left")
    total = F.when(F.col("_w").isNotNull(), F.lit(0.0))
    for k in range(max_lag + 1):
        lagged = F.coalesce(F.lag(x, k).over(w) if k else F.col(x), F.lit(0.0))
        total = total + F.coalesce(F.get("_w", F.lit(k)), F.lit(0.0)) * lagged
    return joined.withColumn(name, total).drop("_w")


def convolve_sparse(
    df: DataFrame,
    weights: DataFrame,
    x: str,
    name: str,
    step_days: int = WEEK,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """The same sum on a panel with gaps: every row sends w_k·x to the period k steps on.

    Returns (keys, period, name) for every period that receives something, also beyond
    the last observed one.  Parts for one cell are added map-side.  A series without weights keeps its
    own periods, with NULL.
    """
    sent = df.join(weights.select(*keys, F.col("weights").alias("_w")), list(keys), "left").select(
        *keys, PERIOD, F.col(x).alias("_x"), F.col("_w").isNull().alias("_none"), F.posexplode_outer("_w").alias("k", "w")
    )
    return (
        sent.filter(F.col("_none") | ((F.col("w") != 0) & (F.col("_x") != 0)))
        .withColumn(PERIOD, F.date_add(PERIOD, F.coalesce("k", F.lit(0)) * step_days))
        .groupBy(*keys, PERIOD)
        .agg(F.sum(F.col("w") * F.col("_x")).alias(name))
    )


def cascade(
    extended: DataFrame,
    first: DataFrame,
    second: DataFrame,
    max_lags: tuple[int, int],
    stages: tuple[str, str, str],
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Two convolutions in a row over history ⊎ future (column ``h``, 0 on history).

    The future of stage 2 is filled from stage 1, then stage 3 from stage 2.
    """
    a, b, c = stages
    out = convolve(extended, first, a, max_lags[0], "_fit", keys)
    out = out.withColumn(b, F.when(F.col("h") == 0, F.col(b)).otherwise(clip_low("_fit")))
    out = convolve(out.drop("_fit"), second, b, max_lags[1], "_fit", keys)
    return out.withColumn(
        c, F.when(F.col("h") == 0, F.col(c)).otherwise(clip_low("_fit"))
    ).drop("_fit")


def lag_ratio_projection(
    df: DataFrame, upstream: str, downstream: str, lags: Sequence[int] = (1, 2, 3), keys=(SERIES,)
) -> DataFrame:
    """Mean of y_{t+k}/x_t per lag, and last x times the mean of those ratios."""
    w = ordered(keys)
    ratios = df.withColumns(
        {f"_r{k}": F.try_divide(F.lead(downstream, k).over(w), F.col(upstream)) for k in lags}
    )
    s = ratios.groupBy(*keys).agg(
        *[F.avg(f"_r{k}").alias(f"lag{k}") for k in lags],
        F.avg(upstream).alias("mean_level"),
        F.max_by(upstream, PERIOD).alias("last_level"),
    )
    total = F.lit(0.0)
    for k in lags:
        total = total + F.col(f"lag{k}")
    return s.withColumn("per_period", F.col("last_level") * total / len(lags))


# --- recursions: a fold over the (bounded) horizon of one series -------------


def _steps(columns: Sequence[str]) -> Column:
    return F.sort_array(F.collect_list(F.struct(PERIOD, *columns)))


def stock_flow(
    inputs: DataFrame,
    state: DataFrame,
    inflow: str = "applications",
    rates: tuple[str, str] = ("issue_rate", "arrival_rate"),
    stocks: tuple[str, str] = ("app_backlog", "visa_stock"),
    names: tuple[str, str] = ("visas_issued", "arrivals"),
    keys: Sequence[str] = (SERIES,),
    state_keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Two chained stocks rolled over the horizon: out = rate · (stock + in), stock −= out.

    One row per key and step comes back.  Runs as a fold over the horizon's array inside
    the JVM; the array holds one entry per future step.
    """
    r1, r2 = rates
    packed = (
        inputs.groupBy(*keys).agg(_steps([inflow, r1, r2]).alias("_steps")).join(state, list(state_keys))
    )
    row = "struct<period:date,inflow:double,out1:double,out2:double,stock1:double,stock2:double>"
    zero = F.struct(
        F.col(stocks[0]).cast("double").alias("s1"),
        F.col(stocks[1]).cast("double").alias("s2"),
        F.array().cast(f"array<{row}>").alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        avail1 = s["s1"] + x[inflow]
        out1 = x[r1] * avail1
        avail2 = s["s2"] + out1
        out2 = x[r2] * avail2
        rest1, rest2 = avail1 - out1, avail2 - out2
        done = F.struct(
            x[PERIOD].alias("period"),
            x[inflow].cast("double").alias("inflow"),
            out1.alias("out1"),
            out2.alias("out2"),
            rest1.alias("stock1"),
            rest2.alias("stock2"),
        )
        return F.struct(
            rest1.alias("s1"), rest2.alias("s2"), F.array_append(s["out"], done).alias("out")
        )

    return packed.select(*keys, F.inline(F.aggregate("_steps", zero, step)["out"])).withColumnsRenamed(
        {
            "period": PERIOD,
            "inflow": inflow,
            "out1": names[0],
            "out2": names[1],
            "stock1": stocks[0],
            "stock2": stocks[1],
        }
    )


def regression_feedback(
    future: DataFrame,
    model: DataFrame,
    state: DataFrame,
    inflow: str,
    regressors: Sequence[str],
    stock: str = "backlog",
    name: str = "forecast",
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """One-step regression rolled forward with the stock it feeds.

    ŷ_t = b₀ + b₁·stock_{t−1} + Σ bᵢ·regressorᵢ; stock_t = stock_{t−1} + inflow_t − ŷ_t.
    *model* is a ``fit_linear`` result whose first coefficient belongs to the stock.
    """
    packed = (
        future.groupBy(*keys)
        .agg(_steps(list(dict.fromkeys([inflow, *regressors]))).alias("_steps"))
        .join(model.select(*keys, "intercept", "coef"), list(keys))
        .join(state.select(*keys, stock), list(keys))
    )
    row = "struct<period:date,forecast:double,stock:double>"
    zero = F.struct(
        F.col(stock).cast("double").alias("s"), F.array().cast(f"array<{row}>").alias("out")
    )

    def step(s: Column, x: Column) -> Column:
        y = F.col("intercept") + F.col("coef")[0] * s["s"]
        for i, r in enumerate(regressors, start=1):
            y = y + F.col("coef")[i] * x[r]
        rest = s["s"] + x[inflow] - y
        done = F.struct(x[PERIOD].alias("period"), y.alias("forecast"), rest.alias("stock"))
        return F.struct(rest.alias("s"), F.array_append(s["out"], done).alias("out"))

    return packed.select(*keys, F.inline(F.aggregate("_steps", zero, step)["out"])).withColumnsRenamed(
        {"period": PERIOD, "forecast": name, "stock": stock}
    )


def project_autoregression(
    rows: DataFrame,
    model: DataFrame,
    y: str,
    exog: Mapping[str, Sequence[int]] | None = None,
    p: int = 1,
    name: str = "forecast",
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """AR(p) with exogenous lags rolled over the horizon: (keys, h, period, *name*).

    *rows* is history followed by future rows as ``extend`` makes them (``h`` is 0 on history), with
    values of the exogenous columns in both; *model* comes from ``fit_autoregression`` with the same
    lags.  The state is a ring of the last p own values: each step's forecast enters it and the oldest
    value leaves.  Rows are steps, so history has to be dense.  A series without a model, or with a gap
    among the values that a step needs, keeps its rows with NULL from that step on.
    """
    w = ordered(keys)
    lags = [(c, k) for c, ks in (exog or {}).items() for k in ks]
    own = F.array(*[F.lag(y, k).over(w).cast("double") for k in range(1, p + 1)])
    inputs = F.array(*[F.lag(c, k).over(w).cast("double") for c, k in lags]) if lags else F.array().cast("array<double>")
    future = rows.withColumns({"_ring": own, "_x": inputs}).filter(F.col("h") > 0)
    steps = F.sort_array(F.collect_list(F.struct("h", PERIOD, "_x", F.when(F.col("h") == 1, F.col("_ring")).alias("_ring"))))
    packed = future.groupBy(*keys).agg(steps.alias("_steps")).join(model.select(*keys, "intercept", "coef"), list(keys), "left")
    row = f"struct<h:int,{PERIOD}:date,{name}:double>"

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    def step(s: Column, x: Column) -> Column:
        value = F.col("intercept") + dot(F.slice("coef", 1, p), s["ring"])
        if lags:
            value = value + dot(F.slice("coef", p + 1, len(lags)), x["_x"])
        ring = F.slice(F.concat(F.array(value), s["ring"]), 1, p)
        done = F.struct(x["h"].cast("int").alias("h"), x[PERIOD].alias(PERIOD), value.alias(name))
        return F.struct(ring.alias("ring"), F.array_append(s["out"], done).alias("out"))

    zero = F.struct(F.col("_steps")[0]["_ring"].alias("ring"), F.array().cast(f"array<{row}>").alias("out"))
    return packed.select(*keys, F.inline(F.aggregate("_steps", zero, step)["out"]))


def cap_outflow(
    df: DataFrame,
    demand: str,
    inflow: str,
    opening: Column | str | float = 0.0,
    name: str = "capped",
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Outflow that never exceeds what is in stock: min(demand, stock + inflow) step by step.

    Solved without a recursion: with X the uncapped running balance, the total cut so far
    is max(0, −min X), so one running sum and one running minimum give every step.
    Demand and inflow are expected to be non-negative.
    """
    w = ordered(keys)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    if isinstance(opening, (int, float)):
        opening = F.lit(float(opening))
    start = clip_low(F.col(opening) if isinstance(opening, str) else opening)
    return (
        df.withColumn("_x", start + F.sum(F.col(inflow) - F.col(demand)).over(run))
        .withColumn("_cut", F.greatest(F.lit(0.0), -F.min("_x").over(run)))
        .withColumn(
            name, F.col(demand) - (F.col("_cut") - F.coalesce(F.lag("_cut").over(w), F.lit(0.0)))
        )
        .drop("_x", "_cut")
    )


# --- simple projections and combinations -------------------------------------


def decaying(level: Column, h: Column, rate: float) -> Column:
    return level * F.exp(F.lit(-rate) * h)


def bands(point: Column, low: float, high: float) -> dict[str, Column]:
    """Rounded percentage band around a point forecast."""
    return {"lower": F.bround(point * low), "upper": F.bround(point * high)}


def ensemble(
    forecasts: DataFrame,
    weights: Mapping[str, float] | None = None,
    model: str = "ensemble",
    keys: Sequence[str] = (PERIOD,),
) -> DataFrame:
    """Weighted sum (or plain mean without weights) of long forecasts per key.

    Models of weight 0 or without a weight stay out; a null forecast that takes part
    makes the result null.
    """
    if weights is None:
        combined = F.try_divide(strict_sum("forecast"), F.count(F.lit(1)))
        used = forecasts
    else:
        used = forecasts.filter(F.col("model").isin([m for m, x in weights.items() if x != 0]))
        w = F
        for m, x in weights.items():
            w = w.when(F.col("model") == m, F.lit(float(x)))
        combined = strict_sum(F.col("forecast") * w)
    return used.groupBy(*keys).agg(combined.alias("forecast")).withColumn("model", F.lit(model))


def log_residuals(
    df: DataFrame, y: str, fitted: str, name: str = "residual", keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Centred log multipliers ln((y+1)/(ŷ+1)) − series mean."""
    raw = F.ln(F.try_divide(F.col(y) + 1, F.col(fitted) + 1))
    return df.withColumn("_r", raw).withColumn(
        name, F.col("_r") - F.avg("_r").over(whole(keys))
    ).drop("_r")


def stacked_regression(
    df: DataFrame,
    first_fit: DataFrame,
    y: str,
    xs: Sequence[str],
    fitted: str = "fitted",
    keys: Sequence[str] = (SERIES,),
    name: str = "prediction",
) -> DataFrame:
    """Second-level regression on a first model's one-step fits and further features."""
    table = df.join(first_fit.select(*keys, PERIOD, fitted), [*keys, PERIOD])
    regressors = [fitted, *xs]
    model = fit_linear(table, y, regressors, keys)
    return predict_linear(table, model, regressors, keys, name)
