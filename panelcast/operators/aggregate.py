"""Aggregates: totals, strict sums, exact quantiles, last states, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.functions.exprs import strict_sum
from panelcast.schema import PERIOD, SERIES, STAGES

TOTAL = "TOTAL"


def period_totals(
    df: DataFrame,
    values: Sequence[str] = STAGES,
    keys: Sequence[str] = (PERIOD,),
    strict: bool = False,
) -> DataFrame:
    """Sum over series; with *strict* a null makes the whole group null."""
    how = strict_sum if strict else F.sum
    return df.groupBy(*keys).agg(*[how(v).alias(v) for v in values])


def with_total_rows(
    df: DataFrame, values: Sequence[str] = STAGES, keys: Sequence[str] = (PERIOD,)
) -> DataFrame:
    """Rows by series plus one TOTAL row per key, in one pass over the data."""
    grouped = df.groupingSets(
        [[*[F.col(k) for k in keys], F.col(SERIES)], [F.col(k) for k in keys]],
        *[F.col(k) for k in keys],
        F.col(SERIES),
    ).agg(F.grouping(SERIES).alias("_total"), *[F.sum(v).alias(v) for v in values])
    label = F.when(F.col("_total") == 1, F.lit(TOTAL)).otherwise(F.col(SERIES))
    return grouped.select(*keys, label.alias(SERIES), *values)


def last_state(
    df: DataFrame, values: Sequence[str] = STAGES, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Values at each key's last period; an aggregate, so no sort and no ranking."""
    state = F.max_by(F.struct(PERIOD, *values), PERIOD).alias("s")
    return df.groupBy(*keys).agg(state).select(*keys, "s.*")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact interpolated quantiles where a group is bounded by design.

    For path and calendar groups only (at most paths or periods per group): the buffer of
    ``percentile`` holds a group's distinct values.  ``exact_quantiles`` is the form for
    groups of any size.
    """
    q = F.percentile(F.col(value), F.array(*[F.lit(p) for p in probs.values()])).alias("_q")
    return (
        df.groupBy(*keys)
        .agg(*extra, q)
        .select("*", *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
        .drop("_q")
    )


#: Sketch entries: a quantile's bracket is about 6 / ACCURACY of its group.
ACCURACY = 10_000


def _sketch(value: str, probs: Sequence[float], accuracy: int) -> list[Column]:
    """Count of the values, and for each prob the ends of a bracket that holds its exact quantile.

    The sketch is mergeable and wrong by at most 1 / accuracy of the ranks, the bracket reaches over
    three times as much on both sides.  A group of a few sketch sizes is its own bracket.
    """
    margin = 3.0 / accuracy
    at = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    n = F.count(value)
    ends = F.percentile_approx(value, at, accuracy)
    whole = n <= 4 * accuracy
    lows = [F.when(whole, F.min(value)).otherwise(ends[i]).alias(f"_lo{i}") for i in range(len(probs))]
    highs = [F.when(whole, F.max(value)).otherwise(ends[len(probs) + i]).alias(f"_hi{i}") for i in range(len(probs))]
    return [n.alias("_n"), *lows, *highs]


def _selected(inside: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles from merged values and the counts below each bracket.

    *inside* has (keys, _v, _c, _n, _b{i}, _lo{i}, _hi{i}): distinct values with their counts, where _v is
    null for all values outside the brackets, and how many of the counted ones are below bracket i.
    """
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked, out = {}, []
    for i, (name, p) in enumerate(probs.items()):
        met = F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        below = F.sum(f"_b{i}").over(group)
        ranked[f"_m{i}"] = met
        ranked[f"_r{i}"] = below + F.coalesce(F.sum(F.when(met, F.col("_c"))).over(before), F.lit(0))
        at = F.lit(float(p)) * (F.col("_n") - 1)

        def value_at(rank: Column, i: int = i) -> Column:
            first = F.col(f"_r{i}")
            return F.max(F.when(F.col(f"_m{i}") & (rank >= first) & (rank < first + F.col("_c")), F.col("_v")))

        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        missed = (F.max("_n") > 0) & (low.isNull() | high.isNull())
        exact = low + F.max(at - F.floor(at)) * (high - low)
        out.append(F.when(missed, F.raise_error(F.lit("quantile outside its bracket"))).otherwise(exact).alias(name))
    rows = inside.select("*", *[c.alias(n) for n, c in ranked.items()])
    return rows.groupBy(*keys).agg(*out)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Exact interpolated quantiles for groups of any size, in two passes.

    The first pass keeps a mergeable sketch of each group, which gives every wanted rank a bracket of
    values.  The second counts what is below the brackets and merges equal values inside them, all on
    the map side, so that only the brackets are shuffled and sorted: 6 / *accuracy* of a group's distinct
    values for each prob.  A group that holds nulls only keeps its row.
    """
    keys, wanted = list(keys), list(probs.values())
    rows = df.select(*keys, F.col(value).alias("_x"))
    found = rows.groupBy(*keys).agg(*_sketch("_x", wanted, accuracy))
    names = [c for c in found.columns if c not in keys]
    if keys:
        rows = _null_safe(rows, found, keys, "inner")
    else:  # one row: a scalar subquery, no join
        bounds = found.select(F.struct(*names)).scalar()
        rows = rows.withColumn("_s", bounds).select("_x", "_s.*")
    near = reduce(lambda a, b: a | b, [F.col("_x").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(wanted))])
    merged = rows.groupBy(*keys, F.when(near, F.col("_x")).alias("_v")).agg(
        F.count("_x").alias("_c"),
        *[F.count_if(F.col("_x") < F.col(f"_lo{i}")).alias(f"_b{i}") for i in range(len(wanted))],
        *[F.first(c).alias(c) for c in names],
    )
    return _selected(merged, keys, probs)


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join in which a NULL key meets a NULL key; the key columns come once."""
    other = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(other, same, how).drop(*[f"_on_{c}" for c in on])


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column: rows, nulls, min, quartiles, mean, max."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    wanted = list(probs.values())
    first = numbers.agg(
        *[
            F.struct(
                F.count(F.lit(1)).alias("n"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                F.min(c).alias("min"),
                F.avg(c).alias("mean"),
                F.max(c).alias("max"),
                *_sketch(c, wanted, ACCURACY),
            ).alias(c)
            for c in columns
        ]
    ).first()  # one row of bounds
    # values inside a bracket, and for each column how many are below each bracket
    bounds = {c: [(first[c][f"_lo{i}"], first[c][f"_hi{i}"]) for i in range(len(wanted))] for c in columns}
    used = [c for c in columns if first[c]["_n"]]

    def near(c: str) -> Column:
        return reduce(lambda a, b: a | b, [F.col(c).between(F.lit(lo), F.lit(hi)) for lo, hi in bounds[c]])

    entries = F.array(*[F.when(near(c), F.struct(F.lit(c).alias("column"), F.col(c).alias("_v"))) for c in used])
    spark = df.sparkSession
    facts = [(c, *(first[c][k] for k in ("n", "nulls", "min", "mean", "max", "_n")), *[x for b in bounds[c] for x in b]) for c in columns]
    names = ["_n", *[f"_{end}{i}" for i in range(len(wanted)) for end in ("lo", "hi")]]
    kinds = "column string, n long, nulls long, min double, mean double, max double, _n long"
    facts = spark.createDataFrame(facts, kinds + "".join(f", {x} double" for x in names[1:]))
    if not used:
        return facts.select("column", "n", "nulls", "min", *[F.lit(None).cast("double").alias(q) for q in probs], "max", "mean")
    inside = numbers.select(F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("_e")).select("_e.*")
    inside = inside.groupBy("column", "_v").agg(F.count(F.lit(1)).alias("_c"))
    below = [
        F.struct(F.lit(c).alias("column"), *[F.count_if(F.col(c) < F.lit(lo)).alias(f"_b{i}") for i, (lo, _) in enumerate(bounds[c])])
        for c in used
    ]
    below = numbers.agg(F.array(*below).alias("_b")).select(F.inline("_b"))
    values = inside.withColumns({f"_b{i}": F.lit(0).cast("long") for i in range(len(wanted))})
    values = values.unionByName(below.withColumns({"_v": F.lit(None).cast("double"), "_c": F.lit(0).cast("long")}))
    quartiles = _selected(values.join(facts.select("column", *names), "column"), ["column"], probs)
    return facts.join(quartiles, "column", "left").select("column", "n", "nulls", "min", *probs, "max", "mean")


def horizon_totals(
    forecast: DataFrame, values: Sequence[str], keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Sum of a forecast, and of its bounds as they stand, over the horizon."""
    return forecast.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
