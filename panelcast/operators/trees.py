"""Boosted regression trees with an exact split search, as aggregates and joins.

Every round fits a tree to what is left of the target.  Candidates of a split are all distinct values of
all features: rows are merged by node, feature and value, running sums along the values
(:mod:`panelcast.operators.ranges`) give the squared error that each cut saves, and the best cut of
each node is taken; ties go to the first feature, then to the smaller threshold.  Trees are rows, so
predicting is a join for each level with a table of at most 2**depth rows a tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.ranges import running_sums
from panelcast.sources.tables import materialise


def _long(rows: DataFrame, xs: Sequence[str]) -> DataFrame:
    """(node, feature, value, n, r): rows merged by the values of each feature; null features stay out."""
    entries = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(x).cast("double").alias("value")) for i, x in enumerate(xs)])
    long = rows.select("_node", "_r", F.inline(F.filter(entries, lambda e: e["value"].isNotNull())))
    return long.groupBy("_node", "feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("r"))


def best_splits(rows: DataFrame, xs: Sequence[str], min_rows: int = 1, parts: int | None = None) -> DataFrame:
    """(_node, feature, threshold, gain) of the best cut of each node of *rows* (_node, _r, features).

    Rows with value ≤ threshold go left.  A node without a cut that saves anything has no row.
    """
    sums = running_sums(_long(rows, xs), ["_node", "feature"], ["value"], ["n", "r"], parts)
    left, right = F.col("n_upto"), F.col("n_all") - F.col("n_upto")
    rest = F.col("r_all") - F.col("r_upto")
    gain = F.col("r_upto") * F.col("r_upto") / left + rest * rest / right - F.col("r_all") * F.col("r_all") / F.col("n_all")
    cuts = sums.filter((left >= min_rows) & (right >= min_rows)).withColumn("gain", F.round(gain, 9)).filter("gain > 0")
    best = F.min(F.struct((-F.col("gain")).alias("loss"), "feature", F.col("value").alias("threshold"))).alias("s")
    return cuts.groupBy("_node").agg(best).select("_node", "s.feature", "s.threshold", (-F.col("s.loss")).alias("gain"))


def _value_of(xs: Sequence[str]) -> Column:
    """The value of the feature that a split names; a null goes right."""
    return F.get(F.array(*[F.col(x).cast("double") for x in xs]), F.col("feature"))


def _descend(rows: DataFrame, splits: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Rows moved to the child of their node; those of a node without a split stay."""
    met = rows.join(splits.select("_node", "feature", "threshold"), "_node", "left")
    goes_left = F.coalesce(_value_of(xs) <= F.col("threshold"), F.lit(False))
    child = F.when(F.col("threshold").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + F.when(goes_left, 0).otherwise(1))
    return met.withColumn("_node", child.cast("long")).drop("feature", "threshold")


def fit_trees(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    rounds: int = 2,
    depth: int = 1,
    step: float = 0.1,
    min_rows: int = 1,
    parts: int | None = None,
) -> DataFrame:
    """(tree, node, feature, threshold, value): tree 0 is the mean; node 1 is a root, 2k and 2k + 1 children.

    Splits have a feature and a threshold, leaves a value, already times *step*.  Rows without a target
    stay out; without any the result has no rows.
    """
    rows = df.select(*[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias("_y")).filter("_y is not null")
    rows = materialise(rows)
    start = rows.agg(F.avg("_y").alias("value")).filter("value is not null")
    model = materialise(start.select(F.lit(0).alias("tree"), F.lit(1).cast("long").alias("node"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), "value"))
    state = materialise(rows.withColumn("_r", F.col("_y") - model.select("value").scalar()).drop("_y"))
    for tree in range(1, rounds + 1):
        at = state.withColumn("_node", F.lit(1).cast("long"))
        for _ in range(depth):
            splits = materialise(best_splits(at, xs, min_rows, parts))
            named = splits.select(F.lit(tree).alias("tree"), F.col("_node").alias("node"), "feature", "threshold", F.lit(None).cast("double").alias("value"))
            model = model.unionByName(named)
            at = materialise(_descend(at, splits, xs))
        leaves = materialise(at.groupBy("_node").agg((F.avg("_r") * step).alias("value")))
        model = model.unionByName(
            leaves.select(F.lit(tree).alias("tree"), F.col("_node").alias("node"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), "value")
        )
        state = materialise(at.join(leaves, "_node").withColumn("_r", F.col("_r") - F.col("value")).drop("_node", "value"))
    return materialise(model)


def predict_trees(df: DataFrame, model: DataFrame, xs: Sequence[str], rounds: int, depth: int, name: str = "prediction") -> DataFrame:
    """*df* with *name*: the sum of the leaves that a row reaches.

    The model enters as one map for each tree, so a row is neither multiplied nor shuffled; trees are
    bounded by rounds · 2**(depth + 1) nodes.
    """
    nodes = F.map_from_entries(F.collect_list(F.struct((F.col("tree") * F.lit(1 << (depth + 1)) + F.col("node")).alias("k"), F.struct("feature", "threshold", "value").alias("v"))))
    rows = df.withColumn("_m", model.agg(nodes.alias("m")).select("m").scalar())
    total = F.element_at("_m", F.lit(1).cast("long"))["value"]
    for tree in range(1, rounds + 1):
        base = F.lit(tree * (1 << (depth + 1)))
        rows = rows.withColumn("_n", F.lit(1).cast("long"))
        for _ in range(depth):
            here = F.element_at("_m", base + F.col("_n"))
            feature = F.get(F.array(*[F.col(x).cast("double") for x in xs]), here["feature"])
            child = 2 * F.col("_n") + F.when(F.coalesce(feature <= here["threshold"], F.lit(False)), 0).otherwise(1)
            rows = rows.withColumn("_n", F.when(here["threshold"].isNull(), F.col("_n")).otherwise(child).cast("long"))
        rows = rows.withColumn(f"_l{tree}", F.element_at("_m", base + F.col("_n"))["value"])
        total = total + F.col(f"_l{tree}")
    return rows.withColumn(name, total).drop("_m", "_n", *[f"_l{t}" for t in range(1, rounds + 1)])
