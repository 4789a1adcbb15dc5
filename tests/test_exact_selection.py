"""Exact quantiles from brackets: groups far larger than the sketch, ties, nulls, and a profile of columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import aggregate
from panelcast.operators.aggregate import exact_quantiles, profile

PROBS = {"q0": 0.0, "q01": 0.013, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q1": 1.0}


def _groups(seed):
    rng = np.random.default_rng(seed)
    return {
        "ties": rng.integers(0, 7, 5000).astype(float),
        "normal": rng.normal(size=9000),
        "heavy": rng.pareto(0.5, 4000),
        "constant": np.full(3000, 2.5),
        "edge": rng.integers(0, 3, 201).astype(float),
        "small": rng.normal(size=5),
        "one": np.array([4.0]),
        None: rng.normal(size=2500) * 1e6,
    }


@pytest.mark.parametrize("seed, accuracy", [(1, 50), (2, 50), (3, 13), (4, 10_000)])
def test_quantiles_are_exact_whatever_the_sketch(spark, seed, accuracy):
    groups = _groups(seed)
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("nulls", None), ("ties", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", PROBS, accuracy).collect()}
    assert set(got) == {*groups, "nulls"} and got["nulls"]["q50"] is None
    for g, v in groups.items():
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12), (g, name)


def test_quantiles_without_keys_and_without_rows(spark):
    v = np.random.default_rng(5).normal(size=30_000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    row = exact_quantiles(df, [], "v", PROBS, 40).first()
    assert [row[n] for n in PROBS] == pytest.approx([np.quantile(v, p) for p in PROBS.values()])
    empty = df.filter("v > 1e9")
    assert exact_quantiles(empty, [], "v", {"m": 0.5}).first()["m"] is None


def test_only_brackets_are_shuffled(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.rand(7).alias("v"))
    out = exact_quantiles(df, ["g"], "v", {"m": 0.5}, 1000)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_percentile_approx" in plan and "RangePartitioning" not in plan


def test_profile_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "ACCURACY", 60)
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=4000), rng.integers(0, 5, 4000)
    rows = [(float(x), int(y) if k % 10 else None, None) for k, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    got = {r["column"]: r for r in profile(df, ["a", "b", "c"]).collect()}
    kept = np.array([y for k, y in enumerate(b) if k % 10])
    for name, v in (("a", a), ("b", kept)):
        r = got[name]
        want = [4000, 4000 - len(v), v.min(), *np.quantile(v, [0.25, 0.5, 0.75]), v.max(), v.mean()]
        assert [r[c] for c in ("n", "nulls", "min", "q25", "median", "q75", "max", "mean")] == pytest.approx(want)
    assert (got["c"]["n"], got["c"]["nulls"], got["c"]["median"]) == (4000, 4000, None)
    assert profile(df.select("c"), ["c"]).first()["q25"] is None
