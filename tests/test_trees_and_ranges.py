"""Trees against a brute-force search of all splits; running sums and lags across range partitions."""

import numpy as np
import pytest

from panelcast.operators.ranges import previous, running_sums
from panelcast.operators.trees import fit_trees, predict_trees


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(120):
        a, b, c = float(rng.integers(0, 9)), float(rng.normal()), float(rng.integers(0, 3))
        a = None if rng.random() < 0.1 else a
        y = None if rng.random() < 0.05 else (3.0 if (a or 0) > 4 else -1.0) + b * c + rng.normal() / 4
        rows.append((a, b, c, y))
    return rows, spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(3)


def _best(x, r):
    """(gain, feature, threshold) over all features and all distinct values."""
    best = None
    for f in range(x.shape[1]):
        known = ~np.isnan(x[:, f])
        v, rr = x[known, f], r[known]
        for cut in np.unique(v)[:-1]:
            left = v <= cut
            gain = rr[left].sum() ** 2 / left.sum() + rr[~left].sum() ** 2 / (~left).sum() - rr.sum() ** 2 / len(rr)
            key = (-round(gain, 9), f, cut)
            if gain > 1e-9 and (best is None or key < best):
                best = key
    return best


def _grown(x, r, depth, node, split, leaf):
    best = _best(x, r) if depth else None
    if best is None:
        leaf[node] = (r.mean(), len(r))
        return
    split[node] = best[1:]
    left = np.nan_to_num(x[:, best[1]], nan=np.inf) <= best[2]
    _grown(x[left], r[left], depth - 1, 2 * node, split, leaf)
    _grown(x[~left], r[~left], depth - 1, 2 * node + 1, split, leaf)


@pytest.mark.parametrize("rounds, depth, parts", [(3, 1, None), (2, 3, 5)])
def test_trees_equal_brute_force(points, rounds, depth, parts):
    rows, df = points
    xs = ["a", "b", "c"]
    x = np.array([[np.nan if v is None else v for v in row[:3]] for row in rows])
    y = np.array([np.nan if row[3] is None else row[3] for row in rows])
    kept = ~np.isnan(y)
    want = np.full(len(rows), y[kept].mean())
    model = fit_trees(df, "y", xs, rounds, depth, 0.3, parts=parts)
    found = model.collect()
    r = y[kept] - y[kept].mean()
    for tree in range(1, rounds + 1):
        split, leaf = {}, {}
        _grown(x[kept], r, depth, 1, split, leaf)
        got = {n.node: (n.feature, n.threshold) for n in found if n.tree == tree and n.threshold is not None}
        assert got == split

        def reach(v, split=split):
            node = 1
            while node in split:
                f, cut = split[node]
                node = 2 * node + (0 if v[f] <= cut else 1)
            return node

        step = np.array([0.3 * leaf[reach(v)][0] for v in x])
        want += step
        r = r - step[kept]
    got = predict_trees(df, model, xs, rounds, depth).collect()
    key = lambda v: tuple(-1e9 if z is None else z for z in v)
    pairs = {key((p.a, p.b, p.c)): p.prediction for p in got}
    for row, w in zip(rows, want, strict=True):
        assert pairs[key(row[:3])] == pytest.approx(w, abs=1e-9)


def test_trees_without_rows_or_splits(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, y double")
    model = fit_trees(flat, "y", ["a"], 2, 2)
    assert [p.prediction for p in predict_trees(flat, model, ["a"], 2, 2).collect()] == [3.0, 3.0]
    none = fit_trees(flat.filter("a > 5"), "y", ["a"], 1, 1)
    assert none.count() == 0
    assert predict_trees(flat, none, ["a"], 1, 1).first().prediction is None


@pytest.mark.parametrize("parts", [None, 1, 9])
def test_sums_and_lags_cross_partitions(spark, parts):
    rng = np.random.default_rng(8)
    rows = [(g, k, float(rng.integers(-5, 9))) for g, n in (("hot", 400), ("b", 3), (None, 20)) for k in range(n)]
    rows[5] = ("hot", 5, None)
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(4)
    want_sum, want_lag, all_ = {}, {}, {}
    for g in ("hot", "b", None):
        total, before = 0.0, None
        for key, k, v in rows:
            if key == g:
                total += v or 0.0
                want_sum[g, k], want_lag[g, k] = total, before
                before = v
        all_[g] = total
    sums = running_sums(df, ["g"], ["k"], ["v"], parts).collect()
    assert {(r.g, r.k): r.v_upto for r in sums} == want_sum and all(r.v_all == all_[r.g] for r in sums)
    lags = previous(df, ["g"], ["k"], "v", "p", parts).collect()
    assert {(r.g, r.k): r.p for r in lags} == want_lag
    one = previous(df.filter("g = 'hot'").select("k", "v"), [], ["k"], "v", "p", parts).collect()
    assert {("hot", r.k): r.p for r in one} == {k: v for k, v in want_lag.items() if k[0] == "hot"}
