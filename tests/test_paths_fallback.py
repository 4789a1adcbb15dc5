"""Draws that any engine can replay, fallback pools, and series without residuals."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from panelcast.operators.paths import bootstrap_paths, draw
from panelcast.schema import PERIOD, SERIES

DAY0 = dt.date(2024, 1, 1)


def _index(series, sim, h, seed, n):
    return int(hashlib.md5(f"{series}|{sim}|{h}|{seed}".encode()).hexdigest()[:15], 16) % n


def test_draws_are_md5_of_their_keys(spark):
    df = spark.range(60).select(
        F.concat(F.lit("sé"), F.col("id") % 7).alias("s"), (F.col("id") % 11).alias("m"), F.col("id").cast("int").alias("h")
    )
    rows = df.withColumn("i", draw(F.col("s"), F.col("m"), F.col("h"), 9, F.lit(13))).collect()
    assert all(r.i == _index(r.s, r.m, r.h, 9, 13) for r in rows) and len({r.i for r in rows}) > 9


@pytest.fixture(scope="module")
def tables(spark):
    days = [DAY0 + dt.timedelta(days=7 * k) for k in range(9)]
    residuals = [("full", d, 0.1 * k - 0.3) for k, d in enumerate(days)] + [("short", days[0], 0.5), ("short", days[1], None)]
    levels = [("short", d, float(k)) for k, d in enumerate(days)] + [("none", days[3], 7.0), ("low", days[0], -4.0)]
    forecast = [(s, h, days[0] + dt.timedelta(days=70 + 7 * h), 10.0) for s in ("full", "short", "none", "low", "bare") for h in (1, 2)]
    return (
        spark.createDataFrame(forecast, "series string, h int, period date, forecast double"),
        spark.createDataFrame(residuals, "series string, period date, residual double"),
        spark.createDataFrame(levels, "series string, period date, level double"),
    )


@pytest.mark.parametrize("parts, blocks", [(1, 1), (16, 1), (3, 4)])
def test_short_series_draw_from_their_levels(tables, parts, blocks):
    forecast, residuals, levels = tables
    out = bootstrap_paths(
        forecast.repartition(parts), residuals.repartition(parts), 12, seed=3, mode="multiply", blocks=blocks,
        fallback=levels.repartition(parts), min_residuals=4,
    ).collect()
    got = {(r[SERIES], r["sim"], r["h"]): r["value"] for r in out}
    assert len(out) == len(got) == 5 * 12 * 2 and all(r[PERIOD] is not None for r in out)
    for (s, sim, h), v in got.items():
        if s == "full":
            assert v == pytest.approx(10.0 * math.exp(0.1 * _index(s, sim, h, 3, 9) - 0.3))
        elif s == "short":
            assert v == float(_index(s, sim, h, 3, 9))
        else:
            assert v == {"none": 7.0, "low": 0.0, "bare": None}[s]


def test_series_without_residuals_stay_with_null_values(tables):
    forecast, residuals, _ = tables
    out = bootstrap_paths(forecast, residuals, 3).collect()
    assert {r[SERIES] for r in out if r["value"] is None} == {"none", "low", "bare"}
    assert len(out) == 5 * 3 * 2
