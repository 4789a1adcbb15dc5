"""Odd inputs: gaps, zeros, short series, duplicates, year ends, null dates, ties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.functions.exprs import clamp, clip_low, is_finite, logit, ratio, strict_sum
from panelcast.functions.weeks import (
    iso_week,
    iso_year,
    monday,
    simple_week,
    sunday_week,
    week_index,
    week_start,
)
from panelcast.operators.calendar import densify, hold_out_fraction, merge_cells, split_at
from panelcast.operators.evaluate import accuracy, leaderboard, metrics, scoreboard, with_errors
from panelcast.operators.fit import beta_moments, choose_by_aicc, fit_linear, random_walk
from panelcast.operators.reshape import pivot_series, screen_features
from panelcast.operators.windows import growth, interpolate, rolling, with_stock
from panelcast.schema import PANEL_SCHEMA, PERIOD, SERIES
from panelcast.sources.adapters import ForecastShape, adapt_forecast, null_periods
from panelcast.sources.panel import Fact, build_panel, contract_violations
from panelcast.sources.tables import read_csv, round_trip, shared_dir, write_table
from panelcast.sources.text import FENCED_BLOCK, explode_blocks, joined_blocks

START = dt.date(2022, 1, 3)
SCHEMA = "series string, period date, x double"


def week(i):
    return START + dt.timedelta(days=7 * i)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_ratios_never_blow_up(spark):
    num, zero = F.lit(3.0), F.lit(0.0)
    r = one(
        spark,
        null=ratio(num, zero),
        zero=ratio(num, zero, "zero"),
        plus=ratio(num, zero, "plus_one"),
        floor=ratio(num, zero, "floor_one"),
        gone=ratio(num, F.lit(None).cast("double"), "floor_one"),
        minus=ratio(num, F.lit(-1.0), "plus_one"),
    )
    assert (r["null"], r["zero"], r["plus"], r["floor"], r["gone"], r["minus"]) == (
        None, 0.0, 3.0, 3.0, None, None,
    )
    with pytest.raises(ValueError):
        ratio(num, zero, "other")


def test_nulls_stay_null(spark):
    gone = F.lit(None).cast("double")
    r = one(spark, a=clip_low(gone), b=clamp(gone, 0, 1), c=logit(F.lit(0.5)), d=is_finite(F.lit(float("nan"))))
    assert (r["a"], r["b"], r["c"], r["d"]) == (None, None, 0.0, False)
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, x double")
    out = {r["g"]: r["s"] for r in df.groupBy("g").agg(strict_sum("x").alias("s")).collect()}
    assert out == {"a": None, "b": 2.0}


def test_year_end_weeks(spark):
    days = [dt.date(2022, 12, 31), dt.date(2023, 1, 1), dt.date(2021, 1, 3), dt.date(2020, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select(
        "d",
        simple_week("d").alias("simple"),
        sunday_week("d").alias("sunday"),
        iso_week("d").alias("iso"),
        iso_year("d").alias("iso_year"),
        week_index("d", 2022).alias("index"),
        monday("d").alias("monday"),
    ).collect()
    for r in got:
        d = r["d"]
        assert r["simple"] == (d.timetuple().tm_yday - 1) // 7 + 1
        assert r["sunday"] == int(d.strftime("%U"))
        assert (r["iso_year"], r["iso"]) == d.isocalendar()[:2]
        assert r["monday"] == d - dt.timedelta(days=d.weekday())
    # the last day of a year and the first of the next share one running index
    assert got[0]["index"] == got[1]["index"] == 53
    assert got[3]["iso"] == 53
    assert one(spark, d=week_start(F.lit(3), dt.date(2022, 1, 3)))["d"] == dt.date(2022, 1, 17)


def test_gaps_at_start_middle_and_end(spark):
    rows = [("a", week(i), v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])]
    out = interpolate(spark.createDataFrame(rows, SCHEMA), ["x"]).orderBy(PERIOD)
    assert [r["x"] for r in out.collect()] == [None, 2.0, 4.0, 6.0, 8.0, None]
    none = interpolate(spark.createDataFrame([("a", week(0), None)], SCHEMA), ["x"])
    assert none.first()["x"] is None


def test_duplicates_merge_before_densify(spark):
    rows = [("a", week(0), 1.0), ("a", week(0), 2.0), ("a", week(2), 4.0)]
    df = merge_cells(spark.createDataFrame(rows, SCHEMA), ["x"])
    out = densify(df, 7, ["x"], fill=0.0).orderBy(PERIOD)
    assert [r["x"] for r in out.collect()] == [3.0, 0.0, 4.0]


def test_short_constant_and_zero_series(spark):
    rows = [("one", week(0), 5.0)] + [("flat", week(i), 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    walk = {(r[SERIES], r["h"]): r for r in random_walk(df, "x", 2).collect()}
    assert walk[("one", 2)]["forecast"] == 5.0 and walk[("one", 2)]["lo80"] is None
    assert walk[("flat", 2)]["lo95"] == walk[("flat", 2)]["hi95"] == 0.0
    t = df.withColumn("t", F.datediff(PERIOD, F.lit(START)).cast("double"))
    fit = {r[SERIES]: r for r in fit_linear(t, "x", ["t"]).collect()}
    assert fit["one"]["coef"] == [0.0] and fit["one"]["intercept"] == 5.0
    assert fit["flat"]["sse"] == 0.0 and fit["flat"]["r2"] is None
    g = df.select(SERIES, growth("x").alias("g"), rolling("x", 3, complete=True).alias("m"))
    assert g.filter("g > 0 or m > 0").count() == 0


def test_empty_panel(spark):
    empty = spark.createDataFrame([], PANEL_SCHEMA)
    assert densify(empty).count() == 0
    assert random_walk(empty, "arrivals", 3).count() == 0
    assert fit_linear(empty, "arrivals", ["applications"]).count() == 0
    assert fit_linear(empty, "arrivals", ["applications"], keys=()).count() == 0
    assert with_stock(empty, "applications", "arrivals", "s").count() == 0


def test_stock_opens_just_high_enough(spark):
    rows = [("a", week(i), float(a), float(b)) for i, (a, b) in enumerate([(1, 4), (2, 3), (9, 1)])]
    df = spark.createDataFrame(rows, "series string, period date, i double, o double")
    out = with_stock(df, "i", "o", "s").orderBy(PERIOD).collect()
    assert [r["s_end"] for r in out] == [1.0, 0.0, 8.0]
    assert [r["s_start"] for r in out] == [4.0, 1.0, 0.0]
    assert [r["s_available"] for r in out] == [5.0, 3.0, 9.0]


def test_fraction_split_rounds_half_even(spark):
    rows = [("a", week(i), 0.0) for i in range(5)]
    out = hold_out_fraction(spark.createDataFrame(rows, SCHEMA), 0.5)
    assert out.filter(F.col("role") == "train").count() == 2  # 2.5 → 2


def test_split_keeps_every_row(spark, weekly):
    train, test = split_at(weekly, week(10))
    assert train.count() + test.count() == weekly.count()
    assert train.agg(F.max(PERIOD)).first()[0] == week(10)


def test_contract_reports_each_violation(spark):
    rows = [("a", week(0), 1.0), ("a", week(0), 2.0), ("b", None, 1.0), ("c", week(0), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    need = {"series": "string", "period": "date", "x": "double", "y": "double"}
    out = {(r["check"], r["series"]): r["n"] for r in contract_violations(df, need, min_periods=1).collect()}
    assert out == {
        ("missing_column:y", None): 0,
        ("duplicate_key", "a"): 1,
        ("null_period", "b"): 1,
        ("short_history", "b"): 0,
        ("null_x", "c"): 1,
    }
    sound = spark.createDataFrame([("a", week(0), 1.0)], SCHEMA)
    assert contract_violations(sound, {"x": "double"}).count() == 0
    wrong = contract_violations(sound, {"x": "string"}).collect()
    assert [r["check"] for r in wrong] == ["wrong_type:x"]


def test_undated_shorter_side_decides(spark):
    calendar = spark.createDataFrame([(week(i),) for i in (3, 1, 2, 1)], "period date")
    vector = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "step int, v double")
    out = adapt_forecast(vector, ForecastShape("m", "v", ordinal="step"), calendar).orderBy(PERIOD)
    assert [(r[PERIOD], r["forecast"]) for r in out.collect()] == [
        (week(1), 1.0), (week(2), 2.0), (week(3), 3.0),
    ]
    with pytest.raises(ValueError):
        adapt_forecast(vector, ForecastShape("m", "v"))


def test_null_dates_are_reported_and_score_null(spark):
    rows = [("bad", None, 1.0), ("bad", None, 2.0), ("good", week(0), 3.0)]
    df = spark.createDataFrame(rows, "model string, period date, forecast double")
    assert [(r["model"], r["n"]) for r in null_periods(df).collect()] == [("bad", 2)]
    actual = spark.createDataFrame([(week(0), 4.0)], "period date, actual double")
    board = scoreboard([df], actual).filter("scope = 'period'").orderBy("rank").collect()
    assert [(r["model"], r["n_forecasts"], r["mae"]) for r in board] == [("good", 1, 1.0), ("bad", 2, None)]


def test_ties_and_zero_actuals(spark):
    rows = [("b", 1.0, 0.0), ("a", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "model string, forecast double, actual double")
    out = metrics(with_errors(df)).withColumn("scope", F.lit("x"))
    ranked = leaderboard(out).orderBy("rank").collect()
    assert [r["model"] for r in ranked] == ["a", "b"]
    assert [r["mape"] for r in ranked] == [50.0, None]
    plain = accuracy(df.withColumn(SERIES, F.lit("s"))).first()
    assert plain["me"] == 0.0 and plain["mpe"] == 50.0


def test_beta_fallbacks(spark):
    rows = [("few", week(i), 0.5) for i in range(4)] + [("flat", week(i), 0.5) for i in range(9)]
    rows += [("ok", week(i), v) for i, v in enumerate([0.1, 0.3, 0.5, 0.2, 0.4, 1.0, 0.0])]
    out = {r[SERIES]: r for r in beta_moments(spark.createDataFrame(rows, SCHEMA), "x").collect()}
    assert (out["few"]["alpha"], out["flat"]["beta"]) == (2.0, 2.0)
    m, v = 0.3, 0.025
    c = m * (1 - m) / v - 1
    assert out["ok"]["alpha"] == pytest.approx(m * c) and out["ok"]["n"] == 5


def test_aicc_needs_room(spark):
    rows = [("a", "big", 1.0, 4.0, 3.0), ("a", "small", 2.0, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "series string, model string, sse double, n double, k double")
    assert choose_by_aicc(df).first()["model"] == "small"


def test_screen_keeps_shape_for_new_rows(spark):
    rows = [(1.0, 2.0, None), (None, 2.0, None), (3.0, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out, kept = screen_features(df, ["a", "b", "c"])
    assert kept == ["a"] and [r["a"] for r in out.collect()] == [1.0, 0.0, 3.0]
    again, _ = screen_features(df.limit(1), ["a", "b", "c"], keep=kept)
    assert again.columns == ["a"]


def test_pivot_leaves_absent_cells_null_on_request(spark):
    df = spark.createDataFrame([("p", week(0), 1.0), ("q", week(1), 2.0)], SCHEMA)
    out = pivot_series(df, {"p": "p", "q": "q"}, ["x"], fill=None).orderBy(PERIOD).collect()
    assert [(r["x_p"], r["x_q"]) for r in out] == [(1.0, None), (None, 2.0)]


def test_tables_survive_a_round_trip(spark, weekly, tmp_path):
    back = round_trip(weekly, partition_by=["series"])
    assert back.schema == weekly.schema
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, weekly.collect()))
    with_null = weekly.withColumn("arrivals", F.when(F.col("arrivals") > 5, F.col("arrivals")))
    path = shared_dir(spark)
    write_table(with_null, path, "csv")
    again = read_csv(spark, path, PANEL_SCHEMA)
    assert sorted(map(str, again.collect())) == sorted(map(str, with_null.collect()))


def test_bad_csv_is_an_error(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("period,series,applications,visas_issued,arrivals\n2022-01-03,a,1,2,oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(f), PANEL_SCHEMA).collect()


def test_fenced_blocks(spark):
    texts = [
        (1, "intro\n```r\nx <- 1\n```\nmid ```R\n y\n``` end"),
        (2, "no block at all"),
        (3, "``` bare ``` and an open ```r\nrest"),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    out = {r["id"]: r["c"] for r in df.select("id", joined_blocks("text").alias("c")).collect()}
    assert out == {1: "x <- 1\n\ny", 2: "no block at all", 3: "bare"}
    rows = explode_blocks(df, "text", FENCED_BLOCK).orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["block"]) for r in rows] == [(1, 0, "x <- 1"), (1, 1, "y"), (3, 0, "bare")]


def test_every_fact_row_opens_its_cell(spark):
    rows = [(1, "click"), (1, "signup"), (2, "click")]
    events = spark.createDataFrame(rows, "user long, kind string").withColumn("day", F.lit("2024-01-01").cast("date"))
    fact = Fact(events, "user", F.col("day"), {"applications": F.col("kind") == "signup"})
    out = {r["series"]: r["applications"] for r in build_panel([fact], ["applications"]).collect()}
    assert out == {"1": 1.0, "2": 0.0}


def test_convolve_rejects_weights_beyond_the_last_lag(spark, weekly):
    from panelcast.operators.project import convolve

    weights = spark.createDataFrame([("a", [0.5, 0.3, 0.2])], "series string, weights array<double>")
    with pytest.raises(Exception, match="weights beyond lag 1"):
        convolve(weekly, weights, "applications", 1, "e").collect()
    out = convolve(weekly, weights, "applications", 2, "e")
    assert out.count() == weekly.count() and out.where("series <> 'a' and e is not null").count() == 0


def test_exact_quantiles_keep_null_groups(spark):
    from panelcast.operators.aggregate import exact_quantiles

    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("b", None), ("c", 5.0)], "g string, v double")
    assert {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {None: 2.0, "b": None, "c": 5.0}


def test_perfect_fit_comes_first_and_unscored_keys_stay(spark):
    rows = [("flat", "mean", 0.0, 9, 1), ("flat", "walk", 2.0, 9, 1), ("short", "mean", 1.0, 1, 2)]
    df = spark.createDataFrame(rows, "series string, model string, sse double, n long, k int")
    assert {r["series"]: r["model"] for r in choose_by_aicc(df).collect()} == {"flat": "mean", "short": None}


def test_weights_stand_at_their_lag(spark):
    from panelcast.plans.panels import weight_arrays

    df = spark.createDataFrame([("a", 0, 0.5), ("a", 3, 0.2)], "series string, k int, w double")
    assert weight_arrays(df).first()["weights"] == [0.5, 0.0, 0.0, 0.2]


def test_unset_shared_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
