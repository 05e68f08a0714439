"""Windows without keys block by block against one ordered window."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from faultcast.functions.scalars import sql_select
from faultcast.operators import windows as W
from faultcast.operators.blocks import BLOCK, drop_halo, split, with_halo


def series(spark, n, seed=3, runs=()):
    """Days with gaps, null values and seasons that come back late or are missing."""
    rnd = random.Random(seed)
    day, rows = dt.date(2019, 1, 1), []
    for i in range(n):
        day += dt.timedelta(days=rnd.choice([1, 1, 1, 2, 40]))
        season = None if rnd.random() < 0.05 else (4 if i < 3 or i == n - 1 else 1 + i * 3 // max(n, 1))
        rows.append((day, rnd.choice([None, *[float(v) / 4 for v in range(60)]]), season))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "date date, temp_avg double, season int")


def both(df, back, blocks):
    def exprs(keys):
        out = []
        for k in range(1, back + 1):
            out += [f"{W.rolling_sql('temp_avg', k, fn, keys)} AS {fn}{k}" for fn in ("mean", "std", "min", "max")]
            out.append(f"{W.rolling_trend_sql('temp_avg', k, keys)} AS trend{k}")
        return ["date", "temp_avg", "season", *out, f"{W.diff1_sql('temp_avg', keys)} AS d1", f"{W.diff2_sql('temp_avg', keys)} AS d2",
                f"{W.season_diff_sql('temp_avg', 'season', keys)} AS s"]
    cut = split(df, "date", back, blocks)
    got = sql_select(with_halo(cut, "date", back, "season"), [*exprs([BLOCK]), "_halo"])
    return cut, sorted(map(tuple, drop_halo(got).collect()), key=repr), sorted(map(tuple, sql_select(df, exprs([])).collect()), key=repr)


@pytest.mark.parametrize("n,back,blocks", [(200, 14, 7), (200, 3, 40), (40, 14, 16), (30, 4, 60), (5, 14, 8), (1, 2, 4), (0, 2, 4)])
def test_blocks_equal_one_window(spark, n, back, blocks):
    cut, got, want = both(series(spark, n, seed=n), back, blocks)
    assert got == want and len(got) == n
    counts = {int(r[0]): r[1] for r in cut.groupBy(BLOCK).count().collect()}
    # every block but the last holds what the next one looks back at; with rows enough there are several
    assert all(counts[b] >= back for b in counts if b != max(counts))
    assert n < 200 or len(counts) > 4


def test_a_day_without_date_comes_first(spark):
    df = series(spark, 60).unionByName(spark.createDataFrame([(None, 7.0, 1)], "date date, temp_avg double, season int"))
    _, got, want = both(df, 3, 8)
    assert got == want


def test_small_ranges_make_one_block_without_halo(spark):
    df = series(spark, 50)
    cut = split(df, "date", 5)
    assert {r[0] for r in cut.select(BLOCK).collect()} == {"0"}
    assert "Exchange" not in _plan(with_halo(cut, "date", 5, "season"))
    many = split(spark.range(35_000).withColumnRenamed("id", "date"), "date", 5).groupBy(BLOCK).agg(
        F.count("*"), F.min("date"), F.max("date")).orderBy(F.col(BLOCK).cast("int")).collect()
    assert all(r[1] >= 10_000 for r in many[:-1]) and sum(r[1] for r in many) == 35_000
    assert all(a[3] + 1 == b[2] for a, b in zip(many, many[1:]))


def test_the_number_of_blocks_may_get_lost(spark):
    cut = split(series(spark, 120), "date", 5, 9)
    bare = cut.withColumn(BLOCK, F.concat(F.col(BLOCK)).alias(BLOCK, metadata={}))
    a, b = (sorted(map(tuple, with_halo(x, "date", 5, "season").collect()), key=repr) for x in (cut, bare))
    assert a == b and len(a) > 120


def test_halo_is_bounded(spark):
    # a season that is seen once and never again serves all later blocks by one row each
    df = series(spark, 300, seed=9)
    h = with_halo(split(df, "date", 5, 20), "date", 5, "season")
    most = h.filter("_halo").groupBy(BLOCK).count().agg(F.max("count")).first()[0]
    assert most <= 5 + 5


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _windows_in_one_task(plan):
    """Windows whose rows come from an exchange into a single partition."""
    return re.findall(r"Window \[[^\n]*\n(?:[^\n]*Sort [^\n]*\n)?[^\n]*SinglePartition", plan)


def test_no_window_in_one_task(spark, small_dir):
    from faultcast.plans.features import (BASE_BACK, RICH_BACK, base_features, forecast_trends, lean_temporal, rich_temporal)
    from faultcast.plans.weather import daily_weather
    from faultcast.sources import fixtures as fx
    assert _windows_in_one_task(_plan(daily_weather(fx.line_weather(spark, small_dir), blocks=0)))
    for blocks in (None, 6):
        daily = daily_weather(fx.line_weather(spark, small_dir), blocks=blocks)
        assert "Window [" in _plan(daily) and "SinglePartition" not in _plan(daily)
    cut = split(daily, "date", max(BASE_BACK, RICH_BACK), 6)
    base = base_features(forecast_trends(cut), target="_none_", keys=())
    for x in (base, rich_temporal(base, ()), lean_temporal(base, ())):
        assert "Window [" in _plan(x) and not _windows_in_one_task(_plan(x))


@pytest.mark.parametrize("variant", ["rich", "lean"])
def test_forecast_features_do_not_depend_on_blocks(spark, small_dir, variant):
    from faultcast.plans.features import forecast_features
    from faultcast.plans.queries import weather_fx3
    daily = weather_fx3(spark, small_dir).orderBy("date").limit(200)
    one, many = (forecast_features(daily, variant, scale=False, blocks=b) for b in (1, 9))
    assert one.columns == many.columns and BLOCK not in one.columns
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
