"""By site: the raw columns are exchanged once, and no later step by site exchanges, joins back or stages anything."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultcast.operators import stats as S
from faultcast.operators import windows as W
from faultcast.plans import spec
from faultcast.plans.queries_features import site_features
from faultcast.plans.weather import daily_parts, daily_weather, stats_of_parts, weather_of_stats


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(7)
    cols = sorted(set(spec.HOURLY.values()))
    start = dt.datetime(2023, 11, 20)
    rows = [(site, start + dt.timedelta(hours=9 * i), *[None if rng.random() < 0.1 else rng.randrange(-40, 160) / 4.0 for _ in cols])
            for site, n in ((1, 120), (2, 60), (3, 1), (None, 30)) for i in range(n)]
    schema = "site long, ts timestamp_ntz, " + ", ".join(f"`{c}` double" for c in cols)
    return spark.createDataFrame(rows, schema)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_weather_by_site_exchanges_raw_rows_once(readings):
    got = daily_weather(readings, keys=["site"])
    assert _plan(got).count("Exchange ") == 1
    want = weather_of_stats(stats_of_parts(daily_parts(readings, "ts", ["site"]), ["site"]), ["site"])
    assert got.columns == want.columns
    key = lambda df: sorted((str(r["site"]), str(r["date"]), str(r)) for r in df.collect())
    assert key(got) == key(want)


def test_features_by_site_are_windows_only(readings):
    for variant in ("rich", "lean"):
        p = _plan(site_features(readings, variant))
        assert "Join" not in p and p.count("Exchange ") == 1


def test_missing_site_is_scaled_with_site_zero(spark, readings):
    # E3 fills numbers, the site's too, before scaling: a null site and site 0 share their scale
    zero = readings.withColumn("site", F.when(F.col("site") == 2, 0).otherwise(F.col("site")))
    x = site_features(zero, "lean").filter("site = 0")
    assert x.count() == site_features(zero.filter("site is null or site = 0"), "lean").count()
    r = site_features(zero, "rich").filter("site = 0").agg(F.avg("temp_avg").alias("m"), F.stddev_pop("temp_avg").alias("s")).first()
    assert abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9


def test_statistics_by_window_equal_the_joined_ones(readings):
    x = readings.select("site", "ts", F.col("temperature").alias("a"), F.col("humidity").alias("b"), F.lit(2.0).alias("c"))
    cols = ["a", "b", "c"]
    for f in (lambda **k: S.winsorize_iqr(x, cols, 1.5, ["site"], **k), lambda **k: W.extreme_flag(x, "a", keys=["site"], **k),
              lambda **k: S.standard_scale(x, cols, keys=["site"], **k), lambda **k: S.robust_scale(x, cols, keys=["site"], **k)):
        one, two = f(via_window=True), f()
        assert one.columns == two.columns
        key = lambda df: sorted((str(r["site"]), str(r["ts"]), *[None if r[c] is None else round(r[c], 9) for c in df.columns[2:]].__repr__())
                                for r in df.collect())
        assert key(one) == key(two)
