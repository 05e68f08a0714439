"""Registered queries for windows, outliers, feature pipelines and scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultcast.operators import windows as W
from faultcast.operators.columns import numeric_columns
from faultcast.operators.stats import drop_zscore_rows, robust_scale, standard_scale, winsorize_iqr, zscore_to_median
from faultcast.plans import spec
from faultcast.plans.features import (base_features, feature_columns, forecast_features, lean_temporal,
                                      rich_temporal)
from faultcast.plans.queries import query, training_fx, weather_fx3
from faultcast.plans.training import daily_fault_counts
from faultcast.plans.weather import daily_weather
from faultcast.session import stage
from faultcast.sources import fixtures as fx

KEYS = ["system"]
T = spec.TEMP_AVG


def _series(spark, sf_dir):
    return training_fx(spark, sf_dir).select("system", "date", T, spec.HUMIDITY_AVG, "season")


@query("rolling_mean")
def q_rolling_mean(spark, sf_dir):
    """3/7/14-row means of temperature per system."""
    s = _series(spark, sf_dir)
    return s.select("system", "date", *[W.rolling(T, k, "mean", KEYS).alias(f"mean_{k}") for k in (3, 7, 14)])


@query("rolling_std")
def q_rolling_std(spark, sf_dir):
    """7-row sample std, one-value frame -> 0."""
    s = _series(spark, sf_dir)
    return s.select("system", "date", W.rolling_std0(T, 7, KEYS).alias("std_7"))


@query("rolling_minmax")
def q_rolling_minmax(spark, sf_dir):
    """7-row min and max."""
    s = _series(spark, sf_dir)
    return s.select("system", "date", W.rolling(T, 7, "min", KEYS).alias("min_7"), W.rolling(T, 7, "max", KEYS).alias("max_7"))


@query("diff1")
def q_diff1(spark, sf_dir):
    """Change from the previous row, first -> 0."""
    s = _series(spark, sf_dir)
    return s.select("system", "date", W.diff1(T, KEYS).alias("change"))


@query("diff2")
def q_diff2(spark, sf_dir):
    """Change of the change, first -> 0."""
    s = _series(spark, sf_dir)
    return s.select("system", "date", W.diff2(T, KEYS).alias("acceleration"))


@query("rolling_trend")
def q_rolling_trend(spark, sf_dir):
    """3-row mean minus its previous value."""
    s = _series(spark, sf_dir)
    return s.select("system", "date", W.rolling_trend(T, 3, KEYS).alias("trend_3"))


@query("season_diff")
def q_season_diff(spark, sf_dir):
    """Change from the previous row of the same season (spans years)."""
    s = _series(spark, sf_dir)
    return s.select("system", "date", "season", W.season_diff(T, "season", KEYS).alias("season_change"))


@query("extreme_flag")
def q_extreme_flag(spark, sf_dir):
    """Outside the per-system 5-95 % band."""
    s = _series(spark, sf_dir).select("system", "date", T)
    return W.extreme_flag(s, T, 0.05, 0.95, KEYS, out="extreme")


@query("winsorize")
def q_winsorize(spark, sf_dir):
    """O1: IQR winsorizing of every numeric column except the target, per system."""
    t = training_fx(spark, sf_dir)
    return winsorize_iqr(t, numeric_columns(t, exclude=[spec.TARGET]), 1.5, KEYS)


@query("zscore_median")
def q_zscore_median(spark, sf_dir):
    """O2: |z| >= 3 -> median in every feature, per system."""
    t = training_fx(spark, sf_dir)
    return zscore_to_median(t, spec.daily_columns(), 3.0, KEYS)


@query("null_group_stats")
def q_null_group_stats(spark, sf_dir):
    """O1, O2, E6, E7, W9 on a key that is NULL for some rows (text lengths by quality label): NULL is a group."""
    t = stage(fx.quality_lengths(spark, sf_dir))
    keys = ["quality"]
    out = W.extreme_flag(t, "n_chars", keys=keys)
    for name, x in (("winsorized", winsorize_iqr(t, ["n_chars"], 1.5, keys)), ("cleaned", zscore_to_median(t, ["n_chars"], 3.0, keys)),
                    ("standard", standard_scale(t, ["n_chars"], keys=keys)), ("robust", robust_scale(t, ["n_chars"], keys=keys))):
        out = out.join(x.select("ticket_id", F.col("n_chars").alias(name)), "ticket_id")
    return out


@query("zscore_rows")
def q_zscore_rows(spark, sf_dir):
    """O3: daily fault counts with |z| <= 6 per system."""
    return drop_zscore_rows(daily_fault_counts(fx.tickets(spark, sf_dir)), spec.TARGET, 6.0, KEYS, via_window=True)


def features_base_fx(spark, sf_dir):
    return stage(base_features(training_fx(spark, sf_dir), keys=KEYS))


@query("features_base")
def q_features_base(spark, sf_dir):
    """E2 on the training table."""
    return features_base_fx(spark, sf_dir)


@query("features_rich")
def q_features_rich(spark, sf_dir):
    """E2 + E3 (the cooling feature set)."""
    return rich_temporal(features_base_fx(spark, sf_dir), KEYS)


@query("features_lean")
def q_features_lean(spark, sf_dir):
    """E2 + E4 (the heating feature set)."""
    return lean_temporal(features_base_fx(spark, sf_dir), KEYS)


@query("scale_standard")
def q_scale_standard(spark, sf_dir):
    """Standard scaling of the rich features per system (fit on the same rows)."""
    x = stage(rich_temporal(features_base_fx(spark, sf_dir), KEYS))
    return standard_scale(x, [c for c in numeric_columns(x) if c in feature_columns(x)], None, KEYS)


@query("scale_robust")
def q_scale_robust(spark, sf_dir):
    """Robust scaling of the lean features per system (fit on the same rows)."""
    x = stage(lean_temporal(features_base_fx(spark, sf_dir), KEYS))
    return robust_scale(x, [c for c in numeric_columns(x) if c in feature_columns(x)], None, KEYS)


def rich_feature_names(spark, sf_dir) -> list[str]:
    """The training feature list of the rich set, derived from schemas only (no job runs)."""
    from faultcast.plans.training import fault_training_table
    from faultcast.plans.weather import daily_weather

    schema = fault_training_table(fx.tickets(spark, sf_dir), daily_weather(fx.line_weather(spark, sf_dir))).schema
    empty = spark.createDataFrame([], schema)
    return feature_columns(rich_temporal(base_features(empty, keys=KEYS), KEYS))


@query("forecast_features")
def q_forecast_features(spark, sf_dir):
    """Daily weather -> trends -> E2 -> E3 -> standard scale refit on the rows -> aligned to the training list."""
    expected = rich_feature_names(spark, sf_dir)
    return forecast_features(weather_fx3(spark, sf_dir), "rich", keys=(), expected=expected)


@query("forecast_features_sites")
def q_forecast_features_sites(spark, sf_dir):
    """E8 by site: windows, bounds and scaling of every site's own days."""
    return site_features(fx.line_weather(spark, sf_dir, site=True), expected=rich_feature_names(spark, sf_dir))


def site_features(readings, variant="rich", expected=None):
    """E8 of every site; rows are dealt out once, by the site as E3 and E4 fill it (as text, which they leave alone)."""
    readings = readings.withColumn("_at", F.coalesce("site", F.lit(0)).cast("string"))
    keys = ["_at", "site"]
    daily = daily_weather(readings, keys=keys, deal=["_at"])
    return forecast_features(daily, variant, keys=keys, expected=expected, scale_keys=["_at"]).drop("_at")
