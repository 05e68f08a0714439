"""Registered queries for scans/sinks, column maintenance, statistics, ranking, sets, splits,
scalar functions and model-free evaluation (S1-S6, S8, P1-P14, A9-A15, T1-T5, U1-U2, W8, W10,
W11, M6, M12, M14, M18, J3, F1-F24, E5)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultcast.functions import calendar as cal
from faultcast.functions.scalars import beaufort, cyclic_cos, cyclic_sin, flag_above, flag_below, round_even
from faultcast.operators import columns as P
from faultcast.operators import ranking as R
from faultcast.operators import rollup
from faultcast.operators import stats as S
from faultcast.operators.joins import assemble_predictions
from faultcast.operators.metrics import diagnostics, regression_metrics, vote_weights, weighted_vote
from faultcast.operators.splits import chrono_split, expanding_folds, hash_split
from faultcast.operators.windows import dedupe_first
from faultcast.plans import spec
from faultcast.plans.features import feature_columns, feature_select
from faultcast.plans.models import pick_ensemble
from faultcast.plans.queries import query, training_fx, weather_fx2, weather_fx3
from faultcast.plans.queries_features import features_base_fx
from faultcast.plans.queries_text import classified
from faultcast.plans.training import daily_fault_counts
from faultcast.session import scratch_path
from faultcast.sources import files
from faultcast.sources import fixtures as fx
from faultcast.sources.incremental import land_readings, landed_weather
from faultcast.sources.payload import explode_series, read_payloads

KEYS = ["system"]
HOURLY_SCHEMA = ("ts string, temperature double, humidity double, dew_point double, apparent_temperature double, "
                 "pressure double, cloud_cover double, wind_speed double, wind_gusts double, wind_direction double")
TICKET_SCHEMA = "ticket_id bigint, unit string, text string, text2 string"
AS_OF = "1998-08-01"
CORR_COLS = [spec.TARGET, *spec.daily_columns()]
TARGET_CORR_COLS = spec.daily_columns()
TRAINED_AT = "2026-01-01 00:00:00"



def day_after(day: str, n: int) -> str:
    return (dt.date.fromisoformat(day) + dt.timedelta(days=n)).isoformat()


# ---------------------------------------------------------------- scans and sinks

@query("scan_csv")
def q_scan_csv(spark, sf_dir):
    """Hourly table written as header CSV, read back with a declared schema and parsed timestamps."""
    path = scratch_path(spark, "hourly_csv")
    files.write_table(fx.hourly(spark, sf_dir), path, fmt="csv")
    return files.read_series_csv(spark, path, HOURLY_SCHEMA, ts_col="ts")


@query("scan_fallback")
def q_scan_fallback(spark, sf_dir):
    """The first existing of (missing path, written table) is read."""
    path = scratch_path(spark, "hourly_pq")
    files.write_table(fx.hourly(spark, sf_dir), path)
    return files.read_first_available(spark, [scratch_path(spark, "missing"), path], lambda s, p: s.read.parquet(p))


@query("scan_tickets")
def q_scan_tickets(spark, sf_dir):
    """S3: exported tickets with both texts (line breaks and quotes in them) read from CSV with a declared schema."""
    path = scratch_path(spark, "tickets_csv")
    t = fx.ticket_text(spark, sf_dir)
    quoted = F.concat(F.lit('"'), "text", F.lit('",\\\n'), "unit")
    files.write_table(t.withColumn("text2", F.when(F.col("ticket_id") % 5 > 0, quoted)), path, fmt="csv")
    t = files.read_tickets(spark, path, fmt="csv", schema=TICKET_SCHEMA)
    return t.select("ticket_id", "unit", F.md5("text").alias("digest"), F.length("text").alias("n_chars"),
                    F.md5("text2").alias("digest2"))


def daily_table(spark, sf_dir) -> str:
    """Path of the daily weather table, written once by its job."""
    path = scratch_path(spark, "daily_pq")
    files.write_daily(weather_fx3(spark, sf_dir), path)
    return path


@query("sink_roundtrip")
def q_sink_roundtrip(spark, sf_dir):
    """The daily weather table written as parquet partitioned by year-month and read back."""
    return files.read_daily(spark, daily_table(spark, sf_dir))


@query("daily_incremental")
def q_daily_incremental(spark, sf_dir):
    """U1 + E1 by landing: the known readings, then the fetched ones, which overlap; only the fetched months' folders
    are rewritten, and the daily weather is merged from the stored parts."""
    root = scratch_path(spark, "landed")
    for rows in fx.line_weather_update(spark, sf_dir):
        land_readings(spark, root, rows, "reading_id")
    return landed_weather(spark, root)


@query("sink_tickets")
def q_sink_tickets(spark, sf_dir):
    """The classified ticket table written and read back."""
    path = scratch_path(spark, "classified_pq")
    files.write_table(classified(spark, sf_dir), path)
    return spark.read.parquet(path).select("ticket_id", "unit_before", "unit", "confidence", "details",
                                           F.md5("text").alias("digest"), F.md5("text2").alias("digest2"))


def leaderboard_fx(spark, sf_dir):
    """A15 on FX8 shaped as the persisted leaderboard."""
    m = regression_metrics(fx.predictions_long(spark, sf_dir), keys=["system", "model"])
    return m.select("system", F.col("model").alias("model_name"), "mse", "rmse", "mae", "r2",
                    F.lit(TRAINED_AT).alias("trained_at"))


@query("leaderboard_json")
def q_leaderboard_json(spark, sf_dir):
    """Leaderboard written as JSON, read back, nested per system (best model + map of all), shown flat."""
    path = scratch_path(spark, "leaderboard_json")
    files.write_leaderboard(leaderboard_fx(spark, sf_dir), path)
    nested = files.nested_leaderboard(files.read_leaderboard(spark, path))
    ex = nested.select("system", "best_model", F.col("metrics.R2").alias("best_r2"),
                       F.explode("all_metrics").alias("model_name", "m"), "trained_at")
    return ex.select("system", "best_model", "best_r2", "model_name", F.col("m.MSE").alias("mse"),
                     F.col("m.R2").alias("r2"), "trained_at")


@query("explode_series")
def q_explode_series(spark, sf_dir):
    """Payload arrays -> one row per time step (end exclusive)."""
    return explode_series(fx.payload(spark, sf_dir), ["value", "value_sq"])


@query("explode_documents")
def q_explode_documents(spark, sf_dir):
    """S4 from landed documents: JSON text written, parsed as VARIANT, exploded to one row per time step."""
    path = scratch_path(spark, "payloads")
    fx.payload_documents(spark, sf_dir).write.text(path)
    return explode_series(read_payloads(spark, path, ["value", "value_sq"]), ["value", "value_sq"])


# ---------------------------------------------------------------- projections and filters

@query("select_ordered")
def q_select_ordered(spark, sf_dir):
    """Named columns first, the rest in order."""
    return P.select_ordered(weather_fx2(spark, sf_dir), ["temp_avg", "date"])


@query("parse_ts")
def q_parse_ts(spark, sf_dir):
    """Text -> timestamp, and text with a +01:00 offset -> naive UTC."""
    ev = files.read_table(spark, sf_dir, "events").select("event_id", "ts")
    txt = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return ev.select("event_id", P.parse_ts(txt).alias("ts_parsed"),
                     P.drop_tz(F.concat(txt, F.lit("+01:00"))).alias("ts_utc"))


@query("drop_incomplete")
def q_drop_incomplete(spark, sf_dir):
    """P5: hours with any missing channel dropped."""
    h = fx.hourly(spark, sf_dir)
    return P.drop_incomplete(h, [c for c in h.columns if c != "ts"])


@query("sparse_profile")
def q_sparse_profile(spark, sf_dir):
    """Zero / NULL fractions per column of the daily weather table and the drop decision."""
    return P.sparse_profile(weather_fx3(spark, sf_dir), thr=0.5)


@query("standardize_frame")
def q_standardize_frame(spark, sf_dir):
    """Timestamp as text, numbers rounded half-even to 6 places."""
    return P.standardize_frame(fx.hourly(spark, sf_dir), "ts", 6)


@query("filter_in")
def q_filter_in(spark, sf_dir):
    """Tickets of two systems."""
    return P.filter_in(fx.tickets(spark, sf_dir), "unit", ["1-URGENT", "2-HIGH"])


@query("next_days")
def q_next_days(spark, sf_dir):
    """The 7 days from as_of, read from the year-month folders of the daily table."""
    return P.next_days(files.read_daily(spark, daily_table(spark, sf_dir), AS_OF, day_after(AS_OF, 6)), AS_OF, 6)


@query("recent_slice")
def q_recent_slice(spark, sf_dir):
    """P10: the 30 days before as_of, read from the year-month folders of the daily table."""
    return P.recent_slice(files.read_daily(spark, daily_table(spark, sf_dir), day_after(AS_OF, -30), AS_OF), AS_OF, 30)


@query("align_features")
def q_align_features(spark, sf_dir):
    """Expected list with one missing column (-> 0.0); extras dropped."""
    return P.align_features(weather_fx3(spark, sf_dir), ["temp_avg", "not_in_data", "humidity_avg", "beaufort"], keep=["date"])


@query("drop_leaks")
def q_drop_leaks(spark, sf_dir):
    """Columns derived from the target are dropped."""
    t = training_fx(spark, sf_dir).select("system", "date", "fault_count", "temp_avg")
    w = Window.partitionBy("system").orderBy("date")
    t = t.withColumn("prev_fault_count", F.lag("fault_count").over(w)).withColumn("Fault_Count_7d", F.lit(0))
    return P.drop_target_leaks(t, "fault_count")


# ---------------------------------------------------------------- statistics

@query("quantiles")
def q_quantiles(spark, sf_dir):
    """Exact quantiles per system (linear interpolation)."""
    return S.quantiles(training_fx(spark, sf_dir), CORR_COLS,
                       (0.05, 0.25, 0.5, 0.75, 0.95), KEYS)


@query("box_summary")
def q_box_summary(spark, sf_dir):
    """A10: box-plot numbers of daily fault counts per system."""
    return S.box_summary(daily_fault_counts(fx.tickets(spark, sf_dir)), "fault_count", KEYS)


@query("null_profile")
def q_null_profile(spark, sf_dir):
    """NULL count per column of the hourly grid."""
    return rollup.null_profile(fx.hourly(spark, sf_dir))


@query("span_profile")
def q_span_profile(spark, sf_dir):
    """Row count, first and last hour."""
    return rollup.span_profile(fx.hourly(spark, sf_dir))


@query("corr_matrix")
def q_corr_matrix(spark, sf_dir):
    """|Pearson| of every column pair, per system."""
    return S.corr_pairs(training_fx(spark, sf_dir), CORR_COLS, KEYS)


@query("target_corr")
def q_target_corr(spark, sf_dir):
    """Top 10 features by |corr| with the fault count, per system."""
    return S.target_correlation(training_fx(spark, sf_dir), TARGET_CORR_COLS, "fault_count", KEYS, 10)


@query("feature_select")
def q_feature_select(spark, sf_dir):
    """E5: low-variance and collinearity decisions on the base features, per system."""
    x = features_base_fx(spark, sf_dir)
    feats = feature_columns(x)
    return feature_select(x, feats, KEYS)


# ---------------------------------------------------------------- evaluation on given predictions (FX8)

@query("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    """MSE, RMSE, MAE, R2 per (system, model)."""
    return regression_metrics(fx.predictions_long(spark, sf_dir), keys=["system", "model"])


def _board(spark, sf_dir):
    return regression_metrics(fx.predictions_long(spark, sf_dir), keys=["system", "model"])


@query("vote_weights")
def q_vote_weights(spark, sf_dir):
    """max(R2, 0.01) normalised per system."""
    return vote_weights(_board(spark, sf_dir), KEYS)


def _vote(spark, sf_dir):
    long = fx.predictions_long(spark, sf_dir)
    return weighted_vote(long, vote_weights(_board(spark, sf_dir), KEYS), KEYS, ["date"])


@query("weighted_vote")
def q_weighted_vote(spark, sf_dir):
    """Weighted mean prediction per (system, date)."""
    return _vote(spark, sf_dir)


@query("pick_ensemble")
def q_pick_ensemble(spark, sf_dir):
    """The better of the weighted and the equal-weight vote by R2, per system; single models stand on the board too."""
    long = fx.predictions_long(spark, sf_dir)
    wv = _vote(spark, sf_dir).select("system", "date", "y", F.col("vote").alias("y_hat"), F.lit("weighted_vote").alias("model"))
    mv = long.groupBy("system", "date").agg(F.first("y").alias("y"), F.avg("y_hat").alias("y_hat")).withColumn(
        "model", F.lit("mean_vote"))
    single = long.select("system", "date", "y", "y_hat", "model")
    board = regression_metrics(wv.unionByName(mv).unionByName(single), keys=["system", "model"])
    return pick_ensemble(board, ("weighted_vote", "mean_vote")).select("system", "model", "r2")


@query("best_model")
def q_best_model(spark, sf_dir):
    """The highest-R2 model per system (name breaks ties)."""
    return R.best_model(_board(spark, sf_dir), KEYS, "r2", name="model").select("system", "model", "r2")


@query("diagnostics")
def q_diagnostics(spark, sf_dir):
    """Residuals per model and row."""
    return diagnostics(fx.predictions_long(spark, sf_dir))


def _safe(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", s.lower()).strip("_")


SYSTEMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("assemble_predictions")
def q_assemble_predictions(spark, sf_dir):
    """Per-system vote predictions side by side per date, rounded half-even to integers."""
    v = _vote(spark, sf_dir).select("system", "date", F.col("vote").alias("prediction"))
    return assemble_predictions(v, SYSTEMS, names={s: "s_" + _safe(s) for s in SYSTEMS})


# ---------------------------------------------------------------- ranking, sets, dedupe, splits

@query("top_k")
def q_top_k(spark, sf_dir):
    """The 15 most correlated column pairs over all systems."""
    c = S.corr_pairs(training_fx(spark, sf_dir), CORR_COLS, KEYS)
    c = c.withColumn("pair", F.concat_ws("~", "system", "col_a", "col_b"))
    return R.top_k(c, "corr", 15, tie="pair")


@query("preview")
def q_preview(spark, sf_dir):
    """T5: the first 5 days."""
    return R.preview(weather_fx3(spark, sf_dir), 5, ["date"])


@query("union_series")
def q_union_series(spark, sf_dir):
    """History + forecast, one row per hour, history wins, sorted."""
    hist, fc = fx.overlap(spark, sf_dir)
    return R.sort_by(R.union_series(hist, fc, "ts"), "ts")


@query("distinct_values")
def q_distinct_values(spark, sf_dir):
    """Distinct seasons per system."""
    return R.distinct_values(training_fx(spark, sf_dir), ["system", "season"])


@query("dedupe_first")
def q_dedupe_first(spark, sf_dir):
    """First ticket per (system, day) by ticket id."""
    t = fx.tickets(spark, sf_dir).withColumn("date", F.to_date("created"))
    return dedupe_first(t, ["unit", "date"], "ticket_id").select("unit", "date", "ticket_id", "status")


@query("chrono_split")
def q_chrono_split(spark, sf_dir):
    """First 80 % of each system's days train, the rest test."""
    return chrono_split(training_fx(spark, sf_dir).select("system", "date"), 0.8, KEYS, "date")


@query("expanding_folds")
def q_expanding_folds(spark, sf_dir):
    """5 expanding time folds per system, long form."""
    return expanding_folds(training_fx(spark, sf_dir).select("system", "date"), 5, KEYS, "date")


@query("hash_split")
def q_hash_split(spark, sf_dir):
    """M6: deterministic 80/20 split by md5(system|date)."""
    t = training_fx(spark, sf_dir).select("system", "date")
    return hash_split(t, F.concat_ws("|", "system", F.col("date").cast("string")), 80)


# ---------------------------------------------------------------- scalar functions

@query("calendar")
def q_calendar(spark, sf_dir):
    """Calendar parts of every day."""
    d = weather_fx3(spark, sf_dir).select("date")
    parts = cal.calendar_parts(F.col("date"))
    return d.select("date", *[e.alias(n) for n, e in parts.items()], cal.season_label(F.month("date")).alias("season_label"))


@query("beaufort")
def q_beaufort(spark, sf_dir):
    """F8: Beaufort class of the daily min / mean / max wind."""
    d = weather_fx3(spark, sf_dir)
    return d.select("date", *[beaufort(c).alias(f"bft_{c}") for c in ("wind_min", "wind_avg", "wind_max")])


@query("flags")
def q_flags(spark, sf_dir):
    """strict threshold flags (NULL -> 0) on the hourly grid."""
    h = fx.hourly(spark, sf_dir)
    return h.select("ts", flag_above("temperature", 25.0).alias("hot"), flag_below("temperature", 0.0).alias("frost"),
                    flag_above("humidity", 85.0).alias("humid"), flag_above("wind_speed", 10.0).alias("windy"))


@query("derived")
def q_derived(spark, sf_dir):
    """differences of daily statistics."""
    d = weather_fx3(spark, sf_dir)
    return d.select("date", (F.col("temp_max") - F.col("temp_min")).alias("temp_range"),
                    (F.col("pressure_max") - F.col("pressure_min")).alias("pressure_range"),
                    (F.col("gust_max") - F.col("wind_max")).alias("gust_excess"))


@query("interactions")
def q_interactions(spark, sf_dir):
    """products and squares."""
    d = weather_fx3(spark, sf_dir)
    t, h = F.col("temp_avg"), F.col("humidity_avg")
    ys = cyclic_sin("month", 12)
    return d.select("date", (t * h).alias("temp_humidity"), (t * t).alias("temp_squared"), (t * ys).alias("temp_season"),
                    ((t * h) * ys).alias("temp_humidity_season"), (F.col("is_weekend") * t).alias("weekend_temp"))


@query("cyclic")
def q_cyclic(spark, sf_dir):
    """sin/cos of month, weekday and day of year."""
    d = weather_fx3(spark, sf_dir).select("date")
    m, wd, doy = F.month("date"), cal.dow0("date"), F.dayofyear("date")
    return d.select("date", cyclic_sin(m, 12).alias("month_sin"), cyclic_cos(m, 12).alias("month_cos"),
                    cyclic_sin(wd, 7).alias("weekday_sin"), cyclic_cos(wd, 7).alias("weekday_cos"),
                    cyclic_sin(doy, 365.25).alias("doy_sin"), cyclic_cos(doy, 365.25).alias("doy_cos"))


@query("round_even")
def q_round_even(spark, sf_dir):
    """half-to-even rounding to 0, 1 and 2 places of line amounts."""
    li = files.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    x = F.col("l_extendedprice") * F.col("l_discount")
    return li.select("l_orderkey", "l_linenumber", round_even(x / 1000.0, 0).alias("r0"),
                     round_even(x / 1000.0, 1).alias("r1"), round_even(x, 2).alias("r2"),
                     round_even(F.col("l_discount") * 50.0, 0).alias("r_ties"))


# ---------------------------------------------------------------- streaming

@query("stream_daily_rollup")
def q_stream_daily_rollup(spark, sf_dir):
    """A1 as a stream: hourly grid landed in three batches, rolled up per day with a watermark;
    the days the watermark has closed."""
    from faultcast.streaming.landing import land_and_roll
    return land_and_roll(spark, fx.hourly(spark, sf_dir), scratch_path(spark, "stream"), batches=3)
