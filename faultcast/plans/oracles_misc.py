"""SQL oracles for scans/sinks, column maintenance, statistics, ranking, sets, splits, scalar
functions and model-free evaluation."""

from __future__ import annotations

from faultcast.plans import spec
from faultcast.plans.oracles import (beaufort_sql, cte_counts, cte_daily_weather, cte_hourly, cte_line_weather,
                                     cte_tickets, cte_training, daily_weather_columns, oracle, r6, stat_sql, with_)
from faultcast.plans.oracles_features import TRAIN_INT, TWO_PI, training_features
from faultcast.plans.oracles_text import cte_cls, cte_fx5
from faultcast.plans.queries_misc import (AS_OF, CORR_COLS, SYSTEMS, TARGET_CORR_COLS, TRAINED_AT, _safe)
from faultcast.sources import fixtures as fx

HOURLY_COLS = ["temperature", "humidity", "dew_point", "apparent_temperature", "pressure", "cloud_cover",
               "wind_speed", "wind_gusts", "wind_direction"]
DW_INT = TRAIN_INT - {"fault_count"}


def _r6all(cols):
    return ", ".join(f"{r6(c)} AS {c}" for c in cols)


def dw_final(src: str) -> str:
    parts = []
    for c in daily_weather_columns():
        parts.append(c if c == "date" or c in DW_INT else f"{r6(c)} AS {c}")
    return f"SELECT {', '.join(parts)} FROM {src}"


HOURLY_FINAL = f"SELECT ts, {_r6all(HOURLY_COLS)} FROM hourly"
DW_LONG = cte_daily_weather(cte_line_weather(), "dw_long")
DW_SHORT = cte_daily_weather(cte_hourly(), "dw")

# ---------------------------------------------------------------- scans and sinks
oracle("scan_csv", with_([cte_hourly()], HOURLY_FINAL))
oracle("scan_fallback", with_([cte_hourly()], HOURLY_FINAL))
oracle("scan_tickets", with_([cte_fx5()], """SELECT ticket_id, unit, md5(text) AS digest, length(text) AS n_chars,
  CASE WHEN ticket_id % 5 > 0 THEN md5('"' || text || '",\\' || chr(10) || unit) END AS digest2 FROM fx5"""))
oracle("sink_roundtrip", with_(DW_LONG, dw_final("dw_long")))
oracle("daily_incremental", with_(DW_LONG, dw_final("dw_long")))
oracle("sink_tickets", with_(cte_cls(), f"SELECT ticket_id, unit_before, unit, {r6('confidence')} AS confidence, details, md5(text) AS digest, md5(text2) AS digest2 FROM cls"))


def cte_fx8():
    return cte_counts() + [
        ("p8", """SELECT system, date, fault_count::DOUBLE AS y,
  (lag(fault_count, 1) OVER (PARTITION BY system ORDER BY date))::DOUBLE AS previous,
  avg(fault_count) OVER (PARTITION BY system ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean7,
  avg(fault_count) OVER (PARTITION BY system) AS overall FROM counts"""),
        ("fx8", """SELECT system, date, y, 'previous' AS model, previous AS y_hat FROM p8 WHERE previous IS NOT NULL
UNION ALL SELECT system, date, y, 'mean7', mean7 FROM p8 WHERE previous IS NOT NULL
UNION ALL SELECT system, date, y, 'overall', overall FROM p8 WHERE previous IS NOT NULL""")]


def board_sql(src: str, name: str) -> list[tuple[str, str]]:
    return [(f"{name}_a", f"""SELECT system, model, count(*) AS n, avg((y - y_hat) * (y - y_hat)) AS mse,
  avg(abs(y - y_hat)) AS mae, sum((y - y_hat) * (y - y_hat)) AS sse, var_pop(y) * count(y) AS sst FROM {src} GROUP BY 1, 2"""),
            (name, f"""SELECT system, model, n, mse, sqrt(mse) AS rmse, mae,
  CASE WHEN sst > 0 THEN 1.0 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM {name}_a""")]


BOARD = cte_fx8() + board_sql("fx8", "board")
BEST = ("best", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY round_even(r2 * 1e9, 0) DESC NULLS LAST, model ASC) AS rn
FROM board) b WHERE rn = 1""")
oracle("leaderboard_json", with_(BOARD + [BEST], f"""SELECT b.system, best.model AS best_model, {r6('best.r2')} AS best_r2,
  b.model AS model_name, {r6('b.mse')} AS mse, {r6('b.r2')} AS r2, '{TRAINED_AT}' AS trained_at
FROM board b JOIN best USING (system)"""))

_EXPLODED = with_([("pl", f"""SELECT vec_id AS series_id, TIMESTAMP '{fx.PAYLOAD_BASE}' + to_days(vec_id::INTEGER) AS start_ts,
  embedding FROM embeddings"""),
    ("ex", f"""SELECT series_id, start_ts, i - 1 AS pos, embedding[i]::DOUBLE AS value
FROM pl, range(1, len(embedding) + 1) r(i)""")],
    f"""SELECT series_id, start_ts + to_seconds(pos * {fx.PAYLOAD_STEP_S}) AS ts, pos, {r6('value')} AS value, {r6('value * value')} AS value_sq
FROM ex WHERE pos * {fx.PAYLOAD_STEP_S} < {fx.PAYLOAD_KEEP * fx.PAYLOAD_STEP_S}""")
oracle("explode_series", _EXPLODED)
oracle("explode_documents", _EXPLODED)

# ---------------------------------------------------------------- projections and filters
oracle("select_ordered", with_(DW_SHORT, "SELECT * FROM dw"))
oracle("parse_ts", "SELECT event_id, ts AS ts_parsed, ts - INTERVAL 1 HOUR AS ts_utc FROM events")
oracle("drop_incomplete", with_([cte_hourly()], HOURLY_FINAL + " WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in HOURLY_COLS)))

_dwc = daily_weather_columns()
_agg = []
for _i, _c in enumerate(_dwc):
    _z = "0.0" if _c == "date" else f"coalesce(({_c} = 0)::DOUBLE, 0.0)"
    _agg += [f"avg({_z}) AS z{_i}", f"avg(({_c} IS NULL)::DOUBLE) AS n{_i}"]
_rows = " UNION ALL ".join(
    f"SELECT '{_c}' AS column_name, {r6(f'z{_i}')} AS zero_frac, {r6(f'n{_i}')} AS null_frac, "
    f"CASE WHEN z{_i} >= 0.5 THEN 'zeros' WHEN n{_i} >= 0.5 THEN 'nulls' END AS dropped_for FROM sp" for _i, _c in enumerate(_dwc))
oracle("sparse_profile", with_(DW_LONG + [("sp", f"SELECT {', '.join(_agg)} FROM dw_long")], _rows))

oracle("standardize_frame", with_([cte_hourly()],
    f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {', '.join(f'{r6(c)} AS {c}' for c in HOURLY_COLS)} FROM hourly"))
oracle("filter_in", with_([cte_tickets()],
    f"SELECT ticket_id, unit, status, created, {r6('amount')} AS amount FROM tickets WHERE unit IN ('1-URGENT', '2-HIGH')"))
oracle("next_days", with_(DW_LONG, dw_final("dw_long") + f" WHERE date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + INTERVAL 6 DAY"))
oracle("recent_slice", with_(DW_LONG, dw_final("dw_long")
       + f" WHERE date >= DATE '{AS_OF}' - INTERVAL 30 DAY AND date <= DATE '{AS_OF}' - INTERVAL 1 DAY"))
oracle("align_features", with_(DW_LONG, f"SELECT date, {r6('temp_avg')} AS temp_avg, 0.0 AS not_in_data, {r6('humidity_avg')} AS humidity_avg, beaufort FROM dw_long"))
oracle("drop_leaks", with_(cte_training(), f"SELECT system, date, fault_count, {r6('temp_avg')} AS temp_avg FROM training"))

# ---------------------------------------------------------------- statistics
_PS = (0.05, 0.25, 0.5, 0.75, 0.95)
oracle("quantiles", with_(cte_training(), " UNION ALL ".join(
    f"SELECT system, '{c}' AS column_name, unnest({list(_PS)!r})::DOUBLE AS p, "
    f"{r6(f'unnest(quantile_cont({c}, {list(_PS)!r}))')} AS q FROM training GROUP BY system" for c in CORR_COLS)))

oracle("box_summary", with_(cte_counts() + [
    ("bq", "SELECT system, quantile_cont(fault_count, [0.25, 0.5, 0.75]) AS q FROM counts GROUP BY system"),
    ("bj", """SELECT c.system, c.fault_count AS x, q[1] AS q1, q[2] AS med, q[3] AS q3,
  c.fault_count >= q[1] - (q[3] - q[1]) * 1.5 AND c.fault_count <= q[3] + (q[3] - q[1]) * 1.5 AS inside
FROM counts c JOIN bq USING (system)""")],
    f"""SELECT system, {r6('first(q1)')} AS q1, {r6('first(med)')} AS median, {r6('first(q3)')} AS q3,
  min(CASE WHEN inside THEN x END) AS whisker_lo, max(CASE WHEN inside THEN x END) AS whisker_hi,
  count_if(x IS NOT NULL AND NOT inside) AS n_outliers FROM bj GROUP BY system"""))

oracle("null_profile", with_([cte_hourly()], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS null_count FROM hourly" for c in ["ts"] + HOURLY_COLS)))
oracle("span_profile", with_([cte_hourly()], "SELECT count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts FROM hourly"))


def corr_nn(a, b):
    return f"CASE WHEN isnan(abs(corr({a}, {b}))) THEN NULL ELSE abs(corr({a}, {b})) END"


_pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
_corr_long = ("cm", "SELECT system, unnest(l, recursive := true) FROM (SELECT system, ["
              + ", ".join(f"{{'col_a': '{a}', 'col_b': '{b}', 'corr': {corr_nn(a, b)}}}" for a, b in _pairs)
              + "] AS l FROM training GROUP BY system) x")
oracle("corr_matrix", with_(cte_training() + [_corr_long], f"SELECT system, col_a, col_b, {r6('corr')} AS corr FROM cm"))
oracle("top_k", with_(cte_training() + [_corr_long], f"""SELECT system, col_a, col_b, {r6('corr')} AS corr,
  concat_ws('~', system, col_a, col_b) AS pair FROM cm ORDER BY corr DESC NULLS LAST, pair ASC LIMIT 15"""))

_tc = ("tc", "SELECT system, unnest(l, recursive := true) FROM (SELECT system, ["
       + ", ".join(f"{{'feature': '{c}', 'abs_corr': {corr_nn(c, 'fault_count')}}}" for c in TARGET_CORR_COLS)
       + "] AS l FROM training GROUP BY system) x")
oracle("target_corr", with_(cte_training() + [_tc], f"""SELECT system, feature, {r6('abs_corr')} AS abs_corr, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY system ORDER BY abs_corr DESC NULLS LAST, feature ASC) AS rank FROM tc) r
WHERE rank <= 10"""))


def feature_select_sql() -> str:
    ctes, fin, cols = training_features("base")
    feats = [n for n in cols.names if n not in ("fault_count", "date", "system")]
    pos = ", ".join(f"('{f}', {i})" for i, f in enumerate(feats))
    std = ("fs_std", "SELECT system, unnest(l, recursive := true) FROM (SELECT system, ["
           + ", ".join(f"{{'feature': '{f}', 'std': stddev_samp({f})}}" for f in feats)
           + f"] AS l FROM {fin} GROUP BY system) x")
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    pr = ("fs_pairs", "SELECT system, unnest(l, recursive := true) FROM (SELECT system, ["
          + ", ".join(f"{{'col_a': '{a}', 'col_b': '{b}', 'corr': {corr_nn(a, b)}}}" for a, b in pairs)
          + f"] AS l FROM {fin} GROUP BY system) x")
    ok = ("fs_ok", "SELECT system, feature, std, (std IS NULL OR std >= 0.001) AS var_ok FROM fs_std")
    live = ("fs_prior", """SELECT p.system, p.col_b AS feature, max(p.corr) AS max_prior_corr FROM fs_pairs p
  JOIN fs_ok a ON a.system = p.system AND a.feature = p.col_a JOIN fs_ok b ON b.system = p.system AND b.feature = p.col_b
WHERE a.var_ok AND b.var_ok GROUP BY 1, 2""")
    posc = ("fs_pos", f"SELECT * FROM (VALUES {pos}) v(feature, position)")
    final = f"""SELECT o.system, o.feature, position, {r6('o.std')} AS std, {r6('max_prior_corr')} AS max_prior_corr,
  (var_ok AND (max_prior_corr IS NULL OR max_prior_corr <= 0.95)) AS kept
FROM fs_ok o JOIN fs_pos USING (feature) LEFT JOIN fs_prior p ON p.system = o.system AND p.feature = o.feature"""
    return with_(ctes + [std, pr, ok, live, posc], final)


oracle("feature_select", feature_select_sql())

# ---------------------------------------------------------------- evaluation on given predictions
oracle("regression_metrics", with_(BOARD, f"SELECT system, model, n, {r6('mse')} AS mse, {r6('rmse')} AS rmse, {r6('mae')} AS mae, {r6('r2')} AS r2 FROM board"))
WEIGHTS = ("weights", "SELECT system, model, greatest(r2, 0.01) / sum(greatest(r2, 0.01)) OVER (PARTITION BY system) AS weight FROM board")
oracle("vote_weights", with_(BOARD + [WEIGHTS], f"SELECT system, model, {r6('weight')} AS weight FROM weights"))
VOTE = ("vote", "SELECT system, date, first(y) AS y, sum(weight * y_hat) AS vote FROM fx8 JOIN weights USING (system, model) GROUP BY 1, 2")
oracle("weighted_vote", with_(BOARD + [WEIGHTS, VOTE], f"SELECT system, date, {r6('y')} AS y, {r6('vote')} AS vote FROM vote"))
oracle("pick_ensemble", with_(BOARD + [WEIGHTS, VOTE, ("ens", """SELECT system, date, y, vote AS y_hat, 'weighted_vote' AS model FROM vote
UNION ALL SELECT system, date, first(y), avg(y_hat), 'mean_vote' FROM fx8 GROUP BY 1, 2""")] + board_sql("ens", "eb"),
    f"""SELECT system, model, {r6('r2')} AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY system ORDER BY round_even(r2 * 1e9, 0) DESC NULLS LAST, model ASC) AS rn FROM eb) x WHERE rn = 1"""))
oracle("best_model", with_(BOARD + [BEST], f"SELECT system, model, {r6('r2')} AS r2 FROM best"))
oracle("diagnostics", with_(cte_fx8(), f"SELECT system, date, {r6('y')} AS y, model, {r6('y_hat')} AS y_hat, {r6('y - y_hat')} AS residual FROM fx8"))
_piv = ", ".join(f"max(CASE WHEN system = '{s}' THEN vote END) AS \"{s}\"" for s in SYSTEMS)
_have = " AND ".join(f"\"{s}\" IS NOT NULL" for s in SYSTEMS)
_out = ", ".join(f"round_even(\"{s}\", 0)::BIGINT AS s_{_safe(s)}_fault_prediction" for s in SYSTEMS)
oracle("assemble_predictions", with_(BOARD + [WEIGHTS, VOTE, ("piv", f"SELECT date, {_piv} FROM vote GROUP BY date")],
                                     f"SELECT date, {_out} FROM piv WHERE {_have}"))

# ---------------------------------------------------------------- ranking, sets, dedupe, splits
oracle("preview", with_(DW_LONG, dw_final("dw_long") + " ORDER BY date LIMIT 5"))
_shift = ", ".join(f"{c} + 1.0 AS {c}" for c in HOURLY_COLS)
oracle("union_series", with_([cte_hourly(), ("u", f"""SELECT *, 0 AS src FROM hourly WHERE ts < TIMESTAMP '{fx.OVERLAP_HISTORY_END}'
UNION ALL SELECT ts, {_shift}, 1 AS src FROM hourly WHERE ts >= TIMESTAMP '{fx.OVERLAP_FORECAST_START}'""")],
    f"""SELECT ts, {_r6all(HOURLY_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY src) AS rn FROM u) x WHERE rn = 1"""))
oracle("distinct_values", with_(cte_training(), "SELECT DISTINCT system, season FROM training"))
oracle("dedupe_first", with_([cte_tickets()], """SELECT unit, date, ticket_id, status FROM (
  SELECT unit, created::DATE AS date, ticket_id, status,
    row_number() OVER (PARTITION BY unit, created::DATE ORDER BY ticket_id) AS rn FROM tickets) x WHERE rn = 1"""))
oracle("chrono_split", with_(cte_training(), """SELECT system, date,
  CASE WHEN row_number() OVER (PARTITION BY system ORDER BY date) - 1 < floor(count(*) OVER (PARTITION BY system) * 0.8)
  THEN 'train' ELSE 'test' END AS split FROM training"""))
oracle("expanding_folds", with_(cte_training() + [
    ("ef", """SELECT system, date, row_number() OVER (PARTITION BY system ORDER BY date) - 1 AS pos,
  count(*) OVER (PARTITION BY system) AS n FROM training"""),
    ("eff", """SELECT system, date, fold, CASE WHEN pos < n - (5 - fold) * floor(n / 6) THEN 'train'
  WHEN pos < n - (5 - fold) * floor(n / 6) + floor(n / 6) THEN 'test' END AS role FROM ef CROSS JOIN range(5) r(fold)""")],
    "SELECT system, date, fold, role FROM eff WHERE role IS NOT NULL"))
oracle("hash_split", with_(cte_training(), """SELECT system, date,
  CASE WHEN (('0x' || substr(md5(system || '|' || date::VARCHAR), 1, 8))::BIGINT % 100) < 80 THEN 'train' ELSE 'test' END AS split
FROM training"""))

# ---------------------------------------------------------------- scalar functions
oracle("calendar", with_(DW_LONG, """SELECT date, weekofyear(date) AS week, isodow(date) AS iso_dow, isodow(date) - 1 AS dow0,
  day(date) AS day, month(date) AS month, year(date) AS year, quarter(date) AS quarter, dayofyear(date) AS day_of_year,
  CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend, (floor((month(date) % 12) / 3) + 1)::BIGINT AS season,
  CASE (floor((month(date) % 12) / 3) + 1)::BIGINT WHEN 1 THEN 'winter' WHEN 2 THEN 'spring' WHEN 3 THEN 'summer'
    WHEN 4 THEN 'autumn' END AS season_label FROM dw_long"""))
oracle("beaufort", with_(DW_LONG, "SELECT date, " + ", ".join(f"{beaufort_sql(c)} AS bft_{c}" for c in ("wind_min", "wind_avg", "wind_max")) + " FROM dw_long"))
oracle("flags", with_([cte_hourly()], """SELECT ts, coalesce((temperature > 25.0)::INTEGER, 0) AS hot,
  coalesce((temperature < 0.0)::INTEGER, 0) AS frost, coalesce((humidity > 85.0)::INTEGER, 0) AS humid,
  coalesce((wind_speed > 10.0)::INTEGER, 0) AS windy FROM hourly"""))
oracle("derived", with_(DW_LONG, f"""SELECT date, {r6('temp_max - temp_min')} AS temp_range, {r6('pressure_max - pressure_min')} AS pressure_range,
  {r6('gust_max - wind_max')} AS gust_excess FROM dw_long"""))
_ys = f"sin({TWO_PI} * month / 12.0)"
oracle("interactions", with_(DW_LONG, f"""SELECT date, {r6('temp_avg * humidity_avg')} AS temp_humidity, {r6('temp_avg * temp_avg')} AS temp_squared,
  {r6(f'temp_avg * {_ys}')} AS temp_season, {r6(f'(temp_avg * humidity_avg) * {_ys}')} AS temp_humidity_season,
  {r6('is_weekend * temp_avg')} AS weekend_temp FROM dw_long"""))


def _cyc(fn, x, p):
    return r6(f"{fn}({TWO_PI} * {x} / {float(p)})")


oracle("cyclic", with_(DW_LONG, f"""SELECT date, {_cyc('sin', 'month(date)', 12)} AS month_sin, {_cyc('cos', 'month(date)', 12)} AS month_cos,
  {_cyc('sin', '(isodow(date) - 1)', 7)} AS weekday_sin, {_cyc('cos', '(isodow(date) - 1)', 7)} AS weekday_cos,
  {_cyc('sin', 'dayofyear(date)', 365.25)} AS doy_sin, {_cyc('cos', 'dayofyear(date)', 365.25)} AS doy_cos FROM dw_long"""))
oracle("round_even", f"""SELECT l_orderkey, l_linenumber, {r6('round_even(l_extendedprice * l_discount / 1000.0, 0)')} AS r0,
  {r6('round_even((l_extendedprice * l_discount / 1000.0) * 10.0, 0) / 10.0')} AS r1,
  {r6('round_even((l_extendedprice * l_discount) * 100.0, 0) / 100.0')} AS r2,
  {r6('round_even(l_discount * 50.0, 0)')} AS r_ties FROM lineitem""")


# ---------------------------------------------------------------- streaming
_stat_cols = [f"{p}_{fn}" for _, p, fns in spec.DAILY_STATS for fn in fns]
oracle("stream_daily_rollup", with_([cte_hourly()], f"""SELECT date, {_r6all(_stat_cols)}
FROM (SELECT ts::DATE AS date, {", ".join(stat_sql())} FROM hourly GROUP BY 1) a"""))
