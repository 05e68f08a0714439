"""Feature pipelines (E2-E8) on the per-system daily table.

Each block is one SELECT statement (SURVEY 4.5): overwritten columns keep
their position, new columns are appended in order, exactly like the
reference's column assignments. Windows are partitioned by ``keys``
(system) and ordered by date; all windows of one block share one exchange
and sort. Global statistics (winsor bounds, quantile flags, scalers) are
per-key aggregates joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultcast.functions.scalars import sql_select
from faultcast.operators import windows as W
from faultcast.operators.blocks import BLOCK, drop_halo, split, with_halo
from faultcast.operators.columns import align_features, drop_target_leaks, fill_const, numeric_columns
from faultcast.operators.stats import robust_scale, standard_scale, winsorize_iqr
from faultcast.plans import spec

DEFAULT_SEASONS = (1, 2, 3, 4)
#: Earlier rows that the windows of E2 (7-row statistics) and of E3 (14-row mean, one row earlier) look at.
BASE_BACK, RICH_BACK = 6, 14
TWO_PI = f"{2 * math.pi!r}D"
q = W.q


def sin_sql(x: str, period: float) -> str:
    """F12 as SQL: sin(2*pi*x/period)."""
    return f"sin({TWO_PI} * {x} / {float(period)!r}D)"


def cos_sql(x: str, period: float) -> str:
    return f"cos({TWO_PI} * {x} / {float(period)!r}D)"


def assign(df: DataFrame, items: list[tuple[str, str]], fill0: bool = False) -> DataFrame:
    """Pandas-style assignment as one SELECT: existing names are replaced in place, new ones
    appended; later items with the same name win. ``fill0`` zero-fills numeric NULLs (P12)."""
    new = {}
    for name, expr in items:
        new[name] = expr
    exprs = [f"{new.pop(c)} AS {q(c)}" if c in new else q(c) for c in df.columns]
    exprs += [f"{e} AS {q(n)}" for n, e in new.items()]
    out = sql_select(df, exprs)
    return fill_const(out, 0) if fill0 else out


def window_keys(df: DataFrame, keys: list[str]) -> list[str]:
    """What the windows are partitioned by: the keys, or the blocks of a series that was split (``operators.blocks``)."""
    return keys if keys or BLOCK not in df.columns else [BLOCK]


def assign_windows(df: DataFrame, items: list[tuple[str, str]], by: list[str], date_col: str, back: int,
                   carry: str | None = None, fill0: bool = False) -> DataFrame:
    """``assign`` of windows that look ``back`` rows back, and to the last row of the same ``carry``, by ``window_keys``."""
    if by != [BLOCK]:
        return assign(df, items, fill0)
    return drop_halo(assign(with_halo(df, date_col, back, carry if carry in df.columns else None), items, fill0))


def base_features(df: DataFrame, target: str = spec.TARGET, keys=("system",), date_col: str = "date",
                  winsor_k: float = 1.5, extreme_q=(0.05, 0.95), via_window: bool = False) -> DataFrame:
    """Winsorize -> calendar -> season -> range -> 7-row temp stats -> change/acceleration
    -> extreme flag -> leak drop, in this order.

    Calendar columns present on input are overwritten from the date; the
    input day-of-week column ``dow`` becomes day-of-month ``day`` (the
    reference reuses one name for both). ``season`` is kept when present.
    ``via_window``: bounds from windows per key, nothing joined back.
    """
    keys = [k for k in (keys or []) if k in df.columns]
    cols = numeric_columns(df, exclude=[target, *keys])
    w = winsorize_iqr(df, cols, winsor_k, keys, via_window=via_window)
    d = q(date_col)
    by = window_keys(df, keys)
    items: list[tuple[str, str]] = []
    if date_col in df.columns:
        items += [("day", f"dayofmonth({d})"), ("week", f"weekofyear({d})"), ("month", f"month({d})"),
                  ("year", f"year({d})"), ("dow0", f"weekday({d})"), ("is_weekend", f"CAST(weekday({d}) >= 5 AS INT)"),
                  ("quarter", f"quarter({d})"), ("day_of_year", f"dayofyear({d})"), ("week_of_year", f"weekofyear({d})")]
    if "season" not in df.columns:
        s = f"CAST(floor((month({d}) % 12) / 3) + 1 AS INT)"
        items.append(("season", f"CASE {s} WHEN 1 THEN 'winter' WHEN 2 THEN 'spring' WHEN 3 THEN 'summer' ELSE 'autumn' END"))
    if spec.TEMP_MIN in df.columns and spec.TEMP_MAX in df.columns:
        items.append(("temp_range", f"{q(spec.TEMP_MAX)} - {q(spec.TEMP_MIN)}"))
    if spec.TEMP_AVG in df.columns:
        t = spec.TEMP_AVG
        items += [("temp_7d_mean", W.rolling_sql(t, 7, "mean", by, date_col)),
                  ("temp_7d_std", W.rolling_std0_sql(t, 7, by, date_col)),
                  ("temp_7d_min", W.rolling_sql(t, 7, "min", by, date_col)),
                  ("temp_7d_max", W.rolling_sql(t, 7, "max", by, date_col)),
                  ("temp_change", W.diff1_sql(t, by, date_col)),
                  ("temp_acc", W.diff2_sql(t, by, date_col))]
    # the input day-of-week column is replaced in place by day-of-month
    if "dow" in w.columns and date_col in df.columns:
        w = w.withColumnRenamed("dow", "day")
    out = assign_windows(w, items, by, date_col, BASE_BACK)
    if spec.TEMP_AVG in df.columns:
        out = W.extreme_flag(out, spec.TEMP_AVG, extreme_q[0], extreme_q[1], keys, out="extreme_temp", via_window=via_window)
    return drop_target_leaks(out, target)


def _season_diff_items(df: DataFrame, keys, date_col: str, seasons) -> list[tuple[str, str]]:
    """Per season value, the change from the previous row of that season on its rows;
    elsewhere the column keeps its current value (NULL when new)."""
    items = []
    if spec.TEMP_AVG not in df.columns or "season" not in df.columns:
        return items
    diff = W.season_diff_sql(spec.TEMP_AVG, "season", keys, date_col)
    for s in seasons:
        name = f"temp_trend_{s}"
        other = q(name) if name in df.columns else "CAST(NULL AS DOUBLE)"
        items.append((name, f"CASE WHEN season = {s} THEN {diff} ELSE {other} END"))
    return items


def rich_temporal(df: DataFrame, keys=("system",), date_col: str = "date", seasons=DEFAULT_SEASONS) -> DataFrame:
    """Cyclic terms, seasonal interactions, 3/7/14-row temperature and 3/7-row humidity
    windows with trends, season diffs, weekend x temperature, then NULL -> 0."""
    by = window_keys(df, [k for k in (keys or []) if k in df.columns])
    ysin, ycos = sin_sql("month", 12), cos_sql("month", 12)
    items = [("year_sin", ysin), ("year_cos", ycos), ("week_sin", sin_sql("dow0", 7)), ("week_cos", cos_sql("dow0", 7))]
    if "day_of_year" in df.columns:
        items += [("doy_sin", sin_sql("day_of_year", 365.25)), ("doy_cos", cos_sql("day_of_year", 365.25))]
    t, h = q(spec.TEMP_AVG), q(spec.HUMIDITY_AVG)
    has_t, has_h = spec.TEMP_AVG in df.columns, spec.HUMIDITY_AVG in df.columns
    if has_t:
        items += [("temp_season", f"{t} * {ysin}"), ("temp_season_cos", f"{t} * {ycos}")]
        if spec.TEMP_MIN in df.columns and spec.TEMP_MAX in df.columns:
            items.append(("temp_range_season", f"({q(spec.TEMP_MAX)} - {q(spec.TEMP_MIN)}) * {ysin}"))
        items += [("temp_squared", f"{t} * {t}"), ("temp_squared_season", f"({t} * {t}) * {ysin}")]
    if has_h:
        items += [("humidity_season", f"{h} * {ysin}"), ("humidity_season_cos", f"{h} * {ycos}")]
        if has_t:
            items.append(("temp_humidity_season", f"({t} * {h}) * {ysin}"))
    if has_t:
        for k in (3, 7, 14):
            items += [(f"temp_{k}d", W.rolling_sql(spec.TEMP_AVG, k, "mean", by, date_col)),
                      (f"temp_{k}d_std", W.rolling_sql(spec.TEMP_AVG, k, "std", by, date_col)),
                      (f"temp_{k}d_max", W.rolling_sql(spec.TEMP_AVG, k, "max", by, date_col)),
                      (f"temp_{k}d_min", W.rolling_sql(spec.TEMP_AVG, k, "min", by, date_col)),
                      (f"temp_trend_{k}d", W.rolling_trend_sql(spec.TEMP_AVG, k, by, date_col))]
    if has_h:
        for k in (3, 7):
            items += [(f"humidity_{k}d", W.rolling_sql(spec.HUMIDITY_AVG, k, "mean", by, date_col)),
                      (f"humidity_trend_{k}d", W.rolling_trend_sql(spec.HUMIDITY_AVG, k, by, date_col))]
    items += _season_diff_items(df, by, date_col, seasons)
    if "is_weekend" in df.columns and has_t:
        items.append(("weekend_temp", f"is_weekend * {t}"))
    return assign_windows(df, items, by, date_col, RICH_BACK, "season", fill0=True)


def lean_temporal(df: DataFrame, keys=("system",), date_col: str = "date", seasons=DEFAULT_SEASONS) -> DataFrame:
    """Cyclic month and weekday terms, two seasonal interactions, season diffs, NULL -> 0."""
    by = window_keys(df, [k for k in (keys or []) if k in df.columns])
    items = []
    if "month" in df.columns:
        items += [("year_sin", sin_sql("month", 12)), ("year_cos", cos_sql("month", 12))]
    if "dow0" in df.columns:
        items += [("week_sin", sin_sql("dow0", 7)), ("week_cos", cos_sql("dow0", 7))]
    ysin = sin_sql("month", 12)
    if spec.TEMP_AVG in df.columns:
        items.append(("temp_season", f"{q(spec.TEMP_AVG)} * {ysin}"))
    if spec.HUMIDITY_AVG in df.columns:
        items.append(("humidity_season", f"{q(spec.HUMIDITY_AVG)} * {ysin}"))
    items += _season_diff_items(df, by, date_col, seasons)
    return assign_windows(df, items, by, date_col, 0, "season", fill0=True)


def feature_columns(df: DataFrame, target: str = spec.TARGET, keys=("system",), date_col: str = "date") -> list[str]:
    """Every column except target, date and keys."""
    return [c for c in df.columns if c not in (target, date_col, *keys)]


def forecast_trends(df: DataFrame, keys=(), date_col: str = "date", windows=(1, 3, 4)) -> DataFrame:
    """E8 first step: k-row temperature means and their trends, added before winsorizing."""
    by = window_keys(df, [k for k in (keys or []) if k in df.columns])
    items = []
    for k in windows:
        items += [(f"temp_{k}d", W.rolling_sql(spec.TEMP_AVG, k, "mean", by, date_col)),
                  (f"temp_trend_{k}", W.rolling_trend_sql(spec.TEMP_AVG, k, by, date_col))]
    return assign_windows(df, items, by, date_col, max(windows))


def forecast_features(daily: DataFrame, variant: str = "rich", keys=(), date_col: str = "date",
                      fit_on: DataFrame | None = None, expected: list[str] | None = None, scale: bool = True,
                      blocks: int | None = None, scale_keys=None) -> DataFrame:
    """Daily weather -> trends -> E2 -> E3 (rich) or E4 (lean) -> scale -> align.

    ``fit_on=None`` refits the scaler on the rows being scored (the
    reference's behaviour); pass the training features to avoid that skew.
    The rich variant uses the standard scaler, the lean one the robust scaler;
    ``scale=False`` leaves scaling to the caller, who may have kept statistics.
    Without ``keys`` all windows run block by block over ranges of the dates
    (``blocks``, or as many as adaptive execution makes), never over the series in one task.
    With ``keys`` every step is a window by the keys (``via_window``): rows dealt out by them once
    stay where they are, and nothing is staged or joined back. E3 and E4 fill a missing number in a key as
    well, so that scaling is by the filled key; ``scale_keys`` names those of the keys that are never missing,
    by which rows dealt out stay for scaling too.
    """
    from faultcast.session import stage

    keys = [k for k in (keys or []) if k in daily.columns]
    trends = (1, 3, 4)
    if not keys:
        daily = split(daily, date_col, max(BASE_BACK, RICH_BACK, *trends), blocks)
    x = forecast_trends(daily, keys, date_col, trends)
    x = base_features(x, target="_no_target_", keys=keys, date_col=date_col, via_window=bool(keys))
    if not keys:
        x = stage(x)
    x = rich_temporal(x, keys, date_col) if variant == "rich" else lean_temporal(x, keys, date_col)
    if not keys:
        x = stage(x).drop(BLOCK)
    if not scale:
        return x
    feats = feature_columns(x, "_no_target_", keys, date_col)
    num = [c for c in numeric_columns(x) if c in feats]
    scaled = (standard_scale if variant == "rich" else robust_scale)(x, num, fit_on, scale_keys or keys, via_window=bool(keys))
    return align_features(scaled, expected, keep=[*keys, date_col]) if expected else scaled


def feature_select(df: DataFrame, features: list[str], keys=("system",), min_std: float = 1e-3,
                   max_corr: float = 0.95) -> DataFrame:
    """E5: per key, drop features with sample std < ``min_std``; among the rest drop feature j when
    some earlier feature i < j (itself kept or not) has |corr| > ``max_corr``.

    Decision table (keys, feature, position, std, max_prior_corr, kept). The
    pairwise correlations come from one aggregate per key; the decision is a
    join and a grouped max on that small pair table, so nothing but the final
    table ever leaves the executors.
    """
    from faultcast.operators.stats import attach_global, corr_pairs, join_null_safe
    from faultcast.session import stage

    keys = [k for k in (keys or []) if k in df.columns]
    from faultcast.functions.scalars import sql_agg

    x = stage(df.select(*keys, *features))
    # one row per key: all deviations, and by position of the later feature the largest |corr| with an earlier one
    std = sql_agg(x, keys, ["array(" + ", ".join(f"stddev_samp({q(f)})" for f in features) + ") AS stds"])
    live = lambda c: F.col(c).isNull() | (F.col(c) >= min_std)
    pairs = join_null_safe(corr_pairs(x, features, keys, absolute=True), std, keys) if keys else attach_global(
        corr_pairs(x, features, keys, absolute=True), std)
    names = F.array(*[F.lit(f) for f in features])
    pairs = pairs.select(*keys, "corr", (F.array_position(names, F.col("col_b")) - 1).alias("position"),
                         F.get("stds", (F.array_position(names, F.col("col_a")) - 1).cast("int")).alias("sa"),
                         F.get("stds", (F.array_position(names, F.col("col_b")) - 1).cast("int")).alias("sb"))
    prior = pairs.filter(live("sa") & live("sb")).groupBy(*keys, "position").agg(F.max("corr").alias("max_prior_corr"))
    out = std.select(*keys, F.posexplode("stds").alias("position", "std"))
    out = join_null_safe(out, prior, [*keys, "position"])
    kept = live("std") & (F.col("max_prior_corr").isNull() | (F.col("max_prior_corr") <= max_corr))
    return out.select(*keys, F.get(names, F.col("position")).alias("feature"), "position", "std", "max_prior_corr",
                      kept.alias("kept"))
