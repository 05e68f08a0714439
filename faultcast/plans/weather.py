"""Hourly readings -> one row per day with 44 columns.

Plan shape: two aggregates for all 29 statistics, the first hashed over raw
grain, the second over a few rows per day, then one window stage on daily grain for the two 3-row means.
With ``keys`` (site) the raw columns are dealt out by site once, and both aggregates
and the window, partitioned by site, run where the rows are; without them the
window runs by ranges of days that carry the last rows of the range before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultcast.functions.scalars import BEAUFORT_BOUNDS, sql_agg, sql_select
from faultcast.operators import windows
from faultcast.operators.blocks import BLOCK, HALO, split, with_halo
from faultcast.plans import spec

q = windows.q

#: Earlier rows that the two 3-row means look at.
WINDOW_BACK = 2


def partial_sql(hourly_spec: dict = spec.HOURLY) -> list[str]:
    """First aggregate, per (keys, date, direction): mergeable parts of the 29 statistics."""
    cols = sorted({hourly_spec[r] for r, _, _ in spec.DAILY_STATS} | {hourly_spec[r] for r, _ in spec.DAILY_RANGES})
    out = ["count(1) AS _n"]
    for c in cols:
        x = q(c)
        out += [f"min({x}) AS {q('_min_' + c)}", f"max({x}) AS {q('_max_' + c)}",
                f"sum({x}) AS {q('_sum_' + c)}", f"count({x}) AS {q('_cnt_' + c)}"]
    return out + [f"count_if({q(hourly_spec[r])} {op} {thr!r}D) AS {q('_if_' + n)}" for r, n, op, thr in spec.DAILY_COUNTS]


def merged_sql(hourly_spec: dict = spec.HOURLY) -> list[str]:
    """Second aggregate, per (keys, date): 23 statistics, 2 spreads, 3 hour counts, 1 mode (smallest on ties, NULL never)."""
    def stat(fn: str, c: str) -> str:
        if fn == "avg":
            return f"try_divide(sum({q('_sum_' + c)}), sum({q('_cnt_' + c)}))"
        return f"{fn}({q(f'_{fn}_' + c)})"

    out = [f"{stat(fn, hourly_spec[role])} AS {prefix}_{fn}" for role, prefix, fns in spec.DAILY_STATS for fn in fns]
    out += [f"{stat('max', hourly_spec[r])} - {stat('min', hourly_spec[r])} AS {n}" for r, n in spec.DAILY_RANGES]
    out += [f"sum({q('_if_' + n)}) AS {n}" for _, n, _, _ in spec.DAILY_COUNTS]
    role, name = spec.DAILY_MODE
    c = q(hourly_spec[role])
    out.append(f"max_by({c}, CASE WHEN {c} IS NOT NULL THEN struct(_n, -{c}) END) AS {name}")
    return out


def daily_parts(hourly: DataFrame, ts_col: str = "ts", keys=None, hourly_spec: dict = spec.HOURLY) -> DataFrame:
    """The first aggregate: per direction of a day over the raw readings (hashed, with map-side parts).

    Parts of disjoint readings can be stored, put together by a union and merged by ``stats_of_parts``.
    """
    keys = list(keys or [])
    mode = hourly_spec[spec.DAILY_MODE[0]]
    day = sql_select(hourly, [q(k) for k in keys] + [f"to_date({q(ts_col)}) AS date"]
                     + [q(c) for c in sorted(set(hourly_spec.values())) if c in hourly.columns])
    return sql_agg(day, [*keys, "date", mode], partial_sql(hourly_spec))


def stats_of_parts(parts: DataFrame, keys=None, hourly_spec: dict = spec.HOURLY) -> DataFrame:
    """The second aggregate: the statistics of a day from its parts, a few rows each."""
    return sql_agg(parts, [*(keys or []), "date"], merged_sql(hourly_spec))


def daily_stats(hourly: DataFrame, ts_col: str = "ts", keys=None, hourly_spec: dict = spec.HOURLY, deal=None) -> DataFrame:
    """A1-A4 by two aggregates: per direction of a day over the raw readings, then per day over a few rows each.
    The mode needs no buffer of values, so nothing sorts raw grain.

    By ``keys`` a day has hardly more readings than directions, so that parts per direction are many times the raw
    columns and save no rows: the raw columns are exchanged instead, once, by the keys (or ``deal``, some of them),
    which no later step by these keys exchanges again. A key's readings are one task's, as its days are in every window.
    """
    if keys:
        cols = [c for c in sorted(set(hourly_spec.values())) if c in hourly.columns]
        hourly = hourly.select(*keys, ts_col, *cols).repartition(*(deal or keys))
    return stats_of_parts(daily_parts(hourly, ts_col, keys, hourly_spec), keys, hourly_spec)


def calendar_sql(date_col: str = "date") -> list[str]:
    d = q(date_col)
    return [f"weekofyear({d}) AS week", f"weekday({d}) + 1 AS dow", f"month({d}) AS month",
            f"CAST(floor((month({d}) % 12) / 3) + 1 AS INT) AS season", f"CAST(weekday({d}) >= 5 AS INT) AS is_weekend"]


def derived_sql(keys=None, beaufort_null_as_top: bool = False) -> list[str]:
    """The 9 derived day features."""
    t_avg, h_avg = q(spec.TEMP_AVG), q(spec.HUMIDITY_AVG)
    out = [f"{q(spec.TEMP_MAX)} - {q(spec.TEMP_MIN)} AS temp_range", f"{t_avg} * {h_avg} AS temp_humidity",
           f"{windows.rolling_sql(spec.TEMP_AVG, 3, 'mean', keys)} AS temp_roll3",
           f"{windows.rolling_sql(spec.HUMIDITY_AVG, 3, 'mean', keys)} AS humidity_roll3"]
    for name, col, op, thr in [*spec.DAY_FLAGS, spec.WINDY_FLAG]:
        if name == spec.WINDY_FLAG[0]:
            continue
        out.append(f"coalesce(CAST({q(col)} {op} {thr!r}D AS INT), 0) AS {name}")
    w = q(spec.WIND_AVG)
    cases = " ".join(f"WHEN {w} < {b!r}D THEN {i}" for i, b in enumerate(BEAUFORT_BOUNDS))
    top = "12" if beaufort_null_as_top else f"CASE WHEN {w} IS NOT NULL THEN 12 END"
    out.append(f"CAST(CASE {cases} ELSE {top} END AS INT) AS beaufort")
    name, col, op, thr = spec.WINDY_FLAG
    out.append(f"coalesce(CAST({q(col)} {op} {thr!r}D AS INT), 0) AS {name}")
    return out


def weather_of_stats(stats: DataFrame, keys=None, digits: int = 2, beaufort_null_as_top: bool = False,
                     blocks: int | None = None) -> DataFrame:
    """The rest of E1 on daily grain: calendar and derived features, half-even rounded.

    Without ``keys`` the windows run block by block (``operators.blocks``), in
    ``blocks`` ranges of days or as many as adaptive execution makes; the
    statistics are staged for it. 0: one ordered window, nothing staged.
    """
    keys = list(keys or [])
    in_blocks = not keys and blocks != 0
    stat_cols = [c for c in stats.columns if c not in keys and c != "date"]
    by = keys
    if in_blocks:
        stats, by = with_halo(split(stats, "date", WINDOW_BACK, blocks), "date", WINDOW_BACK), [BLOCK]
    full = sql_select(stats, [q(k) for k in keys] + ["date"] + calendar_sql() + [q(c) for c in stat_cols]
                      + derived_sql(by, beaufort_null_as_top) + ([HALO] if in_blocks else []))
    scale = float(10 ** (digits or 0))
    out = []
    for f in full.schema.fields:
        if f.name == HALO and in_blocks:
            continue
        if digits is not None and isinstance(f.dataType, T.DoubleType):
            out.append(f"rint({q(f.name)} * {scale!r}D) / {scale!r}D AS {q(f.name)}")
        else:
            out.append(q(f.name))
    return sql_select(full, out, where=f"NOT {HALO}" if in_blocks else None)


def daily_weather(hourly: DataFrame, ts_col: str = "ts", keys=None, digits: int = 2,
                  beaufort_null_as_top: bool = False, blocks: int | None = None, deal=None) -> DataFrame:
    """Daily statistics + calendar + derived features, half-even rounded; ``blocks`` as in ``weather_of_stats``,
    ``deal`` as in ``daily_stats``."""
    return weather_of_stats(daily_stats(hourly, ts_col, keys, deal=deal), keys, digits, beaufort_null_as_top, blocks)
