"""Grouped aggregates over raw readings and tickets.

All statistics of a day come out of ONE ``groupBy().agg()`` (the reference
builds two group-bys and concatenates them). Spark runs a partial
aggregate before the exchange, so a key holding a third of all rows still
ships one partial row per map task, never the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultcast.plans import spec

_STAT = {"min": F.min, "max": F.max, "avg": F.avg}
_CMP = {"<": lambda c, t: c < t, ">": lambda c, t: c > t, "<=": lambda c, t: c <= t, ">=": lambda c, t: c >= t}


def day_of(ts_col: str) -> Column:
    """Timestamp -> calendar date."""
    return F.to_date(F.col(ts_col)).alias("date")


def stat_exprs(hourly: dict = spec.HOURLY, stats=spec.DAILY_STATS) -> list[Column]:
    """A1: min / max / mean per variable, with flat output names (P2 needs no rename pass)."""
    out = []
    for role, prefix, fns in stats:
        for fn in fns:
            out.append(_STAT[fn](F.col(hourly[role])).alias(f"{prefix}_{fn}"))
    return out


def range_exprs(hourly: dict = spec.HOURLY, ranges=spec.DAILY_RANGES) -> list[Column]:
    """A2: intraday spread max - min."""
    return [(F.max(F.col(hourly[r])) - F.min(F.col(hourly[r]))).alias(name) for r, name in ranges]


def count_exprs(hourly: dict = spec.HOURLY, counts=spec.DAILY_COUNTS) -> list[Column]:
    """A3: number of hours meeting a strict threshold; NULL hours do not count."""
    return [F.count_if(_CMP[op](F.col(hourly[r]), thr)).alias(name) for r, name, op, thr in counts]


def daily_mode(df: DataFrame, ts_col: str = "ts", keys: list[str] | None = None, hourly: dict = spec.HOURLY,
               mode=spec.DAILY_MODE) -> DataFrame:
    """A4: most frequent value per (keys, date), smallest on ties, NULL when every value is NULL.

    Counted per value first (hashed, with map-side parts), then the largest
    count per day is picked from those few rows.
    """
    keys = list(keys or [])
    role, name = mode
    v = F.col(hourly[role])
    n = df.groupBy(*keys, day_of(ts_col), v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = F.when(F.col("_v").isNotNull(), F.struct(F.col("_n"), -F.col("_v")))
    return n.groupBy(*keys, "date").agg(F.max_by("_v", order).alias(name))


def daily_aggregate(df: DataFrame, ts_col: str = "ts", keys: list[str] | None = None,
                    exprs: list[Column] | None = None) -> DataFrame:
    """Group readings by (keys, date) and evaluate ``exprs`` in one aggregate."""
    keys = list(keys or [])
    if exprs is None:
        exprs = stat_exprs() + range_exprs() + count_exprs()
    return df.groupBy(*[F.col(k) for k in keys], day_of(ts_col)).agg(*exprs)


def daily_rollup(df: DataFrame, ts_col: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """A1: the 23 min/max/mean columns per day."""
    return daily_aggregate(df, ts_col, keys, stat_exprs())


def daily_count(df: DataFrame, ts_col: str = "created", keys: list[str] | None = None,
                out: str = "fault_count") -> DataFrame:
    """A5: rows per (keys, date); one pass for every category at once."""
    keys = list(keys or [])
    return df.groupBy(*[F.col(k) for k in keys], day_of(ts_col)).agg(F.count(F.lit(1)).alias(out))


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL count per column, one aggregate pass stacked into (column_name, null_count) rows."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    pairs = []
    for i, c in enumerate(cols):
        pairs += [F.lit(c), F.col(f"n{i}")]
    return agg.select(F.stack(F.lit(len(cols)), *pairs).alias("column_name", "null_count"))


def span_profile(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Row count and first / last timestamp."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(ts_col).alias("first_ts"),
                  F.max(ts_col).alias("last_ts"))
