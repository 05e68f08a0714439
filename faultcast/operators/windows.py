"""Ordered-window operators.

Frames are ROWS frames over ``order`` (the reference's rolling windows
count rows, not days). Every builder takes ``keys``: windows are
partitioned by series (system / site) and run on daily grain, so one
partition holds at most one series' calendar, never raw readings.

Each builder exists as SQL text (``*_sql``, used by the pipelines so that a
whole feature block is one SELECT statement) and as a Column (the same
text through ``F.expr``). All windows sharing a partitioning and order
share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FN = {"mean": "avg", "avg": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def over(keys=None, order="date", frame: str | None = None) -> str:
    keys = list(keys or [])
    order = [order] if isinstance(order, str) else list(order)
    part = f"PARTITION BY {', '.join(q(k) for k in keys)} " if keys else ""
    fr = f" {frame}" if frame else ""
    return f"OVER ({part}ORDER BY {', '.join(q(o) for o in order)}{fr})"


def rows(lo: int, hi: int = 0) -> str:
    def b(n):
        return "CURRENT ROW" if n == 0 else (f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING")
    return f"ROWS BETWEEN {b(lo)} AND {b(hi)}"


# ---------------------------------------------------------------- SQL text builders

def rolling_sql(c: str, k: int, fn: str = "mean", keys=None, order="date") -> str:
    """Statistic over the last ``k`` rows including the current one (at least one value).

    ``std`` is the sample deviation and is NULL on a one-value frame, as in
    pandas; callers zero-fill where the reference does (W2).
    """
    return f"{_FN[fn]}({q(c)}) {over(keys, order, rows(-(k - 1)))}"


def rolling_std0_sql(c: str, k: int, keys=None, order="date") -> str:
    """Rolling sample std with the one-value frame set to 0."""
    return f"coalesce({rolling_sql(c, k, 'std', keys, order)}, 0D)"


def lag_sql(c: str, n: int = 1, keys=None, order="date") -> str:
    return f"lag({q(c)}, {n}) {over(keys, order)}"


def diff1_sql(c: str, keys=None, order="date") -> str:
    """Change from the previous row; first row (and any NULL) -> 0."""
    return f"coalesce({q(c)} - {lag_sql(c, 1, keys, order)}, 0D)"


def diff2_sql(c: str, keys=None, order="date") -> str:
    """Change of the zero-filled change, first row -> 0.

    Written with lag 1 and lag 2 of the input so both diffs come out of the
    same window node (no window over a window).
    """
    l1, l2 = lag_sql(c, 1, keys, order), lag_sql(c, 2, keys, order)
    return f"coalesce(coalesce({q(c)} - {l1}, 0D) - coalesce({l1} - {l2}, 0D), 0D)"


def rolling_trend_sql(c: str, k: int, keys=None, order="date") -> str:
    """K-row rolling mean minus the same mean one row earlier (NULL on the first row).

    The earlier mean is the frame shifted by one row, so no second window
    stage is needed.
    """
    return f"(avg({q(c)}) {over(keys, order, rows(-(k - 1)))} - avg({q(c)}) {over(keys, order, rows(-k, -1))})"


def season_diff_sql(c: str, season_col: str = "season", keys=None, order="date") -> str:
    """W7 core: change from the previous row of the same season (spans years)."""
    return f"{q(c)} - {lag_sql(c, 1, [*(keys or []), season_col], order)}"


# ---------------------------------------------------------------- Column builders

def rolling(c: str, k: int, fn: str = "mean", keys=None, order="date") -> Column:
    return F.expr(rolling_sql(c, k, fn, keys, order))


def rolling_std0(c: str, k: int, keys=None, order="date") -> Column:
    return F.expr(rolling_std0_sql(c, k, keys, order))


def diff1(c: str, keys=None, order="date") -> Column:
    return F.expr(diff1_sql(c, keys, order))


def diff2(c: str, keys=None, order="date") -> Column:
    return F.expr(diff2_sql(c, keys, order))


def rolling_trend(c: str, k: int, keys=None, order="date") -> Column:
    return F.expr(rolling_trend_sql(c, k, keys, order))


def season_diff(c: str, season_col: str = "season", keys=None, order="date") -> Column:
    return F.expr(season_diff_sql(c, season_col, keys, order))


# ---------------------------------------------------------------- frame operators

def dedupe_first(df: DataFrame, key, priority) -> DataFrame:
    """Keep the first row per key after ordering by ``priority``.

    The window is partitioned by the key itself, so a group holds only the
    copies of one key.
    """
    key = [key] if isinstance(key, str) else list(key)
    priority = [priority] if isinstance(priority, (str, Column)) else list(priority)
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*priority))
    return df.withColumn("_rn", rn).filter(F.col("_rn") == 1).drop("_rn")


def extreme_flag(df: DataFrame, c: str, lo_q: float = 0.05, hi_q: float = 0.95, keys=None,
                 out: str = "extreme", via_window: bool = False) -> DataFrame:
    """1 when c is above its q95 or below its q05 (strict), else 0.

    The quantiles come from one aggregate (one row per key) joined back, or with
    ``via_window`` from a window per key; with no key it is a single row and is broadcast.
    """
    from faultcast.functions.scalars import sql_select
    from faultcast.operators.stats import attach_stats_sql

    j = attach_stats_sql(df, {"_q": f"percentile({q(c)}, array({lo_q!r}D, {hi_q!r}D))"}, keys, via_window)
    flag = f"coalesce(CAST(({q(c)} > _q[1] OR {q(c)} < _q[0]) AS INT), 0) AS {q(out)}"
    return sql_select(j, [q(x) for x in df.columns] + [flag])
