"""Scalar expressions (F8-F14, F21-F24) and output normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Beaufort class upper bounds (m/s), exclusive; beyond the last is class 12.
BEAUFORT_BOUNDS = [0.3, 1.6, 3.4, 5.5, 8.0, 10.8, 13.9, 17.2, 20.8, 24.5, 28.5, 32.7]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def beaufort(x, null_as_top: bool = False) -> Column:
    """Beaufort class 0-12 of a wind speed (F8).

    ``null_as_top=True`` reproduces the reference on a missing speed (every
    comparison fails, so the class is 12); the default keeps NULL.
    """
    x = _c(x)
    expr = None
    for i, bound in enumerate(BEAUFORT_BOUNDS):
        expr = F.when(x < bound, F.lit(i)) if expr is None else expr.when(x < bound, F.lit(i))
    top = F.lit(12) if null_as_top else F.when(x.isNotNull(), F.lit(12))
    return expr.otherwise(top).cast("int")


def flag_above(x, thr) -> Column:
    """1 when x > thr (strict), NULL counts as 0."""
    return F.coalesce((_c(x) > thr).cast("int"), F.lit(0))


def flag_below(x, thr) -> Column:
    """1 when x < thr (strict), NULL counts as 0."""
    return F.coalesce((_c(x) < thr).cast("int"), F.lit(0))


def clip(x, lo, hi) -> Column:
    """Two-sided clip that keeps NULL (F14); ``least``/``greatest`` would skip it."""
    x = _c(x)
    lo, hi = _c(lo) if not isinstance(lo, (int, float)) else F.lit(lo), _c(hi) if not isinstance(hi, (int, float)) else F.lit(hi)
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def cyclic_sin(x, period: float) -> Column:
    """sin(2*pi*x/period)."""
    return F.sin(F.lit(2 * math.pi) * _c(x) / F.lit(float(period)))


def cyclic_cos(x, period: float) -> Column:
    """cos(2*pi*x/period)."""
    return F.cos(F.lit(2 * math.pi) * _c(x) / F.lit(float(period)))


def round_even(x, digits: int = 0) -> Column:
    """Half-to-even rounding the way NumPy does it: scale, rint, unscale.

    Spark's ``round`` is half-up and ``bround`` works on the decimal value,
    so neither matches on ties such as 0.285 or 8.345.
    """
    if digits == 0:
        return F.rint(_c(x))
    scale = float(10 ** digits)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def format_ts(x) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text of a timestamp."""
    return F.date_format(_c(x), "yyyy-MM-dd HH:mm:ss")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (pandas skips NaN, Spark does not)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_select(df: DataFrame, exprs: list[str], where: str | None = None) -> DataFrame:
    """One SELECT over ``df`` from SQL expression texts.

    The whole projection reaches the JVM in one statement, instead of one
    Python-to-JVM call per column function; Catalyst sees the same plan.
    """
    import uuid

    view = f"_fc_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    q = f"SELECT {', '.join(exprs)} FROM {view}" + (f" WHERE {where}" if where else "")
    return df.sparkSession.sql(q)


def sql_agg(df: DataFrame, keys: list[str], exprs: list[str]) -> DataFrame:
    """One grouped aggregate (or a global one without keys) from SQL expression texts."""
    import uuid

    view = f"_fc_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    k = ", ".join(quote(c) for c in keys)
    q = f"SELECT {k + ', ' if keys else ''}{', '.join(exprs)} FROM {view}" + (f" GROUP BY {k}" if keys else "")
    return df.sparkSession.sql(q)


def normalize_output(df: DataFrame, digits: int = 6) -> DataFrame:
    """Canonical output types for comparison with the SQL oracle.

    Integral columns become BIGINT, floating columns DOUBLE rounded half-even
    to ``digits`` places, NaN becomes NULL. Everything else passes through.
    """
    scale = float(10 ** digits)
    exprs = []
    for f in df.schema.fields:
        c = quote(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            exprs.append(f"CAST({c} AS BIGINT) AS {c}")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            exprs.append(f"rint(nanvl(CAST({c} AS DOUBLE), CAST(NULL AS DOUBLE)) * {scale!r}) / {scale!r} AS {c}")
        else:
            exprs.append(c)
    return sql_select(df, exprs)
