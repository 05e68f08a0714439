"""Projections, filters and column maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultcast.functions.scalars import format_ts, round_even

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def select_ordered(df: DataFrame, first: list[str]) -> DataFrame:
    """The named columns first, the rest in their current order."""
    present = [c for c in first if c in df.columns]
    return df.select(*present, *[c for c in df.columns if c not in present])


def parse_ts(c, fmt: str | None = None) -> Column:
    """Text -> TIMESTAMP_NTZ (no time zone involved)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_timestamp_ntz(c, F.lit(fmt)) if fmt else F.to_timestamp_ntz(c)


def drop_tz(c) -> Column:
    """Text with a UTC offset -> naive UTC timestamp.

    The instant is taken as epoch microseconds and added to the NTZ epoch,
    so the result does not depend on the session time zone.
    """
    c = F.col(c) if isinstance(c, str) else c
    micros = F.unix_micros(F.to_timestamp(c))
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5: drop a row when any listed column is NULL."""
    return df.na.drop(how="any", subset=list(cols))


def sparse_profile(df: DataFrame, cols: list[str] | None = None, thr: float = 0.5) -> DataFrame:
    """P6 (the profile): zero and NULL fractions per column and the keep/drop decision.

    Zeros are tested first, as in the reference: a value counts as zero if
    it prints as 0 / 0.0 / 0.00 (numeric 0, or that text). One aggregate pass.
    """
    cols = list(cols or df.columns)
    aggs = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        col = F.col(f"`{c}`")
        if isinstance(dt, _NUMERIC):
            is_zero = col == 0
        else:
            is_zero = col.cast("string").isin("0", "0.0", "0.00")
        aggs += [F.avg(F.coalesce(is_zero.cast("double"), F.lit(0.0))).alias(f"z{i}"),
                 F.avg(col.isNull().cast("double")).alias(f"n{i}")]
    a = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"z{i}").alias("zero_frac"),
                             F.col(f"n{i}").alias("null_frac")) for i, c in enumerate(cols)])
    long = a.select(F.inline(arr))
    reason = (F.when(F.col("zero_frac") >= thr, F.lit("zeros"))
              .when(F.col("null_frac") >= thr, F.lit("nulls")))
    return long.withColumn("dropped_for", reason)


def prune_sparse_columns(df: DataFrame, cols: list[str] | None = None, thr: float = 0.5) -> DataFrame:
    """Drop the columns the profile marks. Only the small profile reaches the driver."""
    prof = sparse_profile(df, cols, thr).filter(F.col("dropped_for").isNotNull()).select("column_name")
    drop = [r["column_name"] for r in prof.collect()]
    return df.drop(*drop)


def standardize_frame(df: DataFrame, ts_col: str = "ts", digits: int = 6) -> DataFrame:
    """Time column -> ``yyyy-MM-dd HH:mm:ss`` text, every other numeric column half-even rounded."""
    out = []
    for f in df.schema.fields:
        if f.name == ts_col:
            out.append(format_ts(F.col(ts_col)).alias(ts_col))
        elif isinstance(f.dataType, _NUMERIC):
            out.append(round_even(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def filter_in(df: DataFrame, c: str, values) -> DataFrame:
    """Membership filter; pushed into the parquet scan as an IN predicate."""
    return df.filter(F.col(c).isin(list(values)))


def next_days(df: DataFrame, as_of: str, n: int = 6, date_col: str = "date") -> DataFrame:
    """as_of <= date <= as_of + n (both ends)."""
    d0 = F.lit(as_of).cast("date")
    return df.filter(F.col(date_col).between(d0, F.date_add(d0, n)))


def recent_slice(df: DataFrame, as_of: str, back: int = 30, date_col: str = "date") -> DataFrame:
    """P10: the ``back`` days before as_of: [as_of - back, as_of - 1]."""
    d0 = F.lit(as_of).cast("date")
    return df.filter((F.col(date_col) >= F.date_sub(d0, back)) & (F.col(date_col) <= F.date_sub(d0, 1)))


def update_subset(df: DataFrame, in_scope: Column, updates: dict[str, Column], defaults: dict[str, Column]) -> DataFrame:
    """Write new values for the rows in scope, keep (or default) the others, in one pass."""
    cols = []
    seen = set()
    for c in df.columns:
        if c in updates:
            base = defaults.get(c, F.col(c))
            cols.append(F.when(in_scope, updates[c]).otherwise(base).alias(c))
            seen.add(c)
        else:
            cols.append(F.col(c))
    for c, e in updates.items():
        if c not in seen:
            cols.append(F.when(in_scope, e).otherwise(defaults.get(c, F.lit(None))).alias(c))
    return df.select(*cols)


def fill_const(df: DataFrame, value=0, cols: list[str] | None = None) -> DataFrame:
    """NULL -> constant on numeric columns (all, or the listed ones)."""
    return df.na.fill(value, subset=cols) if cols else df.na.fill(value)


def align_features(df: DataFrame, expected: list[str] | None, keep: list[str] = ()) -> DataFrame:
    """Missing expected columns := 0.0, extras dropped, order forced; no-op without a list."""
    if not expected:
        return df
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in expected])


def drop_target_leaks(df: DataFrame, target: str) -> DataFrame:
    """Drop columns whose lower-cased name contains the target name, except the target."""
    t = target.lower()
    return df.drop(*[c for c in df.columns if t in c.lower() and c != target])
