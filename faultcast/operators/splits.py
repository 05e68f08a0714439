"""Deterministic splits and folds.

Ranks inside a group never go through one task per group: rows are put in
hash shards (by the first hex digits of an md5; at least four shards for each
shuffle partition of the session, so their number follows the cluster's sizing
for the input), shard counts are prefix-summed on the small (group x shard)
table, and each row's rank is its shard offset plus its position inside the
shard. A group holding a third of all rows is therefore ranked by all tasks.
Ties are broken by a hash of the whole row where no column is named for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultcast.operators.stats import attach_global, join_null_safe

def md5_of(*cols) -> Column:
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(parts[0] if len(parts) == 1 else F.concat_ws("|", *parts))


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 from the first 8 hex digits of md5(key); equal in DuckDB."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def shard_digits(df: DataFrame) -> int:
    """Hex digits that give four shards or more for each shuffle partition."""
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = 1
    while 16 ** digits < n:
        digits += 1
    return digits


def row_hash(df: DataFrame) -> Column:
    """md5 over every column of a row (NULL differs from the empty text)."""
    return F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))


def sharded_rank(df: DataFrame, group: list[str], order_hex: Column, tie: str | None = None,
                 digits: int | None = None) -> DataFrame:
    """0-based rank of every row inside ``group`` by ``order_hex`` (a hex string), plus the group size.

    Adds ``_rank`` and ``_n``. ``digits`` fixes the number of shards (16 to that power).
    """
    x = df.withColumn("_h", order_hex).withColumn("_shard", F.substring("_h", 1, digits or shard_digits(df)))
    counts = x.groupBy(*group, "_shard").agg(F.count(F.lit(1)).alias("_c"))
    gw = Window.partitionBy(*group).orderBy("_shard")
    offsets = counts.select(*group, "_shard",
                            (F.sum("_c").over(gw.rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
                            F.sum("_c").over(Window.partitionBy(*group)).alias("_n"))
    order = [F.col("_h")] + ([F.col(tie)] if tie else [])
    within = F.row_number().over(Window.partitionBy(*group, "_shard").orderBy(*order)) - 1
    j = join_null_safe(x, offsets, [*group, "_shard"])
    return j.withColumn("_rank", F.coalesce(F.col("_off"), F.lit(0)) + within).drop("_h", "_shard", "_off")


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int = 5) -> DataFrame:
    """M3: class-balanced fold ids: rank inside the class by md5(id), modulo k."""
    r = sharded_rank(df, [label_col], md5_of(id_col), tie=id_col)
    return r.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n")


def hash_split(df: DataFrame, key: Column, train_pct: int = 80) -> DataFrame:
    """M6: deterministic random split: md5 bucket < train_pct -> train (independent of partitioning)."""
    return df.withColumn("split", F.when(hash_bucket(key, 100) < train_pct, F.lit("train")).otherwise(F.lit("test")))


def _day_positions(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, day, rows of the day, rows before it, rows of the key) from one aggregate and windows over days."""
    days = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_dc"))
    dw = Window.partitionBy(*keys).orderBy(order)
    return days.select(*keys, order, "_dc",
                       F.coalesce(F.sum("_dc").over(dw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                       F.sum("_dc").over(Window.partitionBy(*keys)).alias("_n"))


def chrono_split(df: DataFrame, frac: float = 0.8, keys=None, order: str = "date", tie: str | None = None) -> DataFrame:
    """The first floor(frac * n) rows by time are train, the rest test (per key).

    One aggregate of daily counts gives the day in which each key's cut falls;
    rows of other days are told by comparison, only that day's rows are ranked
    (by a hash of ``tie``, or of the row).  Rows without a day stand before every day.
    """
    keys = list(keys or [])
    cut = F.floor(F.col("_n") * frac)
    days = _day_positions(df, keys, order).filter((F.col("_before") <= cut) & (cut < F.col("_before") + F.col("_dc")))
    cuts = days.select(*keys, F.col(order).alias("_day"), (cut - F.col("_before")).alias("_take"))
    j = join_null_safe(df, cuts, keys) if keys else attach_global(df, cuts)
    # without a cut day the key's rows are all train; the day itself may be null
    is_day = F.col("_take").isNotNull() & F.col(order).eqNullSafe(F.col("_day"))
    before = F.col("_take").isNull() | F.col(order).isNull() | (F.col(order) < F.col("_day"))
    other = j.filter(~is_day).withColumn("split", F.when(before, "train").otherwise("test"))
    day = j.filter(is_day)
    ranked = sharded_rank(day, [*keys, order], md5_of(tie) if tie else row_hash(df), tie=tie)
    ranked = ranked.withColumn("split", F.when(F.col("_rank") < F.col("_take"), "train").otherwise("test"))
    return other.select(*df.columns, "split").unionByName(ranked.select(*df.columns, "split"))


def expanding_folds(df: DataFrame, n_splits: int = 5, keys=None, order: str = "date", tie: str | None = None) -> DataFrame:
    """Time-ordered folds; fold i tests the i-th block of size n // (n_splits + 1) counted so
    the last block ends the series, and trains on every earlier row. Long form (..., fold, role)."""
    keys = list(keys or [])
    before = _day_positions(df, keys, order).drop("_dc")
    tie_hex = md5_of(tie) if tie else row_hash(df)
    r = join_null_safe(sharded_rank(df, [*keys, order], tie_hex, tie=tie).drop("_n"), before, [*keys, order])
    pos = F.col("_before") + F.col("_rank")
    size = F.floor(F.col("_n") / (n_splits + 1))
    x = r.withColumn("_pos", pos).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("_n") - (F.lit(n_splits) - F.col("fold")) * size
    role = F.when(F.col("_pos") < start, F.lit("train")).when(F.col("_pos") < start + size, F.lit("test"))
    return x.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_rank", "_before", "_n", "_pos")
