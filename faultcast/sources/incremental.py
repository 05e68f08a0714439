"""Readings landed day by day: fetched rows rewrite their own months only.

Two tables below one root, both partitioned by year-month of the reading:
``readings`` (every reading once, by its key) and ``day_parts`` (the mergeable
parts of a day's statistics, a few rows per day). A landing appends the
readings that are new and overwrites the parts of the months it touches
(dynamic partition overwrite), so its cost follows the fetched months, not the
history. The daily table is merged from the parts, which are on daily grain.

A landing that was lost half-way is simply run again: readings that are
already there are not appended twice, and parts are computed anew from the
readings of the months, never added to.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultcast.operators.columns import drop_incomplete
from faultcast.operators.windows import dedupe_first
from faultcast.plans.weather import daily_parts, stats_of_parts, weather_of_stats
from faultcast.sources.files import path_exists

MONTH, PIECE, THERE = "ym", "_piece", "_there"
#: Readings of a month that one task takes in a landing by month, about: larger months are cut by their keys. A task
#: sorts its readings by key, so this bounds the memory it needs, whatever the session's number of shuffle partitions.
PIECE_ROWS = 500_000


def _month(ts_col: str):
    return F.date_format(ts_col, "yyyy-MM")


def _at(root: str, name: str) -> str:
    return os.path.join(root, name)


def land_readings(spark: SparkSession, root: str, fetched: DataFrame, key: str, ts_col: str = "ts",
                  complete: list[str] | None = None, keys: list[str] | None = None, by_month: bool = True) -> list[str]:
    """Land ``fetched`` and return the months whose folders were rewritten.

    U1: a reading that is already there wins over a fetched one of the same
    ``key``; of several fetched ones that of the smallest hash stays. By month
    equal keys of different months are different readings, so that only the
    touched months are compared (right for keys that name the time, as ``ts``
    itself does); with ``by_month=False`` a key is one reading in all of
    history, for which each landing reads the key column of every month.
    ``complete`` (P5): rows with a null in one of these columns land but don't
    count. Rows without a timestamp have no day and are left out; a null key is
    a key like any other. ``keys`` (site) are kept in the parts.
    """
    rows = fetched.filter(F.col(ts_col).isNotNull()).withColumn(MONTH, _month(ts_col))
    counts = {r[0]: r[1] for r in rows.groupBy(MONTH).count().collect()}  # bounded by the calendar
    months = sorted(counts)
    if not months:
        return []
    readings, parts = _at(root, "readings"), _at(root, "day_parts")
    known = path_exists(spark, readings)
    if by_month:
        there = _months_of(spark, readings, months) if known else None
        if known:
            # the keys that are there are exchanged too; their number is read from the files' footers
            for m, n in there.groupBy(MONTH).count().collect():  # bounded by the calendar
                counts[m] += n
        new = _new_by_month(rows, counts, key, fetched.columns, there)
    else:
        new = dedupe_first(rows, [key], [F.xxhash64(*fetched.columns)])
        if known:
            there = _table(spark, readings).select(F.col(key).alias("_there"))
            new = new.join(there, F.col(key).eqNullSafe(F.col("_there")), "left_anti")
        # rebalance: a month's rows in a few files of even size, however the months are filled
        new = new.hint("rebalance", MONTH)
    new.write.mode("append").partitionBy(MONTH).parquet(readings)
    landed = _months_of(spark, readings, months)
    if complete:
        landed = drop_incomplete(landed, list(complete))
    day = daily_parts(landed, ts_col, keys).withColumn(MONTH, _month("date"))
    # a month whose readings are all incomplete leaves no parts; it had none before, since readings only come in
    (day.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(MONTH).parquet(parts))
    return months


def _new_by_month(rows: DataFrame, counts: dict[str, int], key: str, columns: list[str], there: DataFrame | None) -> DataFrame:
    """Of the rows of a month and key the one of the smallest hash, none where ``there`` has the key in that month.

    Rows are exchanged once, with the keys that are there, so that equal keys meet where their month is written.
    """
    order = [F.xxhash64(*columns)]
    if there is not None:
        rows = rows.withColumn(THERE, F.lit(False)).unionByName(
            there.select(MONTH, key).withColumn(THERE, F.lit(True)), allowMissingColumns=True)
        order = [F.col(THERE).desc(), *order]
    new = dedupe_first(_in_pieces(rows, counts, key), [MONTH, PIECE, key], order).drop(PIECE)
    return new if there is None else new.filter(~F.col(THERE)).drop(THERE)


def _in_pieces(rows: DataFrame, counts: dict[str, int], key: str) -> DataFrame:
    """Rows exchanged by month and, in months of more than ``PIECE_ROWS`` rows, by a hash of the key, in at least two
    partitions for ``PIECE_ROWS`` rows: few pieces then share one."""
    large = {m: -(-n // PIECE_ROWS) for m, n in counts.items() if n > PIECE_ROWS}
    pieces = F.lit(1)
    if large:
        of_month = F.create_map(*[F.lit(x) for pair in sorted(large.items()) for x in pair])
        pieces = F.coalesce(F.try_element_at(of_month, F.col(MONTH)), pieces)
    need = 2 * -(-sum(counts.values()) // PIECE_ROWS)
    few = need <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # adaptive execution may merge these
    return rows.withColumn(PIECE, F.pmod(F.xxhash64(key), pieces)).repartition(*([] if few else [need]), MONTH, PIECE)


def _months_of(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """The rows of some months: a partition filter, so that no other folder is read."""
    return _table(spark, path).filter(F.col(MONTH).isin(months))


def _table(spark: SparkSession, path: str) -> DataFrame:
    # the type of the folder column would be guessed from its values
    return spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("string"))


def landed_readings(spark: SparkSession, root: str) -> DataFrame:
    """Every reading landed so far, once."""
    return _table(spark, _at(root, "readings")).drop(MONTH)


def landed_days(spark: SparkSession, root: str, keys: list[str] | None = None, months: list[str] | None = None) -> DataFrame:
    """A1-A4 per day from the stored parts (of some months only, if given)."""
    path = _at(root, "day_parts")
    parts = _table(spark, path) if months is None else _months_of(spark, path, months)
    return stats_of_parts(parts.drop(MONTH), keys)


def landed_weather(spark: SparkSession, root: str, keys: list[str] | None = None) -> DataFrame:
    """E1 from the stored parts: equal to ``daily_weather`` over all landed readings."""
    return weather_of_stats(landed_days(spark, root, keys), keys)
