"""Incremental daily roll-up of landed hourly files (the reference polls its inputs in batch).

Hourly files land in a folder; a Structured Streaming query aggregates
them per calendar day (A1 statistics) with an event-time watermark, and
appends each day to a parquet table once the watermark has passed its end.
State holds only the open days, so it stays bounded however long the
stream runs; the checkpoint lives in the shared checkpoint folder, so a
restarted job resumes where it stopped. ``availableNow`` processes what
has landed and stops (the polling cadence of the reference).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultcast.operators import rollup
from faultcast.plans import spec


def stream_daily_rollup(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                        checkpoint_dir: str, ts_col: str = "ts", delay: str = "1 hour",
                        available_now: bool = True):
    """Start the streaming roll-up; returns the StreamingQuery (awaited when ``available_now``)."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    # event time: the UTC instant with the same wall-clock time as the naive input, so day windows
    # (aligned to UTC epoch days) are the calendar days of the input whatever the session zone is
    tz = spark.conf.get("spark.sql.session.timeZone")
    ev = F.to_utc_timestamp(F.col(ts_col).cast("timestamp"), tz)
    agg = (src.withColumn("_event", ev).withWatermark("_event", delay)
           .groupBy(F.window("_event", "1 day").alias("w"))
           .agg(*rollup.stat_exprs(spec.HOURLY, spec.DAILY_STATS), F.count(F.lit(1)).alias("n_rows")))
    day = F.date_from_unix_date((F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    out = agg.select(day.alias("date"), *[c for c in agg.columns if c != "w"])
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    q = writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="1 minute").start()
    if available_now:
        q.awaitTermination()
    return q


def closed_days(spark: SparkSession, sink_dir: str, counted: bool = False) -> DataFrame:
    """The days the stream has finalised so far; with ``counted`` also their number of rows."""
    d = spark.read.parquet(sink_dir)
    return d if counted else d.drop("n_rows")


def finish(spark: SparkSession, source_dir: str, sink_dir: str, ts_col: str = "ts") -> DataFrame:
    """All days at the end of a bounded run: the closed ones, and the open ones rolled up from the landed files."""
    closed = closed_days(spark, sink_dir)
    landed = spark.read.parquet(source_dir)
    open_ = landed.withColumn("_day", F.to_date(ts_col)).join(closed.select(F.col("date").alias("_day")), "_day", "left_anti")
    return closed.unionByName(rollup.daily_aggregate(open_.drop("_day"), ts_col, exprs=rollup.stat_exprs()))


def late_rows(spark: SparkSession, source_dir: str, sink_dir: str, ts_col: str = "ts") -> DataFrame:
    """(date, landed, counted) of closed days of which more rows have landed than the stream counted: what came too late."""
    landed = spark.read.parquet(source_dir).groupBy(F.to_date(ts_col).alias("date")).agg(F.count(F.lit(1)).alias("landed"))
    return (closed_days(spark, sink_dir, counted=True).select("date", F.col("n_rows").alias("counted"))
            .join(landed, "date").filter(F.col("landed") > F.col("counted")).select("date", "landed", "counted"))


def land_and_roll(spark: SparkSession, hourly: DataFrame, root: str, batches: int = 3) -> DataFrame:
    """Land ``hourly`` as ``batches`` files in arrival order, run the stream after each landing, and
    return every day. Exercises resumption from the checkpoint between landings."""
    src, sink, ckpt = (os.path.join(root, n) for n in ("landed", "daily", "checkpoint"))
    bounds = hourly.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    step = (hi - lo) / batches
    for i in range(batches):
        a = lo + step * i
        part = hourly.filter((F.col("ts") >= F.lit(a)) & ((F.col("ts") < F.lit(a + step)) if i < batches - 1 else F.lit(True)))
        part.write.mode("append").parquet(src)
        stream_daily_rollup(spark, src, hourly.schema, sink, ckpt)
    return finish(spark, src, sink)
