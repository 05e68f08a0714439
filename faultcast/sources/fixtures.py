"""Adapters from the given test tables to the reference's input shapes (FX1-FX9).

Each adapter is a plain projection / aggregation over the parquet tables,
so its work grows with the tables. Channel-to-weather mappings are affine
rescalings chosen so the stand-in values fall in plausible weather ranges;
they are fixed values of the fixtures, mirrored one to one by the SQL
oracle in :mod:`faultcast.plans.oracles`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultcast.sources.files import read_table

# Fixed values of the fixtures.
GENERIC = "GENERIC"
SPECIFIC = ("C1", "C2", "C3")
PROB_CLASSES = SPECIFIC
PAYLOAD_BASE = "2024-01-01 00:00:00"
PAYLOAD_STEP_S = 3600
PAYLOAD_KEEP = 60          # end = start + 60 steps, so 4 of 64 samples fall outside
OVERLAP_HISTORY_END = "2024-01-20 00:00:00"
OVERLAP_FORECAST_START = "2024-01-18 00:00:00"


def _weather_from_channels(temp, humid, press, cloud, wind, gust, direction):
    dew = temp - (F.lit(100.0) - humid) / 4.0
    apparent = temp - wind / 4.0
    return [
        temp.alias("temperature"),
        humid.alias("humidity"),
        dew.alias("dew_point"),
        apparent.alias("apparent_temperature"),
        press.alias("pressure"),
        cloud.alias("cloud_cover"),
        wind.alias("wind_speed"),
        gust.alias("wind_gusts"),
        direction.alias("wind_direction"),
    ]


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: one row per hour with nine weather columns, from ``events``.

    Each channel is the hourly maximum of one event type, in quarter units;
    an hour without that event type gives NULL. All channel values are
    binary fractions, so daily sums are exact in any summation order and
    the engine and the oracle agree bit for bit. Partial aggregation runs
    before the shuffle, so the exchange carries at most one row per hour
    per map task.
    """
    ev = read_table(spark, sf_dir, "events").select("ts", "event_type", "value")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts")

    def ch(name):
        return F.max(F.when(F.col("event_type") == name, F.rint(F.col("value") * 4.0) / 4.0))

    agg = ev.groupBy(hour).agg(
        ch("view").alias("v_view"), ch("click").alias("v_click"), ch("purchase").alias("v_purchase"),
        ch("signup").alias("v_signup"), ch("error").alias("v_error"))
    temp = F.col("v_view") / 16.0 - 5.0
    humid = F.col("v_click") / 8.0 + 35.0
    press = F.col("v_purchase") / 8.0 + 980.0
    cloud = F.col("v_signup") / 4.0
    wind = F.col("v_error") / 32.0
    gust = F.col("v_error") / 16.0
    direction = F.floor(F.col("v_click") / 62.0) * 45.0
    return agg.select("ts", *_weather_from_channels(temp, humid, press, cloud, wind, gust, direction))


#: Weather history and newly fetched readings overlap between these days.
FETCHED_FROM, HISTORY_TO = "1998-01-01", "1998-03-01"


def line_weather_update(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """FX7 at raw grain: readings known so far and readings fetched now, with the key of a reading; they overlap."""
    w = line_weather(spark, sf_dir, ids=True)
    return (w.filter(F.col("ts") < F.lit(HISTORY_TO).cast("timestamp_ntz")),
            w.filter(F.col("ts") >= F.lit(FETCHED_FROM).cast("timestamp_ntz")))


def line_weather(spark: SparkSession, sf_dir: str, site: bool = False, ids: bool = False) -> DataFrame:
    """Raw-grain weather readings from ``lineitem`` (one reading per line at its ship date).

    This is the long daily series (FX3) once rolled up by day. Values are
    binary fractions (see :func:`hourly`). With ``site`` (FX1) each supplier is
    a site with readings of its own. With ``ids`` a reading's key names its line,
    part, supplier and day (order and line number alone repeat).
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        *(["l_suppkey"] if site else []), *(["l_orderkey", "l_partkey"] if ids else []), *(["l_suppkey"] if ids and not site else []),
        "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber")
    disc = F.rint(F.col("l_discount") * 100.0)
    tax = F.rint(F.col("l_tax") * 100.0)
    temp = F.col("l_quantity") / 2.0 - 5.0
    humid = disc * 5.0 + 40.0
    press = tax * 5.0 + 990.0
    cloud = F.rint(F.col("l_extendedprice") / 1050.0)
    wind = F.col("l_quantity") * disc / 16.0
    gust = wind + tax
    direction = (F.col("l_linenumber") * 45).cast("double")
    return li.select(*([F.col("l_suppkey").alias("site")] if site else []),
                     *([F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("reading_id")] if ids else []),
                     F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
                     *_weather_from_channels(temp, humid, press, cloud, wind, gust, direction))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: dated, categorised tickets from ``orders`` (system = order priority)."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("ticket_id"),
        F.col("o_orderpriority").alias("unit"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created"),
        F.col("o_totalprice").alias("amount"),
    )


def ticket_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: free-text tickets with a specific or generic unit, from ``documents`` and ``labels``.

    toxic = 1 -> C3, quality = 1 -> C1, quality = 0 -> C2, unlabelled -> GENERIC.
    ``labels`` has at most one row per document, so AQE broadcasts it when small.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    unit = (F.when(F.col("toxic") == 1, F.lit("C3"))
            .when(F.col("quality") == 1, F.lit("C1"))
            .when(F.col("quality") == 0, F.lit("C2"))
            .otherwise(F.lit(GENERIC)))
    return j.select(F.col("doc_id").alias("ticket_id"), unit.alias("unit"),
                    F.col("text"), F.col("source").alias("text2"))


def quality_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths with the quality label, NULL where there is none."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ticket_id"), F.length("text").cast("double").alias("n_chars"))
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ticket_id"), "quality")
    return d.join(lab, "ticket_id", "left")


def hash_unit(key_col, salt: str) -> F.Column:
    """Deterministic value in [0, 1) from md5(key|salt); equal in DuckDB."""
    h = F.md5(F.concat(key_col.cast("string"), F.lit("|" + salt)))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 1000) / 1000.0


def ticket_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX9: FX5 plus three deterministic class probabilities (no model needed)."""
    t = ticket_text(spark, sf_dir)
    probs = [hash_unit(F.col("ticket_id"), c).alias(f"p_{c}") for c in PROB_CLASSES]
    return t.select("*", *probs)


def dated(tickets_: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation dates for text tickets: those of the order of the same number."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket_id"),
                                                   F.col("o_orderdate").cast("timestamp_ntz").alias("created"))
    return tickets_.join(o, "ticket_id")


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: one payload per embedding: start, end, step and two aligned arrays."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    start = F.timestamp_add("DAY", F.col("vec_id"), F.lit(PAYLOAD_BASE).cast("timestamp_ntz"))
    vals = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    return e.select(
        F.col("vec_id").alias("series_id"),
        start.alias("start_ts"),
        F.timestamp_add("SECOND", F.lit(PAYLOAD_KEEP * PAYLOAD_STEP_S), start).alias("end_ts"),
        F.lit(PAYLOAD_STEP_S).alias("step_s"),
        vals.alias("value"),
        F.transform(vals, lambda x: x * x).alias("value_sq"),
    )


def payload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6 as landed: one JSON document per embedding, times in epoch seconds."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return payload(spark, sf_dir).select(F.to_json(F.struct("series_id", F.struct(
        F.timestamp_diff("SECOND", epoch, F.col("start_ts")).alias("start"),
        F.timestamp_diff("SECOND", epoch, F.col("end_ts")).alias("end"),
        F.col("step_s").alias("interval"), "value", "value_sq").alias("hourly"))).alias("value"))


def overlap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """FX7: FX2 cut into history (< Jan 20) and forecast (>= Jan 18, values + 1)."""
    h = hourly(spark, sf_dir)
    hist = h.filter(F.col("ts") < F.lit(OVERLAP_HISTORY_END).cast("timestamp_ntz"))
    fc = h.filter(F.col("ts") >= F.lit(OVERLAP_FORECAST_START).cast("timestamp_ntz"))
    fc = fc.select("ts", *[(F.col(c) + 1.0).alias(c) for c in h.columns if c != "ts"])
    return hist, fc


def predictions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX8: (system, model, date, y, y_hat) from three naive predictors on FX4 daily counts.

    Windows are partitioned by system, so each runs on one system's daily
    series (bounded by the calendar, not by the ticket volume).
    """
    from faultcast.operators.rollup import daily_count
    from pyspark.sql import Window

    counts = daily_count(tickets(spark, sf_dir), ts_col="created", keys=["unit"]).withColumnRenamed("unit", "system")
    w = Window.partitionBy("system").orderBy("date")
    prev = F.lag("fault_count", 1).over(w)
    mean7 = F.avg("fault_count").over(w.rowsBetween(-7, -1))
    overall = F.avg("fault_count").over(Window.partitionBy("system"))
    wide = counts.select("system", "date", F.col("fault_count").cast("double").alias("y"),
                         prev.cast("double").alias("previous"), mean7.alias("mean7"), overall.alias("overall"))
    wide = wide.filter(F.col("previous").isNotNull())
    return wide.select("system", "date", "y", F.stack(
        F.lit(3), F.lit("previous"), F.col("previous"), F.lit("mean7"), F.col("mean7"),
        F.lit("overall"), F.col("overall")).alias("model", "y_hat"))
