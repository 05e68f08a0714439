"""Landed API payloads (start, end, step, aligned arrays) -> one row per time step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def explode_series(df: DataFrame, arrays: list[str], start: str = "start_ts", end: str = "end_ts",
                   step: str = "step_s", keys=("series_id",)) -> DataFrame:
    """Timestamps start + pos * step (start included, end excluded), arrays aligned by position.

    ``posexplode(arrays_zip(...))`` runs inside each task: no shuffle.
    """
    keys = list(keys)
    # a missing array is an empty one: arrays_zip of a null would lose the whole payload
    full = [F.coalesce(F.col(a), F.array().cast(df.schema[a].dataType)).alias(a) for a in arrays]
    z = df.select(*keys, start, end, step, *full).select(
        *keys, start, end, step, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "v"))
    ts = F.timestamp_add("SECOND", F.col("pos") * F.col(step), F.col(start))
    out = z.select(*keys, ts.alias("ts"), "pos", *[F.col(f"v.{a}").alias(a) for a in arrays], end)
    return out.filter(F.col("ts") < F.col(end)).drop(end)


def read_payloads(spark: SparkSession, path: str, variables: list[str], key: str = "series_id", key_type: str = "bigint",
                  block: str = "hourly", skip_bad: bool = False) -> DataFrame:
    """Landed JSON documents, one a line, as rows for :func:`explode_series`.

    A document holds ``key`` and an object ``block`` with ``start`` and ``end``
    (epoch seconds, UTC), ``interval`` (seconds) and an array per variable.  It is
    parsed once, as VARIANT, whatever other fields it has.  A variable that a
    document lacks is null; arrays may hold nulls and differ in length.  Text that
    is no JSON fails the read, with ``skip_bad`` such lines and documents without a
    time range are left out.  Blank lines are left out always.
    """
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parse = F.try_parse_json if skip_bad else F.parse_json
    doc = raw.select(parse("value").alias("doc"))
    get = F.try_variant_get if skip_bad else F.variant_get
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def at(name: str):
        return F.timestamp_add("SECOND", get("doc", f"$.{block}.{name}", "bigint"), epoch)

    out = doc.select(get("doc", f"$.{key}", key_type).alias(key), at("start").alias("start_ts"), at("end").alias("end_ts"),
                     get("doc", f"$.{block}.interval", "int").alias("step_s"),
                     *[get("doc", f"$.{block}.{v}", "array<double>").alias(v) for v in variables])
    return out.dropna(subset=["start_ts", "end_ts", "step_s"]) if skip_bad else out
