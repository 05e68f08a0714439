"""Scans and sinks.

Every scan takes an explicit schema (no inference pass over the data) and
turns NaN into NULL, because pandas skips NaN in min/max/mean while Spark
would propagate it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultcast.functions.scalars import nan_to_null


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one given table; filters and projections push into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_series_csv(spark: SparkSession, path: str, schema: T.StructType | str,
                    ts_col: str | None = "ts", ts_format: str | None = None) -> DataFrame:
    """Header CSV with a declared schema; the time column is parsed to TIMESTAMP_NTZ."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    fields = []
    for f in schema.fields:
        fields.append(T.StructField(f.name, T.StringType() if f.name == ts_col else f.dataType, True))
    df = (spark.read.option("header", True).option("mode", "PERMISSIVE").options(**CSV_TEXT)
          .option("nanValue", "NaN").schema(T.StructType(fields)).csv(path))
    if ts_col:
        parsed = F.to_timestamp_ntz(F.col(ts_col), F.lit(ts_format)) if ts_format else F.to_timestamp_ntz(F.col(ts_col))
        df = df.withColumn(ts_col, parsed)
    return nan_to_null(df)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (works for any shared store)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def read_first_available(spark: SparkSession, paths: list[str], reader) -> DataFrame:
    """Read the first path that exists with ``reader(spark, path)``; raise if none does."""
    for p in paths:
        if path_exists(spark, p):
            return reader(spark, p)
    raise FileNotFoundError(f"none of the inputs exists: {paths}")


#: Texts may hold quotes and line breaks; a field's own quotes are doubled, and nulls differ from empty texts.
CSV_TEXT = {"quote": '"', "escape": '"', "nullValue": "\\N", "emptyValue": ""}


def read_tickets(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema: T.StructType | str | None = None) -> DataFrame:
    """S3: the exported ticket table (parquet or header CSV with multi-line texts).

    Workbook decoding is not built; tickets enter as an exported table. A CSV
    file whose texts hold line breaks can't be split, so a file is one task's:
    at scale export parquet, or many files.
    """
    if fmt == "csv":
        rdr = spark.read.option("header", True).option("multiLine", True).options(**CSV_TEXT)
        if schema is not None:
            rdr = rdr.schema(schema)
        return rdr.csv(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table at a stage end (parquet by default, CSV with header on request)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).options(**CSV_TEXT).option("quoteAll", True).csv(path)
    else:
        w.parquet(path)


def write_daily(daily: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """S5 for daily tables: partitioned by ``keys`` and year-month, so that a date range reads a few folders."""
    write_table(daily.withColumn("ym", F.date_format("date", "yyyy-MM")), path, partition_by=[*(keys or []), "ym"])


def read_daily(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """The daily table, or its days from ``first`` to ``last`` (ISO dates): a partition filter and a date filter."""
    d = spark.read.parquet(path)
    if first is not None:
        d = d.filter((F.col("ym") >= F.date_format(F.lit(first).cast("date"), "yyyy-MM"))
                     & (F.col("date") >= F.lit(first).cast("date")))
    if last is not None:
        d = d.filter((F.col("ym") <= F.date_format(F.lit(last).cast("date"), "yyyy-MM"))
                     & (F.col("date") <= F.lit(last).cast("date")))
    return d.drop("ym")


LEADERBOARD_SCHEMA = T.StructType([
    T.StructField("system", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("mse", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("trained_at", T.StringType()),
])


def write_leaderboard(board: DataFrame, path: str) -> None:
    """Write the flat leaderboard as JSON lines."""
    board.write.mode("overwrite").json(path)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Read the leaderboard back with its declared schema."""
    return spark.read.schema(LEADERBOARD_SCHEMA).json(path)


def nested_leaderboard(board: DataFrame) -> DataFrame:
    """S8 nested view: per system the best model, its metrics and a map of every model's metrics.

    The map holds one entry per model (a handful), so ``collect_list`` per
    system is bounded by the model list, not by the data.
    """
    from faultcast.operators.ranking import best_model

    m = F.struct(F.col("mse").alias("MSE"), F.col("rmse").alias("RMSE"),
                 F.col("mae").alias("MAE"), F.col("r2").alias("R2"))
    best = best_model(board, keys=["system"], score="r2").select(
        "system", F.col("model_name").alias("best_model"), m.alias("metrics"))
    allm = board.groupBy("system").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("model_name"), m))).alias("all_metrics"),
        F.max("trained_at").alias("trained_at"))
    return best.join(allm, "system")
