"""Registered queries: one per operator of the inventory, each over the given tables.

Every query reads the parquet tables of ``sf_dir`` (through the fixture
adapters) and returns a DataFrame with canonical output types
(:func:`normalize_output`), so that it can be compared with its SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultcast.functions.scalars import normalize_output
from faultcast.operators import rollup
from faultcast.plans import spec
from faultcast.plans.training import daily_fault_counts, fault_training_table
from faultcast.plans.weather import daily_stats, daily_weather
from faultcast.session import stage
from faultcast.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize_output(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ---------------------------------------------------------------- shared inputs

def weather_fx2(spark, sf_dir) -> DataFrame:
    """E1 on the hourly events grid (30 days), materialised."""
    return stage(daily_weather(fx.hourly(spark, sf_dir)))


def weather_fx3(spark, sf_dir) -> DataFrame:
    """E1 on the lineitem readings (the long daily series, ~2,500 days), materialised."""
    return stage(daily_weather(fx.line_weather(spark, sf_dir)))


def training_fx(spark, sf_dir) -> DataFrame:
    """E9 on FX4 tickets and the FX3 daily weather, materialised."""
    return stage(fault_training_table(fx.tickets(spark, sf_dir), weather_fx3(spark, sf_dir)))


# ---------------------------------------------------------------- aggregations (A1-A5)

@query("daily_rollup")
def q_daily_rollup(spark, sf_dir):
    """A1: min/max/mean per day of the hourly grid."""
    return rollup.daily_rollup(fx.hourly(spark, sf_dir))


@query("daily_range")
def q_daily_range(spark, sf_dir):
    """A2: intraday spread of temperature and pressure on the lineitem readings."""
    return rollup.daily_aggregate(fx.line_weather(spark, sf_dir), exprs=rollup.range_exprs())


@query("daily_counts_where")
def q_daily_counts_where(spark, sf_dir):
    """A3: hours with cloud < 10, cloud > 90, gust > 14 per day."""
    return rollup.daily_aggregate(fx.hourly(spark, sf_dir), exprs=rollup.count_exprs())


@query("daily_mode")
def q_daily_mode(spark, sf_dir):
    """A4: dominant wind direction per day (smallest on ties)."""
    return rollup.daily_mode(fx.hourly(spark, sf_dir))


@query("daily_count")
def q_daily_count(spark, sf_dir):
    """A5: tickets per (system, day)."""
    return daily_fault_counts(fx.tickets(spark, sf_dir))


@query("daily_weather")
def q_daily_weather(spark, sf_dir):
    """The 44-column daily weather table of the hourly grid."""
    return weather_fx2(spark, sf_dir)


@query("daily_weather_long")
def q_daily_weather_long(spark, sf_dir):
    """E1 on the long lineitem series."""
    return weather_fx3(spark, sf_dir)


@query("daily_weather_sites")
def q_daily_weather_sites(spark, sf_dir):
    """E1 by site (FX1): windows and statistics per site."""
    return daily_weather(fx.line_weather(spark, sf_dir, site=True), keys=["site"])


@query("join_daily")
def q_join_daily(spark, sf_dir):
    """Daily ticket counts inner-joined with daily features on date."""
    from faultcast.operators.joins import join_daily
    counts = daily_fault_counts(fx.tickets(spark, sf_dir))
    feats = daily_stats(fx.line_weather(spark, sf_dir)).select("date", "temp_avg", "humidity_avg", "clear_hours")
    return join_daily(counts, feats)


@query("training_table")
def q_training_table(spark, sf_dir):
    """The per-system training table."""
    return training_fx(spark, sf_dir)

