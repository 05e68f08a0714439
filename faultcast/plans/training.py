"""Tickets + daily weather -> the per-system training table (A5 -> O3 -> J1 -> P1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultcast.operators import rollup
from faultcast.operators.columns import select_ordered
from faultcast.operators.joins import join_daily
from faultcast.operators.stats import drop_zscore_rows
from faultcast.plans import spec


def daily_fault_counts(tickets: DataFrame, unit_col: str = "unit", ts_col: str = "created",
                       systems: list[str] | None = None) -> DataFrame:
    """A5 for every system in one pass: (system, date, fault_count)."""
    t = tickets if systems is None else tickets.filter(F.col(unit_col).isin(list(systems)))
    return rollup.daily_count(t, ts_col, [unit_col], spec.TARGET).withColumnRenamed(unit_col, "system")


def fault_training_table(tickets: DataFrame, daily: DataFrame, unit_col: str = "unit", ts_col: str = "created",
                         systems: list[str] | None = None, z_thr: float = 6.0, parity: bool = False) -> DataFrame:
    """Per-system daily fault counts, z-score filtered per system, inner-joined to weather on date.

    Days without faults disappear, as in the reference (inner join). The
    weather side is daily grain; AQE broadcasts it when it is small and
    falls back to a sort-merge join otherwise.
    """
    return training_of_counts(daily_fault_counts(tickets, unit_col, ts_col, systems), daily, z_thr, parity)


def training_of_counts(counts: DataFrame, daily: DataFrame, z_thr: float = 6.0, parity: bool = False) -> DataFrame:
    """The rest of E9, from daily fault counts."""
    # daily counts are calendar-bounded per system: a per-system window avoids a second scan
    kept = drop_zscore_rows(counts, spec.TARGET, z_thr, keys=["system"], parity=parity, via_window=True)
    joined = join_daily(kept, daily)
    return select_ordered(joined, ["system", "date", spec.TARGET])
