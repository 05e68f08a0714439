"""Joins (J1, J3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultcast.functions.scalars import round_even


def join_daily(counts: DataFrame, daily: DataFrame, on: str | list[str] = "date") -> DataFrame:
    """Inner equi-join of per-day counts and per-day features; unmatched days disappear.

    No hint: AQE turns the sort-merge join into a broadcast join at runtime
    when the measured daily side is under the broadcast threshold.
    """
    return counts.join(daily, on, "inner")


def assemble_predictions(scores: DataFrame, systems: list[str], key: str = "date", system_col: str = "system",
                         pred_col: str = "prediction", suffix: str = "_fault_prediction",
                         names: dict[str, str] | None = None) -> DataFrame:
    """Per-system scores side by side on ``key``, half-even rounded to integers.

    One conditional aggregate instead of a chain of joins (one shuffle);
    keeping only keys that every system scored gives inner-join semantics.
    """
    aggs = [F.max(F.when(F.col(system_col) == s, F.col(pred_col))).alias(s) for s in systems]
    wide = scores.groupBy(key).agg(*aggs)
    cond = None
    for s in systems:
        c = F.col(f"`{s}`").isNotNull()
        cond = c if cond is None else cond & c
    return wide.filter(cond).select(
        key, *[round_even(F.col(f"`{s}`")).cast("bigint").alias(f"{(names or {}).get(s, s)}{suffix}") for s in systems])
