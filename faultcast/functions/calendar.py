"""Calendar parts of a date (F1-F7). All are built-in, codegen'd expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season labels for months, used only when no season number exists.
SEASON_LABELS = {1: "winter", 2: "spring", 3: "summer", 4: "autumn"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_week(d) -> Column:
    """ISO-8601 week number (F1)."""
    return F.weekofyear(_c(d))


def iso_dow(d) -> Column:
    """Monday = 1 ... Sunday = 7 (F2). ``dayofweek`` would make Sunday 1."""
    return F.weekday(_c(d)) + 1


def dow0(d) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(d))


def is_weekend(d) -> Column:
    """1 for Saturday and Sunday."""
    return (F.weekday(_c(d)) >= 5).cast("int")


def season_no(month) -> Column:
    """Dec-Feb 1, Mar-May 2, Jun-Aug 3, Sep-Nov 4."""
    return (F.floor((_c(month) % 12) / 3) + 1).cast("int")


def season_label(month) -> Column:
    """Text label of the season of a month."""
    s = season_no(month)
    out = None
    for k, label in SEASON_LABELS.items():
        out = F.when(s == k, F.lit(label)) if out is None else out.when(s == k, F.lit(label))
    return out


def calendar_parts(d) -> dict[str, Column]:
    """Every calendar part the pipelines use (F1-F6), keyed by output name."""
    d = _c(d)
    return {
        "week": iso_week(d),
        "iso_dow": iso_dow(d),
        "dow0": dow0(d),
        "day": F.dayofmonth(d),
        "month": F.month(d),
        "year": F.year(d),
        "quarter": F.quarter(d),
        "day_of_year": F.dayofyear(d),
        "is_weekend": is_weekend(d),
        "season": season_no(F.month(d)),
    }
