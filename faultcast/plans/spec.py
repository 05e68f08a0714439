"""The weather spec: hourly input columns, daily output names and thresholds.

Every operator takes names and thresholds as parameters; the defaults of
the composed pipelines come from here and nowhere else.
"""

from __future__ import annotations

# Hourly input columns (role -> column name of the hourly table).
HOURLY = {
    "temperature": "temperature",
    "humidity": "humidity",
    "dew_point": "dew_point",
    "apparent": "apparent_temperature",
    "pressure": "pressure",
    "cloud": "cloud_cover",
    "wind": "wind_speed",
    "gust": "wind_gusts",
    "direction": "wind_direction",
}

# Daily statistics: (hourly role, daily prefix, statistics), in output order.
DAILY_STATS = [
    ("temperature", "temp", ("min", "max", "avg")),
    ("humidity", "humidity", ("min", "max", "avg")),
    ("dew_point", "dewpoint", ("min", "max", "avg")),
    ("apparent", "apparent", ("min", "max", "avg")),
    ("pressure", "pressure", ("min", "max", "avg")),
    ("cloud", "cloud", ("min", "max", "avg")),
    ("wind", "wind", ("min", "max", "avg")),
    ("gust", "gust", ("max", "avg")),
]

# Daily spreads (max - min of one hourly role).
DAILY_RANGES = [("temperature", "temp_spread"), ("pressure", "pressure_delta")]

# Hour counts and their strict thresholds (role, output, op, threshold).
DAILY_COUNTS = [
    ("cloud", "clear_hours", "<", 10.0),
    ("cloud", "cloudy_hours", ">", 90.0),
    ("gust", "strong_gust_hours", ">", 14.0),
]

DAILY_MODE = ("direction", "dominant_wind_dir")

CALENDAR_COLS = ["week", "dow", "month", "season", "is_weekend"]

# Day flags (output, daily column, op, threshold), all strict.
DAY_FLAGS = [
    ("hot_day", "temp_max", ">", 25.0),
    ("frost_day", "temp_min", "<", 0.0),
    ("humid_day", "humidity_avg", ">", 85.0),
]
WINDY_FLAG = ("windy_day", "wind_max", ">", 10.0)

# Daily names the feature pipelines work on.
TEMP_AVG = "temp_avg"
TEMP_MIN = "temp_min"
TEMP_MAX = "temp_max"
HUMIDITY_AVG = "humidity_avg"
WIND_AVG = "wind_avg"
TARGET = "fault_count"


def daily_columns() -> list[str]:
    """Columns of the daily weather table (E1) in order, without keys and date."""
    out = list(CALENDAR_COLS)
    for _, prefix, fns in DAILY_STATS:
        out += [f"{prefix}_{fn}" for fn in fns]
    out += [n for _, n in DAILY_RANGES] + [n for _, n, _, _ in DAILY_COUNTS] + [DAILY_MODE[1]]
    out += ["temp_range", "temp_humidity", "temp_roll3", "humidity_roll3"] + [n for n, *_ in DAY_FLAGS]
    return out + ["beaufort", WINDY_FLAG[0]]
