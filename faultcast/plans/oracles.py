"""Independent SQL oracles (DuckDB dialect) for the registered queries.

Each oracle is written against the raw tables (``events``, ``lineitem``,
``orders``, ``documents``, ``labels``, ``embeddings``) and rebuilds the
fixture adapters as CTEs. Doubles are rounded half-even to 6 places
(``round_even(x*1e6,0)/1e6``), integers cast to BIGINT, to match
:func:`faultcast.functions.scalars.normalize_output`.
"""

from __future__ import annotations

from faultcast.functions.scalars import BEAUFORT_BOUNDS
from faultcast.plans import spec

ORACLES: dict[str, str] = {}


def r6(e: str) -> str:
    return f"round_even(({e})*1e6, 0)/1e6"


def r2(e: str) -> str:
    return f"round_even(({e})*100.0, 0)/100.0"


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    seen, parts = set(), []
    for name, body in ctes:
        if name in seen:
            continue
        seen.add(name)
        parts.append(f"{name} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + final if parts else final


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ---------------------------------------------------------------- fixture CTEs

def _weather_select(inner: str, keys: str = "") -> str:
    return f"""SELECT {keys}ts, temperature, humidity, temperature - (100.0 - humidity)/4.0 AS dew_point,
  temperature - wind_speed/4.0 AS apparent_temperature, pressure, cloud_cover, wind_speed, wind_gusts, wind_direction
FROM ({inner}) w"""


def cte_hourly(name: str = "hourly") -> tuple[str, str]:
    chans = ", ".join(f"max(CASE WHEN event_type = '{c}' THEN round_even(value*4.0, 0)/4.0 END) AS v_{c}"
                      for c in ("view", "click", "purchase", "signup", "error"))
    inner = f"""SELECT ts, v_view/16.0 - 5.0 AS temperature, v_click/8.0 + 35.0 AS humidity, v_purchase/8.0 + 980.0 AS pressure,
  v_signup/4.0 AS cloud_cover, v_error/32.0 AS wind_speed, v_error/16.0 AS wind_gusts, floor(v_click/62.0)*45.0 AS wind_direction
FROM (SELECT date_trunc('hour', ts) AS ts, {chans} FROM events GROUP BY 1) a"""
    return name, _weather_select(inner)


def cte_line_weather(name: str = "line_weather", site: bool = False) -> tuple[str, str]:
    key, own = ("site, ", "l_suppkey AS site, ") if site else ("", "")
    inner = f"""SELECT {key}ts, temperature, disc*5.0 + 40.0 AS humidity, tax*5.0 + 990.0 AS pressure, cloud_cover,
  l_quantity*disc/16.0 AS wind_speed, l_quantity*disc/16.0 + tax AS wind_gusts, wind_direction
FROM (SELECT {own}l_shipdate AS ts, l_quantity, l_quantity/2.0 - 5.0 AS temperature, round_even(l_discount*100.0, 0) AS disc,
  round_even(l_tax*100.0, 0) AS tax, round_even(l_extendedprice/1050.0, 0) AS cloud_cover,
  (l_linenumber*45)::DOUBLE AS wind_direction FROM lineitem) l"""
    return name, _weather_select(inner, key)


def cte_tickets(name: str = "tickets") -> tuple[str, str]:
    return name, """SELECT o_orderkey AS ticket_id, o_orderpriority AS unit, o_orderstatus AS status,
  o_orderdate AS created, o_totalprice AS amount FROM orders"""


def stat_sql() -> list[str]:
    out = []
    for role, prefix, fns in spec.DAILY_STATS:
        c = spec.HOURLY[role]
        for fn in fns:
            out.append(f"{fn}({c}) AS {prefix}_{fn}")
    return out


def range_sql() -> list[str]:
    return [f"max({spec.HOURLY[r]}) - min({spec.HOURLY[r]}) AS {n}" for r, n in spec.DAILY_RANGES]


def count_sql() -> list[str]:
    return [f"count_if({spec.HOURLY[r]} {op} {thr}) AS {n}" for r, n, op, thr in spec.DAILY_COUNTS]


def cte_mode(src: str, name: str, keys: str = "") -> tuple[str, str]:
    c = spec.HOURLY[spec.DAILY_MODE[0]]
    return name, f"""SELECT {keys}date, v AS {spec.DAILY_MODE[1]} FROM (
  SELECT {keys}date, v, row_number() OVER (PARTITION BY {keys}date ORDER BY n DESC, v ASC) AS rn
  FROM (SELECT {keys}ts::DATE AS date, {c} AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY ALL) x) y
WHERE rn = 1"""


def cte_daily_stats(src: str, name: str, keys: str = "") -> list[tuple[str, str]]:
    """A1-A4 in SQL: one aggregate plus the spelled-out mode, left-joined."""
    mode_name = f"{name}_mode"
    exprs = ",\n  ".join(stat_sql() + range_sql() + count_sql())
    agg = f"SELECT {keys}ts::DATE AS date,\n  {exprs}\nFROM {src} GROUP BY ALL"
    return [cte_mode(src, mode_name, keys), (f"{name}_agg", agg),
            (name, f"SELECT a.*, m.{spec.DAILY_MODE[1]} FROM {name}_agg a LEFT JOIN {mode_name} m USING ({keys}date)")]


def beaufort_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} < {b} THEN {i}" for i, b in enumerate(BEAUFORT_BOUNDS))
    return f"CASE {parts} WHEN {x} IS NOT NULL THEN 12 END"


def daily_weather_columns() -> list[str]:
    """Output columns of E1 in order (no keys)."""
    return ["date", *spec.daily_columns()]


def cte_daily_weather(src_cte: tuple[str, str], name: str, keys: str = "") -> list[tuple[str, str]]:
    """E1 in SQL: statistics, calendar, derived features, 2-dp half-even rounding."""
    st = f"{name}_st"
    ctes = [src_cte] + cte_daily_stats(src_cte[0], st, keys)
    dbl = []
    for _, prefix, fns in spec.DAILY_STATS:
        dbl += [f"{r2(f'{prefix}_{fn}')} AS {prefix}_{fn}" for fn in fns]
    dbl += [f"{r2(n)} AS {n}" for _, n in spec.DAILY_RANGES]
    ints = [f"{n}" for _, n, _, _ in spec.DAILY_COUNTS]
    mode = f"{r2(spec.DAILY_MODE[1])} AS {spec.DAILY_MODE[1]}"
    part = f"PARTITION BY {keys[:-2]} " if keys else ""
    w = f"OVER ({part}ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    flags = []
    for n, c, op, thr in spec.DAY_FLAGS:
        flags.append(f"coalesce(({c} {op} {thr})::INTEGER, 0) AS {n}")
    wn, wc, wop, wthr = spec.WINDY_FLAG
    body = f"""SELECT {keys}date, weekofyear(date) AS week, isodow(date) AS dow, month(date) AS month,
  (floor((month(date) % 12) / 3) + 1)::BIGINT AS season, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  {", ".join(dbl)}, {", ".join(ints)}, {mode},
  {r2('temp_max - temp_min')} AS temp_range, {r2('temp_avg * humidity_avg')} AS temp_humidity,
  {r2(f'avg(temp_avg) {w}')} AS temp_roll3, {r2(f'avg(humidity_avg) {w}')} AS humidity_roll3,
  {", ".join(flags)}, {beaufort_sql('wind_avg')} AS beaufort, coalesce(({wc} {wop} {wthr})::INTEGER, 0) AS {wn}
FROM {st}"""
    return ctes + [(name, body)]


def cte_counts(name: str = "counts") -> list[tuple[str, str]]:
    return [cte_tickets(), (name, "SELECT unit AS system, created::DATE AS date, count(*) AS fault_count FROM tickets GROUP BY 1, 2")]


def cte_training(name: str = "training") -> list[tuple[str, str]]:
    """E9 in SQL: counts -> per-system z filter (|z| <= 6, constant kept) -> inner join on date."""
    ctes = cte_counts() + cte_daily_weather(cte_line_weather(), "dw_long")
    ctes.append(("cstats", "SELECT system, avg(fault_count) AS m, stddev_pop(fault_count) AS s FROM counts GROUP BY 1"))
    ctes.append(("kept", """SELECT c.* FROM counts c JOIN cstats USING (system)
WHERE s IS NULL OR s = 0 OR abs((fault_count - m) / s) <= 6"""))
    ctes.append((name, "SELECT k.system, k.date, k.fault_count, w.* EXCLUDE (date) FROM kept k JOIN dw_long w USING (date)"))
    return ctes


def _all_double_r6(cols: list[str]) -> str:
    return ", ".join(f"{r6(c)} AS {c}" for c in cols)


# ---------------------------------------------------------------- A1-A5, E1, J1, E9

def _stat_names():
    return [f"{p}_{fn}" for _, p, fns in spec.DAILY_STATS for fn in fns]


oracle("daily_rollup", with_([cte_hourly()], f"""SELECT date, {_all_double_r6(_stat_names())}
FROM (SELECT ts::DATE AS date, {", ".join(stat_sql())} FROM hourly GROUP BY 1) a"""))

oracle("daily_range", with_([cte_line_weather()], f"""SELECT date, {_all_double_r6([n for _, n in spec.DAILY_RANGES])}
FROM (SELECT ts::DATE AS date, {", ".join(range_sql())} FROM line_weather GROUP BY 1) a"""))

oracle("daily_counts_where", with_([cte_hourly()], f"SELECT ts::DATE AS date, {', '.join(count_sql())} FROM hourly GROUP BY 1"))

oracle("daily_mode", with_([cte_hourly(), ("dates", "SELECT DISTINCT ts::DATE AS date FROM hourly"), cte_mode("hourly", "md")],
                           f"SELECT d.date, {r6('md.' + spec.DAILY_MODE[1])} AS {spec.DAILY_MODE[1]} FROM dates d LEFT JOIN md USING (date)"))

oracle("daily_count", with_(cte_counts(), "SELECT * FROM counts"))

oracle("daily_weather", with_(cte_daily_weather(cte_hourly(), "dw"), "SELECT * FROM dw"))

oracle("daily_weather_long", with_(cte_daily_weather(cte_line_weather(), "dw_long"), "SELECT * FROM dw_long"))

oracle("daily_weather_sites", with_(cte_daily_weather(cte_line_weather("site_weather", True), "dw_sites", "site, "),
                                    "SELECT * FROM dw_sites"))

oracle("join_daily", with_(cte_counts() + [cte_line_weather()], f"""SELECT c.system, c.date, c.fault_count,
  {r6('f.temp_avg')} AS temp_avg, {r6('f.humidity_avg')} AS humidity_avg, f.clear_hours
FROM counts c JOIN (SELECT ts::DATE AS date, avg(temperature) AS temp_avg, avg(humidity) AS humidity_avg,
  count_if(cloud_cover < 10.0) AS clear_hours FROM line_weather GROUP BY 1) f USING (date)"""))

oracle("training_table", with_(cte_training(), "SELECT * FROM training"))

