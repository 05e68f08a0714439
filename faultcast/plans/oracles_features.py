"""SQL oracles for windows, outliers, feature pipelines and scalers.

Column lists are mirrored in Python (``Cols``) so that every double column
can be rounded to 6 places and every pipeline stage can be written as one
SELECT, just like the DataFrame version.
"""

from __future__ import annotations

import math

from faultcast.plans import spec
from faultcast.plans.oracles import (cte_counts, cte_daily_weather, cte_line_weather, cte_training,
                                     daily_weather_columns, oracle, r6, with_)

TWO_PI = repr(2 * math.pi)
T = spec.TEMP_AVG
H = spec.HUMIDITY_AVG

TRAIN_INT = {"fault_count", "week", "dow", "month", "season", "is_weekend", "clear_hours", "cloudy_hours",
             "strong_gust_hours", "hot_day", "frost_day", "humid_day", "beaufort", "windy_day"}


class Cols:
    """Ordered column list with a per-column kind: d (double), i (integer), s (string), t (date)."""

    def __init__(self, items):
        self.items = list(items)

    @property
    def names(self):
        return [n for n, _ in self.items]

    def kind(self, n):
        return dict(self.items)[n]

    def assign(self, new):
        """Pandas-style assignment: replace in place, append new names."""
        d = dict(new)
        out = [(n, d.pop(n)) if n in d else (n, k) for n, k in self.items]
        out += list(d.items())
        return Cols(out)

    def rename(self, a, b):
        return Cols([(b if n == a else n, k) for n, k in self.items])

    def drop(self, names):
        return Cols([(n, k) for n, k in self.items if n not in names])

    def numeric(self, exclude=()):
        return [n for n, k in self.items if k in ("d", "i") and n not in exclude]

    def final(self, src: str, fill0: bool = False) -> str:
        parts = []
        for n, k in self.items:
            e = f"coalesce({n}, 0)" if fill0 and k in ("d", "i") else n
            parts.append(f"{r6(e)} AS {n}" if k == "d" else (f"{e} AS {n}" if e != n else n))
        return f"SELECT {', '.join(parts)} FROM {src}"


def train_cols() -> Cols:
    items = [("system", "s"), ("date", "t")]
    for c in ["fault_count"] + daily_weather_columns()[1:]:
        items.append((c, "i" if c in TRAIN_INT else "d"))
    return Cols(items)


def win(keys, frame: str | None = None, extra_keys=()) -> str:
    part = ", ".join([*keys, *extra_keys])
    p = f"PARTITION BY {part} " if part else ""
    return f"OVER ({p}ORDER BY date{(' ' + frame) if frame else ''})"


def rows(k: int) -> str:
    return f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"


def roll(fn: str, c: str, k: int, keys) -> str:
    return f"{fn}({c}) {win(keys, rows(k))}"


def trend(c: str, k: int, keys) -> str:
    return f"(avg({c}) {win(keys, rows(k))} - avg({c}) {win(keys, f'ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING')})"


def diff1(c: str, keys) -> str:
    return f"coalesce({c} - lag({c}, 1) {win(keys)}, 0)"


def diff2(c: str, keys) -> str:
    l1, l2 = f"lag({c}, 1) {win(keys)}", f"lag({c}, 2) {win(keys)}"
    return f"coalesce(coalesce({c} - {l1}, 0) - coalesce({l1} - {l2}, 0), 0)"


def key_join(keys) -> tuple[str, str]:
    """(join clause, group-by clause) for per-key statistics; a cross join when there are no keys."""
    if keys:
        k = ", ".join(keys)
        return f"JOIN {{stats}} USING ({k})", f"GROUP BY {k}"
    return "CROSS JOIN {stats}", ""


def cte_stats_join(src: str, name: str, stat_exprs: list[str], select_exprs: list[str], keys) -> list[tuple[str, str]]:
    kcols = ", ".join(keys)
    j, g = key_join(keys)
    st = f"{name}_stats"
    sel_keys = f"{kcols}, " if keys else ""
    return [(st, f"SELECT {sel_keys}{', '.join(stat_exprs)} FROM {src} {g}"),
            (name, f"SELECT {', '.join(select_exprs)} FROM {src} {j.format(stats=st)}")]


def clip_sql(c: str, b: str, k: float = 1.5) -> str:
    lo = f"({b}[1] - ({b}[2] - {b}[1]) * {k})"
    hi = f"({b}[2] + ({b}[2] - {b}[1]) * {k})"
    return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END"


def cte_winsor(src: str, name: str, cols: Cols, exclude, keys) -> tuple[list[tuple[str, str]], Cols]:
    wcols = cols.numeric(exclude=[*exclude, *keys])
    stats = [f"quantile_cont({c}, [0.25, 0.75]) AS b_{c}" for c in wcols]
    sel = [clip_sql(f"{src}.{c}", f"b_{c}") + f" AS {c}" if c in wcols else f"{src}.{c}" for c in cols.names]
    out = Cols([(n, "d" if n in wcols else k) for n, k in cols.items])
    return cte_stats_join(src, name, stats, sel, keys), out


def cte_base_features(src: str, name: str, cols: Cols, target: str, keys) -> tuple[list[tuple[str, str]], Cols]:
    """E2 in SQL."""
    ctes, wc = cte_winsor(src, f"{name}_w", cols, [target], keys)
    wsrc = f"{name}_w"
    wc = wc.rename("dow", "day")
    new = [("day", "i", "day(date)"), ("week", "i", "weekofyear(date)"), ("month", "i", "month(date)"),
           ("year", "i", "year(date)"), ("dow0", "i", "isodow(date) - 1"),
           ("is_weekend", "i", "CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END"),
           ("quarter", "i", "quarter(date)"), ("day_of_year", "i", "dayofyear(date)"),
           ("week_of_year", "i", "weekofyear(date)"),
           ("temp_range", "d", f"{spec.TEMP_MAX} - {spec.TEMP_MIN}"),
           ("temp_7d_mean", "d", roll("avg", T, 7, keys)),
           ("temp_7d_std", "d", f"coalesce({roll('stddev_samp', T, 7, keys)}, 0)"),
           ("temp_7d_min", "d", roll("min", T, 7, keys)), ("temp_7d_max", "d", roll("max", T, 7, keys)),
           ("temp_change", "d", diff1(T, keys)), ("temp_acc", "d", diff2(T, keys))]
    exprs = {n: e for n, _, e in new}
    out = wc.assign([(n, k) for n, k, _ in new])
    renamed = {"day": "dow"}
    sel = []
    for n in out.names:
        if n in exprs:
            sel.append(f"{exprs[n]} AS {n}")
        else:
            sel.append(f"{renamed.get(n, n)} AS {n}" if n in renamed else n)
    ctes.append((f"{name}_a", f"SELECT {', '.join(sel)} FROM {wsrc}"))
    q_stats = [f"quantile_cont({T}, [0.05, 0.95]) AS eq"]
    flag = f"coalesce(({T} > eq[2] OR {T} < eq[1])::INTEGER, 0) AS extreme_temp"
    ctes += cte_stats_join(f"{name}_a", name, q_stats, [f"{name}_a.*", flag], keys)
    out = out.assign([("extreme_temp", "i")])
    leak = target.lower()
    out = out.drop([n for n in out.names if leak in n.lower() and n != target])
    return ctes, out


def season_items(cols: Cols, keys, seasons=(1, 2, 3, 4)):
    items = []
    for s in seasons:
        n = f"temp_trend_{s}"
        other = n if n in cols.names else "NULL"
        items.append((n, "d", f"CASE WHEN season = {s} THEN {T} - lag({T}, 1) {win(keys, extra_keys=['season'])} ELSE {other} END"))
    return items


def _apply(src: str, name: str, cols: Cols, new) -> tuple[tuple[str, str], Cols]:
    exprs = {n: e for n, _, e in new}
    out = cols.assign([(n, k) for n, k, _ in new])
    sel = [f"{exprs[n]} AS {n}" if n in exprs else n for n in out.names]
    return (name, f"SELECT {', '.join(sel)} FROM {src}"), out


def sin_(x, p):
    return f"sin({TWO_PI} * {x} / {float(p)})"


def cos_(x, p):
    return f"cos({TWO_PI} * {x} / {float(p)})"


def rich_items(cols: Cols, keys):
    ys, yc = sin_("month", 12), cos_("month", 12)
    new = [("year_sin", "d", ys), ("year_cos", "d", yc), ("week_sin", "d", sin_("dow0", 7)), ("week_cos", "d", cos_("dow0", 7)),
           ("doy_sin", "d", sin_("day_of_year", 365.25)), ("doy_cos", "d", cos_("day_of_year", 365.25)),
           ("temp_season", "d", f"{T} * {ys}"), ("temp_season_cos", "d", f"{T} * {yc}"),
           ("temp_range_season", "d", f"({spec.TEMP_MAX} - {spec.TEMP_MIN}) * {ys}"),
           ("temp_squared", "d", f"{T} * {T}"), ("temp_squared_season", "d", f"({T} * {T}) * {ys}"),
           ("humidity_season", "d", f"{H} * {ys}"), ("humidity_season_cos", "d", f"{H} * {yc}"),
           ("temp_humidity_season", "d", f"({T} * {H}) * {ys}")]
    for k in (3, 7, 14):
        new += [(f"temp_{k}d", "d", roll("avg", T, k, keys)), (f"temp_{k}d_std", "d", roll("stddev_samp", T, k, keys)),
                (f"temp_{k}d_max", "d", roll("max", T, k, keys)), (f"temp_{k}d_min", "d", roll("min", T, k, keys)),
                (f"temp_trend_{k}d", "d", trend(T, k, keys))]
    for k in (3, 7):
        new += [(f"humidity_{k}d", "d", roll("avg", H, k, keys)), (f"humidity_trend_{k}d", "d", trend(H, k, keys))]
    new += season_items(cols, keys)
    new.append(("weekend_temp", "d", f"is_weekend * {T}"))
    return new


def lean_items(cols: Cols, keys):
    ys = sin_("month", 12)
    new = [("year_sin", "d", ys), ("year_cos", "d", cos_("month", 12)), ("week_sin", "d", sin_("dow0", 7)),
           ("week_cos", "d", cos_("dow0", 7)), ("temp_season", "d", f"{T} * {ys}"), ("humidity_season", "d", f"{H} * {ys}")]
    return new + season_items(cols, keys)


def filled(src: str, name: str, cols: Cols) -> tuple[str, str]:
    sel = [f"coalesce({n}, 0) AS {n}" if k in ("d", "i") else n for n, k in cols.items]
    return name, f"SELECT {', '.join(sel)} FROM {src}"


KEYS = ["system"]


def training_features(kind: str):
    """CTEs for E2 (+E3/E4) on the training table; returns (ctes, final cte name, cols)."""
    ctes = cte_training()
    b_ctes, cols = cte_base_features("training", "e2", train_cols(), "fault_count", KEYS)
    ctes += b_ctes
    if kind == "base":
        return ctes, "e2", cols
    new = rich_items(cols, KEYS) if kind == "rich" else lean_items(cols, KEYS)
    c, cols = _apply("e2", f"{kind}_raw", cols, new)
    ctes.append(c)
    ctes.append(filled(f"{kind}_raw", kind, cols))
    return ctes, kind, cols


def cte_scale(src: str, name: str, cols: Cols, feats: list[str], how: str, keys):
    if how == "standard":
        stats = []
        for c in feats:
            stats += [f"avg({c}) AS m_{c}", f"stddev_pop({c}) AS s_{c}"]
        expr = {c: f"({src}.{c} - m_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END)" for c in feats}
    else:
        stats = [f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in feats]
        expr = {c: f"({src}.{c} - q_{c}[2]) / (CASE WHEN (q_{c}[3] - q_{c}[1]) IS NULL OR (q_{c}[3] - q_{c}[1]) = 0 THEN 1.0 "
                   f"ELSE (q_{c}[3] - q_{c}[1]) END)" for c in feats}
    sel = [f"{expr[n]} AS {n}" if n in expr else f"{src}.{n}" for n in cols.names]
    out = Cols([(n, "d" if n in expr else k) for n, k in cols.items])
    return cte_stats_join(src, name, stats, sel, keys), out


# ---------------------------------------------------------------- registrations

def _series_sql(final: str) -> str:
    return with_(cte_training(), final)


_W = f"FROM training"
oracle("rolling_mean", _series_sql("SELECT system, date, " + ", ".join(
    f"{r6(roll('avg', T, k, KEYS))} AS mean_{k}" for k in (3, 7, 14)) + f" {_W}"))
oracle("rolling_std", _series_sql(f"SELECT system, date, {r6('coalesce(' + roll('stddev_samp', T, 7, KEYS) + ', 0)')} AS std_7 {_W}"))
oracle("rolling_minmax", _series_sql(f"SELECT system, date, {r6(roll('min', T, 7, KEYS))} AS min_7, {r6(roll('max', T, 7, KEYS))} AS max_7 {_W}"))
oracle("diff1", _series_sql(f"SELECT system, date, {r6(diff1(T, KEYS))} AS change {_W}"))
oracle("diff2", _series_sql(f"SELECT system, date, {r6(diff2(T, KEYS))} AS acceleration {_W}"))
oracle("rolling_trend", _series_sql(f"SELECT system, date, {r6(trend(T, 3, KEYS))} AS trend_3 {_W}"))
oracle("season_diff", _series_sql(
    f"SELECT system, date, season, {r6(f'{T} - lag({T}, 1) ' + win(KEYS, extra_keys=['season']))} AS season_change {_W}"))
oracle("extreme_flag", with_(cte_training() + cte_stats_join(
    "training", "xf", [f"quantile_cont({T}, [0.05, 0.95]) AS q"],
    ["system", "date", f"{r6(T)} AS {T}", f"coalesce(({T} > q[2] OR {T} < q[1])::INTEGER, 0) AS extreme"], KEYS), "SELECT * FROM xf"))

_wc, _wcols = cte_winsor("training", "wz", train_cols(), ["fault_count"], KEYS)
oracle("winsorize", with_(cte_training() + _wc, _wcols.final("wz")))

_zs = []
for _c in spec.daily_columns():
    _zs += [f"avg({_c}) AS m_{_c}", f"stddev_pop({_c}) AS s_{_c}", f"quantile_cont({_c}, 0.5) AS d_{_c}"]
_zsel = ["training.system", "date", "fault_count"]
for _c in spec.daily_columns():
    _z = f"(CASE WHEN s_{_c} = 0 THEN NULL ELSE (training.{_c} - m_{_c}) / s_{_c} END)"
    _zsel.append(f"{r6(f'CASE WHEN coalesce(abs({_z}) < 3.0, false) THEN training.{_c} ELSE d_{_c} END')} AS {_c}")
oracle("zscore_median", with_(cte_training() + cte_stats_join("training", "zm", _zs, _zsel, KEYS), "SELECT * FROM zm"))

_lo, _hi = "(q[2] - (q[4] - q[2]) * 1.5)", "(q[4] + (q[4] - q[2]) * 1.5)"
_nz = "abs((n_chars - m) / nullif(s, 0)) < 3.0"
oracle("null_group_stats", f"""WITH t AS (
  SELECT doc_id AS ticket_id, length(text)::DOUBLE AS n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)),
g AS (
  SELECT quality AS k, avg(n_chars) AS m, stddev_pop(n_chars) AS s, quantile_cont(n_chars, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q
  FROM t GROUP BY 1)
SELECT ticket_id, n_chars, quality, (n_chars > q[5] OR n_chars < q[1])::BIGINT AS extreme,
  {r6(f"least(greatest(n_chars, {_lo}), {_hi})")} AS winsorized,
  {r6(f"CASE WHEN coalesce({_nz}, false) THEN n_chars ELSE q[3] END")} AS cleaned,
  {r6("(n_chars - m) / CASE WHEN s = 0 THEN 1 ELSE s END")} AS standard,
  {r6("(n_chars - q[3]) / CASE WHEN q[4] = q[2] THEN 1 ELSE q[4] - q[2] END")} AS robust
FROM t JOIN g ON t.quality IS NOT DISTINCT FROM g.k""")

oracle("zscore_rows", with_(cte_counts() + [
    ("cstats", "SELECT system, avg(fault_count) AS m, stddev_pop(fault_count) AS s FROM counts GROUP BY 1")],
    "SELECT c.* FROM counts c JOIN cstats USING (system) WHERE s IS NULL OR s = 0 OR abs((fault_count - m) / s) <= 6"))

for _kind, _key in (("base", "features_base"), ("rich", "features_rich"), ("lean", "features_lean")):
    _ctes, _fin, _cols = training_features(_kind)
    oracle(_key, with_(_ctes, _cols.final(_fin)))


def _feats(cols: Cols, target="fault_count", keys=KEYS):
    return [n for n in cols.names if n not in (target, "date", *keys) and cols.kind(n) in ("d", "i")]


_ctes, _fin, _cols = training_features("rich")
_sc, _scols = cte_scale(_fin, "sc", _cols, _feats(_cols), "standard", KEYS)
oracle("scale_standard", with_(_ctes + _sc, _scols.final("sc")))
RICH_FEATURES = [n for n in _cols.names if n not in ("fault_count", "date", "system")]

_ctes, _fin, _cols = training_features("lean")
_sc, _scols = cte_scale(_fin, "sc", _cols, _feats(_cols), "robust", KEYS)
oracle("scale_robust", with_(_ctes + _sc, _scols.final("sc")))


def forecast_sql(keys=()) -> str:
    """E8 in SQL, of the whole series or by site."""
    own = ", ".join([*keys, ""])
    ctes = cte_daily_weather(cte_line_weather("readings", bool(keys)), "dw_long", own)
    cols = Cols([(k, "t") for k in keys] + [(n, "t" if n == "date" else ("i" if n in TRAIN_INT else "d")) for n in daily_weather_columns()])
    new = []
    for k in (1, 3, 4):
        new += [(f"temp_{k}d", "d", roll("avg", T, k, keys)), (f"temp_trend_{k}", "d", trend(T, k, keys))]
    c, cols = _apply("dw_long", "ft", cols, new)
    ctes.append(c)
    b, cols = cte_base_features("ft", "fb", cols, "_no_target_", keys)
    ctes += b
    c, cols = _apply("fb", "fr_raw", cols, rich_items(cols, keys))
    ctes.append(c)
    ctes.append(filled("fr_raw", "fr", cols))
    feats = [n for n in cols.names if n not in ("date", *keys) and cols.kind(n) in ("d", "i")]
    sc, cols = cte_scale("fr", "fs", cols, feats, "standard", keys)
    ctes += sc
    have = set(cols.names)
    parts = [*keys, "date"] + [f"{r6(n)} AS {n}" if n in have else f"0.0 AS {n}" for n in RICH_FEATURES]
    return with_(ctes, f"SELECT {', '.join(parts)} FROM fs")


oracle("forecast_features", forecast_sql())
oracle("forecast_features_sites", forecast_sql(["site"]))
