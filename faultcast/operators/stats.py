"""Statistics, outliers and scaling.

Global statistics are one aggregate producing one row per key, joined
back. Without keys that row is a scalar subquery (one row, checked at
run time; no join). With keys the
statistics table has one row per key and AQE decides broadcast vs
sort-merge from its measured size. Nothing is collected to the driver.

Exact quantiles use ``percentile`` (linear interpolation, equal to
DuckDB's ``quantile_cont``); its buffer holds one count per distinct value
per group, which is right for daily-grain tables. For raw-grain inputs pass
``approx=True`` to use ``percentile_approx``; it is never switched silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultcast.functions.scalars import clip


def pearson(x, y) -> Column:
    """Pearson correlation over rows where both are present; NULL when either side is constant.

    Built from ``covar_pop`` and ``stddev_pop`` with ``try_divide`` because
    the built-in ``corr`` raises on a zero variance under ANSI mode.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def attach_global(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the single row of a global aggregate next to every row of ``df``, without a join.

    The aggregate becomes an uncorrelated scalar subquery: Spark runs it
    once, fails at runtime if it returns more than one row (the size bound
    is enforced, not assumed), and the value enters the projection as a
    literal inside whole-stage codegen.
    """
    names = one_row.columns
    g = one_row.select(F.struct(*[F.col(c) for c in names]).alias("_g")).scalar()
    return df.select("*", g.alias("_g")).select(*[df[c] for c in df.columns],
                                                 *[F.col("_g")[c].alias(c) for c in names])


def join_null_safe(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of per-key rows where a NULL key is a group of its own, as in ``groupBy``."""
    s = stats.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    cond = [df[k].eqNullSafe(s[f"_key{i}"]) for i, k in enumerate(keys)]
    return df.join(s, cond, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def attach_stats(df: DataFrame, stats: dict[str, Column], keys=None) -> DataFrame:
    """Aggregate ``stats`` (name -> aggregate expression) per key and join them onto every row."""
    keys = list(keys or [])
    agg_exprs = [e.alias(n) for n, e in stats.items()]
    if not keys:
        return attach_global(df, df.agg(*agg_exprs))
    return join_null_safe(df, df.groupBy(*keys).agg(*agg_exprs), keys)


def attach_stats_sql(df: DataFrame, stats: dict[str, str], keys=None, via_window: bool = False) -> DataFrame:
    """``attach_stats`` with SQL aggregate texts: one aggregate statement, one join.

    ``via_window=True`` (keys only): a window per key instead, so that rows
    already dealt out by the keys are neither exchanged nor computed twice. A
    key's rows pass one task, so it is meant for daily grain, as in ``drop_zscore_rows``.
    """
    from faultcast.functions.scalars import sql_agg, sql_select

    keys = list(keys or [])
    if keys and via_window:
        over = f"OVER (PARTITION BY {', '.join(_q(k) for k in keys)})"
        return sql_select(df, ["*"] + [f"{e} {over} AS {_q(n)}" for n, e in stats.items()])
    s = sql_agg(df, keys, [f"{e} AS `{n}`" for n, e in stats.items()])
    if not keys:
        return attach_global(df, s)
    return join_null_safe(df, s, keys)


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def quantile_sql(c: str, ps, approx: bool = False, accuracy: int = 10000) -> str:
    arr = "array(" + ", ".join(f"{float(p)!r}D" for p in ps) + ")"
    return f"percentile_approx({_q(c)}, {arr}, {accuracy})" if approx else f"percentile({_q(c)}, {arr})"


def clip_sql(x: str, lo: str, hi: str) -> str:
    """F14 as SQL: two-sided clip that keeps NULL."""
    return f"CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END"


def quantile_expr(c: str, ps, approx: bool = False, accuracy: int = 10000) -> Column:
    arr = F.array(*[F.lit(float(p)) for p in ps])
    if approx:
        return F.percentile_approx(F.col(c), arr, accuracy)
    return F.percentile(F.col(c), arr)


def quantiles(df: DataFrame, cols: list[str], ps=(0.05, 0.25, 0.5, 0.75, 0.95), keys=None,
              approx: bool = False) -> DataFrame:
    """Quantiles per column, long form (keys..., column_name, p, q)."""
    keys = list(keys or [])
    aggs = [quantile_expr(c, ps, approx).alias(f"q{i}") for i, c in enumerate(cols)]
    a = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"q{i}").alias("qs")) for i, c in enumerate(cols)])
    ex = a.select(*keys, F.explode(rows).alias("r"))
    pz = F.arrays_zip(F.array(*[F.lit(float(p)) for p in ps]).alias("p"), F.col("r.qs").alias("q"))
    return ex.select(*keys, F.col("r.column_name").alias("column_name"), F.explode(pz).alias("z")).select(
        *keys, "column_name", F.col("z.p").alias("p"), F.col("z.q").alias("q"))


def box_summary(df: DataFrame, c: str, keys=None, whis: float = 1.5) -> DataFrame:
    """A10: the numbers behind a box plot: quartiles, whisker ends and outlier count.

    Read twice (quartiles, then counts), so the input is written as a stage table.
    """
    from faultcast.session import stage

    keys = list(keys or [])
    j = attach_stats(stage(df.select(*keys, c)), {"_q": F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))}, keys)
    q1, med, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    lo, hi = q1 - (q3 - q1) * whis, q3 + (q3 - q1) * whis
    x = F.col(c)
    inside = (x >= lo) & (x <= hi)
    g = j.groupBy(*keys) if keys else j.groupBy()
    return g.agg(
        F.first(q1).alias("q1"), F.first(med).alias("median"), F.first(q3).alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_lo"), F.max(F.when(inside, x)).alias("whisker_hi"),
        F.count_if(x.isNotNull() & ~inside).alias("n_outliers"),
    )


#: Keys whose Gram sums a task holds before it gives them out: bounds its memory at this many times six matrices.
GRAM_KEYS = 64


def corr_pairs(df: DataFrame, cols: list[str], keys=None, absolute: bool = True) -> DataFrame:
    """Pearson correlation of every pair i < j (pairwise complete), long form (keys, col_a, col_b, corr).

    The co-moments come from Gram matrices: each task multiplies its rows'
    (centred, zero-filled) value and presence matrices per key and emits one
    partial row per (key, pair), whatever its row count; a grouped sum merges
    them, so a key holding a third of all rows is spread over every task that
    holds its rows. NaN counts as missing, like NULL. The one plan for any
    number of columns: an aggregate of the per-key means, joined back, one
    ``mapInPandas`` pass, one grouped sum.
    """
    from faultcast.functions.scalars import quote, sql_agg, sql_select

    keys = list(keys or [])
    n_cols = len(cols)
    clean = [f"nanvl(CAST({quote(c)} AS DOUBLE), NULL) AS _v{i}" for i, c in enumerate(cols)]
    x = sql_select(df, [quote(k) for k in keys] + clean)
    means = sql_agg(x, keys, [f"avg(_v{i}) AS _m{i}" for i in range(n_cols)])
    j = join_null_safe(x, means, keys) if keys else attach_global(x, means)
    centred = sql_select(j, [quote(k) for k in keys] + [f"_v{i} - _m{i} AS _c{i}" for i in range(n_cols)])
    key_fields = [f for f in df.schema.fields if f.name in keys]
    stats = ", ".join(f"{n} double" for n in ("n", "sx", "sy", "sxx", "syy", "sxy", "x_lo", "x_hi", "y_lo", "y_hi"))
    schema = ", ".join([f"{quote(f.name)} {f.dataType.simpleString()}" for f in key_fields] + ["a int, b int", stats])
    partial = centred.mapInPandas(_gram_partials(n_cols, keys), schema)
    summed = sql_agg(partial, [*keys, "a", "b"],
                     [f"sum({c}) AS {c}" for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
                     + ["min(x_lo) AS x_lo", "max(x_hi) AS x_hi", "min(y_lo) AS y_lo", "max(y_hi) AS y_hi"])
    r = ("CASE WHEN n = 0 OR x_lo >= x_hi OR y_lo >= y_hi THEN CAST(NULL AS DOUBLE) ELSE "
         "try_divide(n * sxy - sx * sy, sqrt(greatest(n * sxx - sx * sx, 0D) * greatest(n * syy - sy * sy, 0D))) END")
    names = F.array(*[F.lit(c) for c in cols])
    out = sql_select(summed, [quote(k) for k in keys] + ["a", "b", f"{'abs(' + r + ')' if absolute else r} AS corr"])
    return out.select(*keys, F.get(names, F.col("a")).alias("col_a"), F.get(names, F.col("b")).alias("col_b"), "corr")


def _gram_partials(n_cols: int, keys: list[str]):
    """mapInPandas body: per key, sums over the rows of one partition for every pair i < j.

    Values arrive centred by their key's mean (``_c{i}``), so the sums of
    squares carry no large offsets. With presence matrix M and zero-filled
    values X: n = M'M, sum_x = X'M, sum_xx = (X*X)'M, sum_xy = X'X, each
    restricted to rows where both columns are present. The exact minimum
    and maximum of each column over those rows let the final step return
    NULL for a constant column exactly, as ``stddev_pop = 0`` does.
    """
    import numpy as np
    import pandas as pd

    names = [f"_c{i}" for i in range(n_cols)]
    iu, ju = np.triu_indices(n_cols, 1)

    def rows_of(acc):
        for key, (n, sx, sxx, sxy, lo, hi) in acc.items():
            # pandas reports a NULL key as NaN; it goes back as NULL
            out = {k: pd.Series([None if isinstance(v, float) and v != v else v] * len(iu), dtype=object)
                   for k, v in zip(keys, key)}
            out.update(a=iu.astype("int32"), b=ju.astype("int32"), n=n[iu, ju], sx=sx[iu, ju], sy=sx[ju, iu],
                       sxx=sxx[iu, ju], syy=sxx[ju, iu], sxy=sxy[iu, ju], x_lo=lo[iu, ju], x_hi=hi[iu, ju],
                       y_lo=lo[ju, iu], y_hi=hi[ju, iu])
            yield pd.DataFrame(out)

    def run(batches):
        acc = {}
        for pdf in batches:
            if len(acc) > GRAM_KEYS:
                yield from rows_of(acc)
                acc = {}
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = g[names].to_numpy(dtype="float64")
                m = ~np.isnan(x)
                x0 = np.where(m, x, 0.0)
                mf = m.astype("float64")
                if m.all():
                    lo = np.repeat(x.min(axis=0)[:, None], n_cols, axis=1)
                    hi = np.repeat(x.max(axis=0)[:, None], n_cols, axis=1)
                else:
                    lo = np.full((n_cols, n_cols), np.inf)
                    hi = np.full((n_cols, n_cols), -np.inf)
                    for j in range(n_cols):
                        sel = m[:, j]
                        if sel.any():
                            lo[:, j] = np.where(m[sel], x[sel], np.inf).min(axis=0)
                            hi[:, j] = np.where(m[sel], x[sel], -np.inf).max(axis=0)
                part = (mf.T @ mf, x0.T @ mf, (x0 * x0).T @ mf, x0.T @ x0, lo, hi)
                if key in acc:
                    a = acc[key]
                    acc[key] = (a[0] + part[0], a[1] + part[1], a[2] + part[2], a[3] + part[3],
                                np.minimum(a[4], part[4]), np.maximum(a[5], part[5]))
                else:
                    acc[key] = part
        yield from rows_of(acc)

    return run


def target_correlation(df: DataFrame, cols: list[str], target: str, keys=None, k: int | None = 10) -> DataFrame:
    """|corr(feature, target)| ranked descending (name breaks ties), top ``k`` per key."""
    from pyspark.sql import Window

    keys = list(keys or [])
    aggs = [F.abs(pearson(c, target)).alias(f"c{i}") for i, c in enumerate(cols)]
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(f"c{i}"), F.lit(None).cast("double")).alias("abs_corr"))
                    for i, c in enumerate(cols)])
    long = g.select(*keys, F.inline(arr))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("abs_corr").desc_nulls_last(), "feature"))
    out = long.withColumn("rank", rank)
    return out.filter(F.col("rank") <= k) if k else out


def winsorize_iqr(df: DataFrame, cols: list[str], k: float = 1.5, keys=None, approx: bool = False,
                  via_window: bool = False) -> DataFrame:
    """O1: clip each column to [Q1 - k*IQR, Q3 + k*IQR] with bounds from the input itself.

    All bounds come from one aggregate, or with ``via_window`` from one window
    per key; a column with IQR 0 collapses to its quartile, as in the reference.
    """
    from faultcast.functions.scalars import sql_select

    j = attach_stats_sql(df, {f"_b{i}": quantile_sql(c, (0.25, 0.75), approx) for i, c in enumerate(cols)}, keys, via_window)
    kk = f"{float(k)!r}D"
    repl = {}
    for i, c in enumerate(cols):
        q1, q3 = f"_b{i}[0]", f"_b{i}[1]"
        repl[c] = clip_sql(_q(c), f"({q1} - ({q3} - {q1}) * {kk})", f"({q3} + ({q3} - {q1}) * {kk})")
    return sql_select(j, [f"{repl[c]} AS {_q(c)}" if c in repl else _q(c) for c in df.columns])


def zscore_to_median(df: DataFrame, cols: list[str], thr: float = 3.0, keys=None) -> DataFrame:
    """O2: values with |z| >= thr (population std) and NULLs become the column median.

    Statistics skip NULLs (the reference would turn a whole column with one
    NaN into its median); a constant column has no z and becomes its median.
    """
    stats = {}
    for i, c in enumerate(cols):
        stats[f"_m{i}"] = F.avg(F.col(c))
        stats[f"_s{i}"] = F.stddev_pop(F.col(c))
        stats[f"_d{i}"] = F.percentile(F.col(c), F.lit(0.5))
    j = attach_stats(df, stats, keys)
    repl = {}
    for i, c in enumerate(cols):
        z = F.try_divide(F.col(c) - F.col(f"_m{i}"), F.col(f"_s{i}"))
        keep = F.coalesce(F.abs(z) < thr, F.lit(False))
        repl[c] = F.when(keep, F.col(c)).otherwise(F.col(f"_d{i}"))
    return j.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in df.columns])


def drop_zscore_rows(df: DataFrame, c: str, thr: float = 6.0, keys=None, parity: bool = False,
                     via_window: bool = False) -> DataFrame:
    """O3: keep rows with |z| <= thr (population std), per key.

    A constant column has no z: the reference then drops every row
    (``parity=True``); by default all rows are kept. ``via_window=True``
    computes the statistics with a window per key instead of an aggregate
    joined back: one scan and one exchange, meant for daily-grain inputs
    whose groups are bounded by the calendar.
    """
    from pyspark.sql import Window

    keys = list(keys or [])
    if via_window:
        w = Window.partitionBy(*keys)
        j = df.select("*", F.avg(F.col(c)).over(w).alias("_m"), F.stddev_pop(F.col(c)).over(w).alias("_s"))
    else:
        j = attach_stats(df, {"_m": F.avg(F.col(c)), "_s": F.stddev_pop(F.col(c))}, keys)
    z = F.try_divide(F.col(c) - F.col("_m"), F.col("_s"))
    no_z = F.col("_s").isNull() | (F.col("_s") == 0)
    if parity:
        cond = F.coalesce(F.abs(z) <= thr, F.lit(False)) & ~no_z
    else:
        cond = no_z | (F.abs(z) <= thr)
    return j.filter(cond).select(*df.columns)


def _scale(df: DataFrame, stats: dict[str, str], exprs: dict[str, str], fit_on: DataFrame | None, keys,
           via_window: bool = False) -> DataFrame:
    from faultcast.functions.scalars import sql_agg, sql_select

    keys = list(keys or [])
    if fit_on is None:
        j = attach_stats_sql(df, stats, keys, via_window)
    else:
        s = sql_agg(fit_on, keys, [f"{e} AS `{n}`" for n, e in stats.items()])
        j = join_null_safe(df, s, keys) if keys else attach_global(df, s)
    return sql_select(j, [f"{exprs[c]} AS {_q(c)}" if c in exprs else _q(c) for c in df.columns])


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, keys=None,
                   via_window: bool = False) -> DataFrame:
    """(x - mean) / population std, zero std -> divide by 1.

    ``fit_on`` is the frame the statistics come from (the training rows);
    ``None`` fits on ``df`` itself, as the reference does at forecast time.
    MLlib's StandardScaler uses the sample std, so it is not used here.
    """
    stats, exprs = {}, {}
    for i, c in enumerate(cols):
        stats[f"_m{i}"] = f"avg({_q(c)})"
        stats[f"_s{i}"] = f"stddev_pop({_q(c)})"
        exprs[c] = f"({_q(c)} - _m{i}) / (CASE WHEN _s{i} IS NULL OR _s{i} = 0 THEN 1.0D ELSE _s{i} END)"
    return _scale(df, stats, exprs, fit_on, keys, via_window)


def robust_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, keys=None,
                 approx: bool = False, via_window: bool = False) -> DataFrame:
    """(x - median) / IQR, zero IQR -> divide by 1.

    MLlib's RobustScaler maps zero-range columns to 0 and uses approximate
    quantiles, so it is not used for parity.
    """
    stats, exprs = {}, {}
    for i, c in enumerate(cols):
        stats[f"_q{i}"] = quantile_sql(c, (0.25, 0.5, 0.75), approx)
        iqr = f"(_q{i}[2] - _q{i}[0])"
        exprs[c] = f"({_q(c)} - _q{i}[1]) / (CASE WHEN {iqr} IS NULL OR {iqr} = 0 THEN 1.0D ELSE {iqr} END)"
    return _scale(df, stats, exprs, fit_on, keys, via_window)


def fitted_scale(src: DataFrame, cols: list[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """(centre, scale) per column from one aggregate over ``src``: a row per column, to be kept with a model."""
    from faultcast.functions.scalars import sql_agg

    exprs = []
    for i, c in enumerate(cols):
        if kind == "standard":
            exprs += [f"avg({_q(c)}) AS c{i}", f"stddev_pop({_q(c)}) AS s{i}"]
        else:
            exprs += [f"percentile({_q(c)}, 0.5) AS c{i}", f"percentile({_q(c)}, 0.75) - percentile({_q(c)}, 0.25) AS s{i}"]
    r = sql_agg(src, [], exprs).first()
    return {c: (float(r[f"c{i}"] or 0.0), float(r[f"s{i}"] or 0.0) or 1.0) for i, c in enumerate(cols)}


def apply_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """E6/E7 with kept statistics: (x - centre) / scale as literals, no join."""
    from faultcast.functions.scalars import sql_select

    return sql_select(df, [f"({_q(c)} - {fitted[c][0]!r}D) / {fitted[c][1]!r}D AS {_q(c)}" if c in fitted else _q(c)
                           for c in df.columns])
