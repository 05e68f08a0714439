"""Evaluation and reporting aggregates.

All work on long tables ((keys, model, y, y_hat) or labelled tickets) with
plain SQL aggregates; per-model metrics are a grouped aggregate, never a
loop over models on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultcast.operators.stats import attach_global

# Confidence bands (label, low inclusive, high exclusive) of the report.
CONF_BANDS = [("90-100%", 0.9, 1.01), ("80-90%", 0.8, 0.9), ("70-80%", 0.7, 0.8), ("60-70%", 0.6, 0.7), ("<60%", 0.0, 0.6)]


def regression_metrics(df: DataFrame, keys=("model",), y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """MSE, RMSE, MAE and R2 = 1 - SSE/SST per key (R2 is 1 for a perfect fit of a constant, else 0)."""
    keys = list(keys)
    e = F.col(y) - F.col(y_hat)
    a = df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"),
        (F.var_pop(F.col(y)) * F.count(F.col(y))).alias("_sst"), F.count(F.lit(1)).alias("n"))
    r2 = (F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_sse") / F.col("_sst"))
          .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return a.select(*keys, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def binary_metrics(df: DataFrame, keys=("class",), fold: str = "fold", y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall and F1 of the positive class per fold (0 when undefined), then the mean
    and the population std over folds."""
    keys = list(keys)
    yc, pc = F.col(y) == 1, F.col(y_pred) == 1
    per = df.groupBy(*keys, fold).agg(F.count_if(yc & pc).alias("tp"), F.count_if(~yc & pc).alias("fp"),
                                      F.count_if(yc & ~pc).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    per = per.select(*keys, fold, prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    per = per.withColumn("f1", f1)
    aggs = []
    for m in ("precision", "recall", "f1"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), *aggs)


def vote_weights(board: DataFrame, keys=("system",), score: str = "r2", floor: float = 0.01) -> DataFrame:
    """weight = max(score, floor) normalised to sum 1 per key (on the small leaderboard)."""
    keys = list(keys)
    raw = F.greatest(F.col(score), F.lit(floor))
    return board.select(*keys, "model", (raw / F.sum(raw).over(Window.partitionBy(*keys))).alias("weight"))


def weighted_vote(long: DataFrame, weights: DataFrame, keys=("system",), row_key=("date",),
                  y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Per row, the weighted mean of the models' predictions.

    The weights table has one row per (key, model); AQE broadcasts it.
    """
    keys, row_key = list(keys), list(row_key)
    j = long.join(weights, [*keys, "model"])
    return j.groupBy(*keys, *row_key).agg(F.first(F.col(y)).alias(y), F.sum(F.col("weight") * F.col(y_hat)).alias("vote"))


def diagnostics(long: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Residuals and actual-vs-predicted pairs (the tables behind the plots)."""
    return long.withColumn("residual", F.col(y) - F.col(y_hat))


def category_shift(df: DataFrame, before: str, after: str, categories: list[str]) -> DataFrame:
    """Per category final count and share, original count, newly assigned count and net change.

    One pass over the stacked labels (two rows per ticket), grouped by
    category with map-side combine; empty categories show 0.
    """
    stacked = df.select(F.explode(F.array(
        F.struct(F.col(before).alias("category"), F.lit(1).alias("orig"), F.lit(0).alias("fin"), F.lit(0).alias("new")),
        F.struct(F.col(after).alias("category"), F.lit(0).alias("orig"), F.lit(1).alias("fin"),
                 (F.col(after) != F.col(before)).cast("int").alias("new")))).alias("s")).select("s.*")
    agg = stacked.groupBy("category").agg(F.sum("orig").alias("original_n"), F.sum("fin").alias("final_n"),
                                          F.sum("new").alias("new_n"))
    spark = df.sparkSession
    cats = spark.createDataFrame([(c, i) for i, c in enumerate(categories)], "category string, ord int")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    j = attach_global(cats.join(agg, "category", "left"), total)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("category", z("final_n").alias("final_n"),
                    (F.try_divide(z("final_n"), F.col("_total")) * 100.0).alias("final_pct"),
                    z("original_n").alias("original_n"), z("new_n").alias("new_n"),
                    (z("final_n") - z("original_n")).alias("net_change"))


def confidence_bands(df: DataFrame, conf: str, generic_mask, bands=CONF_BANDS) -> DataFrame:
    """Counts and shares per confidence band, over all rows and over generic rows only."""
    band = None
    for lab, lo, hi in bands:
        cond = (F.col(conf) >= lo) & (F.col(conf) < hi)
        band = F.when(cond, F.lit(lab)) if band is None else band.when(cond, F.lit(lab))
    x = df.select(band.alias("band"), generic_mask.alias("_g"))
    agg = x.groupBy("band").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("_g")).alias("n_generic"))
    totals = x.agg(F.count(F.lit(1)).alias("t_all"), F.count_if(F.col("_g")).alias("t_generic"))
    spark = df.sparkSession
    blist = spark.createDataFrame([(lab, i) for i, (lab, _, _) in enumerate(bands)], "band string, ord int")
    j = attach_global(blist.join(agg, "band", "left"), totals)
    rows = []
    for scope, n, t in (("all", "n_all", "t_all"), ("generic", "n_generic", "t_generic")):
        rows.append(j.select(F.lit(scope).alias("scope"), "band", F.coalesce(F.col(n), F.lit(0)).alias("n"),
                             (F.try_divide(F.coalesce(F.col(n), F.lit(0)), F.col(t)) * 100.0).alias("pct")))
    return rows[0].unionByName(rows[1])


def resolution_breakdown(df: DataFrame, unit_before: str, unit_after: str, keyword_label: str,
                         generic: str) -> DataFrame:
    """Generic tickets resolved by keyword, by model, or left generic; counts and shares."""
    g = df.filter(F.col(unit_before) == generic)
    a = g.agg(F.count_if(F.col(keyword_label).isNotNull()).alias("keyword"),
              F.count_if(F.col(keyword_label).isNull() & (F.col(unit_after) != generic)).alias("model"),
              F.count_if(F.col(unit_after) == generic).alias("unresolved"),
              F.count(F.lit(1)).alias("_total"))
    st = F.stack(F.lit(3), F.lit("keyword"), F.col("keyword"), F.lit("model"), F.col("model"),
                 F.lit("unresolved"), F.col("unresolved")).alias("outcome", "n")
    return a.select(st, "_total").select("outcome", "n", (F.try_divide(F.col("n"), F.col("_total")) * 100.0).alias("pct"))
