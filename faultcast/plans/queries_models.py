"""Registered model queries: S7, P15, M2, M4, M5, M7-M11, M13, M15-M17, M19-M21.

Each runs the full fit and score over every row of its input (all three
classified systems, all six models where the operator compares models) with the
sizes that were measured to finish (``models.CHECK`` and ``BOOST``), or the
reference's: the search (``SEARCH``) and the retrain run at the reference's, finished or not. A query returns what SQL can state about
that output: which rows were scored, by whom, and flags computed from every
prediction.

The model target follows the weather (``jobs.with_signal``), so "better than
the mean" says that a model has learnt something.
"""

from __future__ import annotations

import datetime as dt
import os
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultcast.plans import jobs, spec
from faultcast.plans import models as M
from faultcast.plans.pool import run_all
from faultcast.plans.queries import query, weather_fx3
from faultcast.plans.queries_text import FX_RULES, FX_SCOPE, THRESHOLD
from faultcast.plans.training import daily_fault_counts, training_of_counts
from faultcast.session import scratch_path, stage
from faultcast.sources import files
from faultcast.sources import fixtures as fx

SIZES, WHOLE = M.CHECK, M.ModelSizes()
FORECAST_AS_OF = "2024-01-20"
TRAINED_AT = "2026-01-01 00:00:00"
RULES = {"rules": FX_RULES, "scope": FX_SCOPE, "generic": fx.GENERIC, "threshold": THRESHOLD}


def relabelled_training(spark, sf_dir) -> DataFrame:
    """E9 after the decision stage with given probabilities: faults are counted by the unit that M5 decided."""
    tickets = fx.dated(fx.ticket_probs(spark, sf_dir), spark, sf_dir)
    classified = jobs.classify_stage(tickets, SIZES, probabilities=tickets, **RULES)
    counts = daily_fault_counts(classified, systems=[s.system for s in jobs.SETUPS])
    return stage(training_of_counts(*run_all([partial(stage, counts), partial(weather_fx3, spark, sf_dir)])))


def prepared(spark, sf_dir):
    return jobs.prepared_all(jobs.with_signal(relabelled_training(spark, sf_dir)))


def each_system(spark, sf_dir, work) -> DataFrame:
    """Rows of ``work(setup, prepared)`` of every system; the systems run side by side."""
    return _union(run_all([partial(work, setup, p) for setup, p in prepared(spark, sf_dir)]))


def facts(preds: DataFrame, keys=("system", "model")) -> DataFrame:
    """Per key: rows, days, sum of the target, finite predictions, and whether the squared error beats the mean's."""
    keys = list(keys)
    a = preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("days"), F.sum("y").alias("sum_y"),
        F.count_if(F.abs("y_hat") < float("inf")).alias("n_scored"),
        F.sum((F.col("y") - F.col("y_hat")) ** 2).alias("_sse"), (F.var_pop("y") * F.count("y")).alias("_sst"))
    return a.select(*keys, "n", "days", "sum_y", "n_scored", (F.col("_sse") < F.col("_sst")).alias("beats_mean"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("training_relabelled")
def q_training_relabelled(spark, sf_dir):
    """M5 -> A5 -> E9: the training table of the retrain chain, from relabelled tickets."""
    return relabelled_training(spark, sf_dir)


@query("feature_target_split")
def q_feature_target_split(spark, sf_dir):
    """P15 + M6/W10 + E6/E7: prepared rows per system and split: rows, target sum, features, none missing, scaled mean
    (standard) or median (robust) of the training rows at zero."""
    parts = []
    for setup, p in prepared(spark, sf_dir):
        n = len(p.features)
        for name, rows in (("train", p.train), ("test", p.test)):
            v = F.unwrap_udt("features")["values"]
            x = M.vector_to_array("features")
            bad = F.exists(x, lambda e: F.isnan(e) | (F.abs(e) == float("inf")))
            parts.append(rows.select("system", F.lit(name).alias("split"), "label", F.size(x).alias("k"), bad.alias("bad")).groupBy(
                "system", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("sum_y"), F.min("k").alias("n_features"),
                                       F.count_if((F.col("k") == n) & ~F.col("bad")).alias("n_whole")))
    return _union(parts)


def _fit_predict(spark, sf_dir, names, sizes=WHOLE):
    return facts(each_system(spark, sf_dir, lambda _, p: M.compare_models(p, sizes, names)[1]))


@query("train_rf")
def q_train_rf(spark, sf_dir):
    """M7: random forest per system, every test row scored."""
    return _fit_predict(spark, sf_dir, ["RandomForest"])


@query("train_gbt")
def q_train_gbt(spark, sf_dir):
    """M8: gradient-boosted trees per system, every test row scored."""
    return _fit_predict(spark, sf_dir, ["GradientBoosting"], M.BOOST)


@query("train_gbt_presets")
def q_train_gbt_presets(spark, sf_dir):
    """M9: the two boosted-tree presets, every test row scored."""
    return _fit_predict(spark, sf_dir, ["GBTPresetColumnSampled", "GBTPresetCoarseBins"], M.BOOST)


@query("train_enet")
def q_train_enet(spark, sf_dir):
    """Elastic net per system, every test row scored."""
    return _fit_predict(spark, sf_dir, ["ElasticNet"])


@query("leaderboard")
def q_leaderboard(spark, sf_dir):
    """Every model and the weighted vote (as a deployable pipeline) on every test row, with their ranks by R2."""
    def board(_, p):
        models, preds = M.compare_models(p, SIZES)
        preds = stage(preds)
        vote = PipelineModel(stages=[M.assembler(p.features), *M.vote_model(models, M.leaderboard(preds))])
        allp = stage(preds.unionByName(M.scored({"VotingEnsemble": vote}, p.test)))
        n = M.leaderboard(allp).filter(F.col("r2").isNotNull()).groupBy("system").agg(F.count(F.lit(1)).alias("n_ranked"))
        return facts(allp).join(n, "system")

    return each_system(spark, sf_dir, board)


@query("stacking")
def q_stacking(spark, sf_dir):
    """Out-of-fold stacking over all six bases (threshold off) with a boosted meta-model; every test row scored."""
    def stacked(setup, p):
        models, preds, folded = M.fit_with_folds(p, SIZES, setup.contiguous_folds)
        stack = M.stack_model(p, models, stage(M.leaderboard(preds)), SIZES, -float("inf"), setup.contiguous_folds, folded)
        pm = PipelineModel(stages=[M.assembler(p.features), *stack])
        return facts(stage(M.scored({"StackingEnsemble": pm}, p.test))).withColumn("n_bases", F.lit(len(stack) - 2))

    return each_system(spark, sf_dir, stacked)


@query("search_params")
def q_search_params(spark, sf_dir):
    """Random search on the hashed hold-out and on time folds: rows scored per trial and fold, one best trial."""
    def found(setup, p):
        parts = []
        for mode in ("holdout", "time"):
            r = M.search_params(p, jobs.search_sizes(setup, M.SEARCH, mode), mode)
            best = M.best_settings(r)
            is_best = (F.col("step_size") == best["stepSize"]) & (F.col("rounds") == best["maxIter"])
            parts.append(r.groupBy("system", "mode", "fold").agg(
                F.count(F.lit(1)).alias("n_trials"), F.min("n").alias("n_least"), F.max("n").alias("n_most"),
                F.count_if(is_best).alias("n_best")))
        return _union(parts)

    return each_system(spark, sf_dir, found)


@query("cross_validate")
def q_cross_validate(spark, sf_dir):
    """All six models on hashed folds; every training row scored once by a model that did not see it."""
    return facts(each_system(spark, sf_dir, lambda _, p: stage(M.out_of_fold(p, SIZES, k=SIZES.cv_folds))))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Importances of all features by tree model: how many, their sum, and the top 15 listed."""
    def ranked(_, p):
        models, _ = M.compare_models(p, SIZES, ["RandomForest", "GradientBoosting", "GBTPresetColumnSampled", "GBTPresetCoarseBins"])
        every = M.importances(models, p).groupBy("system", "model").agg(
            F.countDistinct("feature").alias("n_features"), F.sum("importance").alias("total"))
        top = M.feature_importance(models, p, 15).groupBy("system", "model").agg(F.count(F.lit(1)).alias("n_top"))
        return every.join(top, ["system", "model"])

    return each_system(spark, sf_dir, ranked)


@query("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """Every model and both ensembles saved, loaded and run on every test row; how many rows are equal."""
    def again(setup, p):
        pipelines, preds = jobs.train_system(p, setup, SIZES, stack_all=True)
        path = scratch_path(spark, "models")

        def round_trip(name):
            M.save_model(pipelines[name], os.path.join(path, name))
            return M.load_model(spark, os.path.join(path, name))

        loaded = dict(zip(pipelines, run_all([partial(round_trip, name) for name in pipelines])))
        second = M.scored(loaded, p.test).withColumnRenamed("y_hat", "again")
        return preds.join(second.drop("y"), ["system", "model", "date"]).groupBy("system", "model").agg(
            F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"), F.count_if(F.col("again") == F.col("y_hat")).alias("n_equal"))

    return each_system(spark, sf_dir, again)


@query("ticket_classifier")
def q_ticket_classifier(spark, sf_dir):
    """M1 (ML form) + M2: per-class probabilities of every ticket from one-vs-rest forests, and own class on top."""
    t = fx.ticket_text(spark, sf_dir)
    model = M.fit_text_classifier(t, jobs.TEXT_CLASSES, WHOLE)
    pr = M.class_probabilities(model, M.text_frame(t, jobs.TEXT_CLASSES), jobs.TEXT_CLASSES)
    ok = F.lit(True)
    for c in jobs.TEXT_CLASSES:
        ok = ok & F.col(f"p_{c}").between(0.0, 1.0)
    return pr.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticket_id").alias("n_tickets"),
                                  F.count_if(ok).alias("n_valid"))


@query("ticket_cv")
def q_ticket_cv(spark, sf_dir):
    """M4: stratified 5-fold CV of the text classifier: tickets and positives per class and fold, each scored once."""
    o = M.text_out_of_fold(fx.ticket_text(spark, sf_dir), jobs.TEXT_CLASSES, WHOLE, 5)
    return o.groupBy("class", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_positive"),
                                          F.countDistinct("ticket_id").alias("n_tickets"),
                                          F.count_if(F.col("y_pred").isin(0, 1)).alias("n_scored"))


@query("classify_tickets")
def q_classify_tickets(spark, sf_dir):
    """M5: model probabilities + keyword rules -> relabelled tickets; every row against the decision's rules."""
    c = jobs.classify_stage(fx.ticket_text(spark, sf_dir), WHOLE, **RULES)
    generic = F.col("unit_before") == fx.GENERIC
    want = (F.when(~generic, F.col("unit_before")).when(F.col("keyword_label").isNotNull(), F.col("keyword_label"))
            .when(F.col("model_confidence") >= THRESHOLD, F.col("model_label")).otherwise(F.lit(fx.GENERIC)))
    return c.groupBy("unit_before", "keyword_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("unit") == want).alias("n_by_rule"),
        F.count_if(F.col("confidence").between(0.0, 1.0)).alias("n_confident"),
        F.count_if(F.col("model_label").isin(jobs.TEXT_CLASSES)).alias("n_model"))


#: Roots of the retrain job by application and tables: three queries read what one run wrote.
_ROOTS: dict[tuple[str, str], str] = {}


def retrained(spark, sf_dir) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROOTS:
        root = scratch_path(spark, "retrain")
        tickets = fx.dated(fx.ticket_probs(spark, sf_dir), spark, sf_dir)
        known, fetched = fx.line_weather_update(spark, sf_dir)
        jobs.retrain_job(spark, root, tickets, known, fetched, "reading_id", RULES, TRAINED_AT, WHOLE, probabilities=tickets)
        _ROOTS[key] = root
    return _ROOTS[key]


@query("retrain_job")
def q_retrain_job(spark, sf_dir):
    """The whole retrain application; its training table, the models on its leaderboard and what it deployed."""
    root = retrained(spark, sf_dir)
    t = spark.read.parquet(os.path.join(root, "training")).groupBy("system").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum(spec.TARGET).alias("n_faults"))
    board = files.read_leaderboard(spark, os.path.join(root, "leaderboard"))
    singles = board.filter(~F.col("model_name").isin(list(M.ENSEMBLES))).groupBy("system").agg(
        F.count(F.lit(1)).alias("n_models"), F.max("trained_at").alias("trained_at"))
    metas = _union([spark.read.parquet(os.path.join(root, s.name, "deployed")) for s in jobs.SETUPS])
    top = board.groupBy("system").agg(F.max("r2").alias("top"))
    best = metas.join(top, "system").select("system", (F.abs(F.col("r2") - F.col("top")) < 1e-9).alias("deployed_best"))
    return t.join(singles, "system").join(best, "system")


@query("score_forecast")
def q_score_forecast(spark, sf_dir):
    """The deployed models score every day of the weather table; which days, and whole numbers for every system."""
    s = jobs.score_forecast(spark, weather_fx3(spark, sf_dir), retrained(spark, sf_dir))
    return s.select("date", *[F.col(f"{x.name}_fault_prediction").isNotNull().alias(f"{x.name}_scored") for x in jobs.SETUPS])


@query("forecast_job")
def q_forecast_job(spark, sf_dir):
    """The forecast application on what the retrain application left: the 7 days, predictions of every system, the
    name and metrics being those stored with the deployed model."""
    root = retrained(spark, sf_dir)
    hist, fc = fx.overlap(spark, sf_dir)
    v = jobs.forecast_job(spark, root, hist, fc, FORECAST_AS_OF)
    names = {s.name: m["model_name"] for s, m, _, _ in jobs.deployed(spark, root)}
    cols = []
    for s in jobs.SETUPS:
        cols += [F.col(f"{s.name}_fault_prediction").isNotNull().alias(f"{s.name}_scored"),
                 (F.col(f"{s.name}_model") == names[s.name]).alias(f"{s.name}_named"), F.col(f"{s.name}_trained_at")]
    return v.select("date", *cols)


FORECAST_DAYS = [(dt.date.fromisoformat(FORECAST_AS_OF) + dt.timedelta(days=k)).isoformat() for k in range(7)]
