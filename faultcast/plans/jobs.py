"""The two applications of the reference as Spark jobs: retrain (M20) and forecast (M21, with M19).

Stages hand over through tables below a root folder that the caller names (a
shared store), as the reference hands over through files: classified tickets
(S6), daily weather (S5), training table, saved models (S7) and the leaderboard
(S8). The forecast application only reads what the retrain application wrote,
so the two may be different applications.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, replace
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import faultcast
from faultcast.operators.columns import align_features, next_days
from faultcast.operators.joins import assemble_predictions
from faultcast.operators.metrics import regression_metrics
from faultcast.operators.ranking import best_model, union_series
from faultcast.operators.stats import apply_scale, attach_global, fitted_scale
from faultcast.operators.text import classify_tickets
from faultcast.plans import models as M
from faultcast.plans import spec
from faultcast.plans.pool import run_all
from faultcast.plans.features import base_features, forecast_features, lean_temporal, rich_temporal
from faultcast.plans.training import fault_training_table
from faultcast.plans.weather import daily_weather
from faultcast.session import stage
from faultcast.sources import files
from faultcast.sources import fixtures as fx
from faultcast.sources.incremental import land_readings, landed_weather


@dataclass(frozen=True)
class SystemSetup:
    """How one system is trained (the reference trains a cooling and a heating system)."""
    name: str          # output prefix
    system: str        # unit code in the classified tickets
    variant: str       # 'rich' (E3) or 'lean' (E4)
    split: str         # 'random' or 'time'
    scaler: str        # 'standard' or 'robust'
    stack_r2_min: float
    contiguous_folds: bool
    search: str        # 'holdout' or 'time'
    wide_search: bool = False   # more trials on time folds


# The classes of the fixture tickets and how each is trained.
SETUPS = (
    SystemSetup("cooling", "C1", "rich", "random", "standard", 0.4, False, "holdout"),
    SystemSetup("heating", "C2", "lean", "time", "robust", 0.3, True, "time", True),
    SystemSetup("other", "C3", "lean", "random", "standard", 0.3, False, "holdout"),
)
TEXT_CLASSES = list(fx.SPECIFIC)


def system_features(base: DataFrame, variant: str) -> DataFrame:
    """Features of every system in one pass, from their base features; windows and bounds are per system."""
    return stage(rich_temporal(base, ["system"]) if variant == "rich" else lean_temporal(base, ["system"]))


def prepared_all(training: DataFrame, setups=SETUPS, stop_share: int = 0) -> list[tuple[SystemSetup, M.Prepared]]:
    """The rows of each setup, from base features that are built once and features that are built once per variant."""
    wanted = training.filter(F.col("system").isin([s.system for s in setups]))
    variants = sorted({s.variant for s in setups})
    base = stage(base_features(wanted, keys=["system"]))
    feats = dict(zip(variants, run_all([partial(system_features, base, v) for v in variants])))
    return list(zip(setups, run_all([partial(M.prepare, feats[s.variant], s.system, s.split, s.scaler, stop_share=stop_share)
                                     for s in setups])))


def search_sizes(setup: SystemSetup, sizes: M.ModelSizes, mode: str) -> M.ModelSizes:
    """M15 with the reference's number of trials: 20 on the hold-out; on time folds 20 of the heating system, else 5."""
    return replace(sizes, search_trials=sizes.search_wide) if mode == "holdout" or setup.wide_search else sizes


def train_system(p: M.Prepared, setup: SystemSetup, sizes: M.ModelSizes, tune: bool = False,
                 stack_all: bool = False) -> tuple[dict[str, PipelineModel], DataFrame]:
    """M8-M15 for one system: (pipelines by name, their test predictions).

    With ``tune`` the boosted trees take the settings that M15 finds (hold-out
    or time folds, as the setup says).
    """
    if tune:
        sizes = replace(sizes, tuned=M.best_settings(M.search_params(p, search_sizes(setup, sizes, setup.search), setup.search)))
    if stack_all:
        models, preds, folded = M.fit_with_folds(p, sizes, setup.contiguous_folds)
    else:
        (models, preds), folded = M.compare_models(p, sizes), None
    board = stage(M.leaderboard(preds))
    pipelines = M.deployable(p, models, board, sizes, -float("inf") if stack_all else setup.stack_r2_min,
                             setup.contiguous_folds, folded)
    return pipelines, stage(M.scored(pipelines, p.test))


def classify_stage(tickets: DataFrame, sizes: M.ModelSizes, probabilities: DataFrame | None = None, **rules) -> DataFrame:
    """M5: text model probabilities for every ticket (or the given ones), then the relabelling decision."""
    if probabilities is None:
        model = M.fit_text_classifier(tickets, TEXT_CLASSES, sizes)
        probabilities = M.class_probabilities(model, M.text_frame(tickets, TEXT_CLASSES), TEXT_CLASSES).drop("label")
    return classify_tickets(probabilities, {c: f"p_{c}" for c in TEXT_CLASSES}, **rules)


def content_keys(training: DataFrame, setups, *settings) -> dict[str, str]:
    """Per setup a key of all that its models depend on: the system's training rows as a multiset, the setup, the
    settings, and the versions of the library and of Spark.

    The rows of a system enter as their number and four sums over the pieces of each row's SHA-256, which no order of
    rows and no partitioning changes. One aggregate; the driver sees a row per system.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(training.columns)]), {"ignoreNullFields": "false"}), 256)
    pieces = [F.sum(F.conv(F.substring(row, 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    rows = training.filter(F.col("system").isin([s.system for s in setups])).groupBy("system").agg(F.count(F.lit(1)), *pieces)
    content = {r[0]: tuple(r)[1:] for r in rows.collect()}
    versions = (faultcast.__version__, training.sparkSession.version)
    return {s.name: hashlib.sha256(repr((s, content.get(s.system), sorted(training.columns), settings, versions)).encode())
            .hexdigest()[:32] for s in setups}


def is_registered(spark: SparkSession, root: str, name: str, key: str) -> bool:
    """True when the models of this key were saved to the end: their description is written last."""
    return files.path_exists(spark, os.path.join(root, name, key, "deployed", "_SUCCESS"))


def save_system(root: str, setup: SystemSetup, key: str, p: M.Prepared, pipelines: dict[str, PipelineModel], board: DataFrame,
                trained_at: str) -> None:
    """S7 under the content key: every pipeline, the metrics of all, and of the best of all its name, metrics and the
    statistics of its features.

    M14: of the two ensembles the better one competes with the single models.
    """
    at = lambda *names: os.path.join(root, setup.name, key, *names)
    run_all([partial(M.save_model, pm, at("models", name)) for name, pm in pipelines.items()])
    ensemble = M.pick_ensemble(board)
    single = board.filter(~F.col("model").isin(list(M.ENSEMBLES)))
    best = best_model(single.unionByName(ensemble.select(*single.columns)), ["system"], "r2", name="model")
    spark = board.sparkSession
    metrics = [F.col("model").alias("model_name"), "mse", "rmse", "mae", "r2", F.lit(trained_at).alias("trained_at")]
    scaler = [(i, c, *p.scaler[c]) for i, c in enumerate(p.features)]
    files.write_table(spark.createDataFrame(scaler, "position int, feature string, centre double, scale double"), at("scaler"))
    files.write_table(board.select("system", *metrics), at("board"))
    files.write_table(best.select(F.lit(setup.name).alias("setup"), "system", *metrics, F.lit(key).alias("model_key")),
                      at("deployed"))


def retrain_job(spark: SparkSession, root: str, tickets: DataFrame, readings: DataFrame, fetched: DataFrame, reading_key: str,
                rules: dict, trained_at: str, sizes: M.ModelSizes = M.ModelSizes(), probabilities: DataFrame | None = None,
                setups=SETUPS, tune: bool = True, stack_all: bool = False) -> DataFrame:
    """History and fetched readings landed (U1), complete rows only (P5) -> daily weather; tickets -> classified
    -> counted by their new unit -> training table -> tune, train and compare every system -> save.

    ``readings`` is the history of a new root; a later run on the same root
    lands only ``fetched``. Models are kept by content (``content_keys``): a
    system whose training rows and settings were trained before is not fitted
    again, its models are deployed anew with the metrics and the time of their
    own training. Returns the leaderboard read back from its JSON
    file. ``rules`` are the arguments of the relabelling decision;
    ``trained_at`` is written as given.
    """
    at = lambda name: os.path.join(root, name)
    files.write_table(classify_stage(tickets, sizes, probabilities, **rules), at("tickets_classified"))
    # a root that holds landed readings takes the fetched ones only, and these rewrite their own months
    known = files.path_exists(spark, os.path.join(at("landed"), "readings"))
    for rows in ([] if known else [readings]) + [fetched.select(*readings.columns)]:
        land_readings(spark, at("landed"), rows, reading_key, complete=[c for c in readings.columns if c != reading_key])
    files.write_daily(landed_weather(spark, at("landed")), at("daily_weather"))
    classified = spark.read.parquet(at("tickets_classified"))
    training = fault_training_table(classified, files.read_daily(spark, at("daily_weather")),
                                    systems=[s.system for s in setups])
    files.write_table(training, at("training"), partition_by=["system"])
    training = spark.read.parquet(at("training"))

    keys = content_keys(training, setups, sizes, tune, stack_all)

    def train(setup: SystemSetup, p: M.Prepared) -> None:
        pipelines, preds = train_system(p, setup, sizes, tune, stack_all)
        board = stage(regression_metrics(preds, keys=["system", "model"]))
        save_system(root, setup, keys[setup.name], p, pipelines, board, trained_at)

    new = [s for s in setups if not is_registered(spark, root, s.name, keys[s.name])]
    if new:
        run_all([partial(train, setup, p) for setup, p in prepared_all(training, new, sizes.stop_share)])
    flat = None
    for setup in setups:
        folder = os.path.join(root, setup.name)
        files.write_table(spark.read.parquet(os.path.join(folder, keys[setup.name], "deployed")), os.path.join(folder, "deployed"))
        board = spark.read.parquet(os.path.join(folder, keys[setup.name], "board"))
        flat = board if flat is None else flat.unionByName(board)
    files.write_leaderboard(flat, at("leaderboard"))
    return files.read_leaderboard(spark, at("leaderboard"))


def deployed(spark: SparkSession, root: str, setups=SETUPS) -> list[tuple[SystemSetup, dict, list[tuple], PipelineModel]]:
    """Name and metrics, feature statistics and pipeline of each system; raises where the retrain job left none."""
    out = []
    for setup in setups:
        path = os.path.join(root, setup.name)
        if not files.path_exists(spark, os.path.join(path, "deployed")):
            raise FileNotFoundError(f"no saved model for {setup.name} under {root}: run the retrain job first")
        meta = spark.read.parquet(os.path.join(path, "deployed")).first().asDict()
        path = os.path.join(path, meta["model_key"])
        scaler = [(r["feature"], r["centre"], r["scale"]) for r in  # a row per feature
                  spark.read.parquet(os.path.join(path, "scaler")).orderBy("position").collect()]
        out.append((setup, meta, scaler, M.load_model(spark, os.path.join(path, "models", meta["model_name"]))))
    return out


def score_forecast(spark: SparkSession, daily: DataFrame, root: str, parity: bool = False, setups=SETUPS) -> DataFrame:
    """Per system, forecast features (E8) scaled with the training rows' statistics and aligned to the saved
    model's features, predicted, rounded half-even to integers, the systems side by side (J3).

    ``parity=True`` refits the statistics on the rows being scored, like the reference.
    """
    scores = None
    for setup, _, scaler, model in deployed(spark, root, setups):
        names = [f for f, _, _ in scaler]
        x = stage(align_features(forecast_features(daily, setup.variant, keys=(), scale=False), names, keep=["date"]))
        fitted = fitted_scale(x, names, setup.scaler) if parity else {f: (c, s) for f, c, s in scaler}
        pr = model.transform(apply_scale(x, fitted)).select("date", F.lit(setup.name).alias("system"), "prediction")
        scores = pr if scores is None else scores.unionByName(pr)
    return assemble_predictions(scores, [s.name for s in setups])


def forecast_job(spark: SparkSession, root: str, history: DataFrame, forecast: DataFrame, as_of: str, parity: bool = False,
                 setups=SETUPS) -> DataFrame:
    """History + forecast hours (U1, all of them) -> daily weather -> scores -> the 7 days from ``as_of``, with
    name and metrics of the model that made each system's predictions."""
    daily = stage(daily_weather(union_series(history, forecast, "ts")))
    view = next_days(score_forecast(spark, daily, root, parity, setups), as_of, 6)
    metas = None
    for setup in setups:
        m = spark.read.parquet(os.path.join(root, setup.name, "deployed"))
        metas = m if metas is None else metas.unionByName(m)
    wide = metas.agg(*[F.max(F.when(F.col("setup") == s.name, F.col(c))).alias(f"{s.name}_{n}") for s in setups
                       for c, n in (("model_name", "model"), ("r2", "r2"), ("rmse", "rmse"), ("trained_at", "trained_at"))])
    return attach_global(view, wide)


def with_signal(training: DataFrame) -> DataFrame:
    """The training table with a target that follows the weather: fault count + twice the mean temperature."""
    return training.withColumn(spec.TARGET, F.col(spec.TARGET) + 2.0 * F.col(spec.TEMP_AVG))
