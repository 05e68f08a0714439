"""Models on MLlib.

Data preparation is the DataFrame pipeline (features, splits, scalers);
estimators are MLlib's. Every fit input is materialised once (a written stage table)
because tree and linear solvers read it many times. Predictions of every
model land in one long table ``(system, model, date, y, y_hat)`` so that
metrics, votes and model choice are the grouped operators of
:mod:`faultcast.operators.metrics` and :mod:`faultcast.operators.ranking`.

Defaults are the reference's sizes (500 trees, 100 trees for text, 10,000
linear iterations). The registered queries run with :data:`CHECK`, the sizes
that were measured to finish. Independent fits run side by side (``plans/pool.py``).
"""

from __future__ import annotations

import math
import os
import random
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultcast.operators.metrics import regression_metrics, vote_weights
from faultcast.operators.splits import chrono_split, expanding_folds, hash_split, md5_of
from faultcast.operators.stats import apply_scale, fitted_scale
from faultcast.operators.text import TOKEN_PATTERN, combine_text
from faultcast.plans import spec
from faultcast.plans.pool import WIDTH, run_all
from faultcast.plans.trees import BoostedTrees, ForestOfTrees, TextForests
from faultcast.session import stage


@dataclass
class ModelSizes:
    """Sizes of the estimators. Defaults follow the reference."""
    rf_trees: int = 500
    rf_depth: int = 10
    gbt_iter: int = 500
    gbt_depth: int = 6
    gbt_step: float = 0.05
    enet_iter: int = 10000
    text_trees: int = 100
    ada_rounds: int = 100
    ada_rate: float = 0.1
    stack_folds: int = 5
    search_trials: int = 5
    search_wide: int = 20     # trials of the searches that the reference gives more (``jobs.search_sizes``)
    search_per_fit: int = 1   # trials that differ in their rounds only and so cost one fit
    search_depth: tuple[int, int] = (3, 12)
    search_rounds: tuple[int, int] = (100, 1000)
    stop_share: int = 0       # percent of the training rows on which boosting stops early; 0: all rounds
    text_depth: int = 30      # the reference's text forests are unlimited; MLlib allows 30
    cv_folds: int = 5
    seed: int = 42
    tuned: dict = field(default_factory=dict)   # boosting settings found by search_params


#: Sizes of the registered queries that fit many models, as measured (README, "Model sizes"); ``ModelSizes()`` has
#: the reference's, which the queries of one forest, one linear model or the text classifier use.
CHECK = ModelSizes(rf_trees=50, gbt_iter=20, ada_rounds=5, stack_folds=3, cv_folds=3, search_trials=3, search_wide=3, search_per_fit=3,
                   search_depth=(3, 6), search_rounds=(20, 30))
#: Of the queries that only boost.
BOOST = ModelSizes(gbt_iter=60)
#: Of the search query: the reference's ranges and numbers of trials, every trial a fit of its own.
SEARCH = ModelSizes()


# ---------------------------------------------------------------- estimators

def estimators(sizes: ModelSizes = ModelSizes()) -> dict:
    """The regression estimators by name (RBF-SVR is not built)."""
    from faultcast.plans.adaboost import AdaBoostR2

    s = sizes
    # M15 -> M8/M9: what the search found replaces the defaults
    stop = {"validationIndicatorCol": "held_out", "validationTol": 0.001} if s.stop_share else {}
    gbt = {"maxIter": s.gbt_iter, "stepSize": s.gbt_step, "maxDepth": s.gbt_depth, "subsamplingRate": 0.8,
           "minInstancesPerNode": 2, "seed": s.seed, **stop, **s.tuned}
    return {
        "RandomForest": ForestOfTrees(numTrees=s.rf_trees, maxDepth=s.rf_depth, minInstancesPerNode=2,
                                      featureSubsetStrategy="sqrt", seed=s.seed),
        "GradientBoosting": BoostedTrees(**gbt),
        # M9: two further boosted-tree presets (column-sampled and histogram-like with coarse bins)
        "GBTPresetColumnSampled": BoostedTrees(**{**gbt, "minInstancesPerNode": 3, "featureSubsetStrategy": "0.8"}),
        "GBTPresetCoarseBins": BoostedTrees(**{**gbt, "featureSubsetStrategy": "0.8"}, maxBins=16),
        # AdaBoost.R2 over depth-3 trees, linear loss
        "AdaBoost": AdaBoostR2(numRounds=s.ada_rounds, learningRate=s.ada_rate, maxDepth=3, seed=s.seed),
        "ElasticNet": LinearRegression(regParam=0.5, elasticNetParam=0.5, maxIter=s.enet_iter, standardization=False),
    }


# ---------------------------------------------------------------- data preparation

@dataclass
class Prepared:
    system: str
    features: list[str]
    scaler: dict[str, tuple[float, float]]   # of the training rows; kept with the models
    train: DataFrame   # (system, date, label, features)
    test: DataFrame


def prepare(feats: DataFrame, system: str, split: str = "random", scaler: str = "standard",
            target: str = spec.TARGET, stop_share: int = 0) -> Prepared:
    """P15 + M6/W10 + E6/E7 + assembler for one system.

    ``split='random'`` is the md5 80/20 split (cooling), ``'time'`` the first
    80 % of days (heating). The scaler is fitted on the training rows only.
    """
    x = feats.filter(F.col("system") == system)
    names = [c for c in x.columns if c not in ("system", "date", target)]
    if split == "random":
        x = hash_split(x, F.concat_ws("|", "system", F.col("date").cast("string")), 80)
    else:
        x = chrono_split(x, 0.8, ["system"], "date")
    x = stage(x)
    fitted = fitted_scale(x.filter(F.col("split") == "train"), names, scaler)
    data = assembler(names).transform(apply_scale(x, fitted)).select(
        "system", "date", F.col(target).cast("double").alias("label"), "features", "split")
    data = stage(packed(data, x.count()))
    return Prepared(system, names, fitted, with_held_out(data.filter(F.col("split") == "train").drop("split"), stop_share),
                    data.filter(F.col("split") == "test").drop("split"))


def with_held_out(train: DataFrame, percent: int) -> DataFrame:
    """M8: ``held_out`` marks the hashed ``percent`` of the training rows on which boosting stops early; no column for 0."""
    if not percent:
        return train
    bucket = F.conv(F.substring(md5_of(F.lit("stop"), "system", F.col("date").cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    return train.withColumn("held_out", bucket < percent)


def packed(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """As many partitions as the rows need: solvers run a job per iteration, so empty tasks cost more than they save."""
    return df.coalesce(max(1, -(-rows // per_task)))


def spread(df: DataFrame, rows: int, fits: int, least: int = 500, most: int = 20_000) -> DataFrame:
    """Rows dealt to the cores that each of ``fits`` forests has at a time (half as many tasks again), ``least`` rows a task
    or more. Every task of a forest sends the statistics of all open nodes, so that tasks beyond the cores only add to what
    is sent; they are taken where a task would hold more than ``most`` rows."""
    share = -(-3 * df.sparkSession.sparkContext.defaultParallelism // (2 * fits))
    return df.repartition(max(1, -(-rows // most), min(share, -(-rows // least))))


def assembler(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")


def predictions_of(model, data: DataFrame, name: str) -> DataFrame:
    return model.transform(data).select("system", F.lit(name).alias("model"), "date", F.col("label").alias("y"),
                                        F.col("prediction").alias("y_hat"))


# ---------------------------------------------------------------- M11 compare, M12 vote, M13 stacking

def compare_models(p: Prepared, sizes: ModelSizes = ModelSizes(), names: list[str] | None = None):
    """Fit each estimator on train, predict test; returns (models, long predictions)."""
    est = estimators(sizes)
    names = names or list(est)
    models = dict(zip(names, run_all([partial(est[n].fit, p.train) for n in names])))
    return models, _union([predictions_of(m, p.test, n) for n, m in models.items()])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_fits(folded: DataFrame, names: list[str], k: int, sizes: ModelSizes) -> dict[tuple[str, int], object]:
    """A model per name and fold, fitted on the other folds."""
    est = estimators(sizes)
    keys = [(n, f) for n in names for f in range(k)]
    return dict(zip(keys, run_all([partial(est[n].fit, folded.filter(F.col("fold") != f)) for n, f in keys])))


def leaderboard(preds: DataFrame) -> DataFrame:
    """A15 over the long prediction table: one row per (system, model)."""
    return regression_metrics(preds, keys=["system", "model"])


def fold_column(data: DataFrame, k: int, contiguous: bool) -> DataFrame:
    """Fold ids for out-of-fold predictions: hashed (shuffled) or contiguous blocks by date."""
    if not contiguous:
        h = md5_of("system", F.col("date").cast("string"))
        return data.withColumn("fold", (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % k).cast("int"))
    ef = expanding_folds(data.select("system", "date"), k - 1, ["system"], "date")
    # contiguous blocks: rows before the first test block form block 0, each test block its own
    blocks = ef.filter(F.col("role") == "test").select("system", "date", (F.col("fold") + 1).alias("fold"))
    return data.join(blocks, ["system", "date"], "left").withColumn("fold", F.coalesce("fold", F.lit(0)).cast("int"))


def _named(model, name: str):
    """A copy of a fitted model that writes its predictions to a column of its own."""
    return model.copy({model.getParam("predictionCol"): f"b_{name}"})


def vote_model(models: dict, board: DataFrame) -> list:
    """M12 as pipeline stages after the assembler: every model, then the mean weighted by max(R2, 0.01)."""
    w = {r["model"]: r["weight"] for r in vote_weights(board, ["system"]).collect()}   # a row per model
    mean = " + ".join(f"{w[n]!r}D * b_{n}" for n in models)
    return [*[_named(m, n) for n, m in models.items()], SQLTransformer(statement=f"SELECT *, {mean} AS prediction FROM __THIS__")]


#: Fits of a system at a time where the folds are fitted along: all boosted ones, whose chains of jobs are the longest.
FOLD_WIDTH = 12


@dataclass
class Folded:
    """Training rows with their stacking folds, and the models fitted on the other folds by (name, fold)."""
    data: DataFrame
    rows: int
    fits: dict[tuple[str, int], object]


def stack_folds(p: Prepared, sizes: ModelSizes, contiguous: bool) -> tuple[DataFrame, int]:
    """The training rows with their folds, in the tasks they need, and their number."""
    rows = p.train.count()
    return stage(packed(fold_column(p.train, sizes.stack_folds, contiguous), rows)), rows


def fit_with_folds(p: Prepared, sizes: ModelSizes = ModelSizes(), contiguous: bool = False):
    """M11 and the fold models of M13 for a stack that takes every base: one set of fits side by side, since none of
    them waits for the board. Returns (models, long predictions, :class:`Folded`)."""
    est = estimators(sizes)
    data, rows = stack_folds(p, sizes, contiguous)
    keys = [(n, f) for n in sorted(est, key=lambda n: not isinstance(est[n], GBTRegressor))  # the longest chains of jobs first
            for f in (None, *range(sizes.stack_folds))]
    fits = dict(zip(keys, run_all([partial(est[n].fit, p.train if f is None else data.filter(F.col("fold") != f))
                                   for n, f in keys], FOLD_WIDTH)))
    models = {n: fits.pop((n, None)) for n in est}
    return models, _union([predictions_of(m, p.test, n) for n, m in models.items()]), Folded(data, rows, fits)


def stack_model(p: Prepared, models: dict, board: DataFrame, sizes: ModelSizes = ModelSizes(), r2_min: float = 0.4,
                contiguous: bool = False, folded: Folded | None = None) -> list | None:
    """M13 as pipeline stages after the assembler; None without a base whose R2 exceeds ``r2_min``.

    Out-of-fold base predictions feed a boosted meta-model: every training row's
    come from models that did not see it. The bases themselves are the ones
    fitted on all training rows. Predictions are chained columns, no joins.
    ``folded`` holds the fold models where they are fitted already.
    """
    good = [r["model"] for r in board.filter((F.col("r2") > r2_min) & F.col("model").isin(list(models)))
            .select("model").orderBy("model").collect()]
    if not good:
        return None
    if folded is None:
        data, rows = stack_folds(p, sizes, contiguous)
        folded = Folded(data, rows, fold_fits(data, good, sizes.stack_folds, sizes))
    rows, fits = folded.rows, folded.fits
    parts = []
    for k in range(sizes.stack_folds):
        part = folded.data.filter(F.col("fold") == k)
        for name in good:
            part = _named(fits[name, k], name).transform(part)
        parts.append(part.select("label", *[f"b_{n}" for n in good]))
    oof = _union(parts)
    joined = VectorAssembler(inputCols=[f"b_{n}" for n in good], outputCol="meta")
    meta = BoostedTrees(featuresCol="meta", maxIter=sizes.gbt_iter, stepSize=sizes.gbt_step, maxDepth=sizes.gbt_depth,
                        subsamplingRate=0.8, seed=sizes.seed).fit(stage(packed(joined.transform(oof).select("label", "meta"), rows)))
    return [*[_named(models[n], n) for n in good], joined, meta]


ENSEMBLES = ("VotingEnsemble", "StackingEnsemble")


def deployable(p: Prepared, models: dict, board: DataFrame, sizes: ModelSizes = ModelSizes(), r2_min: float = 0.4,
               contiguous: bool = False, folded: Folded | None = None) -> dict[str, PipelineModel]:
    """Every model and both ensembles as pipelines from the scaled feature columns to ``prediction``."""
    first = assembler(p.features)
    out = {n: PipelineModel(stages=[first, m]) for n, m in models.items()}
    out["VotingEnsemble"] = PipelineModel(stages=[first, *vote_model(models, board)])
    stack = stack_model(p, models, board, sizes, r2_min, contiguous, folded)
    if stack:
        out["StackingEnsemble"] = PipelineModel(stages=[first, *stack])
    return out


def scored(pipelines: dict[str, PipelineModel], data: DataFrame) -> DataFrame:
    """Long predictions of pipelines on prepared rows (their assembler stage is already applied)."""
    out = None
    for name, pm in pipelines.items():
        pr = predictions_of(PipelineModel(stages=pm.stages[1:]), data, name)
        out = pr if out is None else out.unionByName(pr)
    return out


def pick_ensemble(board: DataFrame, names=ENSEMBLES) -> DataFrame:
    """The better ensemble by R2 per system."""
    from faultcast.operators.ranking import best_model
    return best_model(board.filter(F.col("model").isin(list(names))), ["system"], "r2", name="model")


# ---------------------------------------------------------------- M15 search, M16 CV, M17 importance

def draw_trials(sizes: ModelSizes, seed: int = 42) -> list[dict]:
    """Seeded draws: a logarithmic step size, depth, leaf size, shares of columns and rows, and rounds; ``search_per_fit``
    trials in a row share everything but their rounds."""
    rng = random.Random(seed)
    trials: list[dict] = []
    while len(trials) < sizes.search_trials:
        settings = {"stepSize": round(math.exp(rng.uniform(math.log(0.001), math.log(0.1))), 6),
                    "maxDepth": rng.randint(*sizes.search_depth), "minInstancesPerNode": rng.randint(1, 20),
                    "featureSubsetStrategy": str(round(rng.uniform(0.1, 1.0), 3)), "subsamplingRate": round(rng.uniform(0.5, 1.0), 3)}
        rounds = rng.sample(range(sizes.search_rounds[0], sizes.search_rounds[1] + 1), sizes.search_per_fit)
        trials += [{**settings, "maxIter": r} for r in rounds[:sizes.search_trials - len(trials)]]
    return trials


def search_params(p: Prepared, sizes: ModelSizes = ModelSizes(), mode: str = "holdout", seed: int = 42,
                  n_splits: int = 5) -> DataFrame:
    """Seeded random draws of boosted-tree settings; a row per (trial, fold) with R2 and RMSE.

    ``holdout`` scores a hashed fifth of the training rows, ``time`` the test
    blocks of expanding time folds (W11). Neither depends on partitioning.
    Trials that differ in their rounds only cost one fit of the most rounds: its
    first r trees are the model of r rounds, so each trial's error is the staged
    error after its rounds.
    """
    trials = draw_trials(sizes, seed)
    if mode == "holdout":
        h = hash_split(p.train, F.concat_ws("|", F.lit("search"), "system", F.col("date").cast("string")), 80)
        folds = stage(h.withColumnRenamed("split", "role").withColumn("fold", F.lit(0)))
    else:
        folds = stage(packed(expanding_folds(p.train.select("system", "date"), n_splits, ["system"], "date")
                             .join(p.train, ["system", "date"]), p.train.count() * n_splits))
    groups: dict[tuple, list[int]] = {}
    for i, t in enumerate(trials):
        groups.setdefault(tuple((k, v) for k, v in t.items() if k != "maxIter"), []).append(i)

    def fit(settings: tuple, members: list[int], f: int) -> list[tuple]:
        rows = folds.filter(F.col("fold") == f)
        part = lambda role: rows.filter(F.col("role") == role).drop("fold", "role")
        most = max(trials[i]["maxIter"] for i in members)
        found = BoostedTrees(seed=sizes.seed, maxIter=most, **dict(settings)).staged_errors(
            part("train"), part("test"), [trials[i]["maxIter"] for i in members])
        if found is None:
            return []
        n, v, errors = found
        return [(p.system, i, f, n, 1.0 - mse / v if v else None, math.sqrt(mse)) for i, mse in zip(members, errors)]

    k = 1 if mode == "holdout" else n_splits
    # the longest first: a fit is one task, and the later folds have more rows
    calls = sorted(((s, members, f) for s, members in groups.items() for f in range(k)),
                   key=lambda c: -max(trials[i]["maxIter"] for i in c[1]) * (c[2] + 1))
    rows = run_all([partial(fit, *c) for c in calls], max(WIDTH, p.train.sparkSession.sparkContext.defaultParallelism))
    spark = p.train.sparkSession
    board = spark.createDataFrame([r for part in rows for r in part],  # a row per trial and fold
                                  "system string, trial int, fold int, n long, r2 double, rmse double")
    drawn = spark.createDataFrame(
        [(i, t["stepSize"], t["maxDepth"], t["maxIter"], t["subsamplingRate"], t["minInstancesPerNode"], t["featureSubsetStrategy"])
         for i, t in enumerate(trials)],
        "trial int, step_size double, max_depth int, rounds int, subsampling double, min_instances int, columns string")
    return board.join(drawn, "trial").withColumn("mode", F.lit(mode))


def best_settings(found: DataFrame, by: str = "r2") -> dict:
    """Settings of the best trial, ready for ``ModelSizes.tuned``: the highest mean R2 (then lowest RMSE), or with
    ``by="rmse"`` the lowest mean RMSE; the first trial on ties."""
    keys = ["trial", "step_size", "max_depth", "rounds", "subsampling", "min_instances", "columns"]
    order = [F.col("r2").desc_nulls_last(), F.col("rmse")] if by == "r2" else [F.col("rmse")]
    r = (found.groupBy(*keys).agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse")).orderBy(*order, "trial").first())
    return {"stepSize": r["step_size"], "maxDepth": r["max_depth"], "maxIter": r["rounds"], "subsamplingRate": r["subsampling"],
            "minInstancesPerNode": r["min_instances"], "featureSubsetStrategy": r["columns"]}


def out_of_fold(p: Prepared, sizes: ModelSizes = ModelSizes(), names: list[str] | None = None, k: int = 5) -> DataFrame:
    """(system, model, fold, date, y, y_hat): every training row scored by the model that did not see its hashed fold."""
    data = stage(fold_column(p.train, k, contiguous=False))
    fits = fold_fits(data, names or list(estimators(sizes)), k, sizes)
    return _union([predictions_of(m, data.filter(F.col("fold") == f), name).withColumn("fold", F.lit(f))
                   for (name, f), m in fits.items()])


def cross_validate(p: Prepared, sizes: ModelSizes = ModelSizes(), names: list[str] | None = None, k: int = 5) -> DataFrame:
    """K-fold R2 per model (mean and population std over folds)."""
    board = regression_metrics(out_of_fold(p, sizes, names, k), keys=["system", "model", "fold"])
    return board.groupBy("system", "model").agg(F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"))


def importances(models: dict, p: Prepared) -> DataFrame:
    """Importance of every feature in the tree models."""
    rows = [(p.system, name, f, float(v)) for name, m in models.items() if hasattr(m, "featureImportances")
            for f, v in zip(p.features, m.featureImportances.toArray())]
    return p.train.sparkSession.createDataFrame(rows, "system string, model string, feature string, importance double")


def feature_importance(models: dict, p: Prepared, k: int = 15) -> DataFrame:
    """Importances of the tree models, top k per model (feature name breaks ties)."""
    from faultcast.operators.ranking import top_k
    return top_k(importances(models, p), "importance", k, keys=["system", "model"], tie="feature")


# ---------------------------------------------------------------- S7 persistence

class _PipelineWriter(MLWriter):
    """MLlib's layout of a pipeline model with Python stages, its stages written side by side."""

    def __init__(self, instance: PipelineModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        stages = self.instance.stages
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession,
                                         paramMap={"stageUids": [s.uid for s in stages], "language": "Python"})
        run_all([partial(s.write().save, at) for s, at in zip(stages, _stage_paths(path, [s.uid for s in stages]))])


def _stage_paths(path: str, uids: list[str]) -> list[str]:
    return [os.path.join(path, "stages", f"{str(i).zfill(len(str(len(uids))))}_{uid}") for i, uid in enumerate(uids)]


def save_model(model, path: str) -> None:
    """MLlib persistence (overwrite)."""
    (_PipelineWriter(model) if isinstance(model, PipelineModel) else model.write()).overwrite().save(path)


def load_model(spark, path: str, kind=PipelineModel):
    """Load a saved model; None when the path is absent, any other failure is raised."""
    from faultcast.sources.files import path_exists

    if not path_exists(spark, path):
        return None
    meta = DefaultParamsReader.loadMetadata(path, spark) if kind is PipelineModel else {}
    if meta.get("paramMap", {}).get("language") != "Python":
        return kind.load(path)
    stages = run_all([partial(DefaultParamsReader.loadParamsInstance, at, spark)
                      for at in _stage_paths(path, meta["paramMap"]["stageUids"])])
    return PipelineModel(stages=stages)._resetUid(meta["uid"])


# ---------------------------------------------------------------- text classifier (M2, M4, M5)

#: Forests of a classifier that are fitted at a time, and classifiers (folds); each forest keeps its binned rows.
TEXT_FORESTS, TEXT_WIDTH = 3, 3


def text_pipeline(sizes: ModelSizes = ModelSizes(), vocab: int = 5000) -> Pipeline:
    """M1 (ML form) + M2: tokens -> counts (top ``vocab`` terms) -> idf -> L2 norm -> one binary random
    forest per class (their trees are grown side by side, ``trees.TextForests``).

    MLlib's idf is ln((n+1)/(df+1)) without the +1 of the reference; the SQL
    form of M1 is the exact one. Trees of depth 30 take hundreds of passes: each row's node is kept between them
    (``cacheNodeIds``) instead of walked to from the root of every tree.
    """
    rf = RandomForestClassifier(numTrees=sizes.text_trees, maxDepth=sizes.text_depth, seed=sizes.seed, featuresCol="tfidf",
                                labelCol="label", cacheNodeIds=True)
    return Pipeline(stages=[
        RegexTokenizer(inputCol="combined", outputCol="tokens", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
        CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=vocab),
        IDF(inputCol="tf", outputCol="idf"),
        Normalizer(inputCol="idf", outputCol="tfidf", p=2.0),
        TextForests(classifier=rf, featuresCol="tfidf", labelCol="label", parallelism=TEXT_FORESTS),
    ])


def text_frame(tickets: DataFrame, classes: list[str], text_cols=("text", "text2")) -> DataFrame:
    label = None
    for i, c in enumerate(classes):
        label = F.when(F.col("unit") == c, F.lit(float(i))) if label is None else label.when(F.col("unit") == c, F.lit(float(i)))
    return tickets.select("*", combine_text(*text_cols).alias("combined"), label.alias("label"))


def class_probabilities(model: PipelineModel, tickets: DataFrame, classes: list[str]) -> DataFrame:
    """Per-class positive-class probability of each binary forest, as columns ``p_<class>``.

    A text passes some hundred deep trees, so texts are dealt out evenly first, however few files hold them.
    """
    ovr = model.stages[-1]
    tickets = tickets.repartition(int(tickets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pre = PipelineModel(stages=model.stages[:-1]).transform(tickets)
    out = pre
    for i, (c, m) in enumerate(zip(classes, ovr.models)):
        m2 = m.copy()
        m2.setProbabilityCol(f"_prob{i}").setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_pred{i}")
        out = m2.transform(out).withColumn(f"p_{c}", vector_to_array(F.col(f"_prob{i}"))[1]).drop(
            f"_prob{i}", f"_raw{i}", f"_pred{i}")
    return out.drop("tokens", "tf", "idf", "tfidf", "combined")


def fit_text_classifier(tickets: DataFrame, classes: list[str], sizes: ModelSizes = ModelSizes(), at_a_time: int = 1) -> PipelineModel:
    """M2: fit on the tickets that carry a specific class; ``at_a_time`` classifiers are fitted side by side."""
    train = text_frame(tickets.filter(F.col("unit").isin(classes)), classes)
    train = stage(spread(train, train.count(), at_a_time * min(TEXT_FORESTS, len(classes))))
    return text_pipeline(sizes).fit(train)


def text_out_of_fold(tickets: DataFrame, classes: list[str], sizes: ModelSizes = ModelSizes(), k: int = 5) -> DataFrame:
    """(ticket_id, fold, class, y, y_pred): each specific ticket scored by the classifier that did not see its fold."""
    from faultcast.operators.splits import stratified_folds

    rows = stage(stratified_folds(tickets.filter(F.col("unit").isin(classes)), "ticket_id", "unit", k))
    fits = run_all([partial(fit_text_classifier, rows.filter(F.col("fold") != f), classes, sizes, min(k, TEXT_WIDTH)) for f in range(k)],
                   TEXT_WIDTH)
    out = _union([class_probabilities(m, text_frame(rows.filter(F.col("fold") == f), classes), classes) for f, m in enumerate(fits)])
    return out.select("ticket_id", "fold", F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), (F.col("unit") == c).cast("int").alias("y"),
                 (F.col(f"p_{c}") >= 0.5).cast("int").alias("y_pred")) for c in classes])).alias("s")).select(
        "ticket_id", "fold", "s.*")


def text_cv(tickets: DataFrame, classes: list[str], sizes: ModelSizes = ModelSizes(), k: int = 5) -> DataFrame:
    """M4: stratified k-fold CV; per class precision / recall / F1 (prediction = p >= 0.5), mean and std."""
    from faultcast.operators.metrics import binary_metrics
    return binary_metrics(text_out_of_fold(tickets, classes, sizes, k).drop("ticket_id"), keys=["class"])
