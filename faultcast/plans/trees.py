"""MLlib's tree ensembles, grown by one task of Spark where the rows of a fit are few.

MLlib starts a job or two for every level of every tree, so that a fit of hundreds of rounds on a system's days is
thousands of jobs whose tasks have next to nothing to do. Up to :data:`FIT_CELLS` values a fit is one task
(:mod:`faultcast.plans.grow`): its rows reach it through the plan of the training frame, the nodes it gives are written in
MLlib's own layout and loaded as MLlib's own model. Larger fits, and settings that ``grow`` does not know, are MLlib's.
"""

from __future__ import annotations

import json
import math
import os
import time
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import OneVsRest, OneVsRestModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultcast.plans import grow
from faultcast.plans.pool import run_all
from faultcast.session import scratch_path

#: Values (rows times columns) up to which one task fits: 64 MB of doubles.
FIT_CELLS = 8_000_000
#: Values that are not zero up to which a tree of a text forest is one task's: 3 bytes each, held by every task.
TEXT_CELLS = 64_000_000
#: Rows that MLlib takes for the thresholds of a column.
CUT_ROWS = 10_000
NODES = ("tree int, weight double, id int, prediction double, impurity double, w double, s double, ss double, n long, gain double, "
         "left_child int, right_child int, feature int, threshold double")


def subset_size(strategy: str, n: int) -> int:
    """Columns drawn for a node, as MLlib reads its ``featureSubsetStrategy``."""
    named = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(max(n, 1)))), "onethird": math.ceil(n / 3.0),
             "auto": math.ceil(n / 3.0)}
    if strategy in named:
        return max(1, named[strategy])
    return min(int(strategy), n) if strategy.isdigit() else min(n, math.ceil(float(strategy) * n))


def fits_one_task(df: DataFrame, features: str = "features") -> int:
    """Columns of the features where one task may fit these rows, else 0."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array(features))).alias("k")).first()
    return r["k"] if r["n"] and r["k"] and r["n"] * r["k"] <= FIT_CELLS else 0


def _settings(est: GBTRegressor) -> dict:
    return {"rounds": est.getMaxIter(), "step": est.getStepSize(), "depth": est.getMaxDepth(), "least": est.getMinInstancesPerNode(),
            "share": est.getSubsamplingRate(), "max_bins": est.getMaxBins(), "seed": est.getSeed()}


def _is_plain(est) -> bool:
    """Settings that ``grow`` knows."""
    unset = [p for p in ("validationIndicatorCol", "weightCol", "thresholds") if est.hasParam(p) and est.isDefined(p) and est.getOrDefault(p)]
    loss = est.getLossType() if est.hasParam("lossType") else "squared"
    return not unset and loss == "squared" and est.getMinInfoGain() == 0.0 and est.getMinWeightFractionPerNode() == 0.0


def grown(df: DataFrame, features: str, label: str, method: str, settings: dict) -> DataFrame:
    """Nodes of an ensemble that one task grows on the rows of ``df``."""
    def fit(frames):
        import pandas as pd

        x = pd.concat(list(frames), ignore_index=True)
        if len(x):
            for i, (cuts, tree, weight, _) in enumerate(getattr(grow, method)(grow.matrix(x["x"]), x["y"].to_numpy(float), **settings)):
                yield pd.DataFrame(grow.table_of(i, cuts, tree, weight))

    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return rows.coalesce(1).mapInPandas(fit, NODES)


def as_mllib(est, nodes: DataFrame, kind, n_features: int, tree_depth: int):
    """The nodes as a fitted ensemble of MLlib with the uid and settings of ``est``."""
    spark = nodes.sparkSession
    path = scratch_path(spark, "trees")
    at = lambda name: os.path.join(path, name)
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(
        F.expr("CAST(array() AS ARRAY<DOUBLE>)")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    classes = kind is RandomForestClassificationModel
    stats = F.array(F.col("w") - F.col("s"), "s") if classes else F.array("w", "s", "ss")
    nodes.select(F.col("tree").alias("treeID"), F.struct("id", "prediction", "impurity", stats.alias("impurityStats"), F.col("n").alias(
        "rawCount"), "gain", F.col("left_child").alias("leftChild"), F.col("right_child").alias("rightChild"), split.alias("split")).alias(
        "nodeData"), "weight").write.parquet(at("data"))
    data = spark.read.parquet(at("data"))
    package = f"org.apache.spark.ml.{'classification' if classes else 'regression'}"
    tree = {"class": f"{package}.DecisionTree{'Classification' if classes else 'Regression'}Model", "timestamp": int(time.time() * 1000),
            "sparkVersion": spark.version, "uid": f"dtr_{est.uid}", "paramMap": {"maxDepth": tree_depth}, "defaultParamMap": {}}
    (data.filter(F.col("nodeData.id") == 0).select(F.col("treeID").alias("_1"), F.lit(json.dumps(tree)).alias("_2"), F.col("weight").alias("_3"))
     .coalesce(1).write.parquet(at("treesMetadata")))
    n_trees = spark.read.parquet(at("treesMetadata")).count()
    values = lambda params: {p.name: v for p, v in params.items()}
    meta = {**tree, "class": f"{package}.{kind.__name__}", "uid": est.uid, "paramMap": values(est._paramMap),
            "defaultParamMap": values(est._defaultParamMap), "numFeatures": n_features, "numTrees": n_trees,
            **({"numClasses": 2} if classes else {})}
    spark.range(1, numPartitions=1).select(F.lit(json.dumps(meta)).alias("value")).write.text(at("metadata"))
    return kind.load(path)


class BoostedTrees(GBTRegressor):
    """M8/M9: boosted trees; what ``fit`` returns is MLlib's ``GBTRegressionModel``."""

    def _fit(self, df: DataFrame) -> GBTRegressionModel:
        k = fits_one_task(df, self.getFeaturesCol()) if _is_plain(self) else 0
        if not k:
            return super()._fit(df)
        settings = {**_settings(self), "k": subset_size(self.getFeatureSubsetStrategy(), k)}
        nodes = grown(df, self.getFeaturesCol(), self.getLabelCol(), "boost", settings)
        return as_mllib(self, nodes, GBTRegressionModel, k, self.getMaxDepth())

    def staged_errors(self, train: DataFrame, test: DataFrame, rounds: list[int]):
        """(rows, variance of the label, mean squared errors of ``test`` after each of ``rounds``) or None without rows."""
        features, label = self.getFeaturesCol(), self.getLabelCol()
        k = fits_one_task(train.select(features).unionByName(test.select(features)), features) if _is_plain(self) else 0
        facts = None if k else test.agg(F.count(F.lit(1)).alias("n"), F.var_pop(label).alias("v")).first()
        if not k:
            if not facts["n"]:
                return None
            mse = self.fit(train).evaluateEachIteration(test, "squared")
            return facts["n"], facts["v"], [mse[r - 1] for r in rounds]
        settings = {**_settings(self), "k": subset_size(self.getFeatureSubsetStrategy(), k)}

        def score(frames):
            import pandas as pd

            x = pd.concat(list(frames), ignore_index=True)
            fit, held = x[~x["held"].astype(bool)], x[x["held"].astype(bool)]
            if len(fit) and len(held):
                x_held, y = grow.in_order(grow.matrix(held["x"]), held["y"].to_numpy(float))
                errors = [e for *_, e in grow.boost(grow.matrix(fit["x"]), fit["y"].to_numpy(float), test=(x_held, y), **settings)]
                yield pd.DataFrame({"n": [len(y)], "v": [float(y.var())], "mse": [[errors[r - 1] for r in rounds]]})

        rows = lambda df, held: df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.lit(held).alias("held"))
        r = rows(train, False).unionByName(rows(test, True)).coalesce(1).mapInPandas(score, "n long, v double, mse array<double>").first()
        return (r["n"], r["v"], list(r["mse"])) if r else None


class ForestOfTrees(RandomForestRegressor):
    """M7: random forest; what ``fit`` returns is MLlib's ``RandomForestRegressionModel``."""

    def _fit(self, df: DataFrame) -> RandomForestRegressionModel:
        k = fits_one_task(df, self.getFeaturesCol()) if _is_plain(self) and self.getBootstrap() and self.getSubsamplingRate() == 1.0 else 0
        if not k:
            return super()._fit(df)
        settings = {"trees": self.getNumTrees(), "depth": self.getMaxDepth(), "least": self.getMinInstancesPerNode(),
                    "k": subset_size(self.getFeatureSubsetStrategy(), k), "max_bins": self.getMaxBins(), "seed": self.getSeed()}
        nodes = grown(df, self.getFeaturesCol(), self.getLabelCol(), "forest", settings)
        return as_mllib(self, nodes, RandomForestRegressionModel, k, self.getMaxDepth())


class TextForests(OneVsRest):
    """M2: a binary forest per class over sparse texts, the trees of all classes dealt to the cores.

    MLlib sends the sums of every open node from every task, 32 bins of 71 columns for a node of two rows as well, so
    that deep forests send more the more texts and tasks there are. Here the binned texts go to the tasks once, as a
    broadcast, and a tree is grown where they are. Beyond :data:`TEXT_CELLS` values, and for settings or vectors that
    ``grow`` does not know, the forests are MLlib's.
    """

    def _fit(self, df: DataFrame) -> OneVsRestModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        vec = F.unwrap_udt(F.col(features))
        rows = df.select(vec["type"].alias("type"), vec["size"].alias("size"), vec["indices"].alias("i"), vec["values"].alias("v"),
                         F.col(label).cast("int").alias("y"))
        rows.persist(StorageLevel.MEMORY_AND_DISK)   # read three times
        try:
            return self._fit_texts(rows) or super()._fit(df)
        finally:
            rows.unpersist()

    def _fit_texts(self, rows: DataFrame) -> OneVsRestModel | None:
        """From rows of vectors' parts and class numbers; None where the forests are to be MLlib's."""
        rf, spark, features = self.getClassifier(), rows.sparkSession, self.getFeaturesCol()
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("k"), F.sum(F.size("i").cast("long")).alias("cells"),
                     F.min("type").alias("low"), F.max("type").alias("high"), F.min(F.array_min("v")).alias("least"),
                     F.max("y").alias("top"), F.count_if(F.col("type").isNull() | F.col("y").isNull()).alias("none")).first()
        plain = (_is_plain(rf) and rf.getMinInstancesPerNode() == 1 and rf.getBootstrap() and rf.getSubsamplingRate() == 1.0
                 and rf.getNumTrees() > 1 and rf.getImpurity() == "gini" and not (self.isDefined(self.weightCol) and self.getWeightCol()))
        if not (plain and r["n"] and not r["none"] and (r["low"], r["high"]) == (0, 0) and 0 < r["cells"] <= TEXT_CELLS and r["k"] < 1 << 16
                and (r["least"] or 0.0) >= 0.0):
            return None
        n_cols, n_classes = r["k"], r["top"] + 1
        rows = rows.select("i", "v", "y")
        cuts = _text_cuts(rows if r["n"] <= CUT_ROWS else rows.sample(False, CUT_ROWS / r["n"], rf.getSeed()), n_cols, rf.getMaxBins())
        sent = spark.sparkContext.broadcast(_binned_texts(rows, cuts, n_cols))
        trees, depth, seed = rf.getNumTrees(), rf.getMaxDepth(), rf.getSeed()
        strategy = rf.getFeatureSubsetStrategy()
        k, width = subset_size("sqrt" if strategy == "auto" else strategy, n_cols), max(2, max(map(len, cuts)) + 1)

        def fit(frames):
            import pandas as pd

            ends, cols, bins, y = sent.value
            texts = grow.Texts(ends, cols, bins, n_cols)
            for i in (int(i) for x in frames for i in x["id"]):
                c, number = i % n_classes, i // n_classes
                rng = np.random.default_rng([seed & 0xFFFFFFFF, c, number])
                tree = grow.grow_texts(texts, width, (y == c).astype(float), rng.poisson(1.0, len(y)).astype(float), depth, k, rng)
                yield pd.DataFrame({"class": np.full(len(tree["w"]), c, np.int32)} | grow.table_of(number, cuts, tree, 1.0))

        total = trees * n_classes
        tasks = min(total, 4 * spark.sparkContext.defaultParallelism)
        path = scratch_path(spark, "text-trees")
        spark.range(0, total, 1, total).coalesce(tasks).mapInPandas(fit, f"class int, {NODES}").write.parquet(path)
        sent.unpersist()
        nodes = spark.read.parquet(path)
        models = run_all([partial(as_mllib, rf.copy({rf.featuresCol: features}), nodes.filter(F.col("class") == c).drop("class"),
                                  RandomForestClassificationModel, n_cols, depth) for c in range(n_classes)])
        return self._copyValues(OneVsRestModel(models=models).setPredictionCol(self.getPredictionCol()))


def _text_cuts(rows: DataFrame, n_cols: int, max_bins: int) -> list:
    """Thresholds per column, as :func:`grow.cuts_of` on the columns with their zeros; the driver sees CUT_ROWS texts or so."""
    r = rows.select("i", "v").toArrow()
    n = r.num_rows
    i, v = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in r[x].chunks]) for x in ("i", "v"))
    order = np.argsort(i, kind="stable")
    starts = np.searchsorted(i[order], np.arange(n_cols + 1))
    out = []
    for j in range(n_cols):
        mine = v[order[starts[j]:starts[j + 1]]]
        column = np.concatenate([np.zeros(n - len(mine)), mine])
        out.append(grow.cuts_of(column[:, None], max_bins)[0])
    return out


def _binned_texts(rows: DataFrame, cuts: list, n_cols: int):
    """Row ends, columns, bins and labels of all texts, binned where the texts are."""
    def pack(frames):
        import pandas as pd

        for x in frames:
            size = x["i"].map(len).to_numpy(np.int64)
            i = np.concatenate([*x["i"], np.empty(0, np.int32)]).astype(np.int64)
            v = np.concatenate([*x["v"], np.empty(0)])
            bins, order = np.empty(len(i), np.uint8), np.argsort(i, kind="stable")
            starts = np.searchsorted(i[order], np.arange(n_cols + 1))
            for j in np.flatnonzero(starts[1:] > starts[:-1]):
                mine = order[starts[j]:starts[j + 1]]
                bins[mine] = np.searchsorted(cuts[j], v[mine], side="left")
            yield pd.DataFrame({"size": [size.tobytes()], "i": [i.astype(np.uint16).tobytes()], "b": [bins.tobytes()],
                                "y": [x["y"].to_numpy(np.int32).tobytes()]})

    parts = rows.mapInPandas(pack, "size binary, i binary, b binary, y binary").collect()   # 3 bytes a value, TEXT_CELLS at most
    joined = lambda name, kind: np.concatenate([np.frombuffer(p[name], kind) for p in parts])
    return np.concatenate([[0], np.cumsum(joined("size", np.int64))]), joined("i", np.uint16), joined("b", np.uint8), joined("y", np.int32)
