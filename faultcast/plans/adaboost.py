"""AdaBoost.R2 regression (Drucker, 1997) on MLlib decision trees.

Where the rows are few (``trees.FIT_CELLS``) all rounds are one task (:func:`faultcast.plans.grow.adaboost`) and its
trees one ensemble of MLlib. Else each boosting round is a distributed job: a weighted ``DecisionTreeRegressor``
fit (``weightCol``), one aggregate for the round's largest error and
weighted mean loss, and a column expression for the new sample weights.
The weighted table is persisted every round and checkpointed every ``CUT``
rounds, so the lineage stays that deep. Only three numbers per round reach the driver.

Prediction is the weighted median of the trees' predictions (weights
``learning_rate * ln(1/beta)``), computed per row with array expressions.

The reference's library draws a weighted bootstrap sample per round; here
the weights enter the tree fit directly, which is deterministic and does
not depend on partitioning.
"""

from __future__ import annotations

import math
import os
from functools import partial

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultcast.plans.pool import run_all
from faultcast.plans.trees import as_mllib, fits_one_task, grown

#: Rounds after which the lineage of the weights is cut.
CUT = 10


class _AdaParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    numRounds = Param(Params._dummy(), "numRounds", "number of boosting rounds", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of each tree's weight", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(numRounds=50, learningRate=1.0, maxDepth=3, seed=42)


class AdaBoostR2(Estimator, _AdaParams):
    """AdaBoost.R2 with the linear loss: ``fit`` returns an :class:`AdaBoostR2Model`."""

    def __init__(self, numRounds: int = 50, learningRate: float = 1.0, maxDepth: int = 3, seed: int = 42):
        super().__init__()
        self._set(numRounds=numRounds, learningRate=learningRate, maxDepth=maxDepth, seed=seed)

    def _fit(self, df: DataFrame) -> "AdaBoostR2Model":
        from faultcast.session import stage

        feats, label = self.getFeaturesCol(), self.getLabelCol()
        rounds, lr = self.getOrDefault(self.numRounds), self.getOrDefault(self.learningRate)
        depth, seed = self.getOrDefault(self.maxDepth), self.getOrDefault(self.seed)
        k = fits_one_task(df, feats)
        if k and rounds:
            nodes = grown(df, feats, label, "adaboost", {"rounds": rounds, "rate": lr, "depth": depth, "max_bins": 32})
            kind = GBTRegressor(featuresCol=feats, labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=1.0, seed=seed)
            return self._copyValues(AdaBoostR2Model(ensemble=as_mllib(kind, nodes, GBTRegressionModel, k, depth)))
        cur = stage(df.select(F.col(feats).alias("features"), F.col(label).cast("double").alias("label"),
                              F.lit(1.0).alias("_w")))
        trees, alphas, held = [], [], []
        for m in range(rounds):
            tree = DecisionTreeRegressor(maxDepth=depth, weightCol="_w", seed=seed + m,
                                         predictionCol="_p").fit(cur)
            scored = tree.transform(cur).select("features", "label", "_w", F.abs(F.col("_p") - F.col("label")).alias("_e"))
            s = scored.agg(F.max("_e").alias("d"), F.sum(F.col("_w") * F.col("_e")).alias("we"),
                           F.sum("_w").alias("w")).first()
            d, we, wsum = (s["d"] or 0.0), (s["we"] or 0.0), (s["w"] or 0.0)
            if d <= 0.0 or wsum <= 0.0:          # perfect fit: this tree decides alone
                trees.append(tree)
                alphas.append(1.0)
                break
            loss = we / (d * wsum)
            if loss >= 0.5:                       # no better than chance: stop (keep a lone first tree)
                if not trees:
                    trees.append(tree)
                    alphas.append(0.0)
                break
            beta = loss / (1.0 - loss)
            trees.append(tree)
            alphas.append(lr * math.log(1.0 / beta))
            if m + 1 < rounds:
                # w <- w * beta^(lr * (1 - e/d)), renormalised by the round's weight sum
                weighted = scored.select("features", "label", (
                    F.col("_w") * F.pow(F.lit(beta), F.lit(lr) * (F.lit(1.0) - F.col("_e") / F.lit(d)))
                    / F.lit(wsum)).alias("_w"))
                held.append(weighted.persist(StorageLevel.MEMORY_AND_DISK))
                cur = weighted
                if len(held) == CUT:
                    cur = stage(weighted)
                    while held:
                        held.pop().unpersist()
        while held:
            held.pop().unpersist()
        model = AdaBoostR2Model(trees, alphas)
        return self._copyValues(model)


class AdaBoostR2Model(Model, _AdaParams, MLReadable, MLWritable):
    """Weighted median of the trees' predictions."""

    def __init__(self, trees=None, alphas=None, ensemble: GBTRegressionModel | None = None):
        super().__init__()
        self.ensemble = ensemble   # all trees and their weights, where one task has grown them
        self._trees = None if ensemble else list(trees or [])
        self.alphas = [float(a) for a in (ensemble.treeWeights if ensemble else alphas or [])]

    @property
    def trees(self) -> list[DecisionTreeRegressionModel]:
        if self._trees is None:
            self._trees = self.ensemble.trees
        return self._trees

    def _transform(self, df: DataFrame) -> DataFrame:
        feats, out = self.getFeaturesCol(), self.getPredictionCol()
        if self.ensemble is not None:
            return self._transform_together(df, feats, out)
        x = df
        names = []
        for i, t in enumerate(self.trees):
            name = f"_ada_p{i}"
            x = t.copy().setFeaturesCol(feats).setPredictionCol(name).transform(x)
            names.append(name)
        pairs = F.arrays_zip(F.array(*[F.col(n) for n in names]).alias("p"),
                             F.array(*[F.lit(a) for a in self.alphas]).alias("a"))
        return x.withColumn("_ada_s", F.array_sort(pairs)).withColumn(out, self._median()).drop("_ada_s", *names)

    def _transform_together(self, df: DataFrame, feats: str, out: str) -> DataFrame:
        """One pass of all trees: the leaf each row falls into, and the leaves' predictions as a constant."""
        leaves: list[list[str]] = []
        for line in self.ensemble.toDebugString.split("\n"):   # leaves from left to right, as MLlib numbers them
            if line.lstrip().startswith("Tree "):
                leaves.append([])
            elif "Predict:" in line:
                leaves[-1].append(f"{float(line.split('Predict:')[1])!r}D")
        width = max(map(len, leaves))
        values = ", ".join(v for tree in leaves for v in tree + ["0D"] * (width - len(tree)))
        weights = ", ".join(f"{a!r}D" for a in self.alphas)
        trees = self.ensemble.copy({self.ensemble.featuresCol: feats, self.ensemble.predictionCol: "", self.ensemble.leafCol: "_ada_l"})
        pairs = (f"transform(sequence(0, {len(leaves) - 1}), i -> named_struct("
                 f"'p', array({values})[i * {width} + CAST(_ada_l[i] AS INT)], 'a', array({weights})[i]))")
        return (trees.transform(df).withColumn("_ada_l", vector_to_array("_ada_l")).withColumn("_ada_s", F.array_sort(F.expr(pairs)))
                .withColumn(out, self._median()).drop("_ada_l", "_ada_s"))

    def _median(self):
        """The weighted median of the pairs in ``_ada_s``, which are sorted."""
        total = sum(self.alphas)
        # sorted by prediction; the first prediction whose running weight reaches half the total
        half = f"{0.5 * total!r}D"
        pick = (f"aggregate(_ada_s, named_struct('sum', 0D, 'p', CAST(NULL AS DOUBLE)), (s, y) -> named_struct("
                f"'sum', s.sum + y.a, 'p', CASE WHEN s.p IS NULL AND s.sum + y.a >= {half} THEN y.p ELSE s.p END), s -> s.p)")
        return F.expr(pick)

    def write(self) -> MLWriter:
        return _AdaWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _AdaReader(cls)


class _AdaWriter(MLWriter):
    def __init__(self, instance: AdaBoostR2Model):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        ensemble = self.instance.ensemble
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc,
                                         extraMetadata={"alphas": self.instance.alphas, "n_trees": len(self.instance.alphas),
                                                        "together": ensemble is not None})
        if ensemble is not None:
            ensemble.write().overwrite().save(os.path.join(path, "trees"))
            return
        run_all([partial(t.write().overwrite().save, os.path.join(path, f"tree_{i}")) for i, t in enumerate(self.instance.trees)])


class _AdaReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> AdaBoostR2Model:
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        if meta.get("together"):
            model = self.cls(ensemble=GBTRegressionModel.load(os.path.join(path, "trees")))
        else:
            trees = run_all([partial(DecisionTreeRegressionModel.load, os.path.join(path, f"tree_{i}")) for i in range(meta["n_trees"])])
            model = self.cls(trees, meta["alphas"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
