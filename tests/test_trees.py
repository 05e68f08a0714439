"""Ensembles that one task grows: equal to MLlib's where nothing is drawn, MLlib's own models, few jobs, bounded."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from faultcast.plans import grow, trees
from faultcast.plans import models as M
from faultcast.plans.trees import BoostedTrees


def _rows(spark, n=240, parts=1):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4))
    y = 3 * x[:, 0] + np.sin(2 * x[:, 1]) + rng.normal(size=n) * 0.1 + 20
    return spark.createDataFrame([("S", f"2024-{1 + i % 12:02d}-{1 + i // 12:02d}", float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))],
                                 ["system", "date", "label", "features"]).withColumn(
        "date", F.to_date("date")).repartition(parts).cache()


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_boosted_fit_is_a_few_jobs_and_mllibs_model(spark):
    df = _rows(spark)
    rounds, common = 25, {"maxDepth": 3, "seed": 1, "stepSize": 0.1}
    ours, n_jobs = _jobs(spark, "boosted", lambda: BoostedTrees(maxIter=rounds, **common).fit(df))
    assert n_jobs < rounds
    theirs = GBTRegressor(maxIter=rounds, **common).fit(df)
    assert type(ours) is type(theirs) and ours.getNumTrees == rounds and ours.treeWeights == theirs.treeWeights
    one = lambda m: m.transform(df).select(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]
    assert math.isclose(one(ours), one(theirs), rel_tol=0.05)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.02)
    # the first tree has no ties: the same splits
    splits = lambda m: [r for r in m.trees[0].toDebugString.split("\n") if "(feature" in r]
    assert splits(ours) == splits(theirs) and splits(ours)


def test_staged_errors_are_those_of_mllib_and_need_no_partitioning(spark):
    df, test = _rows(spark), _rows(spark, 60)
    est = BoostedTrees(maxIter=6, maxDepth=2, seed=1)
    n, v, mse = est.staged_errors(df, test, [1, 3, 6])
    want = GBTRegressor(maxIter=6, maxDepth=2, seed=1).fit(df).evaluateEachIteration(test, "squared")
    assert n == 60 and np.allclose(mse, [want[0], want[2], want[5]], rtol=1e-9)
    assert math.isclose(v, test.select(F.var_pop("label")).first()[0], rel_tol=1e-12)
    drawn = BoostedTrees(maxIter=6, maxDepth=4, seed=1, subsamplingRate=0.6, featureSubsetStrategy="0.5")
    assert drawn.staged_errors(df, test, [6]) == drawn.staged_errors(df.repartition(5), test.repartition(3), [6])
    assert est.staged_errors(df, test.limit(0), [6]) is None


def test_larger_fits_and_other_settings_are_mllibs(spark, monkeypatch):
    df = _rows(spark, 60)
    ours = BoostedTrees(maxIter=3, maxDepth=2, seed=1)
    small = ours.staged_errors(df, df, [1, 3])
    monkeypatch.setattr(trees, "FIT_CELLS", 60)
    monkeypatch.setattr(trees, "grown", None)   # not called
    monkeypatch.setattr(grow, "boost", None)
    assert ours.fit(df).getNumTrees == 3
    assert np.allclose(ours.staged_errors(df, df, [1, 3])[2], small[2])
    monkeypatch.setattr(trees, "FIT_CELLS", 10**6)
    held = df.withColumn("held_out", F.col("label") > 20)
    assert BoostedTrees(maxIter=3, validationIndicatorCol="held_out").fit(held).getNumTrees <= 3


def test_the_search_is_a_few_jobs_a_fit(spark):
    df = _rows(spark)
    p = M.Prepared("S", ["a", "b", "c", "d"], {}, df, df)
    sizes = M.ModelSizes(search_trials=2, search_rounds=(40, 60), search_depth=(3, 4))
    found, n_jobs = _jobs(spark, "search", lambda: M.search_params(p, sizes, "time").collect())
    assert len(found) == 10 and all(r["r2"] is not None and r["n"] == 40 for r in found)
    assert n_jobs < 40 * 10   # a job or more a round before


@pytest.mark.parametrize("cells", [1 << 21, 1])
def test_trees_hold_their_limits(cells, monkeypatch):
    monkeypatch.setattr(grow, "CELLS", cells)   # nodes in pieces give the same tree
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 9, size=(300, 5)).astype(float), rng.normal(size=300)
    cuts = grow.cuts_of(x, 32)
    bins, one = grow.binned(x, cuts), np.ones(300)
    t = grow.grow(bins, cuts, y, one, one, 7, 6, 5, None)
    inner = t["feature"] >= 0
    assert inner.any() and t["n"][~inner].min() >= 6 and t["n"][~inner].sum() == 300
    kids = t["left"][inner]
    assert np.allclose(t["s"][kids] + t["s"][kids + 1], t["s"][inner]) and (kids > np.flatnonzero(inner)).all()
    assert np.isclose(grow.apply(t, bins).sum(), y.sum())
    # brute force for the root: the largest variance reduction
    best = max((((y[x[:, f] <= c].sum() ** 2) / (x[:, f] <= c).sum() + (y[x[:, f] > c].sum() ** 2) / (x[:, f] > c).sum(), f, c)
                for f in range(5) for c in cuts[f] if 6 <= (x[:, f] <= c).sum() <= 294))
    assert (t["feature"][0], cuts[t["feature"][0]][t["bin"][0]]) == best[1:]


def test_searches_have_the_trials_of_the_reference():
    import __spark_entry__ as e
    from faultcast.plans import jobs

    n = {(s.name, mode): len(M.draw_trials(jobs.search_sizes(s, M.SEARCH, mode))) for s in jobs.SETUPS for mode in ("holdout", "time")}
    assert n == {("cooling", "holdout"): 20, ("heating", "holdout"): 20, ("other", "holdout"): 20,
                 ("cooling", "time"): 5, ("heating", "time"): 20, ("other", "time"): 5}
    assert M.draw_trials(M.SEARCH) == M.draw_trials(jobs.search_sizes(jobs.SETUPS[1], M.SEARCH, "time"))[:5]
    assert "'holdout' AS mode, 0::BIGINT AS fold, 20::BIGINT AS n_trials" in e.oracle_sql()["search_params"]


def test_the_deployed_models_are_trained_at_the_reference_s_sizes(spark, monkeypatch):
    from faultcast.plans import queries_models as Q

    seen = []
    empty = lambda *a: None
    for name, given in (("ticket_probs", empty), ("dated", empty), ("line_weather_update", lambda *a: (None, None))):
        monkeypatch.setattr(Q.fx, name, given)
    monkeypatch.setattr(Q.jobs, "retrain_job", lambda *a, **k: seen.append((a, k)))
    monkeypatch.setattr(Q, "_ROOTS", {})
    assert Q.retrained(spark, "nowhere") == Q.retrained(spark, "nowhere") and len(seen) == 1
    (*_, sizes), given = seen[0]
    assert sizes == M.ModelSizes() and (sizes.rf_trees, sizes.gbt_iter, sizes.ada_rounds, sizes.stack_folds, sizes.search_trials) == (500, 500, 100, 5, 5)
    assert given.keys() == {"probabilities"}


def test_adaboost_is_a_few_jobs_and_one_ensemble(spark, tmp_path, monkeypatch):
    from faultcast.plans import adaboost

    df = _rows(spark)
    est = adaboost.AdaBoostR2(numRounds=30, learningRate=0.5, maxDepth=2, seed=3)
    model, n_jobs = _jobs(spark, "ada", lambda: est.fit(df))
    assert n_jobs < 30 and 1 < len(model.trees) == len(model.alphas) <= 30
    key = lambda m: sorted((r["date"], r["prediction"]) for r in m.transform(df).collect())
    apart = adaboost.AdaBoostR2Model(model.trees, model.alphas)   # the trees one by one
    assert key(model) == key(apart)
    for name, m in (("together", model), ("apart", adaboost.AdaBoostR2Model(model.trees[:3], model.alphas[:3]))):
        m.write().overwrite().save(str(tmp_path / name))
        assert key(adaboost.AdaBoostR2Model.load(str(tmp_path / name))) == key(m)
    # larger tables: MLlib's tree every round
    monkeypatch.setattr(trees, "FIT_CELLS", 1)
    monkeypatch.setattr(adaboost, "grown", None)
    assert len(adaboost.AdaBoostR2(numRounds=2, maxDepth=2).fit(df).trees) == 2


def test_a_forest_is_mllibs_model(spark):
    from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor

    df, common = _rows(spark), {"numTrees": 40, "maxDepth": 6, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "seed": 4}
    ours, theirs = trees.ForestOfTrees(**common).fit(df), RandomForestRegressor(**common).fit(df)
    assert type(ours) is RandomForestRegressionModel and ours.getNumTrees == 40
    one = lambda m: m.transform(df).select(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]
    assert 0.5 < one(ours) / one(theirs) < 2.0
    assert [trees.subset_size(s, 10) for s in ("all", "sqrt", "log2", "onethird", "auto", "0.25", "1.0", "7", "30")] == [10, 4, 4, 4, 4, 3, 10, 7, 10]


def _texts(spark, n=400):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(8)
    out = []
    for i in range(n):
        c = i % 3
        cols = sorted({int(j) for j in rng.integers(0, 60, 8)} | ({c} if rng.random() < 0.8 else set()))
        out.append((i, float(c), Vectors.sparse(60, cols, [0.1 + float(rng.random()) for _ in cols])))
    return spark.createDataFrame(out, ["id", "label", "tfidf"]).repartition(3).cache()


def test_text_forests_are_mllibs_models_in_a_few_jobs(spark, monkeypatch):
    from pyspark.ml.classification import OneVsRest, RandomForestClassificationModel, RandomForestClassifier

    df = _texts(spark)
    rf = RandomForestClassifier(numTrees=30, maxDepth=30, seed=2, featuresCol="tfidf", labelCol="label", cacheNodeIds=True)
    common = {"classifier": rf, "featuresCol": "tfidf", "labelCol": "label"}
    ours, n_jobs = _jobs(spark, "texts", lambda: trees.TextForests(**common).fit(df))
    theirs = OneVsRest(**common).fit(df)
    assert n_jobs < 60   # MLlib's: two or more a level of each forest
    assert [type(m) for m in ours.models] == [RandomForestClassificationModel] * 3 and [m.getNumTrees for m in ours.models] == [30] * 3
    for a, b in zip(ours.models, theirs.models):
        assert 0.8 < a.totalNumNodes / b.totalNumNodes < 1.25
        assert abs(a.featureImportances.toArray() - b.featureImportances.toArray()).max() < 0.1
    right = lambda m: m.transform(df).filter(F.col("prediction") == F.col("label")).count()
    assert abs(right(ours) - right(theirs)) <= 12 and right(ours) > 300
    # more texts than a task may hold, and vectors that are not sparse: MLlib's
    monkeypatch.setattr(grow, "grow_texts", None)
    monkeypatch.setattr(trees, "TEXT_CELLS", 10)
    few = {**common, "classifier": rf.copy({rf.numTrees: 2, rf.maxDepth: 3})}
    assert len(trees.TextForests(**few).fit(df).models) == 3
    monkeypatch.setattr(trees, "TEXT_CELLS", 10**6)
    dense = df.select("label", F.udf(lambda v: Vectors.dense(v.toArray()), df.schema["tfidf"].dataType)("tfidf").alias("tfidf"))
    assert len(trees.TextForests(**few).fit(dense).models) == 3


@pytest.mark.parametrize("cells", [1 << 21, 200])
def test_a_text_tree_is_the_dense_one(cells, monkeypatch):
    monkeypatch.setattr(grow, "CELLS", cells)
    rng = np.random.default_rng(4)
    x = np.where(rng.random((200, 12)) < 0.3, rng.integers(1, 5, (200, 12)), 0).astype(float)
    y = ((x[:, 0] > 1) ^ (rng.random(200) < 0.2)).astype(float)
    cuts = grow.cuts_of(x, 32)
    bins, count = grow.binned(x, cuts), rng.poisson(1.0, 200).astype(float)
    at = x > 0
    texts = grow.Texts(np.concatenate([[0], np.cumsum(at.sum(1))]), np.nonzero(at)[1].astype(np.uint16), bins[at].astype(np.uint8), 12)
    width = max(map(len, cuts)) + 1
    # all columns for every node: nothing is drawn
    monkeypatch.setattr(grow, "pruned", lambda t: t)
    sparse = grow.grow_texts(texts, width, y, count, 6, 12, rng)
    dense = grow.grow(bins, cuts, y, count, np.ones(200), 6, 1, 12, None)
    assert all((sparse[k] == dense[k]).all() for k in ("feature", "bin", "left", "w", "s"))


def test_leaves_of_one_prediction_are_one():
    arr = lambda *v: np.array(v)
    t = {"feature": arr(0, 1, 2, -1, -1, -1, -1), "bin": arr(0, 0, 0, 0, 0, 0, 0), "left": arr(1, 3, 5, -1, -1, -1, -1),
         "gain": arr(1.0, .5, .5, -1, -1, -1, -1), "w": arr(10., 5, 5, 2, 3, 4, 1), "s": arr(5., 1, 4, 0, 1, 4, 0)}
    p = grow.pruned(t)
    assert p["feature"].tolist() == [0, -1, 2, -1, -1] and p["left"].tolist() == [1, -1, 3, -1, -1] and p["w"].tolist() == [10, 5, 5, 4, 1]
    assert all(len(set(map(int, grow.draws(np.random.default_rng(1), 50, n, k)[i]))) == k for n, k in ((100, 20), (30, 20), (5, 5)) for i in range(50))
