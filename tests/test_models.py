"""Model checks: fixed seed twice gives the same output; save/load gives equal predictions; out-of-fold folds partition
the training rows; ensembles are what their parts say; the two applications hand over through their root folder."""

import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from faultcast.plans import jobs
from faultcast.plans import models as M
from faultcast.plans.queries_models import RULES, TRAINED_AT, relabelled_training
from faultcast.session import scratch_path
from faultcast.sources import fixtures as fx

SIZES = M.ModelSizes(rf_trees=5, rf_depth=4, gbt_iter=4, gbt_depth=3, gbt_step=0.3, enet_iter=50, ada_rounds=2, stack_folds=2,
                     search_trials=2, search_depth=(2, 3), search_rounds=(2, 4))


@pytest.fixture(scope="module")
def cooling(spark, small_dir):
    setup = jobs.SETUPS[0]
    return setup, jobs.prepared_all(jobs.with_signal(relabelled_training(spark, small_dir)), [setup])[0][1]


@pytest.fixture(scope="module")
def trained(cooling):
    _, p = cooling
    models, preds = M.compare_models(p, SIZES, ["RandomForest", "GradientBoosting", "ElasticNet"])
    return models, preds.collect(), M.leaderboard(preds).collect()


def test_seed_determinism_and_roundtrip(spark, cooling, trained):
    _, p = cooling
    models, preds, _ = trained
    _, again = M.compare_models(p, SIZES, ["GradientBoosting"])
    a = sorted((r["date"], r["y_hat"]) for r in preds if r["model"] == "GradientBoosting")
    assert a == sorted((r["date"], r["y_hat"]) for r in again.collect()) and len(a) > 0
    path = scratch_path(spark, "model-test")
    M.save_model(PipelineModel(stages=[M.assembler(p.features), models["GradientBoosting"]]), path)
    loaded = M.load_model(spark, path)
    assert a == sorted((r["date"], r["y_hat"]) for r in M.scored({"x": loaded}, p.test).collect())
    assert M.load_model(spark, path + "-absent") is None
    with pytest.raises(Exception):
        M.load_model(spark, os.path.join(path, "metadata"))


def test_scaler_is_fitted_on_training_rows(cooling):
    _, p = cooling
    from pyspark.ml.functions import vector_to_array
    r = p.train.select(vector_to_array("features").alias("x")).agg(*[F.avg(F.col("x")[i]) for i in range(len(p.features))]).first()
    assert max(abs(v) for v in r) < 1e-9


def test_oof_folds_partition_training_rows(cooling):
    _, p = cooling
    for contiguous in (False, True):
        f = M.fold_column(p.train, 3, contiguous)
        assert f.count() == p.train.count()
        assert f.filter(F.col("fold").isNull()).count() == 0


def test_models_learn_a_signal(trained):
    _, _, board = trained
    assert all(r["r2"] > 0.2 for r in board), board


def test_vote_is_the_weighted_mean(spark, cooling, trained):
    _, p = cooling
    models, preds, board = trained
    table = spark.createDataFrame(board)
    pm = PipelineModel(stages=[M.assembler(p.features), *M.vote_model(models, table)])
    raw = {r["model"]: max(r["r2"], 0.01) for r in board}
    want = {}
    for r in preds:
        want[r["date"]] = want.get(r["date"], 0.0) + r["y_hat"] * raw[r["model"]] / sum(raw.values())
    got = {r["date"]: r["y_hat"] for r in M.scored({"VotingEnsemble": pm}, p.test).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)


def test_stack_takes_the_bases_above_the_threshold(spark, cooling, trained):
    _, p = cooling
    models, _, board = trained
    table = spark.createDataFrame(board)
    best = max(r["r2"] for r in board)
    assert M.stack_model(p, models, table, SIZES, best + 1.0) is None
    one = M.stack_model(p, models, table, SIZES, best - 1e-9, contiguous=True)
    assert len(one) == 3
    pm = PipelineModel(stages=[M.assembler(p.features), *M.stack_model(p, models, table, SIZES, -float("inf"))])
    assert M.scored({"s": pm}, p.test).filter("y_hat is not null").count() == p.test.count()


def test_search_feeds_the_boosted_trees(cooling):
    _, p = cooling
    for mode, folds in (("holdout", 1), ("time", 5)):
        found = M.search_params(p, SIZES, mode)
        assert found.count() == folds * SIZES.search_trials
        best = M.best_settings(found)
        trees = M.estimators(M.ModelSizes(tuned=best))["GradientBoosting"]
        assert trees.getMaxIter() == best["maxIter"] and trees.getStepSize() == best["stepSize"]


def test_two_applications_hand_over(spark, small_dir, tmp_path):
    setups = jobs.SETUPS[:1]
    root = str(tmp_path / "models")
    hist, fc = fx.overlap(spark, small_dir)
    with pytest.raises(FileNotFoundError):
        jobs.forecast_job(spark, root, hist, fc, "2024-01-20", setups=setups)
    tickets = fx.dated(fx.ticket_probs(spark, small_dir), spark, small_dir)
    known, fetched = fx.line_weather_update(spark, small_dir)
    board = jobs.retrain_job(spark, root, tickets, known, fetched, "reading_id", RULES, TRAINED_AT, SIZES, probabilities=tickets,
                             setups=setups, tune=False, stack_all=True)
    assert board.count() == 8 and {r["trained_at"] for r in board.collect()} == {TRAINED_AT}
    a = jobs.forecast_job(spark, root, hist, fc, "2024-01-20", setups=setups).collect()
    other = spark.newSession()
    h2, f2 = fx.overlap(other, small_dir)
    b = jobs.forecast_job(other, root, h2, f2, "2024-01-20", setups=setups).collect()
    assert sorted(a) == sorted(b) and len(a) == 7
    assert {r["cooling_model"] for r in a} == {spark.read.parquet(os.path.join(root, "cooling/deployed")).first()["model_name"]}
    # refitting the scaler on the scored rows is another result, and an option
    c = jobs.forecast_job(spark, root, hist, fc, "2024-01-20", parity=True, setups=setups).collect()
    assert [r["date"] for r in sorted(c)] == [r["date"] for r in sorted(a)]


def test_text_classifier_probabilities(spark, small_dir):
    t = fx.ticket_text(spark, small_dir)
    model = M.fit_text_classifier(t, list(fx.SPECIFIC), M.ModelSizes(text_trees=5))
    pr = M.class_probabilities(model, M.text_frame(t, list(fx.SPECIFIC)), list(fx.SPECIFIC))
    r = pr.agg(*[F.min(f"p_{c}").alias(f"lo_{c}") for c in fx.SPECIFIC],
               *[F.max(f"p_{c}").alias(f"hi_{c}") for c in fx.SPECIFIC]).first()
    for c in fx.SPECIFIC:
        assert 0.0 <= r[f"lo_{c}"] <= r[f"hi_{c}"] <= 1.0
    assert pr.count() == t.count()


def test_adaboost_r2_weights_median_and_roundtrip(spark, cooling):
    import math

    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from faultcast.plans.adaboost import AdaBoostR2, AdaBoostR2Model

    _, p = cooling
    est = AdaBoostR2(numRounds=4, learningRate=0.5, maxDepth=2, seed=7)
    model = est.fit(p.train)
    assert 1 <= len(model.trees) <= 4 and len(model.alphas) == len(model.trees)
    # the weight recursion, recomputed on the driver from each tree's errors (brute force)
    rows = p.train.select("features", "label").collect()
    y = np.array([r["label"] for r in rows])
    w = np.ones(len(y))
    for tree, alpha in zip(model.trees, model.alphas):
        pred = np.array([tree.predict(r["features"]) for r in rows])
        e = np.abs(pred - y)
        loss = float((w * e).sum() / (e.max() * w.sum()))
        beta = loss / (1 - loss)
        assert math.isclose(alpha, 0.5 * math.log(1 / beta), rel_tol=1e-9)
        w = w * beta ** (0.5 * (1 - e / e.max())) / w.sum()
    # weighted median of the tree predictions
    test = p.test.collect()
    got = {r["date"]: r["prediction"] for r in model.transform(p.test).collect()}
    a = np.array(model.alphas)
    for r in test:
        preds = np.array([t.predict(r["features"]) for t in model.trees])
        order = np.argsort(preds, kind="stable")
        cdf = np.cumsum(a[order])
        want = preds[order][int(np.argmax(cdf >= 0.5 * cdf[-1]))]
        assert math.isclose(got[r["date"]], want, rel_tol=1e-12)
    # persistence inside a pipeline (the way the retrain job saves models)
    raw = p.train.select("system", "date", "label", F.col("label").alias("x1"), (F.col("label") * 0 + 1).alias("x2"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x1", "x2"], outputCol="features"),
                            AdaBoostR2(numRounds=3, learningRate=0.1)]).fit(raw)
    path = scratch_path(spark, "ada-test")
    pipe.write().overwrite().save(path)
    back = PipelineModel.load(path)
    assert isinstance(back.stages[-1], AdaBoostR2Model)
    k = lambda m: sorted((r["date"], r["prediction"]) for r in m.transform(raw).collect())
    assert k(pipe) == k(back)
    # a label the first tree fits exactly stops after one round with weight 1
    const = p.train.select("features", (F.col("label") * 0 + 3.0).alias("label"))
    one = AdaBoostR2(numRounds=5).fit(const)
    assert one.alphas == [1.0] and {r["prediction"] for r in one.transform(const).collect()} == {3.0}


def test_sizes_of_the_registered_queries():
    from faultcast.plans import queries_models
    w = queries_models.WHOLE
    assert (w.rf_trees, w.rf_depth, w.gbt_iter, w.gbt_depth, w.gbt_step, w.enet_iter) == (500, 10, 500, 6, 0.05, 10000)
    assert (w.text_trees, w.text_depth, w.ada_rounds, w.stack_folds, w.cv_folds) == (100, 30, 100, 5, 5)
    assert (w.search_trials, w.search_depth, w.search_rounds, w.tuned) == (5, (3, 12), (100, 1000), {})
    for s in (M.CHECK, M.BOOST, M.SEARCH):
        assert s.rf_trees >= 20 and s.gbt_iter >= 20 and s.ada_rounds >= 5 and s.stack_folds >= 3 and s.cv_folds >= 3
        assert s.search_trials >= 3 and s.search_rounds[0] >= 20 and s.gbt_depth == 6


def test_the_search_query_runs_the_whole_search():
    import __spark_entry__ as e
    whole = M.ModelSizes()
    for name in ("search_trials", "search_per_fit", "search_depth", "search_rounds", "seed", "stop_share"):
        assert getattr(M.SEARCH, name) == getattr(whole, name), name
    assert M.draw_trials(M.SEARCH) == M.draw_trials(whole)
    assert f"{whole.search_trials}::BIGINT AS n_trials" in e.oracle_sql()["search_params"]


def test_pooled_fits_equal_serial_ones(spark, cooling, monkeypatch):
    _, p = cooling
    names = ["GradientBoosting", "AdaBoost", "ElasticNet"]
    pooled = sorted(tuple(r) for r in M.out_of_fold(p, SIZES, names, k=2).collect())
    monkeypatch.setattr(M, "run_all", lambda calls: [c() for c in calls])
    assert sorted(tuple(r) for r in M.out_of_fold(p, SIZES, names, k=2).collect()) == pooled


def test_pool_keeps_order_properties_and_failures(spark):
    import threading

    from faultcast.plans.pool import run_all
    spark.sparkContext.setLocalProperty("faultcast.test", "here")
    try:
        gate = threading.Barrier(3, timeout=30)   # passes only if three calls run at a time
        assert run_all([lambda k=k: (gate.wait() >= 0, k, spark.sparkContext.getLocalProperty("faultcast.test")) for k in range(3)],
                       width=3) == [(True, k, "here") for k in range(3)]
    finally:
        spark.sparkContext.setLocalProperty("faultcast.test", None)
    with pytest.raises(ZeroDivisionError):
        run_all([lambda: 1, lambda: 1 // 0, lambda: 2])


def test_staged_errors_equal_separate_fits(cooling):
    _, p = cooling
    apart = M.ModelSizes(search_trials=4, search_per_fit=1, search_depth=(2, 3), search_rounds=(2, 6))
    trials = M.draw_trials(M.ModelSizes(search_trials=4, search_per_fit=2, search_depth=(2, 3), search_rounds=(2, 6)))
    assert [{**t, "maxIter": 0} for t in trials[::2]] == [{**t, "maxIter": 0} for t in trials[1::2]]
    found = {}
    for key, groups in (("staged", trials), ("apart", [{**t, "stepSize": t["stepSize"] + k * 1e-12} for k, t in enumerate(trials)])):
        # settings that differ by nothing that counts are fits of their own
        real, M.draw_trials = M.draw_trials, lambda sizes, seed=42, groups=groups: groups
        try:
            found[key] = sorted((r["trial"], r["n"], round(r["r2"], 9), round(r["rmse"], 9)) for r in M.search_params(p, apart).collect())
        finally:
            M.draw_trials = real
    assert found["staged"] == found["apart"] and len(found["staged"]) == 4


def test_draws_follow_the_ranges():
    draws = M.draw_trials(M.ModelSizes(search_trials=400))
    steps = sorted(d["stepSize"] for d in draws)
    assert 0.001 <= steps[0] and steps[-1] <= 0.1 and 0.007 < steps[200] < 0.014   # the middle of a logarithmic draw
    assert {d["minInstancesPerNode"] for d in draws} == set(range(1, 21)) and {d["maxDepth"] for d in draws} == set(range(3, 13))
    assert all(0.1 <= float(d["featureSubsetStrategy"]) <= 1 and 0.5 <= d["subsamplingRate"] <= 1 and 100 <= d["maxIter"] <= 1000
               for d in draws)


def test_boosting_stops_on_held_out_rows(spark, small_dir, cooling):
    setup, p = cooling
    sizes = M.ModelSizes(gbt_iter=30, gbt_depth=3, gbt_step=0.9, stop_share=25)
    held = M.with_held_out(p.train, 25)
    assert 0 < held.filter("held_out").count() < held.count() // 2
    model = M.estimators(sizes)["GradientBoosting"].fit(held)
    assert model.getNumTrees < 30
    assert "held_out" not in M.with_held_out(p.train, 0).columns


def test_choice_by_rmse(spark):
    cols = "trial int, step_size double, max_depth int, rounds int, subsampling double, min_instances int, columns string, r2 double, rmse double"
    rows = [(0, 0.1, 3, 5, 1.0, 1, "0.5", 0.9, 3.0), (1, 0.2, 3, 5, 1.0, 1, "0.5", 0.8, 2.0)]
    found = spark.createDataFrame(rows, cols)
    assert M.best_settings(found)["stepSize"] == 0.1 and M.best_settings(found, "rmse")["stepSize"] == 0.2


def test_fold_rows_take_as_many_tasks_as_they_need(cooling, trained, monkeypatch):
    _, p = cooling
    models, _, board = trained
    seen = []
    real = M.fold_fits
    monkeypatch.setattr(M, "fold_fits", lambda folded, *a: seen.append(folded.rdd.getNumPartitions()) or real(folded, *a))
    for contiguous in (False, True):
        M.stack_model(p, {"ElasticNet": models["ElasticNet"]}, p.train.sparkSession.createDataFrame(board), SIZES, -1e9, contiguous)
    assert seen == [1, 1]   # a fit is thousands of jobs: a task of a few rows more costs in each of them


def test_text_forests_use_the_cores(spark, monkeypatch):
    rows = spark.range(4000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert M.spread(rows, 4000, 1).rdd.getNumPartitions() == min(8, -(-3 * cores // 2))
    assert M.spread(rows, 4000, 1000).rdd.getNumPartitions() == 1
    assert M.spread(rows, 20_000 * 100, 1).rdd.getNumPartitions() >= 100
    assert M.spread(rows, 0, 3).rdd.getNumPartitions() == 1
    assert M.text_pipeline().getStages()[-1].getClassifier().getCacheNodeIds()


def test_folds_of_the_text_classifier_are_fitted_side_by_side(spark, monkeypatch):
    import threading
    texts = spark.createDataFrame([(i, "C1" if i % 2 else "C2", f"word{i % 2} other{i % 5}", "x") for i in range(40)],
                                  "ticket_id long, unit string, text string, text2 string")
    gate, real = threading.Barrier(2, timeout=60), M.fit_text_classifier
    monkeypatch.setattr(M, "fit_text_classifier", lambda *a: gate.wait() >= 0 and real(*a))
    o = M.text_out_of_fold(texts, ["C1", "C2"], M.ModelSizes(text_trees=2, text_depth=3), 2).collect()
    assert len(o) == 80 and len({(r["ticket_id"], r["class"]) for r in o}) == 80 and {r["fold"] for r in o} == {0, 1}


def test_base_features_are_built_once_for_all_variants(spark, monkeypatch):
    built = []
    monkeypatch.setattr(jobs, "base_features", lambda t, keys: built.append(keys) or t)
    monkeypatch.setattr(jobs, "rich_temporal", lambda base, keys: base.withColumn("variant", F.lit("rich")))
    monkeypatch.setattr(jobs, "lean_temporal", lambda base, keys: base.withColumn("variant", F.lit("lean")))
    monkeypatch.setattr(jobs.M, "prepare", lambda feats, system, *a, **k: [tuple(r) for r in feats.filter(F.col("system") == system).collect()])
    rows = spark.createDataFrame([("C1", 1), ("C2", 2), ("C3", 3), ("C9", 4)], "system string, x int")
    got = {s.name: p for s, p in jobs.prepared_all(rows)}
    assert built == [["system"]]
    assert got == {"cooling": [("C1", 1, "rich")], "heating": [("C2", 2, "lean")], "other": [("C3", 3, "lean")]}


def test_folds_fitted_along_give_the_same_stack(cooling, monkeypatch):
    _, p = cooling
    every = M.estimators(SIZES)
    monkeypatch.setattr(M, "estimators", lambda sizes: {n: every[n] for n in ("RandomForest", "GradientBoosting")})
    one = lambda stages, name: sorted((r["date"], r["y_hat"]) for r in M.scored(
        {name: PipelineModel(stages=[M.assembler(p.features), *stages])}, p.test).collect())
    models, preds = M.compare_models(p, SIZES)
    board = M.leaderboard(preds)
    along, preds2, folded = M.fit_with_folds(p, SIZES)
    assert list(along) == list(models) and set(folded.fits) == {(n, f) for n in models for f in range(SIZES.stack_folds)}
    rows = lambda x: sorted((r["model"], r["date"], r["y_hat"]) for r in x.collect())
    assert rows(preds2) == rows(preds)
    # every fold model is there, none is fitted again
    want = one(M.stack_model(p, models, board, SIZES, -float("inf")), "x")
    monkeypatch.setattr(M, "fold_fits", None)
    assert one(M.stack_model(p, along, board, SIZES, -float("inf"), folded=folded), "x") == want


def test_stages_of_a_pipeline_are_saved_and_loaded_side_by_side(spark, cooling, monkeypatch):
    _, p = cooling
    e = M.estimators(SIZES)
    pm = PipelineModel(stages=[M.assembler(p.features), *[M._named(e[n].fit(p.train), n) for n in ("AdaBoost", "RandomForest")]])
    calls, run_all = [], M.run_all
    monkeypatch.setattr(M, "run_all", lambda c, *a: calls.append(len(c)) or run_all(c, *a))
    path = scratch_path(spark, "model-test")
    M.save_model(pm, path)
    M.save_model(pm, path)   # overwrites
    loaded = M.load_model(spark, path)
    assert calls == [3, 3, 3]
    seen = lambda m: sorted(tuple(r) for r in PipelineModel(stages=m.stages[1:]).transform(p.test).select(
        "date", "b_AdaBoost", "b_RandomForest").collect())
    # MLlib's own reader knows the layout, and the loader reads what MLlib's own writer wrote
    pm.write().overwrite().save(path + "-mllib")
    assert seen(pm) == seen(loaded) == seen(PipelineModel.load(path)) == seen(M.load_model(spark, path + "-mllib"))
    assert loaded.uid == pm.uid and [type(s) for s in loaded.stages] == [type(s) for s in pm.stages]
