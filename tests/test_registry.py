"""Models kept by content: what was fitted on the same rows with the same settings is not fitted again."""

import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from faultcast.plans import jobs
from faultcast.plans import models as M
from faultcast.plans.queries_models import RULES
from faultcast.sources import fixtures as fx

SIZES = M.ModelSizes(enet_iter=5)


@pytest.fixture
def fits(monkeypatch):
    """One linear model stands for every model of a system, so that the test counts fits and not their seconds."""
    seen = []

    def train_system(p, setup, sizes, tune=False, stack_all=False):
        seen.append(setup.name)
        model = LinearRegression(maxIter=sizes.enet_iter, regParam=1.0).fit(p.train)
        pipelines = {n: PipelineModel(stages=[M.assembler(p.features), model]) for n in ("ElasticNet", "VotingEnsemble")}
        return pipelines, jobs.stage(M.scored(pipelines, p.test))
    monkeypatch.setattr(jobs, "train_system", train_system)
    return seen


def test_unchanged_systems_are_not_fitted_again(spark, small_dir, tmp_path, fits):
    setups, root = jobs.SETUPS[:2], str(tmp_path / "root")
    tickets = fx.dated(fx.ticket_probs(spark, small_dir), spark, small_dir)
    known, fetched = fx.line_weather_update(spark, small_dir)

    def retrain(tickets, when, sizes=SIZES):
        fits.clear()
        board = jobs.retrain_job(spark, root, tickets, known, fetched, "reading_id", RULES, when, sizes, probabilities=tickets,
                                 setups=setups, tune=False)
        return sorted(fits), sorted(map(tuple, board.collect()))

    def keys():
        return {s.name: spark.read.parquet(os.path.join(root, s.name, "deployed")).first()["model_key"] for s in setups}

    first, board = retrain(tickets, "2024-01-01 00:00:00")
    before = keys()
    assert first == ["cooling", "heating"]
    # nothing new, in another order of rows: no fit, the metrics and times of the first run
    assert retrain(tickets.repartition(5), "2024-01-02 00:00:00") == ([], board) and keys() == before
    # new tickets of one system: every ticket of one day once more
    heating = tickets.filter("unit = 'C2'")
    day = heating.agg(F.min("created")).first()[0]
    more = tickets.unionByName(heating.filter(F.col("created") == F.lit(day)).withColumn("ticket_id", F.col("ticket_id") + 10 ** 9))
    some, later = retrain(more, "2024-01-03 00:00:00")
    assert some == ["heating"]
    after = keys()
    assert after["cooling"] == before["cooling"] and after["heating"] != before["heating"]
    assert {(r[0], r[-1]) for r in later} == {("C1", "2024-01-01 00:00:00"), ("C2", "2024-01-03 00:00:00")}
    # the old tickets again: both are known; the deployed models are read by their key
    assert retrain(tickets, "2024-01-04 00:00:00") == ([], board) and keys() == before
    assert [m["model_key"] for _, m, _, _ in jobs.deployed(spark, root, setups)] == [before[s.name] for s in setups]
    # other settings are other models; a save that was lost before its end does not count
    assert retrain(tickets, "2024-01-05 00:00:00", M.ModelSizes(enet_iter=6))[0] == ["cooling", "heating"]
    done = os.path.join(root, "cooling", before["cooling"], "deployed", "_SUCCESS")
    os.unlink(done)
    assert retrain(tickets, "2024-01-06 00:00:00")[0] == ["cooling"]


def test_content_keys(spark):
    setups = jobs.SETUPS[:2]
    rows = [("C1", 1.0, None), ("C1", 2.0, "x"), ("C2", 1.0, None)]
    schema = "system string, a double, b string"
    k = lambda rows, *s: jobs.content_keys(spark.createDataFrame(rows, schema), setups, *(s or (1,)))
    one = k(rows)
    assert one == k(rows[::-1]) and len(set(one.values())) == 2
    # a repeated row, a null in another place and another setting tell; a system without rows has a key too
    assert k(rows + rows[:1])["cooling"] != one["cooling"] and k(rows + rows[:1])["heating"] == one["heating"]
    assert k([("C1", None, "1.0"), *rows[1:]])["cooling"] != one["cooling"]
    assert k(rows, 2) != one and k(rows[:2])["heating"] not in one.values()
