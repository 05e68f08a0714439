"""Plan checks: no Python UDFs, filters and projections reach the scan, raw grain is aggregated
before any single-partition exchange."""

import re

import pytest

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _unstaged(spark, small_dir):
    """Plan functions whose frames have not been written yet, so that the plan shows the work."""
    from faultcast.operators import text as tx
    from faultcast.plans.features import base_features, lean_temporal, rich_temporal
    from faultcast.plans.training import fault_training_table
    from faultcast.plans.weather import daily_weather
    from faultcast.sources import fixtures as fx
    daily = daily_weather(fx.line_weather(spark, small_dir), blocks=0)
    training = fault_training_table(fx.tickets(spark, small_dir), daily)
    base = base_features(training, keys=["system"])
    t = fx.ticket_text(spark, small_dir)
    return {"daily_weather": daily, "by_site": daily_weather(fx.line_weather(spark, small_dir, site=True), keys=["site"]),
            "training": training, "base": base, "rich": rich_temporal(base, ["system"]), "lean": lean_temporal(base, ["system"]),
            "tfidf": tx.tfidf(t, "ticket_id", tx.combine_text("text", "text2"), 500)}


@pytest.fixture(scope="module")
def unstaged(spark, small_dir):
    return {k: plan_of(v) for k, v in _unstaged(spark, small_dir).items()}


@pytest.mark.parametrize("name", ["daily_weather", "by_site", "training", "base", "rich", "lean", "tfidf"])
def test_no_python_and_raw_scan(unstaged, name):
    p = unstaged[name]
    assert "FileScan parquet" in p
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow"):
        assert node not in p, node


def test_no_value_buffers_over_raw_grain(unstaged):
    # percentiles (object aggregates) only stand above daily grain
    for name in ("daily_weather", "by_site", "training"):
        assert "ObjectHashAggregate" not in unstaged[name]
    assert re.search(r"(?<!Object)HashAggregate\(keys=\[date", unstaged["daily_weather"])


def test_tfidf_shuffles_nothing_by_document(spark, small_dir):
    from faultcast.operators import text as tx
    from faultcast.sources.files import read_table
    d = read_table(spark, small_dir, "documents")
    p = plan_of(tx.tfidf(d, "doc_id", d["text"], 500))
    assert "Exchange" not in p and "SortMergeJoin" not in p and "BroadcastHashJoin" not in p


def test_daily_slice_reads_folders(spark, small_dir, tmp_path):
    from faultcast.plans.queries import weather_fx3
    from faultcast.sources import files
    files.write_daily(weather_fx3(spark, small_dir), str(tmp_path / "daily"))
    p = plan_of(files.read_daily(spark, str(tmp_path / "daily"), "1998-08-01", "1998-08-07"))
    assert re.search(r"PartitionFilters: \[[^\]]*ym", p)


def test_filter_pushed_into_scan(spark, small_dir):
    import __spark_entry__ as e
    p = plan_of(e.queries()["filter_in"](spark, small_dir))
    assert re.search(r"PushedFilters: \[[^\]]*In\(o_orderpriority", p)


def test_column_pruning_on_lineitem(spark, small_dir):
    from faultcast.plans.weather import daily_weather
    from faultcast.sources import fixtures as fx
    p = plan_of(daily_weather(fx.line_weather(spark, small_dir), blocks=0))
    scanned = re.search(r"FileScan parquet \[([^\]]*)\]", p).group(1)
    assert "l_partkey" not in scanned and "l_returnflag" not in scanned and "l_shipdate" in scanned
    assert len(scanned.split(",")) == 6


def test_raw_grain_aggregated_before_exchange(spark, small_dir):
    from faultcast.plans.weather import daily_weather
    from faultcast.sources import fixtures as fx
    df = daily_weather(fx.line_weather(spark, small_dir), blocks=0)
    p = df._jdf.queryExecution().executedPlan().toString()
    # the only exchange over raw rows is the hash exchange of the partial aggregate
    assert "partial_" in p
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = "\n".join(lines[i:])
            assert "HashAggregate" in below


def test_global_statistics_attached_without_join(spark, small_dir):
    # E8 scales on the whole unkeyed daily series: the one-row statistics enter as a scalar subquery
    import __spark_entry__ as e
    df = e.queries()["forecast_features"](spark, small_dir)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "Subquery" in p or "subquery" in p


def test_many_column_correlation_uses_partial_gram_sums(spark, small_dir):
    # one partial row per (key, pair) per task, merged by a grouped sum; no per-row pair records
    import __spark_entry__ as e
    p = plan_of(e.queries()["feature_select"](spark, small_dir))
    assert "MapInPandas" in p and "HashAggregate" in p
    assert "flatten" not in p and "BatchEvalPython" not in p
