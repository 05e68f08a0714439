"""Readings landed month by month against one full run."""

import datetime as dt
import os

from pyspark.sql import functions as F

from faultcast.operators.columns import drop_incomplete
from faultcast.operators.ranking import union_series
from faultcast.plans import spec
from faultcast.plans.weather import daily_weather
from faultcast.sources.incremental import land_readings, landed_readings, landed_weather

COLS = sorted(set(spec.HOURLY.values()))
SCHEMA = "id string, site string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in COLS)


def readings(spark, first, days, hours=(0, 9, 18), salt=0, missing=None):
    rows = []
    for d in range(days):
        for h in hours:
            ts = dt.datetime.fromisoformat(first) + dt.timedelta(days=d, hours=h)
            for s in ("a", None):
                v = [float((ts.day * 7 + ts.month * 3 + h + i + salt) % 40) for i in range(len(COLS))]
                if missing and missing(ts):
                    v[0] = None
                rows.append((f"{ts.isoformat()} {s}", s, ts, *v))
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def files_of(root):
    return {os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_landing_equals_a_full_run_and_leaves_other_months(spark, tmp_path):
    root = str(tmp_path / "landed")
    history = readings(spark, "2023-11-20", 60)
    # overlaps the history with other values, goes on into a new month, repeats itself and holds incomplete rows
    fetched = readings(spark, "2024-01-10", 30, salt=5, missing=lambda t: t.day == 25)
    fetched = fetched.unionByName(fetched.filter(F.dayofmonth("ts") == 2)).unionByName(
        readings(spark, "2024-02-03", 2, salt=9))
    complete = [c for c in history.columns if c not in ("id", "site")]
    assert land_readings(spark, root, history, "id", complete=complete, keys=["site"]) == ["2023-11", "2023-12", "2024-01"]
    before = files_of(root)
    assert land_readings(spark, root, fetched, "id", complete=complete, keys=["site"]) == ["2024-01", "2024-02"]
    after = files_of(root)
    untouched = {f for f in before if "ym=2023" in f}
    assert untouched and all(after.get(f) == before[f] for f in untouched)
    # the readings of a touched month are not rewritten either, its parts are
    assert all(f in after for f in before if "readings" in f)
    assert not any(f in after for f in before if "day_parts" in f and "ym=2024-01" in f)

    full = union_series(history, fetched, "id")
    want = daily_weather(drop_incomplete(full, complete), keys=["site"])
    assert rows_of(landed_weather(spark, root, ["site"])) == rows_of(want)
    assert rows_of(landed_readings(spark, root)) == rows_of(full)


def test_landing_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "landed")
    history = readings(spark, "2024-01-30", 4)
    land_readings(spark, root, history, "id")
    want = rows_of(landed_weather(spark, root))
    land_readings(spark, root, history, "id")
    assert rows_of(landed_weather(spark, root)) == want
    assert landed_readings(spark, root).count() == history.count()
    # as after a run that was lost between the readings and their parts
    more = readings(spark, "2024-02-02", 3)
    lost = more.withColumn("ym", F.date_format("ts", "yyyy-MM")).join(history.select("id"), "id", "left_anti")
    lost.select(*history.columns, "ym").write.mode("append").partitionBy("ym").parquet(os.path.join(root, "readings"))
    land_readings(spark, root, more, "id")
    assert rows_of(landed_weather(spark, root)) == rows_of(daily_weather(union_series(history, more, "id")))


def test_nothing_fetched_and_rows_without_time(spark, tmp_path):
    root = str(tmp_path / "landed")
    land_readings(spark, root, readings(spark, "2024-01-01", 2), "id")
    none = readings(spark, "2024-01-01", 2).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    assert land_readings(spark, root, none, "id") == []
    assert land_readings(spark, root, none.limit(0), "id") == []
    assert landed_weather(spark, root).count() == 2


def test_only_the_touched_months_are_read(spark, tmp_path):
    from faultcast.sources.incremental import _months_of
    root = str(tmp_path / "landed")
    land_readings(spark, root, readings(spark, "2024-01-20", 30), "id")
    p = _months_of(spark, os.path.join(root, "readings"), ["2024-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in p or "PartitionFilters: [(ym" in p


def test_a_key_of_another_month(spark, tmp_path):
    history = readings(spark, "2024-01-30", 2)
    # the same keys again, a month later
    fetched = readings(spark, "2024-01-30", 3, salt=3).withColumn("ts", F.expr("ts + INTERVAL 31 DAYS"))
    for by_month, want in ((True, history.unionByName(fetched)), (False, union_series(history, fetched, "id"))):
        root = str(tmp_path / f"landed_{by_month}")
        for rows in (history, fetched):
            land_readings(spark, root, rows, "id", by_month=by_month)
        assert rows_of(landed_readings(spark, root)) == rows_of(want)
        assert rows_of(landed_weather(spark, root)) == rows_of(daily_weather(want))


def test_first_landing_exchanges_the_readings_once(spark, tmp_path, monkeypatch):
    from faultcast.sources import incremental as inc
    monkeypatch.setattr(inc, "PIECE_ROWS", 3)
    # a large month and a small one; copies, null keys and a key in both months
    rows = [(k, dt.datetime(2024, 1, 1 + i % 20), float(i % 2)) for i, k in enumerate([*range(12), *range(12), None, None])]
    rows += [(3, dt.datetime(2024, 2, 1), 1.0), (None, dt.datetime(2024, 2, 2), 2.0), (4, None, 1.0)]
    df = spark.createDataFrame(rows, "reading_id long, ts timestamp_ntz, v double")
    cut = inc._in_pieces(df.filter("ts is not null").withColumn(inc.MONTH, inc._month("ts")), {"2024-01": 26, "2024-02": 2}, "reading_id")
    assert cut.select(inc.MONTH, inc.PIECE).distinct().filter("ym = '2024-01'").count() > 3
    once = inc.dedupe_first(cut, [inc.MONTH, inc.PIECE, "reading_id"], ["v"])
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(inc, "daily_parts", lambda landed, ts_col, keys: landed.selectExpr("to_date(ts) AS date", "v"))
    assert inc.land_readings(spark, str(tmp_path), df, "reading_id") == ["2024-01", "2024-02"]
    got = [(r["ts"].month, r["reading_id"]) for r in inc.landed_readings(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(1, k) for k in [*range(12), None]] + [(2, 3), (2, None)], key=str)


def test_a_later_landing_exchanges_its_rows_once(spark, tmp_path):
    from faultcast.sources import incremental

    root = str(tmp_path / "landed")
    known = readings(spark, "2024-01-01", 10).withColumn("id", F.when(F.dayofmonth("ts") != 3, F.col("id")))
    fetched = readings(spark, "2024-01-05", 40, salt=3).withColumn("id", F.when(F.dayofmonth("ts") != 7, F.col("id")))
    land_readings(spark, root, known, "id", keys=["site"])
    rows = fetched.withColumn("ym", F.date_format("ts", "yyyy-MM"))
    counts = {r[0]: r[1] for r in rows.groupBy("ym").count().collect()}
    there = incremental._months_of(spark, os.path.join(root, "readings"), sorted(counts))
    new = incremental._new_by_month(rows, counts, "id", fetched.columns, there)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    # a null key is there in January only: of February's null keys one reading stays
    want = {r["id"] for r in fetched.collect()} - {r["id"] for r in known.collect()}
    got = [(r["ym"], r["id"]) for r in new.collect()]
    assert {i for _, i in got} == want | {None}
    assert [m for m, i in got if i is None] == ["2024-02"] and len(got) == len(want) + 1


def test_partitions_of_a_landing_follow_its_readings(spark, tmp_path, monkeypatch):
    from faultcast.sources import incremental as inc
    most, dealt = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    monkeypatch.setattr(inc, "PIECE_ROWS", 5)
    whole = inc._in_pieces
    monkeypatch.setattr(inc, "_in_pieces", lambda rows, counts, key: dealt.append((counts, whole(rows, counts, key))) or dealt[-1][1])
    root = str(tmp_path / "landed")
    history = readings(spark, "2024-01-01", 20)
    for rows in (history, history, history.limit(1)):
        land_readings(spark, root, rows, "id")
    n = history.count()
    assert 2 * n // 5 > most
    # a later landing counts the keys that are there, also where it fetches a single reading
    assert [sum(counts.values()) for counts, _ in dealt] == [n, 2 * n, n + 1]
    for counts, cut in dealt:
        size = cut.groupBy(inc.MONTH, inc.PIECE).count()
        assert cut.rdd.getNumPartitions() >= 2 * sum(counts.values()) / 5 > most
        assert size.count() > 1 and cut.count() == sum(counts.values())
    assert rows_of(landed_readings(spark, root)) == rows_of(history)
