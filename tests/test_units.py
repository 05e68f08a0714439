"""Hand-computed unit frames for the traps listed in SURVEY section 0 and FIXTURES section 3."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from faultcast.functions import calendar as cal
from faultcast.functions.scalars import BEAUFORT_BOUNDS, beaufort, nan_to_null, round_even
from faultcast.operators import columns as P
from faultcast.operators import rollup
from faultcast.operators import stats as S
from faultcast.operators import text as tx
from faultcast.operators import windows as W
from faultcast.operators.metrics import regression_metrics, vote_weights
from faultcast.operators.ranking import best_model, union_series
from faultcast.operators.splits import chrono_split, expanding_folds, hash_split, stratified_folds


def d(s):
    return dt.date.fromisoformat(s)


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_mode_tie_smallest_and_null_day(spark):
    rows = [(ts("2024-01-01 00:00"), 90.0), (ts("2024-01-01 01:00"), 90.0), (ts("2024-01-01 02:00"), 45.0),
            (ts("2024-01-01 03:00"), 45.0), (ts("2024-01-02 00:00"), None), (ts("2024-01-02 01:00"), None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, wind_direction double")
    out = {r["date"]: r["dominant_wind_dir"] for r in rollup.daily_mode(df).collect()}
    assert out[d("2024-01-01")] == 45.0
    assert out[d("2024-01-02")] is None


def test_rolling_mean_min_one_value_and_std_of_one_row(spark):
    rows = [(d("2024-01-01"), 1.0), (d("2024-01-02"), None), (d("2024-01-03"), 3.0), (d("2024-01-04"), 5.0)]
    df = spark.createDataFrame(rows, "date date, x double")
    out = df.select("date", W.rolling("x", 3).alias("m"), W.rolling_std0("x", 3).alias("s")).orderBy("date").collect()
    assert [r["m"] for r in out] == [1.0, 1.0, 2.0, 4.0]
    assert out[0]["s"] == 0.0 and out[1]["s"] == 0.0
    assert math.isclose(out[2]["s"], math.sqrt(2.0))


def test_diff_and_acceleration_first_rows_zero(spark):
    df = spark.createDataFrame([(d("2024-01-0%d" % i), float(v)) for i, v in [(1, 1), (2, 4), (3, 9), (4, 16)]],
                               "date date, x double")
    out = df.select(W.diff1("x").alias("d1"), W.diff2("x").alias("d2"), W.rolling_trend("x", 2).alias("t")).collect()
    assert [r["d1"] for r in out] == [0.0, 3.0, 5.0, 7.0]
    assert [r["d2"] for r in out] == [0.0, 3.0, 2.0, 2.0]
    assert out[0]["t"] is None and out[1]["t"] == 1.5


def test_winsorize_flag_collapses_and_bounds_hold(spark):
    rows = [(i, 1 if i % 10 == 0 else 0, float(i)) for i in range(100)] + [(100, 0, 1000.0)]
    df = spark.createDataFrame(rows, "id int, flag int, x double")
    out = S.winsorize_iqr(df, ["flag", "x"]).collect()
    assert {r["flag"] for r in out} == {0.0}
    q1, q3 = 25.0, 75.0
    hi = q3 + 1.5 * (q3 - q1)
    assert max(r["x"] for r in out) == hi


def test_zscore_constant_column(spark):
    df = spark.createDataFrame([(i, 5) for i in range(10)], "id int, c int")
    assert S.drop_zscore_rows(df, "c", 6.0).count() == 10
    assert S.drop_zscore_rows(df, "c", 6.0, parity=True).count() == 0
    z = spark.createDataFrame([(i, float(i)) for i in range(20)] + [(99, 1000.0)], "id int, c double")
    assert S.drop_zscore_rows(z, "c", 3.0).filter("id = 99").count() == 0


def test_calendar_year_boundary_and_season_diff(spark):
    rows = [(d("2020-12-31"),), (d("2021-01-01"),), (d("2021-01-04"),), (d("2021-12-31"),), (d("2022-01-02"),)]
    df = spark.createDataFrame(rows, "date date")
    out = df.select("date", cal.iso_week("date").alias("w"), cal.iso_dow("date").alias("dow"),
                    cal.season_no(F.month("date")).alias("s"), cal.is_weekend("date").alias("we")).orderBy("date").collect()
    assert [r["w"] for r in out] == [53, 53, 1, 52, 52]
    assert [r["dow"] for r in out] == [4, 5, 1, 5, 7]
    assert {r["s"] for r in out} == {1}
    assert [r["we"] for r in out] == [0, 0, 0, 0, 1]
    t = spark.createDataFrame([(d("2021-02-27"), 1, 1.0), (d("2021-06-01"), 3, 5.0), (d("2021-12-01"), 1, 4.0)],
                              "date date, season int, t double")
    sd = t.select("date", W.season_diff("t", "season").alias("x")).orderBy("date").collect()
    assert sd[0]["x"] is None and sd[1]["x"] is None and sd[2]["x"] == 3.0


def test_combine_text_keeps_separator_and_rule_order(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, "a", None), (3, "Alpha and beta", "x")], "id int, t1 string, t2 string")
    rules = [("alpha", "C1"), ("beta", "C2")]
    out = df.select("id", tx.combine_text("t1", "t2").alias("c"),
                    tx.keyword_rules(tx.combine_text("t1", "t2"), rules)["label"].alias("k")).orderBy("id").collect()
    assert out[0]["c"] == " b" and out[1]["c"] == "a "
    assert out[2]["k"] == "C1"


def test_threshold_inclusive_and_first_wins(spark):
    rows = [(1, "GENERIC", "x", None, 0.8, 0.1, 0.1), (2, "GENERIC", "y", None, 0.5, 0.5, 0.5),
            (3, "C1", "z", None, 0.1, 0.1, 0.1), (4, "OTHER", "z", None, 0.9, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, unit string, text string, text2 string, a double, b double, c double")
    out = {r["id"]: r for r in tx.classify_tickets(
        df, {"C1": "a", "C2": "b", "C3": "c"}, rules=[("alpha", "C1")], generic="GENERIC").collect()}
    assert out[1]["unit"] == "C1" and out[1]["confidence"] == 0.8
    assert out[1]["details"] == "model: C1 (80.0%)"
    assert out[2]["unit"] == "GENERIC" and out[2]["model_label"] == "C1"
    assert out[3]["unit"] == "C1" and out[3]["confidence"] == 1.0 and out[3]["details"] == ""
    assert out[4]["unit"] == "OTHER" and out[4]["confidence"] is None and out[4]["details"] == ""


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (0.285,), (8.345,)], "x double")
    out = df.select(round_even("x").alias("r0"), round_even("x", 2).alias("r2")).collect()
    assert [r["r0"] for r in out[:4]] == [0.0, 2.0, 2.0, -0.0]
    assert out[4]["r2"] == 0.28 and out[5]["r2"] == 8.35


def test_beaufort_exclusive_upper_bounds(spark):
    vals = [0.0] + BEAUFORT_BOUNDS + [None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r["b"] for r in df.select(beaufort("x").alias("b")).collect()]
    assert out[:-1] == list(range(13))
    assert out[-1] is None
    assert df.select(beaufort("x", null_as_top=True).alias("b")).collect()[-1]["b"] == 12


def test_align_features_missing_and_extra(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, a double, extra double")
    out = P.align_features(df, ["a", "missing"], keep=["k"])
    assert out.columns == ["k", "a", "missing"]
    assert out.collect()[0]["missing"] == 0.0


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    r = nan_to_null(df).collect()[0]
    assert r["a"] is None and r["b"] == 1.0


def test_splits_disjoint_and_complete(spark):
    rows = [("s1" if i % 3 else "s2", d("2024-01-01") + dt.timedelta(days=i)) for i in range(200)]
    df = spark.createDataFrame(rows, "system string, date date")
    cs = chrono_split(df, 0.8, ["system"], "date")
    assert cs.count() == 200
    for s in ("s1", "s2"):
        n = df.filter(F.col("system") == s).count()
        tr = cs.filter((F.col("system") == s) & (F.col("split") == "train"))
        assert tr.count() == int(n * 0.8)
        last_train = tr.agg(F.max("date")).first()[0]
        first_test = cs.filter((F.col("system") == s) & (F.col("split") == "test")).agg(F.min("date")).first()[0]
        assert last_train < first_test
    hs = hash_split(df, F.concat_ws("|", "system", F.col("date").cast("string")))
    assert hs.count() == 200 and hs.filter("split not in ('train', 'test')").count() == 0
    ef = expanding_folds(df, 5, ["system"], "date")
    n1 = df.filter("system = 's1'").count()
    size = n1 // 6
    assert ef.filter("system = 's1' and role = 'test'").groupBy("fold").count().agg(F.min("count")).first()[0] == size
    sf = stratified_folds(df.withColumn("id", F.monotonically_increasing_id()), "id", "system", 5)
    counts = [r["count"] for r in sf.filter("system = 's1'").groupBy("fold").count().collect()]
    assert max(counts) - min(counts) <= 1 and sum(counts) == n1


@pytest.mark.parametrize("nulls", [3, 40])
def test_chrono_split_keeps_rows_without_a_date(spark, nulls):
    rows = [("s", None, k) for k in range(nulls)] + [("s", d("2024-01-01") + dt.timedelta(days=k), 100 + k) for k in range(10)]
    rows += [("t", d("2024-01-01"), 200), (None, None, 300), (None, d("2024-01-02"), 301)]
    df = spark.createDataFrame(rows, "system string, date date, id int")
    got = {r["id"]: r["split"] for r in chrono_split(df, 0.6, ["system"], "date").collect()}
    assert set(got) == {r[2] for r in rows}
    n = nulls + 10
    assert sum(got[r[2]] == "train" for r in rows if r[0] == "s") == int(n * 0.6)
    if int(n * 0.6) >= nulls:
        assert all(got[k] == "train" for k in range(nulls))
    else:
        assert all(got[100 + k] == "test" for k in range(10))
    alone = df.filter("system = 's'").drop("system")
    assert chrono_split(alone, 0.6, order="date").filter("split = 'train'").count() == int(n * 0.6)


def test_vote_weights_sum_to_one_and_best_model_ties(spark):
    board = spark.createDataFrame([("s", "a", 0.5), ("s", "b", -1.0), ("s", "c", 0.5)], "system string, model string, r2 double")
    w = vote_weights(board)
    assert math.isclose(sum(r["weight"] for r in w.collect()), 1.0)
    b = best_model(board, name="model").collect()
    assert [r["model"] for r in b] == ["a"]


def test_regression_metrics_constant_target(spark):
    df = spark.createDataFrame([("m", 2.0, 2.0), ("m", 2.0, 2.0)], "model string, y double, y_hat double")
    r = regression_metrics(df).first()
    assert r["r2"] == 1.0 and r["mse"] == 0.0


def test_union_series_unique_and_history_wins(spark):
    h = spark.createDataFrame([(ts("2024-01-01 00:00"), 1.0), (ts("2024-01-01 01:00"), 2.0)], "ts timestamp_ntz, v double")
    f = spark.createDataFrame([(ts("2024-01-01 01:00"), 20.0), (ts("2024-01-01 02:00"), 30.0)], "ts timestamp_ntz, v double")
    out = union_series(h, f).collect()
    assert [r["v"] for r in out] == [1.0, 2.0, 30.0]


def test_standard_scale_mean_zero_and_constant_divides_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    out = S.standard_scale(df, ["a", "c"]).collect()
    assert math.isclose(sum(r["a"] for r in out), 0.0, abs_tol=1e-12)
    assert {r["c"] for r in out} == {0.0}
    rb = S.robust_scale(df, ["a"]).collect()
    assert [r["a"] for r in rb] == [-1.0, 0.0, 1.0]


def test_tfidf_rows_are_unit_length(spark):
    df = spark.createDataFrame([(1, "aa bb bb"), (2, "bb cc")], "id int, t string")
    out = tx.tfidf(df, "id", F.col("t"), 10)
    norms = out.groupBy("id").agg(F.sqrt(F.sum(F.col("tfidf") ** 2)).alias("n")).collect()
    assert all(math.isclose(r["n"], 1.0) for r in norms)
    w = {(r["id"], r["term"]): r["tfidf"] for r in out.collect()}
    assert w[(1, "bb")] > 0 and (1, "cc") not in w


def test_feature_select_drops_low_variance_and_collinear(spark):
    rows = [(float(i), 2.0 * i + 1.0, 7.0, float((i * 37) % 11)) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("system", F.lit("s"))
    from faultcast.plans.features import feature_select
    out = {r["feature"]: r["kept"] for r in feature_select(df, ["a", "b", "c", "d"], ["system"]).collect()}
    assert out == {"a": True, "b": False, "c": False, "d": True}


def test_corr_pairs_gram_path_equals_wide_aggregate(spark):
    # NULLs (pairwise complete), a constant column, a column constant only where `c` is present,
    # and a NULL key that forms its own group
    rows = [("k1", 1.0, 2.0, 5.0, 7.0), ("k1", 2.0, 1.0, 5.0, 7.0), ("k1", 4.0, None, 5.0, 9.0),
            ("k1", 3.0, 3.5, 5.0, None), ("k1", None, 8.0, 5.0, 7.0), ("k1", 7.0, 0.5, 5.0, 7.0),
            ("k2", 10.0, 1.0, 1.0, 2.0), ("k2", 20.0, 2.0, 2.0, 1.0), ("k2", 15.0, 4.0, 0.5, 3.0),
            (None, 1.0, 1.0, 1.0, 1.0), (None, 2.0, 3.0, 1.0, 2.0), (None, 3.0, 2.0, 1.5, 2.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, d double").repartition(3)
    cols = ["a", "b", "c", "d"]
    for absolute in (True, False):
        wide = {(r["k"], r["col_a"], r["col_b"]): r["corr"]
                for r in S.corr_pairs(df, cols, ["k"], absolute=absolute).collect()}
        gram = {(r["k"], r["col_a"], r["col_b"]): r["corr"]
                for r in S.corr_pairs(df, cols, ["k"], absolute=absolute).collect()}
        assert wide.keys() == gram.keys() and len(wide) == 18
        for key, v in wide.items():
            if v is None:
                assert gram[key] is None, key
            else:
                assert gram[key] is not None and math.isclose(gram[key], v, abs_tol=1e-12), key
    assert gram[("k1", "a", "c")] is None            # constant column -> NULL, not noise
    nokey = {(r["col_a"], r["col_b"]): r["corr"] for r in S.corr_pairs(df, cols, None).collect()}
    assert len(nokey) == 6


def test_splits_do_not_depend_on_partitions_when_days_tie(spark):
    from faultcast.operators.splits import chrono_split, expanding_folds
    rows = [("a" if k % 3 else None, d("2021-01-01") + dt.timedelta(days=k // 20), k) for k in range(200)]
    df = spark.createDataFrame(rows, "system string, date date, v int")
    for n in (1, 7):
        x = df.repartition(n)
        s = {r["v"]: r["split"] for r in chrono_split(x, 0.5, ["system"]).collect()}
        f = sorted((r["v"], r["fold"], r["role"]) for r in expanding_folds(x, 3, ["system"]).collect())
        if n == 1:
            first = (s, f)
        assert (s, f) == first and len(s) == 200
    for key in ("a", None):
        mine = [r[2] for r in rows if r[0] == key]
        assert sum(s[v] == "train" for v in mine) == len(mine) // 2
    # earlier days are train, later ones test
    cut = {r[2]: r[1] for r in rows}
    assert max(cut[v] for v in cut if s[v] == "train") <= min(cut[v] for v in cut if s[v] == "test") + dt.timedelta(days=1)


def test_null_keys_are_a_group(spark):
    from faultcast.operators import stats as S
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 10.0), (None, 30.0)], "k string, x double")
    got = {(r["k"], r["x"]) for r in S.standard_scale(df, ["x"], keys=["k"]).collect()}
    assert got == {("a", -1.0), ("a", 1.0), (None, -1.0), (None, 1.0)}


def test_union_series_is_stable_for_repeated_keys(spark):
    from faultcast.operators.ranking import union_series
    hist = spark.createDataFrame([(1, float(k)) for k in range(20)], "ts int, v double")
    fc = spark.createDataFrame([(1, -1.0), (2, 5.0)], "ts int, v double")
    a, b = (sorted(tuple(r) for r in union_series(hist.repartition(n), fc, "ts").collect()) for n in (1, 6))
    assert a == b and len(a) == 2 and a[0][1] >= 0


def test_ticket_csv_keeps_texts(spark, tmp_path):
    from faultcast.sources import files
    texts = ['line one\nline "two", three', "", None, 'a\\b \'q\'', "\\N", 'ends with "', "é\tü"]
    df = spark.createDataFrame(list(enumerate(texts)), "ticket_id int, text string")
    files.write_table(df, str(tmp_path / "t"), fmt="csv")
    back = {r["ticket_id"]: r["text"] for r in files.read_tickets(spark, str(tmp_path / "t"), "csv", df.schema).collect()}
    want = dict(enumerate(texts))
    want[4] = None  # the text that stands for NULL
    assert back == want


def test_correlations_take_nan_as_missing(spark):
    from faultcast.operators import stats as S
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (nan, 9.0), (5.0, None)], "a double, b double")
    r = S.corr_pairs(df, ["a", "b"]).first()
    assert abs(r["corr"] - 1.0) < 1e-12


def test_late_rows_are_counted(spark, small_dir, tmp_path):
    from faultcast.sources import fixtures as fx
    from faultcast.streaming import landing
    hourly = fx.hourly(spark, small_dir)
    root = str(tmp_path / "s")
    full = landing.land_and_roll(spark, hourly, root, batches=2)
    days = hourly.select(F.to_date("ts")).distinct().count()
    assert full.count() == days
    src, sink = root + "/landed", root + "/daily"
    assert landing.late_rows(spark, src, sink).count() == 0
    hourly.orderBy("ts").limit(3).write.mode("append").parquet(src)
    assert [r["landed"] - r["counted"] for r in landing.late_rows(spark, src, sink).collect()] == [3]


def test_prune_sparse_columns(spark):
    df = spark.createDataFrame([(1, 0, None, "0"), (2, 0, 1.0, "x"), (3, 5, None, "y"), (4, 0, None, "z")],
                               "a int, zeros int, nulls double, t string")
    assert P.prune_sparse_columns(df).columns == ["a", "t"]
    assert P.fill_const(df, 7, ["nulls"]).filter("nulls = 7").count() == 3


def test_payload_documents(spark, tmp_path):
    from faultcast.sources.payload import explode_series, read_payloads
    good = ['{"series_id": 1, "extra": {"a": [1]}, "hourly": {"start": 0, "end": 7200, "interval": 3600, "t": [1.5, null, 9], "h": [7]}}',
            '{"series_id": 2, "hourly": {"start": 86400, "end": 86401, "interval": 1, "t": [-2e-3]}}', "", "  "]
    (tmp_path / "a.json").write_text("\n".join(good))
    rows = explode_series(read_payloads(spark, str(tmp_path / "a.json"), ["t", "h"]), ["t", "h"]).collect()
    got = sorted((r["series_id"], r["ts"].isoformat(), r["t"], r["h"]) for r in rows)
    assert got == [(1, "1970-01-01T00:00:00", 1.5, 7.0), (1, "1970-01-01T01:00:00", None, None),
                   (2, "1970-01-02T00:00:00", -0.002, None)]
    (tmp_path / "b.json").write_text("\n".join([*good, "not json", '{"series_id": 3}', '{"series_id": 4, "hourly": {"start": "x"}}']))
    with pytest.raises(Exception):
        read_payloads(spark, str(tmp_path / "b.json"), ["t", "h"]).collect()
    assert sorted(r["series_id"] for r in read_payloads(spark, str(tmp_path / "b.json"), ["t", "h"], skip_bad=True).collect()) == [1, 2]
    (tmp_path / "c.json").write_text("")
    assert read_payloads(spark, str(tmp_path / "c.json"), ["t"]).collect() == []
