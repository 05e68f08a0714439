"""Operators and pipeline stages on tables of any make: clashing names, text ids, null ids, no rows, executors without the package."""

import pickle

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .conftest import prose

#: Names that the operators use inside.
HELPERS = ["_lines", "_doc", "_tag", "_dropped", "_kept", "_lost", "_lost_key", "_row", "_source", "_text", "row", "kept", "doc", "tag", "id", "key",
           "mark", "lines", "dropped", "size", "n", "first", "is_first", "rate", "whole", "place", "cut", "node", "root", "copies"]


def table(spark, rows, kind):
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")],
                           T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in HELPERS]])
    return spark.createDataFrame([(*r, "en", r[0] and "s", len(r[1] or ""), *HELPERS) for r in rows], schema)


def rows_for(ids):
    line = prose(77, 30)
    base = prose(1, 120)
    out = [(ids(k), prose(k, 60) + "\n" + line) for k in range(8)]
    out += [(ids(20), base), (ids(21), base + " end"), (ids(22), base), (ids(22), base), (None, prose(9, 40)), (ids(23), None), (ids(24), "")]
    return out


@pytest.fixture(params=["bigint", "string"])
def docs(spark, request):
    if request.param == "bigint":
        return table(spark, rows_for(lambda k: k), T.LongType())
    return table(spark, rows_for(lambda k: f"d{k:02d}"), T.StringType())


def test_stages_keep_the_columns_of_any_table(spark, docs):
    import corpus_pipeline
    from faultcast.llm import compression, decontam, jaccard, lines, mixing
    items = spark.createDataFrame([("q1", prose(3, 30)), (None, prose(4, 25))], "item_id string, text string")
    none = docs.filter("n = 'no'")
    for stage in (compression.keep_good, lines.drop_lines, jaccard.keep_one, lambda d: decontam.drop_contaminated(d, items)):
        out = stage(docs)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert 0 < out.count() <= docs.count()
        assert out.filter("_lines <> '_lines' or _lost <> '_lost' or row <> 'row'").count() == 0
        assert stage(none).collect() == []
    assert lines.drop_lines(docs).filter(F.col("text").endswith(prose(77, 30))).count() == 1
    kept = [r["doc_id"] for r in jaccard.keep_one(docs).filter(F.col("text").startswith(prose(1, 120))).collect()]
    assert kept in ([20], ["d20"])
    assert mixing.mix(docs).count() == docs.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_items_with_text_ids(spark, docs):
    from faultcast.llm.decontam import find_items
    items = spark.createDataFrame([("q1", prose(3, 30)), ("", prose(5, 30)), (None, prose(4, 25))], "item_id string, text string")
    got = find_items(docs, items, null_ids=True).collect()
    assert sorted((str(r["doc_id"])[-1], r["item_id"] or "", r["distance"]) for r in got) == [("3", "q1", 0), ("4", "", 0), ("5", "", 0)]


def test_quality_of_text_ids_and_long_labels(spark, docs):
    from faultcast.llm.quality import classify
    labels = docs.filter("doc_id is not null").select("doc_id", (F.length("text") % 2).cast("long").alias("quality")).dropDuplicates(["doc_id"])
    got = classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)


def test_votes_match_plain_cosines(spark):
    import math

    from faultcast.llm import quality
    docs = spark.createDataFrame([(k, prose(k, 5 + k)) for k in range(40)] + [(40, ""), (41, None)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 % 2).alias("quality")).filter("doc_id < 30")
    model = quality.fit(quality.training_rows(docs, labels, F.lit(True), 100), 8, 5)
    vectors, y = model.vectors.tolist(), model.labels.tolist()
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model, block_rows=7).collect()}
    for r in docs.collect():
        if not r["text"]:
            assert got[r["doc_id"]] == pytest.approx(sum(y) / len(y), abs=1e-6)
            continue
        x = quality.weigh(quality.counts(r["text"])[None, :], model.idf, model.spread)[0]
        v = [sum(float(a) * float(b) for a, b in zip(x - model.mean, axis)) for axis in model.axes.T]
        norm = math.sqrt(sum(a * a for a in v))
        cosine = sorted(((sum(a * b for a, b in zip(v, w)) / norm, label) for w, label in zip(vectors, y)), reverse=True)[:5]
        weight = [max(c, 0) ** 4 for c, _ in cosine]
        want = sum(w * label for w, (_, label) in zip(weight, cosine)) / sum(weight) if sum(weight) else model.prior
        assert got[r["doc_id"]] == pytest.approx(want, abs=1e-3)


def test_broadcasts_need_no_class_of_the_package(spark, docs, monkeypatch):
    from pyspark import SparkContext

    from faultcast.llm import decontam, divergence, jaccard, quality, resampling, tokens
    sent = []
    real = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or real(self, value))
    small = docs.select("doc_id", "text", "lang", "source")
    labels = small.filter("doc_id is not null").select("doc_id", F.lit(1).alias("quality")).dropDuplicates(["doc_id"])
    items = spark.createDataFrame([(1, prose(3, 30))], "item_id long, text string")
    for out in (quality.classify(small, labels), tokens.count_tokens(small, tokens.Vocabulary({"a": -1.0, "b": -2.0}, True, True)),
                decontam.find_items(small, items), divergence.divergence_audit(small, min_docs=1),
                resampling.importance_sample(small, items), jaccard.near_duplicates(small)):
        assert out.count() >= 0
    assert len(sent) >= 6 and not any(b"faultcast" in s for s in sent)


def test_empty_tables(spark):
    from faultcast.llm import quality, tokens
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(none, tokens.Vocabulary({"a": -1.0}, False, True)).collect() == []
    assert quality.classify(none, spark.createDataFrame([], "doc_id long, quality int")).collect() == []
