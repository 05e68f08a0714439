"""Quality classifier (6): similarity-weighted vote of the nearest labelled latent-semantic vectors.

A text is two blocks of the same weight: the log counts of its byte trigrams
(hashed) times their inverse document frequency, and the shares of its character
classes and of its words and lines that stand again, in units of their spread.
Less the sample's mean, it is projected on the leading right singular vectors of
the labelled sample.  Every document's vector meets all labelled
vectors (a block of documents times their matrix), and the ``neighbours`` of
highest cosine vote, weighted by a power of their similarity.

The classifier is fitted on a bounded sample: at most ``per_class`` rows of each
label, those whose hashed id comes first.  So the matrix that is broadcast has
at most ``2 * per_class`` rows of ``rank`` numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

TRIGRAMS = 2048
EXTRA = 16
DIM = TRIGRAMS + EXTRA


class Model(NamedTuple):
    idf: np.ndarray
    spread: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int


def counts(text: str | None) -> np.ndarray:
    """Feature counts of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(DIM, dtype=np.float32)
    if not raw:
        return out
    a = np.frombuffer(raw, dtype=np.uint8)
    if len(a) >= 3:
        b = a.astype(np.uint32)
        key = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
        out[:TRIGRAMS] = np.bincount(key, minlength=TRIGRAMS)
    byte = np.bincount(a, minlength=256)
    words = raw.split()
    extra = out[TRIGRAMS:]
    extra[0] = byte[65:91].sum()
    extra[1] = byte[97:123].sum()
    extra[2] = byte[48:58].sum()
    extra[3] = byte[128:].sum()
    extra[4] = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
    extra[5] = byte[10]
    extra[6] = sum(x == y for x, y in zip(words, words[1:]))
    extra[7] = len(words) - len(set(words))
    extra[8] = len(words)
    lines = raw.split(b"\n")
    extra[9] = len(lines) - len(set(lines))
    return out


def styles(block: np.ndarray) -> np.ndarray:
    """Root shares of character classes per byte, and of words and lines that stand again."""
    extra = block[:, TRIGRAMS:]
    size = np.maximum(block[:, :TRIGRAMS].sum(axis=1, keepdims=True), 1)
    words, lines = np.maximum(extra[:, 8:9], 1), extra[:, 5:6] + 1
    return np.sqrt(np.concatenate([extra[:, :6] / size, extra[:, 6:8] / words, extra[:, 9:10] / lines], axis=1))


def weigh(block: np.ndarray, idf: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Both blocks of features, scaled to length 1 each and as a whole."""
    return _unit(np.concatenate([_unit(np.log1p(block[:, :TRIGRAMS]) * idf), _unit(styles(block) / spread)], axis=1))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int) -> DataFrame:
    """(text, quality) of the sample: bounded, chosen by the hash of the id.

    A doc_id that has several labels or texts counts with the smallest.
    """
    one = (labels.select("doc_id", "quality").dropna().filter(learn).groupBy("doc_id").agg(F.min("quality").alias("quality")))
    parts = [one.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    sample = parts[0].unionAll(parts[1])
    # 2 * per_class ids at most
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))


def fit(rows: DataFrame, rank: int = 64, neighbours: int = 25) -> Model:
    """Fit on the bounded sample: idf, singular vectors by a randomised range finder with a fixed seed, and the vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([counts(t.as_py()).tobytes() for t in batch.column(1)], pa.binary()), batch.column(2)],
                names=["doc_id", "counts", "quality"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    got = rows.mapInArrow(run, f"doc_id {kind}, counts binary, quality int").toArrow().sort_by([("doc_id", "ascending")])
    n = got.num_rows
    if n == 0:
        return Model(*[np.zeros(0, np.float32)] * 6, 0.5, neighbours)
    x = np.frombuffer(b"".join(got["counts"].to_pylist()), dtype=np.float32).reshape(n, DIM)
    y = np.array(got["quality"].to_pylist(), dtype=np.float32)
    idf = (np.log((1 + n) / (1 + (x[:, :TRIGRAMS] > 0).sum(axis=0))) + 1).astype(np.float32)
    spread = styles(x).std(axis=0) + np.float32(1e-3)
    x = weigh(x, idf, spread)
    mean = x.mean(axis=0)
    x = x - mean
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(*x.shape, rank + 16))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    u, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt.T)[:, :rank].astype(np.float32)
    return Model(idf, spread, mean, axes, _unit(x @ axes), y, float(y.mean()), neighbours)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 1e-12, norm, 1)).astype(np.float32)


def vote(model: Model, block: np.ndarray) -> np.ndarray:
    """Scores of a block of counts: nearest labels, weighted by the fourth power of the cosine; the prior where none is similar."""
    if not len(model.labels):
        return np.full(len(block), model.prior)
    full = block.any(axis=1)
    cosine = _unit((weigh(block, model.idf, model.spread) - model.mean) @ model.axes) @ model.vectors.T
    k = min(model.neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4
    total = weight.sum(axis=1)
    return np.where(full & (total > 0), (weight * model.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), model.prior)


def score(docs: DataFrame, model: Model, block_rows: int = 256) -> DataFrame:
    """doc_id, score (0 to 1) per row of ``docs``.

    Null and empty texts get the sample's share of label 1 (0.5 without a
    sample).  Repeated rows give repeated results, an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain: executors have no class of this module

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, block_rows):
                part = batch.slice(i, block_rows)
                got = vote(model, np.stack([counts(t.as_py()) for t in part.column(1)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(got, 0, 1), pa.float64())],
                                                 names=["doc_id", "score"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 2048, rank: int = 64, neighbours: int = 25) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``.

    Labels whose crc32(doc_id as text) mod 3 is 1 are held out; only texts are
    inputs of a score.  A null doc_id is not held out.  Labels of unknown or null
    ids are not used; other columns are not read.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(training_rows(docs, labels, fold != 1, per_class), rank, neighbours)
    held = F.coalesce(fold == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score",
                                     F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


ship(__name__)
