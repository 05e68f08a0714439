"""Target-distribution importance resampling (12): hashed n-gram features, counted once per distinct line.

Newlines separate words, so they cut a text into lines whose inner n-grams don't
depend on the text around them.  Equal lines are brought together; the bucket
counts of a distinct line are computed once and enter the corpus counts times
its occurrences.  n-grams over a line's end (from two words on) belong to one
document each and are added separately.  A document's weight is the sum of its
lines' gains, joined back by the lines' keys, and of its own cross-line n-grams.

The draw adds Gumbel noise (a hash of the id) to each weight and takes the highest
scores.  Scores are whole numbers in a narrow range, so a histogram of them gives
the cut; only rows above it are range-partitioned, sorted and numbered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, ship, staged

#: Bytes of words, A-Z lowered; every other byte separates.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Lines of more than 1 / HOT_SHARE of all lines are joined back by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 4096
#: Words whose bucket a task remembers.
KNOWN = 1 << 18


class Buckets(dict):
    """Bucket of each feature, remembered."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = b = crc32(feature) % self.size
        return b


def line_features(line: bytes, known: Buckets, max_n: int) -> tuple[int, list[int]]:
    """Number of words and the buckets of all runs of 1 to ``max_n`` words of a line."""
    words = line.translate(WORD_BYTES).split()
    got = [known[w] for w in words]
    for n in range(2, max_n + 1):
        got += [known[b" ".join(words[i:i + n])] for i in range(len(words) - n + 1)]
    return len(words), got


def cross_features(text: bytes, known: Buckets, max_n: int) -> list[int]:
    """Buckets of the runs of 2 to ``max_n`` words whose first and last word stand in different lines."""
    lines = [line.split() for line in text.translate(WORD_BYTES[:10] + b"\n" + WORD_BYTES[11:]).split(b"\n")]
    words = [w for line in lines for w in line]
    ends = [e for e in accumulate(map(len, lines)) if 0 < e < len(words)]
    got, last = [], 0
    for end in dict.fromkeys(ends):
        for n in range(2, max_n + 1):
            # starts from which the run passes this end and no earlier one, so that each run counts once
            for i in range(max(end - n + 1, last), min(end, len(words) - n + 1)):
                got.append(known[b" ".join(words[i:i + n])])
        last = end
    return got


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def _distinct_lines(texts: DataFrame, text: str, buckets: int, max_n: int) -> DataFrame:
    """(k1, k2, n, words, features), written: one row per distinct line with a word; n is how often it stands."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in batches:
            words, features = [], []
            for line in batch.column(3):
                n, got = line_features(line.as_py(), known, max_n)
                words.append(n)
                features.append(np.array(got, dtype=kind).tobytes())
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(words, pa.int32()), pa.array(features, pa.binary())],
                names=["k1", "k2", "n", "words", "features"])
            yield out.filter(pa.array(np.array(words) > 0))

    lines = (texts.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line"))
             .groupBy("line").agg(F.count(F.lit(1)).alias("n")))
    return staged(lines.select(*_keys(F.col("line")), "n", F.col("line").cast("binary").alias("line")).mapInArrow(
        run, "k1 bigint, k2 bigint, n bigint, words int, features binary"), "distinct_lines")


def _documents(docs: DataFrame, doc_id: str, text: str, buckets: int, max_n: int) -> DataFrame:
    """(address, doc, k1s, k2s, cross), written: the keys of each document's lines and its cross-line features."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    d = docs.select(F.monotonically_increasing_id().alias("address"), F.col(doc_id).alias("doc"),
                    F.transform(lines, lambda x: F.xxhash64(x)).alias("k1s"),
                    F.transform(lines, lambda x: F.xxhash64(F.lit(1), x)).alias("k2s"),
                    F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    if max_n < 2:
        return staged(d.select("address", "doc", "k1s", "k2s", F.lit(b"").alias("cross")), "line_keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in batches:
            cross = [np.array(cross_features(t.as_py(), known, max_n), dtype=kind).tobytes() for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cross, pa.binary())],
                                             names=["address", "doc", "k1s", "k2s", "cross"])

    return staged(d.mapInArrow(run, f"address bigint, doc {d.schema['doc'].dataType.simpleString()}, k1s array<bigint>, "
                                    "k2s array<bigint>, cross binary"), "line_keys")


def _counts(features: DataFrame, buckets: int) -> list[int]:
    """Occurrences per bucket, from (features, n); a task sends one row per bucket at most."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy()
            for f, times in zip(batch.column(0), n.tolist()):
                np.add.at(total, np.frombuffer(f.as_py(), dtype=kind), times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = features.select("features", "n").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(s: list[int], t: list[int]) -> np.ndarray:
    """Thousandths of the smoothed log ratio of each bucket's share in the target to that in the corpus, rounded down."""
    size, total_s, total_t = len(s), sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((float(b + 1) * (total_s + size)) / (float(a + 1) * (total_t + size))))
                     for a, b in zip(s, t)], dtype=np.int64)


def _gained(rows: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns, number of features and their summed gain."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"
    sent = rows.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            got = [np.frombuffer(f.as_py(), dtype=kind) for f in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([len(x) for x in got], pa.int64()),
                 pa.array([int(g[x].sum()) for x in got], pa.int64())], names=[*keep, "n_features", "gain"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*keep, "features").mapInArrow(run, ", ".join([*kinds, "n_features bigint", "gain bigint"]))


def importance_weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       target_text: str = "text", max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(address, doc, n_words, n_features, gain) per row of ``docs``; an address tells equal rows apart."""
    lines = _distinct_lines(docs, text, buckets, max_n)
    keyed = _documents(docs, doc_id, text, buckets, max_n)
    wanted = _distinct_lines(target, target_text, buckets, max_n)
    one = F.lit(1).cast("long").alias("n")
    own, theirs = lines.select("features", "n"), wanted.select("features", "n")
    if max_n > 1:
        t = _documents(target, target_text, target_text, buckets, max_n)
        own = own.unionAll(keyed.select(F.col("cross").alias("features"), one))
        theirs = theirs.unionAll(t.select(F.col("cross").alias("features"), one))
    gain = gains(_counts(own, buckets), _counts(theirs, buckets))

    keys = ["k1", "k2"]
    weighed = staged(_gained(lines, gain, [*keys, "words", "n"]), "line_gains")
    places = keyed.select("address", F.explode(F.arrays_zip("k1s", "k2s")).alias("k")).select(
        "address", F.col("k.k1s").alias("k1"), F.col("k.k2s").alias("k2"))
    total = weighed.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(weighed.filter(often))
    rare = places.join(hot.select(*keys), keys, "left_anti").join(weighed.filter(~often), keys)
    parts = places.join(hot, keys).unionByName(rare).select("address", F.col("words").cast("long").alias("words"), "n_features", "gain")
    if max_n > 1:
        cross = _gained(keyed.select("address", F.col("cross").alias("features")), gain, ["address"])
        parts = parts.unionAll(cross.select("address", F.lit(0).cast("long"), "n_features", "gain"))
    sums = parts.groupBy("address").agg(F.sum("words").alias("n_words"), F.sum("n_features").alias("n_features"),
                                        F.sum("gain").alias("gain"))
    zero = F.lit(0).cast("long")
    return keyed.select("address", "doc").join(sums, "address", "left").select(
        "address", "doc", *[F.coalesce(c, zero).alias(c) for c in ("n_words", "n_features", "gain")])


def importance_sample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      target_text: str = "text", max_n: int = 1, buckets: int = 10_000, min_words: int = 20,
                      percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words per row of ``docs``; rank is null where a row is not drawn.

    Null texts are empty: no features, weight 0, never drawn.  Equal rows get
    equal scores and are numbered each; null ids hash as the empty id and come
    last among ties.  An empty table gives an empty result, an empty target the
    gains of no evidence.  Other columns are not read.
    """
    w = importance_weights(docs, target, doc_id, text, target_text, max_n, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000.0 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    mean = F.coalesce(F.expr("(gain - pmod(gain, nullif(n_features, 0L))) div nullif(n_features, 0L)"), F.lit(0).cast("long"))
    scored = staged(w.select("address", "doc", "n_words", "n_features", mean.alias("weight"), (mean + noise).alias("score")), "scored")
    fit = F.col("n_words") >= min_words
    # a row per score: gains and noise are logarithms, some 100,000 whole numbers whatever the corpus
    bars = scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.col("score").desc())
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bars = bars.select("score", F.sum("n").over(down).alias("upto"),
                       F.floor(F.sum("n").over(whole) * percent / 100).alias("k"))
    # the highest score at which k rows are reached; none where k is 0
    found = bars.agg(F.max(F.when(F.col("upto") >= F.col("k"), F.col("score"))).alias("cut"), F.max("k").alias("k")).first()
    names = ["doc", "n_features", "weight", "score", "rank", "n_words"]
    k = int(found["k"] or 0)
    rank = F.lit(None).cast("long").alias("rank")
    if k == 0:
        out = scored.withColumn("rank", rank).select(names)
    else:
        high = fit & (F.col("score") >= found["cut"])
        ranked = numbered(scored.filter(high), [F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("address").asc()])
        ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
        out = ranked.select(names).unionByName(scored.filter(~high).withColumn("rank", rank).select(names))
    return out.withColumnRenamed("doc", "doc_id")


ship(__name__)
