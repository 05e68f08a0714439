"""Mixing sources to target weights (1), native: entropy balancing by distributed Newton steps.

Among all rates r in [0, cap] per document whose expected tokens meet the
target of each source, the one closest in relative entropy to "every document
once" is r = min(cap, exp(lambda * x)), x the document's size over its source's
mean size.  lambda solves the convex dual: one scalar per source, found by
Newton steps that are one aggregate over (source, size, count) each, kept inside
a bracket so that flat stretches (all at the cap) cannot throw it off.

The rates become whole copies: floor(r), and one more for the documents whose
hashed draw minus fraction lies lowest.  The cut per source is found by two
rounds of 1,024-bin histograms of tokens, so the copies meet the target to about
a document, whatever the number of documents.  No step holds a source in
one task: all are sums with map-side parts, joined back on the source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, numbered, staged

BINS = 1024


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size, n).

    Weights repeat over the sources in code-point order, null last.  Targets
    stop at ``cap`` times the source; the excess is shared again by weight, an
    aggregate a round, until no further source is at its cap: every open source
    has weight * level then. Sources are numbered over range partitions, so any
    number of them will do.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    s = numbered(s, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = staged(s.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).drop("rank"), "sources")
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("most")
        got = s.agg(F.sum("source_size").alias("all"), F.count(F.when(over, 1)).alias("capped"),
                    F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("most"),
                    F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if got["capped"] == capped:
            break
        capped = got["capped"]
        if not got["weight"]:  # every source at its cap, or no source at all
            level = math.inf
            break
        level = (share * got["all"] - got["most"]) / got["weight"]
    return s.select("source", "source_size", "n_docs", F.least("most", F.col("weight") * level).alias("target"))


def solve_tilts(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, steps: int = 100, tol: float = 1e-7) -> DataFrame:
    """(source, source_size, target, mean, tilt): the dual's solution per source, by Newton steps.

    Fails where a source is further than ``tol`` of its target after ``steps``.
    """
    state = targets.select(
        F.col("source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n_docs")).otherwise(1.0).alias("mean"),
        F.lit(0.0).alias("tilt"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(1.0).alias("off"))
    keys = ["source", "source_size", "target", "mean", "tilt", "low", "high"]
    for _ in range(steps):
        state = staged(state, "tilts")
        if state.filter(F.col("off") > tol).isEmpty():
            break
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        rate = F.least(raw, F.lit(cap))
        s = state.withColumnRenamed("source", "_source")
        sums = (sizes.join(s, sizes["source"].eqNullSafe(s["_source"]))
                .groupBy(*[F.col("_source").alias("source") if c == "source" else F.col(c) for c in keys])
                .agg(F.sum(rate * F.col("size") * F.col("n")).alias("got"),
                     F.sum(F.when(raw < cap, rate * x * F.col("size") * F.col("n")).otherwise(0.0)).alias("slope"),
                     F.max(F.when(F.col("size") > 0, 1.0 / x)).alias("reach")))
        gap = F.col("target") - F.col("got")
        off = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        low = F.when(gap > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("high"))
        full = F.col("target") >= cap * F.col("source_size")  # every document at the cap
        top = F.coalesce(F.log(F.lit(cap)) * F.col("reach"), F.lit(0.0))
        newton = F.col("tilt") + gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        halved = F.when((low > -1e9) & (high < 1e9), (low + high) / 2).when(
            gap > 0, F.greatest(F.col("tilt") * 2, F.lit(1.0))).otherwise(F.least(F.col("tilt") * 2, F.lit(-1.0)))
        state = sums.select(
            "source", "source_size", "target", "mean",
            F.when(full, top).when(off <= tol, F.col("tilt")).when(inside, newton).otherwise(halved).alias("tilt"),
            low.alias("low"), high.alias("high"), F.when(full, 0.0).otherwise(off).alias("off"))
    else:
        raise RuntimeError(f"tilts of some sources have not converged after {steps} steps")
    return state.select("source", "source_size", "target", "mean", "tilt")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate, source for each row of ``docs``.

    Null texts have size 0 and are never taken; null sources are one source.
    Rows that share a doc_id are mixed each on its own (equal rows get equal
    draws, so equal copies).  An empty table gives an empty result.  Reruns agree:
    draws are hashes of the row.  ``cap`` must be a whole number.
    """
    slim = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")),
                  "sizes")
    sizes = staged(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size_counts")
    tilts = staged(solve_tilts(sizes, source_targets(sizes, weights, share, cap), cap), "tilts")
    t = tilts.withColumnRenamed("source", "_source")
    rate = F.least(F.lit(cap), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))))
    whole = F.floor(F.col("rate") + 1e-9)
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "source", "size"), F.lit(1 << 40)) / float(1 << 40)
    rated = (slim.join(t, slim["source"].eqNullSafe(t["_source"])).drop("_source")
             .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
             .withColumn("whole", whole)
             # documents in the order of draw - fraction: a fraction of 1 comes first, one of 0 has no further copy
             .withColumn("place", F.when(F.col("rate") - whole > 1e-9, (draw - (F.col("rate") - whole) + 1.0) / 2.0)))
    cuts = _cuts(rated)
    c = cuts.withColumnRenamed("source", "_source")
    out = rated.join(c, rated["source"].eqNullSafe(c["_source"]), "left").drop("_source")
    copies = F.col("whole") + F.when(F.col("place") < F.col("cut"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"),
                      copies.cast("long").alias("copies"), "rate", "source")


def _cuts(rated: DataFrame) -> DataFrame:
    """(source, cut): documents placed below the cut get one more copy, so that the tokens meet the target.

    First round: tokens in 1,024 bins of the place; the bin where the running
    sum passes what is missing is cut into 1,024 in the second round, and taken
    or left there, whichever comes nearer.
    """
    base = rated.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("base"))
    state = staged(base.select(F.col("source").alias("_source"), (F.col("target") - F.col("base")).alias("missing"),
                               F.lit(0.0).alias("cut")), "cuts")
    places = rated.filter(F.col("place").isNotNull()).select("source", "size", "place")
    width = 1.0
    for last in (False, True):
        width /= BINS
        bins = (places.join(state, F.col("source").eqNullSafe(F.col("_source")))
                .filter((F.col("place") >= F.col("cut")) & (F.col("place") < F.col("cut") + width * BINS))
                .withColumn("bin", F.floor((F.col("place") - F.col("cut")) / width))
                .groupBy("source", "missing", "bin").agg(F.sum("size").alias("tokens")))
        run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("tokens").over(run))  # 1,024 rows per source at most
        fits = F.col("upto") <= F.col("missing")
        if last:
            fits = fits | (F.col("upto") - F.col("missing") < F.col("missing") - (F.col("upto") - F.col("tokens")))
        found = bins.groupBy("source").agg(
            F.max(F.when(fits, F.col("upto"))).alias("upto"), F.max(F.when(fits, F.col("bin") + 1)).alias("end"),
            F.min(F.when(~fits, F.col("bin"))).alias("next"))
        state = staged(state.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "_source", (F.col("missing") - F.coalesce("upto", F.lit(0))).alias("missing"),
            (F.col("cut") + width * F.coalesce("next", "end", F.lit(0))).alias("cut")), "cuts")
    return state.select(F.col("_source").alias("source"), "cut")
