"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b), loops ignored.

    Large-star and small-star rounds: every node hands its larger, then its
    smaller neighbours to the smallest one, until the edges are stars.  A node
    with very many neighbours is only a sum (its minimum) and the larger side of
    a join that adaptive execution splits.  Each round is a written table.
    """
    def large(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join can split the edges of a frequent end
        least = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        # a is the larger end of each edge; large stars have left it few neighbours
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = staged(tidy(edges), "edges")
    for _ in range(rounds):
        e = staged(tidy(small(tidy(large(e)))), "edges")
        # stars: every larger end once, and none of them the smaller end of an edge
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("w")).unionAll(e.select(F.col("b").alias("x"), F.lit(0).alias("w")))
        if ends.groupBy("x").agg(F.sum("w").alias("n"), F.min("w").alias("m")).filter("n > 1 or (n = 1 and m = 0)").isEmpty():
            break
    else:
        raise RuntimeError("components: the edges did not settle")
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.unionAll(out.select(F.col("root").alias("node"), "root").distinct())
