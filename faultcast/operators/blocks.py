"""Ordered windows over a series without keys, block by block.

A window without PARTITION BY sends the whole series to one task. Here the
series is cut into ranges of its order column and every block gets the rows of
earlier blocks that its windows look at (its halo): the last ``back`` rows
before it and, for windows by season, the last earlier row of each season. A
window partitioned by the block then sees for each row what it would see in
the whole series, and the halo rows are dropped after it.

    b = split(df, "date", least=14)            # staged, adds the block column
    h = with_halo(b, "date", back=14, carry="season")
    x = drop_halo(assign(h, window expressions with keys=[BLOCK]))

The order column must be unique, as on daily grain: equal values have no order
in a window either. Nulls come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The block of a row: a number as text, so that it counts as no feature.
BLOCK = "_block"
HALO = "_halo"
#: Rows that are worth a block of their own.
WORTH = 10_000
#: Metadata of the block column: the number of the last block.
LAST = "last_block"


def split(df: DataFrame, order: str, least: int, blocks: int | None = None) -> DataFrame:
    """``df`` staged in ranges of ``order``, numbered by the column BLOCK.

    ``blocks`` ranges of about equal size, as Spark samples them; neighbours are
    put together until every block but the last has at least ``least`` rows, so
    that a block's last ``least`` rows are all that the next one looks back at.
    By default there are as many ranges as shuffle partitions, or as adaptive
    execution makes of them by size, and blocks have ``WORTH`` rows or more,
    below which a task costs more than its rows. The result of no window
    depends on it. The driver sees one count per range.
    """
    from faultcast.session import stage

    least = max(least, 1 if blocks else WORTH)
    by = F.col(order).asc_nulls_first()
    ranges = df.repartitionByRange(blocks, by) if blocks else df.repartitionByRange(by)
    x = stage(ranges.withColumn("_range", F.spark_partition_id()))
    counts = dict(x.groupBy("_range").count().collect())
    label, labels, rows = 0, [], 0
    for i in range(max(counts, default=0) + 1):
        labels.append(label)
        rows += counts.get(i, 0)
        if rows >= least:
            label, rows = label + 1, 0
    numbers = F.array(*[F.lit(v) for v in labels])
    block = F.get(numbers, F.col("_range")).cast("string").alias(BLOCK, metadata={LAST: labels[-1]})
    return x.select("*", block).drop("_range")


def with_halo(df: DataFrame, order: str, back: int, carry: str | None = None) -> DataFrame:
    """The rows of ``split`` and, marked by HALO, copies of those that later blocks look back at.

    ``back`` may not exceed the ``least`` of the split. ``carry``: also the last
    earlier row of each value of this column, however many blocks ago.
    """
    number = F.col(BLOCK).cast("int")
    top = df.schema[BLOCK].metadata.get(LAST)
    if top is None:  # lost on the way, by a union say
        top = df.agg(F.max(number)).first()[0] or 0
    rows = df.withColumn(HALO, F.lit(False))
    if top == 0:
        return rows
    last = F.col(order).desc_nulls_last()
    rn = F.row_number().over(Window.partitionBy(BLOCK).orderBy(last))
    halo = (df.withColumn("_rn", rn).filter((F.col("_rn") <= back) & (number < top)).drop("_rn")
            .withColumn(BLOCK, (number + 1).cast("string")))
    if carry:
        rn = F.row_number().over(Window.partitionBy(BLOCK, carry).orderBy(last))
        ends = df.withColumn("_rn", rn).filter(F.col("_rn") == 1).drop("_rn")
        # a row serves every block up to the next one that has its value; none beyond the last block
        until = F.lead(number).over(Window.partitionBy(carry).orderBy(number))
        ends = (ends.withColumn("_until", F.coalesce(until, F.lit(top))).filter(F.col("_until") > number)
                .withColumn(BLOCK, F.explode(F.sequence(number + 1, F.col("_until")).cast("array<string>"))).drop("_until"))
        halo = halo.unionByName(ends).dropDuplicates([BLOCK, order])
    return rows.unionByName(halo.withColumn(HALO, F.lit(True)))


def drop_halo(df: DataFrame) -> DataFrame:
    """The rows of the series itself, still with their block."""
    return df.filter(~F.col(HALO)).drop(HALO)
