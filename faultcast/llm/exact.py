"""Exact dedup (13), native: sorted digest runs merged up a tree, least verified identifiers kept at every level.

Each partition of the digest table is one run.  In a round, ``fan`` neighbouring
runs become one: the runs are exchanged by (merged run, digest), sorted and
walked in order, and of equal digests only the smallest identifier and the
number of rows go on.  What goes on is verified at every level: rows are one only
where the short digest, the SHA-256 of the text and its length are all equal, so
texts whose short digests collide stay apart.  A merged run is cut by digest over
all tasks, so no level, the last one included, gathers a run in one task, and a
text that a third of all rows share is one row a run from the first level on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Runs merged into one in a round.
FAN = 16
#: Groups of more than 1 / HOT_SHARE of all rows are joined back by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 4096
KEYS = ["short", "strong", "size"]


def digest_columns(text: str | Column) -> list[Column]:
    """short, strong, size of a text whose ASCII white space runs are one space each; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    normal = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return [F.xxhash64(normal).alias("short"), F.unhex(F.sha2(F.encode(normal, "UTF-8"), 256)).alias("strong"),
            F.octet_length(normal).alias("size")]


def merge_runs(runs: DataFrame, n_runs: int, fan: int = FAN) -> DataFrame:
    """(short, strong, size, least, n) of all runs, from (run, short, strong, size, least, n) with runs 0 to n_runs - 1.

    One round per power of ``fan``; each level is a written table.  ``least`` is a
    struct, so the aggregate walks sorted rows and holds one of them at a time.
    """
    while True:
        runs = (runs.withColumn("run", F.floor(F.col("run") / fan).cast("int")).groupBy("run", *KEYS)
                .agg(F.min("least").alias("least"), F.sum("n").alias("n")))
        n_runs = -(-n_runs // fan)
        if n_runs <= 1:
            return runs.drop("run")
        runs = staged(runs, "runs")


def _digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(run, address, doc, short, strong, size), written: an address per row tells wholly repeated rows apart."""
    d = docs.select(F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("address"),
                    F.col(doc_id).alias("doc"), *digest_columns(text))
    return staged(d, "digests")


def _repeated(digests: DataFrame, fan: int) -> DataFrame:
    """(short, strong, size, least, n), written, of the texts that stand in more than one row."""
    last = digests.agg(F.max("run").alias("run")).first()["run"]
    runs = digests.select("run", *KEYS, F.struct(F.col("doc").isNull().alias("absent"), "doc", "address").alias("least"),
                          F.lit(1).cast("long").alias("n"))
    return staged(merge_runs(runs, (last or 0) + 1, fan).filter("n > 1"), "repeated")


def _with_groups(rows: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``least`` and ``n`` of their group, null where a text stands alone."""
    big = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(repeated.filter(big))
    alone = rows.join(hot.select(*KEYS), KEYS, "left_anti")
    return rows.join(hot, KEYS).unionByName(alone.join(repeated.filter(~big), KEYS, "left"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 per row of ``docs``.

    Texts are equal when they are identical after each run of ASCII white space
    is one space; null texts are empty texts.  Of equal texts the row of the
    smallest id stays, null ids last; of wholly equal rows one stays.  An empty
    table gives an empty result; other columns are not read.
    """
    digests = _digests(docs, doc_id, text)
    out = _with_groups(digests, _repeated(digests, fan), digests.count())
    alone = F.col("n").isNull()
    return out.select(F.col("doc").alias("doc_id"), F.when(alone, F.col("doc")).otherwise(F.col("least.doc")).alias("keep_id"),
                      F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                      (alone | (F.col("least.address") == F.col("address"))).alias("kept"),
                      F.lower(F.hex("strong")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; of wholly equal (id, text) any one row stays."""
    digests = _digests(docs, doc_id, text)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("doc"), *digest_columns(docs[text]))
    out = _with_groups(rows, _repeated(digests, fan), digests.count())
    first = out.filter(F.col("n").isNotNull() & F.col("doc").eqNullSafe(F.col("least.doc")))
    return out.filter("n is null").select("row.*").unionAll(first.dropDuplicates(KEYS).select("row.*"))
