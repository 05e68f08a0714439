"""Line dedup (7), native: range-partitioned line hashes, first occurrence streamed, bitmaps returned.

A line's key is stripped and lower-cased; keys of ``min_chars`` code points or
more are hashed to 128 bits.  The occurrences (hash, document, position) are
range-partitioned and sorted by hash, then document from the largest down, then
position; a window with that very order walks each partition once, without a
further exchange, and marks where a new document begins.  A slice of the
document's hash stands between the hash and the document, so that a line of a
third of all documents is walked in ``slices`` parts by as many tasks; the parts'
counts (one row each) are summed.  The result is a keep bitmap per document, as
run lengths, not a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, lower_ascii, staged


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40,
                 min_docs: int = 5, slices: int = 64) -> DataFrame:
    """(doc, tag, dropped): of each document that loses lines, their positions in order.

    ``tag`` is a hash of the text: rows that share a doc_id count as one
    document but keep bitmaps of their own.  A null doc_id ranks below all
    others.  Documents without dropped lines have no row.
    """
    key = lower_ascii(F.btrim("line", F.lit(WS)))
    found = (docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("tag"),
                         F.posexplode(_lines(text)).alias("pos", "line"))
             .filter(F.char_length("line") >= min_chars)
             .select("doc", "tag", "pos", key.alias("key"))
             .filter(F.char_length("key") >= min_chars)
             .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "tag", "pos"))
    found = staged(found, "lines")
    down = F.col("doc").desc_nulls_last()
    part = F.pmod(F.xxhash64("doc"), F.lit(slices)).alias("slice")
    walk = Window.partitionBy("h1", "h2", "slice").orderBy(down, "pos")
    per_slice = (found.select("h1", "h2", part, "doc", "pos")
                 .repartitionByRange("h1", "h2", "slice")
                 .sortWithinPartitions("h1", "h2", "slice", down, "pos")
                 .select("h1", "h2", "doc", (F.row_number().over(walk) == 1).alias("opens"),
                         F.lag("doc").over(walk).alias("before"))
                 .filter(F.col("opens") | ~F.col("doc").eqNullSafe(F.col("before"))))
    common = (per_slice.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
              .filter(F.col("n") >= min_docs))
    common = staged(common, "common_lines")  # written, so that the join can split a frequent line's rows
    lost = (found.join(common, ["h1", "h2"])
            .filter(~F.col("doc").eqNullSafe(F.col("keeper"))))
    return lost.groupBy("doc", "tag").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def _runs(dropped: str, size: Column) -> Column:
    """(start, length) of the kept runs between the dropped positions."""
    ends = F.concat(F.col(dropped), F.array(size))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, kept) per row of ``docs``: the row as a struct, and n_lines, n_dropped, text (kept lines), runs (start, length)
    that stay.  In a struct, no column of ``docs`` can meet a name that is used here."""
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("id"), docs[text].alias("text"),
                    F.xxhash64(docs[text]).alias("mark"), F.split(F.coalesce(docs[text], F.lit("")), "\n", -1).alias("lines"))
    d = d.join(bitmaps, F.col("id").eqNullSafe(F.col("doc")) & (F.col("mark") == F.col("tag")), "left")
    runs = _runs("dropped", F.size("lines"))
    kept = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice("lines", r["start"] + 1, r["length"]))), "\n")
    return d.select("row", F.struct(
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(kept).alias("text"),
        F.when(F.col("dropped").isNotNull(), runs).alias("runs")).alias("kept"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256, keep_runs.

    Lines whose key stands in ``min_docs`` documents or more go, except in the
    largest doc_id that holds it (there all of them stay).  Null and empty texts
    are one empty line.  Repeated rows give repeated results; an empty table
    gives an empty one.  Other columns are not read.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = apply_bitmaps(d, keep_bitmaps(d, **limits))
    return out.select("row.doc_id", "kept.n_lines", "kept.n_dropped",
                      F.sha2(F.encode("kept.text", "UTF-8"), 256).alias("kept_sha256"),
                      F.col("kept.runs").alias("keep_runs"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with the kept lines as text; ``n_chars``, where there is one, follows."""
    d = apply_bitmaps(docs, keep_bitmaps(docs, doc_id, text, **limits), doc_id, text)
    changed, row = F.col("kept.n_dropped") > 0, F.col("row")
    new = {text: F.when(changed, F.col("kept.text")).otherwise(row[text])}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.char_length("kept.text").cast(kind)).otherwise(row["n_chars"])
    return d.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])
