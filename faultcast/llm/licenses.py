"""License scans (8), native: exact set-similarity join of text blocks with license templates.

A block is a line, or (``block="run"``) a run of words of the whole text, twice as
long as the template, over line breaks; it is seen as the set of its words.  It
matches a template when it holds at least ``threshold`` of the template's words.
Words are ordered by their frequency in the whole corpus, the rarest first; then

* prefix filter: a match holds one of the template's first
  ``size - need + 1`` words, so only those are looked up;
* length filter: a block with fewer than ``need`` template words can't match;
* positional filter: from the first common word on, neither side may have too
  few words left.

What survives is verified by intersection.  Of the runs, those that hold a prefix
word and begin with a template word are met; any other holds no more.  One pass
over the texts keeps, per line, its template words, or all of them with their
places (written as a table); the frequencies are counted over
that table, and so is the join.  Only template words (their number is that of
the templates' words, not of the data) reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, staged

#: Phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Common license notices, by label.
TEMPLATES = {
    "all-rights-reserved": ["all rights reserved"],
    "apache": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "gpl": ["this work is licensed under the gnu general public license version 3"],
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
}
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _places(words: str, phrase: str, label: str) -> Column:
    """(start, label) of each place where the phrase's words stand one after another."""
    *first, last = phrase.split()
    n = len(first)

    def follows(hits: Column, k: int) -> Column:
        return F.filter(hits, lambda i: F.get(F.col(words), i + k) == first[k])

    hits = F.filter(F.transform(words, lambda w, i: F.when(w == last, i - n)), lambda i: i.isNotNull() & (i >= 0))
    for k in range(n):
        hits = follows(hits, k)
    return F.transform(hits, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def _ranked_index(d: DataFrame, words: DataFrame, rules: list[tuple], need: list[int], vocabulary: list[str]) -> tuple[DataFrame, list[str]]:
    """A row per prefix word of each template, and the template words by their frequency in ``words``, the rarest first."""
    counts = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per template word
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    index = []
    for k, (label, words_, run) in enumerate(rules):
        ranked = sorted(words_, key=order.index)
        index += [(k, label, len(words_), need[k], run, i, w, ranked) for i, w in enumerate(ranked[:len(words_) - need[k] + 1])]
    return d.sparkSession.createDataFrame(
        index, "rule int, label string, size int, need int, run int, place int, word string, template array<string>"), order


def _in_lines(d: DataFrame, rules: list[tuple], need: list[int], vocabulary: list[str]) -> DataFrame:
    """(row, label, share) of the lines that match."""
    blocks = d.select("row", F.posexplode("blocks").alias("block", "words"))
    index, order = _ranked_index(d, blocks.select(F.explode("words").alias("word")), rules, need, vocabulary)
    ranked = blocks.select("row", "block", F.array_intersect(_array(order), F.col("words")).alias("own"))
    ranked = ranked.select("row", "block", "own", F.posexplode("own").alias("at", "word"))
    left = F.least(F.col("size") - F.col("place"), F.size("own") - F.col("at"))
    # the index has a row per prefix word of a template: bounded by the templates
    return (ranked.join(F.broadcast(index), "word")
            .filter((F.size("own") >= F.col("need")) & (left >= F.col("need")))
            .withColumn("share", F.size(F.array_intersect("own", "template")) / F.col("size"))
            .filter(F.col("share") * F.col("size") >= F.col("need") - 1e-6))


def _in_runs(d: DataFrame, rules: list[tuple], need: list[int], vocabulary: list[str]) -> DataFrame:
    """(row, label, share) of the runs of words that match.

    From each prefix word, taken as the run's first in the order: the runs that
    hold it, seen as their words from it on in the order.
    """
    index, _ = _ranked_index(d, d.select(F.explode("hits.word").alias("word")), rules, need, vocabulary)
    prefix = sorted({r["word"] for r in index.select("word").collect()})  # bounded by the templates
    reach = max((run for *_, run in rules), default=1)
    places = F.filter(F.transform("hits", lambda h, i: F.when(h["word"].isin(prefix), i)), lambda i: i.isNotNull())
    # template words within the longest run: no more of them than its words on either side
    near = F.transform(places, lambda i: F.struct(
        F.get("hits", i)["at"].alias("at"), F.get("hits", i)["word"].alias("word"),
        F.slice("hits", F.greatest(i + 1 - reach, F.lit(1)), F.lit(2 * reach)).alias("near")))
    near = d.select("row", F.explode(near).alias("x")).select("row", "x.*")
    # the index has a row per prefix word of a template: bounded by the templates
    pairs = near.join(F.broadcast(index), "word").withColumn("tail", F.slice("template", F.col("place") + 1, F.col("size")))
    pairs = pairs.withColumn("near", F.filter("near", lambda h: (F.abs(h["at"] - F.col("at")) < F.col("run"))
                                              & F.array_contains("tail", h["word"])))
    pairs = pairs.filter(F.size(F.array_distinct("near.word")) >= F.col("need"))
    starts = F.filter("near", lambda h: h["at"] <= F.col("at"))
    held = F.array_max(F.transform(starts, lambda s: F.size(F.array_distinct(F.transform(
        F.filter("near", lambda h: (h["at"] >= s["at"]) & (h["at"] < s["at"] + F.col("run"))), lambda h: h["word"])))))
    return pairs.withColumn("held", held).filter(F.col("held") >= F.col("need")).withColumn("share", F.col("held") / F.col("size"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict = PHRASES,
                  templates: dict = TEMPLATES, threshold: float = 0.8, block: str = "line") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of ``docs``.

    ``score`` is 1 where a phrase stands, else the largest share of a template's
    words in a matching block, else 0.  Blocks are lines, or with ``block="run"``
    all runs of twice a template's words: a notice may be wrapped at any width, and
    words scattered over a long line are none.  A null text is empty: no words, no
    labels (empty strings).  Repeated rows give repeated results, an empty table
    an empty one; a null doc_id stays null.  Other columns are not read.
    """
    if block not in ("line", "run"):
        raise ValueError(f"block must be 'line' or 'run', not {block!r}")
    rules = [(label, sorted(set(t.split())), 2 * len(t.split())) for label, texts in sorted(templates.items()) for t in texts]
    vocabulary = sorted({w for _, words, _ in rules for w in words})
    need = [math.ceil(threshold * len(words) - 1e-9) for _, words, _ in rules]
    least = min(need, default=1)

    lower = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    d = docs.select(F.col(doc_id).alias("doc_id"), lower.alias("lower"))
    last_words = sorted({p.split()[-1] for p in phrases})
    likely = F.lit(False)
    for w in last_words:
        likely = likely | F.contains("lower", F.lit(w))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    if block == "run":
        d = d.select("doc_id", likely.alias("likely"), F.array_remove(F.split("lower", BREAK, -1), "").alias("all"))
        hits = F.filter(F.transform("all", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("word")))),
                        lambda h: h.isNotNull())
        d = d.select("doc_id", F.size("all").cast("long").alias("n_words"), F.when(F.col("likely"), F.col("all")).alias("words"),
                     hits.alias("hits"))
        own = F.when(F.size("hits") >= least, F.col("hits")).alias("hits")
    else:
        d = d.select("doc_id", likely.alias("likely"),
                     F.transform(F.split("lower", "\n", -1), lambda x: F.array_remove(F.split(x, BREAK, -1), "")).alias("lines"))
        lines = F.transform("lines", lambda b: F.array_intersect(_array(vocabulary), b))
        d = d.select("doc_id", F.aggregate("lines", F.lit(0).cast("long"), lambda a, b: a + F.size(b)).alias("n_words"),
                     F.when(F.col("likely"), F.flatten("lines")).alias("words"),
                     F.filter(lines, lambda b: F.size(b) >= least).alias("blocks"))
        own = F.col("blocks")
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", own,
                 F.coalesce(F.when(F.col("words").isNotNull(), F.concat(*[_places("words", p, label) for p, label in phrases.items()])), none).alias("base"))
    d = staged(d, "license_blocks")

    pairs = (_in_runs if block == "run" else _in_lines)(d, rules, need, vocabulary)
    found = pairs.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    all_ = F.array_sort(F.array_distinct(F.concat("base.label", F.coalesce("found", F.array().cast("array<string>")))))
    return d.join(found, "row", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(all_, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
