"""Benchmark decontamination (4): pigeonhole pieces, Aho-Corasick hits, Myers' bit-parallel verification.

An item may stand in a document with up to ``e = rate * length`` character
edits.  Cut into ``e + 1`` pieces, at least one of them stands there unchanged,
so exact piece hits find every candidate; each hit says where the item would
lie, give or take e, and Myers' algorithm (a text character per step, the whole
column of the dynamic programme in one integer) gives the least distance there.

The test items are a stated query set against all documents: they are taken in
blocks of ``block_bytes`` at most, each a scan of the documents with the block's
automaton broadcast.  Documents are never shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ship

RATE = 0.05
BLOCK_BYTES = 8 << 20


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of ``pattern`` in ``text``, the first of equals; None beyond ``most``."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        more = down | (full & ~(d0 | up))
        less = up & d0
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        more <<= 1
        less <<= 1
        up = full & (less | ~(d0 | more))
        down = more & d0 & full
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if score == 0:
                break
    return best


class Matcher:
    """Finds test items in texts; built once per task."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = items
        self.budget = [int(rate * len(text)) for _, text in items]
        at = defaultdict(list)
        for k, (_, text) in enumerate(items):
            pieces = self.budget[k] + 1
            cuts = [len(text) * i // pieces for i in range(pieces + 1)]
            for a, b in zip(cuts, cuts[1:]):
                at[text[a:b]].append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def __call__(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, least distance) of the items that stand in the text."""
        t = normal(text)
        if self.empty or not t:
            return []
        starts = defaultdict(set)
        for end, (size, places) in self.automaton.iter(t):
            for k, offset in places:
                starts[k].add(end + 1 - size - offset)
        found = []
        for k, where in starts.items():
            (item, pattern), e = self.items[k], self.budget[k]
            best = None
            low = high = None
            for s in [*sorted(where), None]:  # neighbouring starts are one window
                if high is not None and (s is None or s > high + 2 * e + 1):
                    got = myers(pattern, t[max(0, low - e):high + len(pattern) + e], e)
                    if got and (best is None or got[0] < best):
                        best = got[0]
                    low = None
                if s is not None:
                    low, high = s if low is None else low, s
                if best == 0:
                    break
            if best is not None:
                found.append((item, best))
        return found


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int, null_ids: bool) -> Iterator[list[tuple[int | None, str]]]:
    """The normalised items with a text, at most about ``block_bytes`` of them on the driver at a time."""
    d = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(2 * size / block_bytes))
    for k in range(n):
        rows = d.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n > 1 else d.collect()
        block = sorted({(r["item_id"], normal(r["text"])) for r in rows if null_ids or r["item_id"] is not None},
                       key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1]))
        yield [(i, t) for i, t in block if t]


def find_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES,
               null_ids: bool = False) -> DataFrame:
    """(doc_id, item_id, distance): every item that stands in a document's whole text within its error budget.

    Case and white space don't count.  Items without words match nothing, items
    without an id only with ``null_ids`` (their rows have a null item_id; one for
    each different text); items of few characters have a budget of 0.  Equal items under
    several ids are found under each; repeated documents give repeated rows.
    Null and empty texts, and empty tables, give none.
    """
    d = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind, item_kind = d.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType
    arrow_kind = to_arrow_type(item_kind)
    out = None
    for block in _blocks(items, item_id, item_text, block_bytes, null_ids):
        shared = d.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows = [(i, *hit) for i, t in enumerate(batch.column(1)) for hit in matcher(t.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                     pa.array([r[1] for r in rows], arrow_kind), pa.array([r[2] for r in rows], pa.int32())],
                    names=["doc_id", "item_id", "distance"])

        part = d.mapInArrow(run, f"doc_id {kind}, item_id {item_kind.simpleString()}, distance int")
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item stands, with an id or without; a scan per block of items, nothing is shuffled."""
    at = docs.columns.index(text)
    for block in _blocks(items, item_id, item_text, block_bytes, True):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ship(__name__)
