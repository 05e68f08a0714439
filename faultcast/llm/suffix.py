"""Suffix-array dedup (2): bytes covered by strings of ``width`` bytes that stand elsewhere too.

For every position, the longest previous factor (LPF) tells how long a string
starts there that also starts earlier; it is the larger of the common prefixes
with the previous and the next smaller position in suffix order.  Whether
LPF >= ``width`` only needs suffixes that agree on ``width`` bytes to stand
together, so suffixes are ordered by a fingerprint of their first ``width`` bytes
(a sparse suffix array): in a run of equal ones each member but the smallest has
a previous or next smaller position in the run, hence an LPF of ``width`` or
more.  ``keep="first"`` removes those; ``keep="none"`` also removes the smallest,
whose string starts again later.

To bring equal strings together without moving every position, each
``width``-byte window names its anchor: the ``GRAM``-byte string of least hash in
it.  Equal windows have equal anchors, neighbouring windows mostly share one, and
anchors that occur once are done with.  Only the surroundings of repeated
anchors are shuffled, by anchor.  Anchors that occur more than ``HOT`` times
go window by window instead, each task sending one row per different window, so
no anchor's surroundings gather in one task.  Documents with equal texts are one.

Passages are also named in words: of each ``span - passage + 1`` neighbouring runs
of ``passage`` words the one of least hash is a sample, so documents that have
``span`` words in common, whatever their bytes, have a sample in common, and
documents with a common sample have ``passage`` words in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, staged

WIDTH, GRAM = 400, 200
#: Words in common from which documents are told to share a passage, and below which they are not.
SPAN, PASSAGE = 51, 32
#: Occurrences of an anchor from which its windows are sent one by one.
HOT = 256
#: Positions hashed at a time.
SEGMENT = 1 << 20
#: Samples that are compared within a task before they are sent.
SAMPLES = 1 << 20
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)


class Powers:
    """Powers of the hash base and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=np.uint64)
        byte = np.arange(256, dtype=np.uint64) + np.uint64(1)
        byte = byte * np.uint64(0xBF58476D1CE4E5B9)
        self.byte = (byte ^ (byte >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)

    def sums(self, a: np.ndarray) -> np.ndarray:
        """Hash sums of the beginnings of ``a``."""
        n = len(a)
        if n > len(self.up):
            for name, base in (("up", _P), ("down", _INV)):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        c = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.byte[a] * self.up[:n], dtype=np.uint64, out=c[1:])
        return c

    def hashes(self, a: np.ndarray, width: int) -> np.ndarray:
        """Hash of each ``width``-byte string of ``a``."""
        c = self.sums(a)
        return self.spread((c[width:] - c[:-width]) * self.down[:len(a) - width + 1])

    @staticmethod
    def spread(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def anchors(raw: bytes, powers: Powers, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hashes, first window starts): windows from one start to the next have that anchor."""
    found, starts = [], []
    a = np.frombuffer(raw, dtype=np.uint8)
    low = np.uint64((1 << 21) - 1)
    for at in range(0, len(a) - width + 1, SEGMENT):
        h = powers.hashes(a[at:at + SEGMENT + width - 1], gram)
        # of equal hashes the last, which the window's bytes decide and not where it stands
        x = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        x = least_of(x, width - gram + 1)
        place = (low - (x & low)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        found.append(h[place[first]])
        starts.append(first + at)
    if not found:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(starts)


def least_of(x: np.ndarray, need: int) -> np.ndarray:
    """The least of each ``need`` neighbours."""
    size = 1
    while 2 * size <= need:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:-(need - size)], x[need - size:]) if size < need else x


def samples(raw: bytes, powers: Powers, span: int = SPAN, passage: int = PASSAGE) -> np.ndarray:
    """Different hashes of the sampled runs of ``passage`` words; white space between words does not count."""
    a = np.frombuffer(b" ".join(raw.split()), dtype=np.uint8)
    ends = np.append(np.flatnonzero(a == 32), len(a))
    starts = np.concatenate([[0], ends[:-1] + 1])
    found = [np.empty(0, dtype=np.uint64)]
    at = 0
    while at + span <= len(starts):
        # as many words as fit the segment, the last ones again in the next
        to = max(at + span, int(np.searchsorted(ends, starts[at] + SEGMENT)))
        to = min(to, len(starts))
        base = starts[at]
        c = powers.sums(a[base:ends[to - 1]])
        first, last = starts[at:to - passage + 1] - base, ends[at + passage - 1:to] - base
        found.append(np.unique(least_of(powers.spread((c[last] - c[first]) * powers.down[first]), span - passage + 1)))
        at = to - span + 1
    return np.unique(np.concatenate(found))


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs in sorted numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]


def removed(n: int, ranges: list[tuple[int, int]], width: int = WIDTH) -> list[tuple[int, int]]:
    """Maximal spans [from, to) that windows starting in the ranges (first, last) cover."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        end = min(b + width, n)
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((a, end))
    return spans


#: What travels by anchor: kind 0 the bytes around an anchor, 1 a window of a hot one, 2 ranges that are settled.
_SENT = ("kind int, anchor bigint, win bigint, ord bigint, k0 bigint, k1 bigint, k2 bigint, start int, last int, n int, "
         "bytes binary")
_NAMES = ["kind", "anchor", "win", "ord", "k0", "k1", "k2", "start", "last", "n", "bytes"]
_KINDS = [pa.int32(), *[pa.int64()] * 6, *[pa.int32()] * 3, pa.binary()]


def _scan(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(doc, k1, k2, size, anchors, starts); the last two once per different text and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for batch in batches:
            sizes, hashes, starts = [], [], []
            for k1, k2, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                if len(raw) < width or (k1, k2) in seen:
                    hashes.append(None)
                    starts.append(None)
                    continue
                seen.add((k1, k2))
                h, s = anchors(raw, powers, width, gram)
                hashes.append(h.view(np.int64))
                starts.append(s.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64())),
                 pa.array(starts, pa.list_(pa.int32()))], names=["doc", "k1", "k2", "size", "anchors", "starts"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "k1", "k2", "text").mapInArrow(
        run, f"doc {kind}, k1 bigint, k2 bigint, size bigint, anchors array<bigint>, starts array<int>")


def _surroundings(rows: DataFrame, width: int, first: bool) -> DataFrame:
    """What travels, from (ord, k0, k1, k2, text, places: array of (start, last, anchor, n))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out: list[tuple] = []
            hot: list[tuple[np.ndarray, ...]] = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            for row, (t, places) in enumerate(zip(batch.column(4), batch.column(5))):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                for p in places.as_py():
                    a, b = p["start"], p["last"]
                    part = raw[a:b + width]
                    if p["n"] <= HOT:
                        out.append((0, p["anchor"], 0, *keys[row], a, b, 1, part))
                        continue
                    w = powers.hashes(np.frombuffer(part, dtype=np.uint8), width)
                    hot.append((np.full(len(w), p["anchor"], dtype=np.int64), w.view(np.int64),
                                np.full(len(w), row, dtype=np.int64), np.arange(a, b + 1)))
            if hot:
                out += _settle_hot(hot, keys, first)
            for i in range(0, len(out), 20_000):
                part = out[i:i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], kind) for j, kind in enumerate(_KINDS)],
                                                 names=_NAMES)

    return rows.mapInArrow(run, _SENT)


def _settle_hot(hot: list[tuple[np.ndarray, ...]], keys: list[tuple], first: bool) -> list[tuple]:
    """One row per different window of the batch, and the ranges that are settled within it."""
    anchor, window, row, start = (np.concatenate(x) for x in zip(*hot))
    order = np.array([keys[r][0] for r in range(len(keys))], dtype=np.int64)[row]
    by = np.lexsort((start, row, order, window, anchor))
    anchor, window, row, start = anchor[by], window[by], row[by], start[by]
    opens = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])])
    size = np.bincount(np.cumsum(opens) - 1)
    many = size[np.cumsum(opens) - 1] > 1
    out = [(1, a, w, *keys[r], s, s, n, None) for a, w, r, s, n in
           zip(anchor[opens].tolist(), window[opens].tolist(), row[opens].tolist(), start[opens].tolist(), size.tolist())]
    settled = many & ~opens if first else many
    r, s = row[settled], start[settled]
    for k in np.unique(r):
        a, b = _ranges(np.unique(s[r == k]))
        out += [(2, keys[k][2], 0, *keys[k], x, y, 0, None) for x, y in zip(a.tolist(), b.tolist())]
    return out


def _resolve(sent: DataFrame, width: int, first: bool) -> DataFrame:
    """(k0, k1, k2, start, last): windows that stand elsewhere (``first``: earlier), from the rows by anchor and window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        def whole_groups() -> Iterator[pa.Table]:
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if size < 2_000_000:
                    continue
                t = pa.Table.from_batches(held)
                k = np.stack([t["anchor"].to_numpy(), t["win"].to_numpy()], axis=1)
                ends = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1))
                if len(ends):
                    yield t.slice(0, int(ends[-1]) + 1)
                    held = t.slice(int(ends[-1]) + 1).to_batches()
                    size = sum(b.nbytes for b in held)
            if held:
                yield pa.Table.from_batches(held)

        for t in whole_groups():
            kind, anchor, window, rank, start, last, n = (t[c].to_numpy() for c in
                                                          ("kind", "anchor", "win", "ord", "start", "last", "n"))
            hit_row, hit_from, hit_to = [np.flatnonzero(kind == 2)], [start[kind == 2]], [last[kind == 2]]
            one = np.flatnonzero(kind == 1)
            if len(one):
                by = one[np.lexsort((start[one], rank[one], window[one], anchor[one]))]
                opens = np.concatenate([[True], (anchor[by][1:] != anchor[by][:-1]) | (window[by][1:] != window[by][:-1])])
                group = np.cumsum(opens) - 1
                again = ~opens if first else np.bincount(group, weights=n[by])[group] > 1
                hit_row.append(by[again])
                hit_from.append(start[by[again]])
                hit_to.append(last[by[again]])
            near = np.flatnonzero(kind == 0)
            if len(near):
                parts = t["bytes"].take(pa.array(near)).to_pylist()
                size = np.array([len(x) for x in parts])
                offset = np.concatenate([[0], np.cumsum(size)[:-1]])
                hashes = powers.hashes(np.frombuffer(b"".join(parts), dtype=np.uint8), width)
                count = size - width + 1
                row = np.repeat(np.arange(len(near)), count)
                shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                suffix = hashes[offset[row] + shift]
                place = start[near][row] + shift
                # suffix order: by anchor and first bytes; in it, by position
                by = np.lexsort((place, rank[near][row], suffix, anchor[near][row]))
                s, g = suffix[by], anchor[near][row][by]
                opens = np.concatenate([[True], (s[1:] != s[:-1]) | (g[1:] != g[:-1])])
                smaller = ~opens  # a previous smaller position of equal first bytes: the LPF reaches the width
                again = smaller if first else smaller | np.concatenate([smaller[1:], [False]])
                mark = np.zeros(len(row), dtype=bool)
                mark[by[again]] = True
                step = np.flatnonzero(mark)
                if len(step):
                    cut = np.flatnonzero((np.diff(step) > 1) | (row[step][1:] != row[step][:-1]))
                    a, b = step[np.concatenate([[0], cut + 1])], step[np.concatenate([cut, [len(step) - 1]])]
                    hit_row.append(near[row[a]])
                    hit_from.append(place[a])
                    hit_to.append(place[b])
            rows = pa.array(np.concatenate(hit_row))
            yield pa.RecordBatch.from_arrays(
                [*(t[c].take(rows).combine_chunks() if len(rows) else pa.array([], pa.int64()) for c in ("k0", "k1", "k2")),
                 pa.array(np.concatenate(hit_from).astype(np.int32)), pa.array(np.concatenate(hit_to).astype(np.int32))],
                names=["k0", "k1", "k2", "start", "last"])

    d = sent.repartition("anchor", "win").sortWithinPartitions("anchor", "win")
    return d.mapInArrow(run, "k0 bigint, k1 bigint, k2 bigint, start int, last int")


def _ranked(places: DataFrame) -> DataFrame:
    """``places`` with ``ord``: whole numbers in the order of the owners, null last."""
    owner = F.col("_owner")
    order = owner.asc_nulls_last()
    ranks = staged(places.select("_owner").distinct().repartitionByRange(order).sortWithinPartitions(order)
                   .select(owner.alias("_ranked"), F.monotonically_increasing_id().alias("ord")), "owners")
    return places.join(ranks, owner.eqNullSafe(F.col("_ranked"))).drop("_ranked")


def shared_passages(docs: DataFrame, span: int = SPAN, passage: int = PASSAGE) -> DataFrame:
    """(tag), written: the rows (tag, text) that have ``span`` words in common with a row of another tag.

    Rows with ``passage`` to ``span`` words in common may be there too, rows with
    fewer are not.  A task settles the samples that it meets twice and sends each
    one once, so the rows of a sample are no more than the tasks' parts.  Tags are
    whole numbers of 62 bits: what is sent is twice the tag, or one more for a
    tag that is settled, which then stands in place of the sample.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            h = np.concatenate([np.empty(0, dtype=np.uint64), *[x for _, x in held]])
            tag = np.repeat(np.array([t for t, _ in held], dtype=np.int64), [len(x) for _, x in held])
            by = np.lexsort((tag, h))
            h, tag = h[by], tag[by]
            opens = np.concatenate([[True], h[1:] != h[:-1]])[:len(h)]
            start = np.flatnonzero(opens)
            end = np.append(start[1:], len(h))
            several = tag[start] != tag[end - 1] if len(h) else np.empty(0, dtype=bool)
            settled = np.unique(tag[np.repeat(several, end - start)])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h[start].view(np.int64), settled])),
                 pa.array(np.concatenate([2 * tag[start], 2 * settled + 1]))], names=["sample", "tag"])

        for batch in batches:
            for tag, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = samples(text.as_py(), powers, span, passage)
                if not len(x):
                    continue
                held.append((tag, x))
                size += len(x)
                if size >= limit:
                    yield send()
                    held, size = [], 0
        yield send()

    limit = SAMPLES
    sent = docs.select("tag", F.col("text").cast("binary")).mapInArrow(run, "sample bigint, tag bigint")
    order = Window.partitionBy("sample").orderBy("tag")
    near = sent.select("tag", F.lag("tag").over(order).alias("before"), F.lead("tag").over(order).alias("after"))
    found = near.filter("tag % 2 <> 0 or before <> tag or after <> tag")
    return staged(found.select(F.shiftright("tag", 1).alias("tag")).distinct(), "passages")


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
                     keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated_passage, spans per row of ``docs``.

    ``repeated_passage`` says whether the row shares a passage of over 50 words
    with another (always from 51 common words on, never below 32), also where it
    has fewer than ``width`` bytes, so that nothing is removed.

    ``keep="none"`` removes every byte covered by a ``width``-byte string that
    also starts anywhere else; ``"first"`` only where it starts earlier, in a
    smaller doc_id or before in the same text.  Strings are judged on the input.
    Null texts are empty.  Equal rows remove each other (all but one with
    ``"first"``, the one of the smallest doc_id; of equal ids too, all of them
    stay).  Null ids come last.  An empty table gives an empty result; other
    columns are not read.
    """
    first = keep == "first"
    d = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select("doc", F.xxhash64(F.lit(0), "doc").alias("k0"), F.xxhash64("text").alias("k1"),
                 F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    tag = F.shiftright(F.xxhash64("k0", "k1"), 2).alias("tag")
    shared = shared_passages(d.select(tag, "text"))
    scanned = staged(_scan(d, width, gram), "anchors")
    texts = scanned.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc").alias("owner"),
                                            F.max("size").alias("size"))
    texts = staged(texts.filter(F.col("size") >= width), "texts")
    once = scanned.filter(F.col("anchors").isNotNull()).select("k1", "k2", "anchors", "starts").dropDuplicates(["k1", "k2"])
    places = (once.join(texts, ["k1", "k2"])
              .select("owner", "k1", "k2", F.col("size").cast("int").alias("size"), "starts",
                      F.posexplode("anchors").alias("i", "anchor"))
              .select("owner", "k1", "k2", "anchor", F.get("starts", F.col("i")).alias("start"),
                      (F.coalesce(F.get("starts", F.col("i") + 1), F.col("size") - width + 1) - 1).alias("last")))
    places = staged(places, "anchor_places")
    often = places.groupBy("anchor").agg(F.count(F.lit(1)).cast("int").alias("n")).filter("n > 1")
    often = staged(often, "repeated_anchors")  # written, so that the join can split a frequent anchor's rows
    places = (places.join(often, "anchor").groupBy("owner", "k1", "k2")
              .agg(F.collect_list(F.struct("start", "last", "anchor", "n")).alias("places")))
    places = places.select(F.col("owner").alias("_owner"), F.xxhash64(F.lit(0), "owner").alias("k0"), "k1", "k2", "places")
    if isinstance(d.schema["doc"].dataType, T.IntegralType):
        order = F.coalesce(F.col("doc").cast("long"), F.lit((1 << 63) - 1))
    elif first:
        places, order = _ranked(places), F.col("ord")
    else:
        order = F.xxhash64("doc")  # any numbers
    # both joins of the texts read the same columns, so that they share one exchange
    near = d.join(places, ["k0", "k1", "k2"]).select(
        order.alias("ord"), "k0", "k1", "k2", "text", "places")
    if first:
        near = near.dropDuplicates(["k0", "k1", "k2"])  # rows that are equal wholly are one holder
    ranges = _resolve(_surroundings(near, width, first), width, first)
    ranges = ranges.groupBy("k0", "k1", "k2").agg(F.collect_list(F.struct("start", "last")).alias("ranges"))
    many = texts.filter("copies > 1")
    whole = scanned.join(many.select("k1", "k2", "owner"), ["k1", "k2"])
    if first:
        whole = whole.filter(~F.col("doc").eqNullSafe(F.col("owner")))
    whole = whole.select(F.xxhash64(F.lit(0), "doc").alias("k0"), "k1", "k2").distinct()
    none, yes, no = F.lit(None).cast("array<struct<start:int,last:int>>").alias("ranges"), F.lit(True), F.lit(False)
    keys = ["k0", "k1", "k2"]
    told = scanned.select(F.xxhash64(F.lit(0), "doc").alias("k0"), "k1", "k2").select("*", tag).join(shared, "tag")
    cuts = (ranges.select(*keys, "ranges", no.alias("whole"), no.alias("shared"))
            .unionAll(whole.select(*keys, none, yes, no)).unionAll(told.select(*keys, none, no, yes)))
    cuts = cuts.groupBy(*keys).agg(F.max("whole").alias("whole"), F.first("ranges", True).alias("ranges"),
                                   F.max("shared").alias("shared"))
    return _cut(d.join(cuts, ["k0", "k1", "k2"], "left"), width)


def _cut(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for t, whole, ranges in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                ranges = [(0, len(raw) - width)] if whole else [(r["start"], r["last"]) for r in ranges.as_py() or ()]
                spans = removed(len(raw), ranges, width)
                at, digest = 0, hashlib.sha256()
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                got.append((len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest(),
                            [{"start": a, "end": b} for a, b in spans]))
            shared = pa.array([bool(x) for x in batch.column(4).to_pylist()], pa.bool_())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds[:4])), shared,
                 pa.array([g[4] for g in got], kinds[4])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated_passage", "spans"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", "text", "whole", "ranges", "shared").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, repeated_passage boolean, "
             "spans array<struct<start:bigint,end:bigint>>")


ship(__name__)
