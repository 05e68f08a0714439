"""N-gram Jaccard join (9): shingle-group count vectors, packed R-trees, exact verification.

The method counts a document's five-word shingles in ``GROUPS`` hashed groups.
Two sets share at most the sum of the smaller counts of each group, so that sum
bounds their overlap; boxes of a packed R-tree over the count vectors bound it
for many documents at once.  What survives is verified on the shingles.

In so many dimensions a box of unrelated documents excludes nothing, so one
tree over a whole corpus would compare everything with everything.  The trees
are built over blocks that hold all links: a set that is 0.8 similar to another
shares one of its ``n - ceil(0.8 n) + 1`` first shingles, whatever order all sets
agree on.  The order has the shingles that repeat most in the corpus last (a
bounded list; it steers cost, not results).

1. One scan: fingerprint, size and count vector of every set (equal sets become
   one node), counts of repeating shingles.
2. One scan: (first shingle, node) rows, shuffled by shingle; each block links
   its neighbours in order of size and its leaders as candidates.
3. The bound on the count vectors sorts out candidates; a scan collects the
   shingles of what is left.
4. Each node's nearest candidate is verified; links make components.
5. Blocks that hold more than one component are searched in full by R-trees;
   only pairs from different components are verified, in rounds: each node's
   nearest partner, until that joins nothing more, then all that is left.  So
   every link is found or lies inside a component already, and no block gives
   out all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, ship, staged
from .graph import components

SHINGLE = 5
GROUPS = 256
#: Sets of more shingles have counts beyond a byte; their bound is taken as met.
WIDE = 30_000
#: Shingles put last in the order, at most (a broadcast of 2 MB).
FREQUENT = 262_144
#: Shingles of which a task counts the repeating ones at a time.
COUNTED = 2_000_000
#: Parts of the block of a frequent shingle in step 2; members of a block that one task compares in step 5.
SALTS, PART = 32, 1024
#: Rounds of step 5 that join each node to its nearest, before all pairs that are left.
ROUNDS = 1
#: Bits of the filter that step 3 tests nodes against; fixed, so its broadcast is 1 MB for any corpus.
FILTER_BITS = 1 << 23
TOP = np.uint64(1 << 63)
#: Bytes of texts whose shingles a task hashes at a time; a longer text stands alone.
BYTES_AT_ONCE = 500_000
#: In place of the words that a text of fewer than ``SHINGLE`` lacks.
FILL = np.uint64(0xD6E8FEB86659FD93)
#: Odd factors of a shingle's words.
FACTORS = tuple(np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(SHINGLE))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Words:
    """64-bit hashes of the words of a text's bytes, A-Z as a-z: a polynomial in an odd base over a value per byte, so that
    all words of a piece are sums over one array; mixed with the word's length at the end."""
    BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: powers differ in their low bits
    INVERSE = pow(BASE, -1, 1 << 64)
    PIECE = 1 << 18

    def __init__(self):
        small = np.arange(256, dtype=np.uint8)
        small[65:91] += 32
        self.blank = np.zeros(256, dtype=bool)
        self.blank[list(WS.encode())] = True
        self.value = _mix(small.astype(np.uint64) + np.uint64(1), 0x51ED270B)
        self.value[self.blank] = 0
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers, self.inverses = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, x, dtype=np.uint64))])
                                          for x in (self.BASE, self.INVERSE))

    def _piece(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.blank[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        if not len(start):
            return start, np.empty(0, dtype=np.uint64)
        self._reach(len(raw))
        terms = self.value[raw] * self.powers[:len(raw)]
        got = np.add.reduceat(terms, start) * self.inverses[start]
        return start, _mix(got + (end - start).astype(np.uint64), 0x2545F491)

    def ids(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(where it starts, hash) of each word; pieces end at white space, so only a longer word needs more memory."""
        raw = np.frombuffer(text, dtype=np.uint8)
        starts, ids, at = [], [], 0
        while at < len(raw):
            end = at + self.PIECE
            while end < len(raw) and not self.blank[raw[end]]:
                after = np.flatnonzero(self.blank[raw[end:end + self.PIECE]])
                end += int(after[0]) if len(after) else self.PIECE
            start, got = self._piece(raw[at:end])
            starts.append(start + at)
            ids.append(got)
            at = end
        if not ids:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        return np.concatenate(starts), np.concatenate(ids)


class Sets:
    """Sets of 63-bit shingle hashes of some texts: sorted values end to end, set i from ``start[i]`` on; fewer than
    five words are one shingle, none give none."""

    def __init__(self, texts: list[bytes], words: Words):
        at, ids = words.ids(b"\n".join(texts))
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        ends = np.searchsorted(at, np.cumsum(length))
        size = np.diff(ends, prepend=0)
        few = (size > 0) & (size < SHINGLE)
        if few.any():  # filled up with a hash that is no word's
            filled = np.where(few, SHINGLE, size)
            place = np.arange(len(ids)) + np.repeat(np.cumsum(filled) - filled - (ends - size), size)
            own, ids = ids, np.full(filled.sum(), FILL, dtype=np.uint64)
            ids[place], size = own, filled
        total = len(ids)
        places = max(total - SHINGLE + 1, 0)
        key = np.zeros(places, dtype=np.uint64)
        for i, factor in enumerate(FACTORS):
            key += ids[i:i + places] * factor
        key = _mix(key, 0x9E3779B97F4A7C15) >> np.uint64(1)
        first = np.cumsum(size) - size
        count = np.where(size > 0, size - SHINGLE + 1, 0)  # places over the end of a text are none of its shingles
        held = np.zeros(places + 1, dtype=np.int8)
        np.add.at(held, first[count > 0], 1)
        np.add.at(held, (first + count)[count > 0], -1)
        for a, n in zip(first.tolist(), count.tolist()):
            key[a:a + n].sort()
        held = np.cumsum(held[:-1], dtype=np.int8) > 0
        opens = np.zeros(places, dtype=bool)
        opens[first[count > 0]] = True
        held[1:] &= opens[1:] | (key[1:] != key[:-1])
        before = np.concatenate([[0], np.cumsum(held)])
        self.values = key[held]
        self.start = before[np.minimum(first, places)]
        self.n = before[np.minimum(first + count, places)] - self.start

    def __len__(self) -> int:
        return len(self.n)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.start[i]:self.start[i] + self.n[i]]

    def _sums(self, salt: int) -> np.ndarray:
        out = np.zeros(len(self), dtype=np.uint64)
        some = self.n > 0
        if some.any():
            out[some] = np.add.reduceat(_mix(self.values, salt), self.start[some])
        return out.view(np.int64)

    def nodes(self) -> np.ndarray:
        """A 64-bit sum over each set: its node id."""
        return self._sums(0x1234567)

    def marks(self) -> np.ndarray:
        """A second such sum, to check the first."""
        return self._sums(0x89ABCDEF0)

    def vectors(self) -> np.ndarray:
        """Counts of each set's shingles by group, a byte each."""
        at = np.repeat(np.arange(len(self)) * GROUPS, self.n) + (self.values & np.uint64(GROUPS - 1)).astype(np.int64)
        return np.minimum(np.bincount(at, minlength=len(self) * GROUPS), 255).astype(np.uint8).reshape(-1, GROUPS)

    def first(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, shingle): those of each set that one of 0.8 similarity must share one of; the top bit marks frequent ones."""
        if not len(self.values):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        s = self.values
        often = np.zeros(len(s), dtype=bool)
        if len(frequent):
            often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        owner = np.repeat(np.arange(len(self)), self.n)
        rare = np.concatenate([[0], np.cumsum(~often)])
        here = rare[:-1] - rare[self.start][owner]  # rare ones of the set before this place
        all_rare = (rare[self.start + self.n] - rare[self.start])[owner]
        place = np.where(often, all_rare + np.arange(len(s)) - self.start[owner] - here, here)
        wanted = place < (self.n - (4 * self.n + 4) // 5 + 1)[owner]
        return owner[wanted], np.where(often, s | TOP, s)[wanted]


def vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, GROUPS)


def _sets(column: pa.Array, words: Words) -> Iterator[tuple[int, Sets]]:
    """(row of the first, sets) of some texts of a column at a time, so that memory is bounded by them or the longest text."""
    held, start, size = [], 0, 0
    for i, t in enumerate(column.cast(pa.binary())):
        held.append(t.as_py() or b"")
        size += 300 + len(held[-1])
        if size > BYTES_AT_ONCE:
            yield start, Sets(held, words)
            held, start, size = [], i + 1, 0
    if held:
        yield start, Sets(held, words)


def _signed(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, node, mark, key of the row and, once per node and task, the count vector; and (shingle, n)
    of shingles that repeat among ``COUNTED`` or so in a task."""
    names = ["doc_id", "n", "node", "mark", "key", "vector", "shingle"]

    def repeated(kept: list[np.ndarray], ids: pa.DataType) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(kept), return_counts=True)
        value, count = value[count > 1], count[count > 1]
        none = pa.nulls(len(value), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(value), ids), pa.array(count.astype(np.int64)), none, none, none, pa.nulls(len(value), pa.binary()),
             _signed(value)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, kept, size, ids = Words(), set(), [], 0, None
        for batch in batches:
            ids = batch.column(0).type
            for start, sets in _sets(batch.column(1), words):
                nodes, counts, points = sets.nodes(), sets.n, sets.vectors()
                told: list[bytes | None] = [None] * len(sets)
                for i, node in enumerate(nodes.tolist()):
                    if counts[i] and node not in seen:
                        seen.add(node)
                        told[i] = points[i].tobytes()
                        kept.append(sets[i])
                        size += len(sets[i])
                if size > COUNTED:
                    yield repeated(kept, ids)
                    kept, size = [], 0
                rows = slice(start, start + len(sets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(counts), pa.array(nodes), pa.array(sets.marks()), batch.column(2)[rows],
                     pa.array(told, pa.binary()), pa.nulls(len(sets), pa.int64())], names=names)
        if kept:
            yield repeated(kept, ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, node bigint, mark bigint, key bigint, vector binary, shingle bigint")


def grouped(batches: Iterator[pa.RecordBatch], key: Callable[[pa.Table], np.ndarray], rows: int = 400_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups, ``rows`` at least except for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        k = key(t)
        ends = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1))
        if len(ends):
            cut = int(ends[-1]) + 1
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            n -= cut
    if n:
        yield pa.Table.from_batches(held)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


def _first_rows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(shingle, salt, node, n): the first shingles of each different set of a task; blocks of frequent ones in parts."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, often, seen = Words(), shared.value, set()
        for batch in batches:
            for _, sets in _sets(batch.column(0), words):
                nodes = sets.nodes()
                new = np.zeros(len(sets), dtype=bool)
                for i, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        seen.add(node)
                        new[i] = True
                owner, f = sets.first(often)
                owner, f = owner[new[owner]], f[new[owner]]
                node, size = nodes[owner], sets.n[owner].astype(np.int32)
                salt = np.where(f >= TOP, 1 + (node % SALTS), 0).astype(np.int32)
                for i in range(0, len(f), 200_000):
                    j = slice(i, i + 200_000)
                    yield pa.RecordBatch.from_arrays([_signed(f[j]), pa.array(salt[j]), pa.array(node[j]), pa.array(size[j])],
                                                     names=["shingle", "salt", "node", "n"])

    return docs.select("text").mapInArrow(run, "shingle bigint, salt int, node bigint, n int")


def _candidates(rows: DataFrame) -> DataFrame:
    """Of sorted blocks: kind 0, the rows (shingle, node, n) that have a partner of fitting size; kind 1, candidate pairs (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, lambda t: np.stack([_column(t, "shingle"), _column(t, "salt")], axis=1)):
            shingle, salt, n, node = (_column(t, c) for c in ("shingle", "salt", "n", "node"))
            order = np.lexsort((node, n, salt, shingle))
            shingle, salt, n, node = shingle[order], salt[order], n[order], node[order]
            block = np.concatenate([[0], np.cumsum((shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1]))])
            again = np.concatenate([[False], (block[1:] == block[:-1]) & (node[1:] == node[:-1])])
            shingle, salt, n, node, block = (x[~again] for x in (shingle, salt, n, node, block))
            fits = np.concatenate([(block[1:] == block[:-1]) & (5 * n[:-1].astype(np.int64) >= 4 * n[1:]), [False]])
            live = fits | np.concatenate([[False], fits[:-1]]) | (salt > 0)
            if not live.any():
                continue
            shingle, n, node, block = shingle[live], n[live], node[live], block[live]
            # a leader every time the size has grown beyond what its predecessor can link to
            opens = np.concatenate([[True], block[1:] != block[:-1]])
            start = np.maximum.accumulate(np.where(opens, np.arange(len(n)), 0))
            low = n[start]
            level = np.floor(np.log(n / low) / np.log(1.25) + 1e-9)
            lead = np.concatenate([[True], (block[1:] != block[:-1]) | (level[1:] != level[:-1])])
            leader = np.maximum.accumulate(np.where(lead, np.arange(len(n)), 0))
            before = np.arange(len(n)) - 1
            pairs = []
            for left in (leader, before):
                ok = (left >= 0) & (left != np.arange(len(n)))
                ok &= (block[left] == block) & (5 * n[left].astype(np.int64) >= 4 * n.astype(np.int64))
                pairs.append(np.stack([node[left[ok]], node[ok]], axis=1))
            p = np.sort(np.concatenate(pairs), axis=1)
            p = np.unique(p, axis=0) if len(p) else p
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n), np.int32)), pa.array(shingle), pa.array(node), pa.array(n)],
                names=["kind", "a", "b", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(p), np.int32)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(np.zeros(len(p), np.int32))],
                names=["kind", "a", "b", "n"])

    d = rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt")
    return d.mapInArrow(run, "kind int, a bigint, b bigint, n int")


def _node_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(node, n, shingles) of the nodes in ``wanted``, written.

    A scan that goes on with the rows whose key passes a filter of fixed size.
    A node's key is that of one row, but equal rows repeat, and other rows of the
    same text can pass by chance; a row per node is written.
    """
    place = F.pmod("key", F.lit(FILTER_BITS)).alias("place")
    live = nodes.join(wanted.select("node").distinct(), "node").select(place)
    bits = live.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()  # 1 MB in all, whatever the corpus
    table = np.zeros(FILTER_BITS // 8 + 2 * 4096, dtype=np.uint8)
    for r in bits:
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        table[r["bucket"] * 4096:r["bucket"] * 4096 + len(part)] = part
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, sent, bits = Words(), set(), set(), shared.value
        for batch in batches:
            picked = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                bucket, bit = bucket_of(key % FILTER_BITS)
                if key not in seen and bits[bucket * 4096 + bit // 8] >> (bit % 8) & 1:
                    seen.add(key)
                    picked.append(i)
            for _, sets in _sets(batch.column(1).take(pa.array(picked, pa.int64())), words):
                got = []
                for i, node in enumerate(sets.nodes().tolist()):
                    if node not in sent:
                        sent.add(node)
                        got.append((node, len(sets[i]), sets[i].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()),
                     pa.array([g[2] for g in got], pa.list_(pa.int64()))], names=["node", "n", "shingles"])

    sets = docs.select("key", "text").mapInArrow(run, "node bigint, n int, shingles array<bigint>")
    return staged(sets.dropDuplicates(["node"]), name)


def bucket_of(place: int) -> tuple[int, int]:
    """(bucket, bit) as Spark's bitmap functions number a value of 0 or more."""
    return (0, 0) if place == 0 else (1 + (place - 1) // 32768, (place - 1) % 32768)


def reaches(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether summed minima of counts leave a similarity of 0.8 possible: 9 * overlap >= 4 * (na + nb)."""
    met = 9 * np.minimum(a, b).sum(axis=-1, dtype=np.int64) >= 4 * (np.asarray(na, dtype=np.int64) + nb)
    return met | (np.maximum(na, nb) > WIDE)


class Tree:
    """Packed R-tree over count vectors: sorted by size and the most varied group, leaves of ``LEAF`` points, boxes as maxima."""
    LEAF = 16

    def __init__(self, points: np.ndarray, n: np.ndarray):
        axis = np.argsort(-points.astype(np.float32).var(axis=0))[:2]
        tile = max(1, int(np.sqrt(len(n) / self.LEAF))) * self.LEAF
        order = np.argsort(n, kind="stable")  # sort-tile: slabs by size, within them by the groups that vary most
        slab = np.empty(len(n), dtype=np.int64)
        slab[order] = np.arange(len(n)) // tile
        self.order = np.lexsort((points[:, axis[-1]], points[:, axis[0]], slab))
        starts = np.arange(0, len(n), self.LEAF)
        self.leaves = [self.order[i:i + self.LEAF] for i in starts]
        self.high = np.maximum.reduceat(points[self.order], starts, axis=0)
        self.least = np.minimum.reduceat(n[self.order], starts)
        self.most = np.maximum.reduceat(n[self.order], starts)

    def pairs(self, other: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves whose boxes leave a link possible."""
        for i, leaf in enumerate(self.leaves):
            fits = (5 * self.most[i].astype(np.int64) >= 4 * other.least) & (5 * other.most.astype(np.int64) >= 4 * self.least[i])
            fits &= reaches(self.high[i], other.high, self.least[i], other.least) | (np.maximum(self.most[i], other.most) > WIDE)
            if fits.any():
                yield leaf, np.concatenate([other.leaves[j] for j in np.flatnonzero(fits)])


def block_pairs(points: np.ndarray, n: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(i, j) between members ``left`` and ``right`` of a block: different components, similarity not excluded."""
    a = Tree(points[left], n[left])
    b = a if left is right else Tree(points[right], n[right])
    found = []
    for x, y in a.pairs(b):
        x, y = left[x], right[y]
        i, j = np.repeat(x, len(y)), np.tile(y, len(x))
        ok = root[i] != root[j]
        if left is right:
            ok &= i < j
        i, j = i[ok], j[ok]
        ok = reaches(points[i], points[j], n[i], n[j])
        found.append(np.stack([i[ok], j[ok]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)


def _search(rows: DataFrame, every: bool) -> DataFrame:
    """(a, b, near) from rows (shingle, i, j, part, node, root, n, vector), blocks (shingle, i, j) whole.

    Pairs from different components that the bound leaves: all of them, once
    (``every``), or each node a's nearest in each block.
    """
    def small(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All index pairs of the blocks, flat."""
        left, right = [], []
        for k in np.unique(size):
            at = start[size == k]
            i, j = np.triu_indices(k, 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, lambda t: np.stack([_column(t, c) for c in ("shingle", "i", "j")], axis=1), 50_000):
            key = np.stack([_column(t, c) for c in ("shingle", "i", "j")], axis=1)
            part, node, root, n = (_column(t, c) for c in ("part", "node", "root", "n"))
            points = vectors(t["vector"])
            start = np.flatnonzero(np.concatenate([[True], np.any(key[1:] != key[:-1], axis=1)]))
            size = np.diff(np.append(start, len(node)))
            found = []
            few = size <= 48
            if few.any():
                i, j = small(start[few], size[few])
                ok = (root[i] != root[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                for k in range(0, len(i), 200_000):
                    x, y = i[k:k + 200_000], j[k:k + 200_000]
                    ok = reaches(points[x], points[y], n[x], n[y])
                    found.append(np.stack([x[ok], y[ok]], axis=1))
            for s, m in zip(start[~few], size[~few]):
                at = np.arange(s, s + m)
                if key[s, 1] == key[s, 2]:
                    found.append(block_pairs(points, n, root, at, at))
                else:
                    found.append(block_pairs(points, n, root, at[part[at] == key[s, 1]], at[part[at] == key[s, 2]]))
            p = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            if not len(p):
                continue
            near = np.empty(len(p))
            for k in range(0, len(p), 200_000):
                x, y = p[k:k + 200_000].T
                near[k:k + 200_000] = 2.0 * np.minimum(points[x], points[y]).sum(axis=1, dtype=np.int64) / (n[x] + n[y])
            a, b = node[p[:, 0]], node[p[:, 1]]
            if every:
                a, b = np.minimum(a, b), np.maximum(a, b)
                by = np.lexsort((b, a))
                by = by[np.concatenate([[True], (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])])]
            else:
                a, b, near = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([near, near])
                by = np.lexsort((b, near, a))
                by = by[np.concatenate([a[by][1:] != a[by][:-1], [True]])]
            yield pa.RecordBatch.from_arrays([pa.array(a[by]), pa.array(b[by]), pa.array(near[by])], names=["a", "b", "near"])

    d = rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return d.mapInArrow(run, "a bigint, b bigint, near double")


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, near): the pairs that the summed minima leave, and the share of the smaller set that they allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = vectors(batch.column(4)), vectors(batch.column(5))
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            total, most = na + nb, np.minimum(x, y).sum(axis=1, dtype=np.int64)
            ok = pa.array(reaches(x, y, na, nb))
            yield pa.RecordBatch.from_arrays([*(c.filter(ok) for c in batch.columns[:2]), pa.array(2.0 * most / total).filter(ok)],
                                             names=["a", "b", "near"])

    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb"))
    d = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "va", "vb")
    return d.mapInArrow(run, "a bigint, b bigint, near double")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingles have 100 * intersection >= 80 * union."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    d = pairs.join(b, "b").join(a, "a")
    return d.filter(100 * both >= 80 * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _nearest(pairs: DataFrame) -> DataFrame:
    """(a, b): for each node a the nearest b, each pair once."""
    best = pairs.groupBy(F.col("a").alias("node")).agg(F.max_by("b", "near").alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _as_edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _dealt(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the blocks that hold several components, with roots and count vectors; large blocks in pairs of parts."""
    rooted = members.join(roots, "node", "left").select("shingle", "node", F.coalesce("root", "node").alias("root"))
    rooted = staged(rooted, "block_members")
    mixed = (rooted.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size"))
             .filter("x <> y").select("shingle", F.ceil(F.col("size") / PART).alias("parts")))
    mixed = staged(mixed, "mixed_blocks")  # written, so that the joins can split a frequent key's rows; so below
    return (rooted.join(mixed, "shingle").join(nodes.select("node", "n", "vector"), "node")
            .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select("shingle", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node",
                    "root", "n", "vector"))


def _rooted(links: DataFrame) -> DataFrame:
    return staged(components(links), "components")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key, n_shingles, first per row of ``docs``: first is (no id, doc_id, key) of its component's first row by id;
    null where there are no shingles."""
    d = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    d = d.withColumn("key", F.xxhash64("doc_id", "text"))
    scanned = staged(_scan(d), "sets_scanned")
    rows = scanned.filter("shingle is null")
    top = (scanned.filter("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
           .orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).select("shingle").toArrow())  # FREQUENT rows at most
    frequent = np.sort(top["shingle"].to_numpy().view(np.uint64))
    nodes = (rows.filter("n > 0").groupBy("node", "mark")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"),
                  F.min("key").alias("key"), F.max("n").alias("n"),
                  F.max("vector").alias("vector")))
    nodes = staged(nodes, "nodes")
    found = staged(_candidates(_first_rows(d, frequent)), "first_shingles")
    blocks = found.filter("kind = 0").select(F.col("a").alias("shingle"), F.col("b").alias("node"))
    near = staged(_bounded(found.filter("kind = 1").select("a", "b").distinct(), nodes), "candidates")
    sets = _node_sets(d, nodes, near.select(F.col("a").alias("node")).unionAll(near.select(F.col("b").alias("node"))), "sets")
    # first each node's nearest candidate
    links = staged(_verified(_nearest(near.select("a", "b", "near").unionAll(near.select(
        F.col("b").alias("a"), F.col("a").alias("b"), "near"))), sets), "links")
    roots = _rooted(links)

    # step 5: first the nearest of another component in rounds, as long as that joins some, then all that is left
    members = blocks.distinct()
    for k in range(ROUNDS):
        best = staged(_nearest(_search(_dealt(members, nodes, roots), False)), "nearest")
        if k == 0:
            # only nodes that the bound leaves a partner in another component; later there can be no others
            live = staged(best.select(F.col("a").alias("node")).unionAll(best.select(F.col("b").alias("node"))).distinct(), "live")
            sets = _node_sets(d, nodes, live, "live_sets")
            members = staged(members.join(live, "node"), "live_members")
        links = staged(_verified(best, sets), "links")
        if links.isEmpty():
            break
        roots = _rooted(_as_edges(roots).unionAll(links))
    rest = staged(_search(_dealt(members, nodes, roots), True).select("a", "b").distinct(), "rest")
    linked = components(_as_edges(roots).unionAll(_verified(rest, sets)))

    names = nodes.select("node", "mark", "first").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = staged(names, "node_roots")
    least = staged(names.groupBy("root").agg(F.min("first").alias("first")), "component_names")
    named = staged(names.drop("first").join(least, "root").select("node", "mark", "first"), "named_nodes")
    return rows.join(named, ["node", "mark"], "left").select("doc_id", "key", F.col("n").alias("n_shingles"), "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs``: groups of documents linked at 0.8 Jaccard similarity or more.

    Null texts and texts without words have no shingles, link with nothing and
    are their own component.  Equal rows are one node, so they share a component;
    rows that share a doc_id with different texts are nodes of their own.  A
    component is named by its smallest id that isn't null.  An empty table gives
    an empty result; other columns are not read.
    """
    return _grouped(docs, doc_id, text).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; all columns as they were.

    Rows are told apart by id and text: a text that is no near copy stays, whatever
    others bear its id.  Ids that are null come last; of equal rows one stays, the
    first by a hash of all columns.  Rows without words stay.
    """
    found = _grouped(docs, doc_id, text).filter(F.col("first").isNotNull())
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    found = staged(found.groupBy("doc_id", "key", is_first.alias("is_first")).agg(F.count(F.lit(1)).alias("n")), "row_places")
    lost, again = found.filter(~F.col("is_first")), found.filter(F.col("is_first") & (F.col("n") > 1))
    key = F.xxhash64(docs[doc_id], docs[text])

    def same(other: DataFrame):
        # columns of the frames themselves: names that both have do not meet
        return (key == other["key"]) & docs[doc_id].eqNullSafe(other["doc_id"])

    if again.isEmpty():
        return docs.join(lost, same(lost), "left_anti")
    row = F.struct(*[docs[c] for c in docs.columns])
    one = docs.join(again, same(again), "left_semi").select(docs[doc_id].alias("id"), key.alias("key"), row.alias("row")).groupBy(
        "id", "key").agg(F.min_by("row", F.md5(F.to_json("row", {"ignoreNullFields": "false"}))).alias("row")).select("row.*")
    gone = lost.unionAll(again)
    return docs.join(gone, same(gone), "left_anti").unionAll(one)


ship(__name__)
