"""Source divergence audit (11): exact term counts per group through broadcast minimal perfect hashes.

First pass: the number of documents of each (language, term), summed exactly; terms
in ``min_docs`` documents stay.  The kept terms of a language are split into shards
by their hash, and tasks build one minimal perfect hash per shard: terms are dealt
into buckets, and each bucket, large ones first, gets the first displacement that
sends its terms to free slots.  The terms themselves are stored in slot order.

Second pass: shards are broadcast in blocks of at most ``block_bytes``, the corpus
is read once per block, and each kept term found (the stored term must be equal)
adds to a dense slot of its group; a task holds ``DENSE`` bytes of slots at most and
sends the filled ones on when it needs room.

Probabilities are whole numbers, so all sums are exact.  The distance of two sources
is V times the distance of their empty probabilities plus corrections at the terms
either one has: tiles of source blocks and term blocks, each a bounded matrix.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ship, staged

#: Bytes of terms, A-Z lowered; every other byte separates.
TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Terms per perfect hash, and per bucket of it.
SHARD, BUCKET = 2048, 4
#: Bytes of shards broadcast at a time.
BLOCK_BYTES = 32 << 20
#: Different terms a task counts before it looks them up or sends them on; bytes of its dense slots.
PENDING, DENSE = 200_000, 64 << 20
#: Sources and terms of a tile.
TILE_SOURCES, TILE_TERMS = 64, 4096
ONE = 1_000_000_000
_SEED = 42  # of Spark's xxhash64


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(TERM_BYTES).split()


def mixed(h: np.ndarray, d) -> np.ndarray:
    """``h`` mixed with the displacement ``d``."""
    with np.errstate(over="ignore"):
        x = h ^ (np.asarray(d, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement per bucket, slot per key) of different 64-bit hashes: every slot below len(h) is taken once."""
    n = len(h)
    n_buckets = -(-n // BUCKET)
    bucket = (mixed(h, 1 << 40) % np.uint64(n_buckets)).astype(np.int64)
    shift, slot, taken = np.zeros(n_buckets, dtype=np.uint32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for b in np.argsort(-sizes, kind="stable"):
        own = order[starts[b]:starts[b + 1]]
        if not len(own):
            break
        for base in range(0, 1 << 32, 256):
            tries = (mixed(h[own][None, :], np.arange(base, base + 256)[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[tries].any(axis=1)
            if len(own) > 1:
                ranked = np.sort(tries, axis=1)
                free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            hit = np.flatnonzero(free)
            if len(hit):
                shift[b], slot[own] = base + hit[0], tries[hit[0]]
                taken[tries[hit[0]]] = True
                break
    return shift, slot


def term_hash(lang: bytes, term: bytes) -> int:
    """Spark's xxhash64(lang, term) as an unsigned number."""
    return xxh64_intdigest(term, xxh64_intdigest(lang, _SEED))


def _rows(same: dict[str, bytes], own: pa.Array, n) -> pa.RecordBatch:
    """Terms and their numbers under the same language (and source)."""
    same = {name: pa.repeat(pa.scalar(value.decode(), pa.string()), len(own)) for name, value in same.items()}
    return pa.RecordBatch.from_arrays([*same.values(), own, pa.array(n, pa.int64())], names=[*same, "term", "n"])


def _term_frequency(docs: DataFrame) -> DataFrame:
    """(lang, term, n): documents of the language that hold the term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, Counter] = {}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for lang, c in found.items():
                yield _rows({"lang": lang}, pa.array(list(c), pa.binary()).cast(pa.string()), list(c.values()))
            found.clear()

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
                c = found.setdefault(lang, Counter())
                before = len(c)
                c.update(set(terms(raw.as_py())))
                size += len(c) - before
                if size > limit:
                    yield from send()
                    size = 0
        yield from send()

    limit = PENDING
    return docs.mapInArrow(run, "lang string, term string, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def build_shards(kept: DataFrame, per_shard: int = SHARD) -> DataFrame:
    """(lang, shard, n_shards, n, shifts, ends, keys), written: a minimal perfect hash per shard of (lang, term).

    ``keys`` are the terms in slot order, ``ends`` where each one ends.
    """
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang = key[0].as_py().encode()
        own = [t.encode() for t in rows["term"].to_pylist()]
        shift, slot = perfect_hash(np.array([term_hash(lang, t) for t in own], dtype=np.uint64))
        ordered = [b""] * len(own)
        for t, s in zip(own, slot.tolist()):
            ordered[s] = t
        return pa.table({"lang": [key[0].as_py()], "shard": pa.array([key[1].as_py()], pa.int64()),
                         "n_shards": pa.array([rows["n_shards"][0].as_py()], pa.int64()), "n": pa.array([len(own)], pa.int64()),
                         "shifts": pa.array([shift.tobytes()], pa.binary()),
                         "ends": pa.array([np.cumsum([len(t) for t in ordered]).astype(np.int64).tobytes()], pa.binary()),
                         "keys": pa.array([b"".join(ordered)], pa.binary())})

    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / per_shard).alias("n_shards"))
    dealt = kept.join(sizes, "lang").select("lang", "term", "n_shards", F.pmod(
        F.xxhash64("lang", "term"), F.col("n_shards")).alias("shard"))
    return staged(dealt.groupBy("lang", "shard").applyInArrow(
        run, "lang string, shard bigint, n_shards bigint, n bigint, shifts binary, ends binary, keys binary"), "shards")


def blocks(shards: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """``shards`` in parts of at most ``block_bytes`` (a single shard may be larger: one enormous term)."""
    size = F.octet_length("shifts") + F.octet_length("ends") + F.octet_length("keys")
    total = shards.agg(F.sum(size), F.count(F.lit(1))).first()
    if not total[1]:
        return []
    n = max(1, -(-total[0] // block_bytes))
    while True:
        block = F.pmod(F.xxhash64("lang", "shard", F.lit(n)), F.lit(n))
        worst = shards.groupBy(block.alias("block")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).filter("n > 1").agg(
            F.max("bytes")).first()[0] or 0
        if worst <= block_bytes:
            return [shards.filter(block == b) for b in range(n)]
        n *= 2


def packed(block: DataFrame) -> dict:
    """A block as plain arrays per language, for the broadcast; its size is bounded by :func:`blocks`."""
    out: dict = {}
    rows = sorted(block.collect(), key=lambda r: (r["lang"], r["shard"]))
    for r in rows:
        x = out.setdefault(r["lang"].encode(), {"n_shards": r["n_shards"], "shards": {}, "size": 0})
        x["shards"][r["shard"]] = (x["size"], r["n"], np.frombuffer(r["shifts"], dtype=np.uint32),
                                   np.concatenate([[0], np.frombuffer(r["ends"], dtype=np.int64)]), bytes(r["keys"]))
        x["size"] += r["n"]
    return out


def lookup(x: dict, lang: bytes, found: list[bytes]) -> np.ndarray:
    """Slot of each term in the language's part of a block; -1 where the stored term is another or the shard is not here."""
    h = np.fromiter((term_hash(lang, t) for t in found), dtype=np.uint64, count=len(found))
    # Spark's pmod of the signed hash
    shard = np.mod(h.view(np.int64), np.int64(x["n_shards"]))
    out = np.full(len(found), -1, dtype=np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        if not len(own) or int(shard[own[0]]) not in x["shards"]:
            continue
        start, n, shifts, ends, keys = x["shards"][int(shard[own[0]])]
        bucket = (mixed(h[own], 1 << 40) % np.uint64(len(shifts))).astype(np.int64)
        slot = (mixed(h[own], shifts[bucket]) % np.uint64(n)).astype(np.int64)
        for i, s, lo, hi in zip(own.tolist(), slot.tolist(), ends[slot].tolist(), ends[slot + 1].tolist()):
            if keys[lo:hi] == found[i]:
                out[i] = start + s
    return out


def _recount(docs: DataFrame, block: DataFrame) -> DataFrame:
    """(lang, source, term, n) partial counts of the block's terms."""
    sent = docs.sparkSession.sparkContext.broadcast(packed(block))
    pending_limit, dense_limit = PENDING, DENSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        pending: dict[tuple, Counter] = {}
        slots: dict[tuple, np.ndarray] = {}
        names: dict[bytes, pa.Array] = {}
        known: dict[bytes, dict[bytes, int]] = {}
        size = 0

        def add() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in pending.items():
                at = slots_of(lang, c)
                hit = at >= 0
                if not hit.any():
                    continue
                if (lang, source) not in slots:
                    if 8 * (table[lang]["size"] + sum(map(len, slots.values()))) > dense_limit:
                        yield from send()
                    slots[lang, source] = np.zeros(table[lang]["size"], dtype=np.int64)
                # terms are different, so slots are
                slots[lang, source][at[hit]] += np.fromiter(c.values(), dtype=np.int64, count=len(c))[hit]
            pending.clear()

        def slots_of(lang: bytes, c: Counter) -> np.ndarray:
            """Slots of the counter's terms; those of a language's terms are remembered from source to source."""
            seen = known.setdefault(lang, {})
            new = [t for t in c if t not in seen]
            if len(seen) + len(new) > pending_limit:
                seen.clear()
                new = list(c)
            seen.update(zip(new, lookup(table[lang], lang, new).tolist()))
            return np.fromiter(map(seen.__getitem__, c), dtype=np.int64, count=len(c))

        def send() -> Iterator[pa.RecordBatch]:
            for (lang, source), dense in slots.items():
                if lang not in names:
                    names[lang] = pa.array([keys[lo:hi] for _, _, _, ends, keys in table[lang]["shards"].values()
                                            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()).cast(pa.string())
                filled = np.flatnonzero(dense)
                yield _rows({"lang": lang, "source": source}, names[lang].take(pa.array(filled)), dense[filled])
            slots.clear()

        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if lang not in table:
                    continue
                c = pending.setdefault((lang, source), Counter())
                before = len(c)
                c.update(terms(raw.as_py()))
                size += len(c) - before
                if size > pending_limit:
                    yield from add()
                    size = 0
        yield from add()
        yield from send()

    return docs.mapInArrow(run, "lang string, source string, term string, n bigint")


def _probability(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(ONE * (count + 5) / (total + 5 v)), exact: decimals of 38 digits."""
    wide = "decimal(38,0)"
    top = F.lit(ONE).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top.cast(wide), (total + 5 * v).cast(wide))


def group_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30,
                 block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, source, term, n) of kept terms that occur, (lang, source, total, v) of all groups), both written."""
    zero = F.lit(0).cast("long")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    raw = d.select(*[F.col(c).cast("binary").alias(c) for c in ("lang", "source", "text")])
    kept = staged(_term_frequency(raw).filter(F.col("n") >= min_docs).select("lang", "term"), "kept_terms")
    parts = None
    for block in blocks(build_shards(kept), block_bytes):
        p = staged(_recount(raw, block), "recount")
        parts = p if parts is None else parts.unionAll(p)
    if parts is None:
        parts = docs.sparkSession.createDataFrame([], "lang string, source string, term string, n bigint")
    counts = staged(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "group_counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = d.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(v, "lang", "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"))
    return counts, staged(groups, "groups")


def _tiles(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, more): what the terms that either source has add to the distance of empty probabilities."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        s, t = rows["source"].combine_chunks().dictionary_encode(), rows["term"].combine_chunks().dictionary_encode()
        si, ti = s.indices.to_numpy(zero_copy_only=False), t.indices.to_numpy(zero_copy_only=False)
        names, n_terms = s.dictionary.to_pylist(), len(t.dictionary)
        p0, side = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        p0[si] = rows["p0"].to_numpy()
        side[si] = rows["block"].to_numpy()
        m = np.repeat(p0[:, None], n_terms, axis=1)
        m[si, ti] = rows["p"].to_numpy()
        out: list[tuple] = []
        for a in range(len(names)):
            gap = np.abs(m[a] - m).sum(axis=1) - n_terms * np.abs(p0[a] - p0)
            # tile (i, i) has every pair of its block, tile (i, j) those of different blocks
            out += [(names[a], names[b], int(gap[b])) for b in range(len(names))
                    if a != b and (i == j or side[a] != side[b])]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out), pa.string()),
                         "source": pa.array([r[0] for r in out], pa.string()), "item": pa.array([r[1] for r in out], pa.string()),
                         "more": pa.array([r[2] for r in out], pa.int64())})

    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_SOURCES).alias("n_blocks"))
    g = groups.filter("v > 0").join(sizes, "lang").select(
        "lang", "source", "total", "v", "n_blocks", F.pmod(F.xxhash64("source"), "n_blocks").alias("block"),
        _probability(F.lit(0), F.col("total"), F.col("v")).alias("p0"))
    n_parts = F.ceil(F.col("v") / TILE_TERMS)
    # an empty term that no source has brings every source into every tile
    every = g.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1))).select(
        "lang", "source", "block", "n_blocks", "p0", F.lit("").alias("term"), F.col("p0").alias("p"), "part")
    rows = (counts.join(g, ["lang", "source"])
            .select("lang", "source", "block", "n_blocks", "p0", "term", _probability(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                    F.pmod(F.xxhash64("term"), n_parts).alias("part"))
            .unionByName(every)
            .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
            .select("lang", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "part", "source", "term",
                    "block", "p", "p0"))
    tiles = rows.groupBy("lang", "i", "j", "part").applyInArrow(run, "lang string, source string, item string, more bigint")
    return tiles.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))


def divergence_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30,
                     top: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank, p, q per pair of a language's sources and per leading term of a source.

    Null text, language and source are ''.  Part ``pair`` has every ordered pair
    of different sources, ``term`` the ``top`` kept terms whose probability in the
    group lies furthest above that in the language; ties go by the item's bytes.
    Groups without kept terms have pairs (value 0 where the language keeps none)
    and no terms.  Repeated rows count each; an empty table gives an empty result.
    Other columns are not read.
    """
    counts, groups = group_counts(docs, text, lang, source, min_docs, block_bytes)
    null = F.lit(None).cast("long")
    p0 = _probability(F.lit(0), F.col("total"), F.nullif("v", F.lit(0)))
    g = groups.select("lang", "source", "v", p0.alias("p0"))
    pairs = (g.join(g.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang")
             .filter(F.col("source") != F.col("item"))
             .join(_tiles(counts, groups), ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.coalesce(F.col("v") * F.abs(F.col("p0") - F.col("q0")) + F.coalesce("more", F.lit(0)), F.lit(0))
                     .cast("long").alias("value"), null.alias("p"), null.alias("q")))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    of_lang = staged(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "lang_counts")
    both = (counts.join(of_lang, ["lang", "term"]).join(groups, ["lang", "source"]).join(whole, "lang")
            .withColumn("p", _probability(F.col("n"), F.col("total"), F.col("v")))
            .withColumn("q", _probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))))
    leading = both.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          (F.col("p") - F.col("q")).alias("value"), "p", "q")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc())
    rank = F.row_number().over(order)
    pairs = pairs.withColumn("rank", rank)
    leading = leading.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.unionByName(leading).select("lang", "source", "part", "item", "value", "rank", "p", "q")


ship(__name__)
