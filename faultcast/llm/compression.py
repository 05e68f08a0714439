"""Quality rules (10): compression bands over whole documents and fixed chunks.

``zstd(text) / bytes`` says how much of a text is news.  Repetitive text has a
low ratio, random strings a high one, and the ratio falls with the length of
what is compressed; so each length class has limits of its own, for the whole
document and for chunks of a fixed size.  One scan, no shuffle: a document is
measured where it is read, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship

#: (bytes from, lowest ratio, highest ratio) of whole documents; the last class whose start is reached holds.
#: Below 200 bytes a frame is mostly header, so nothing is said.
WHOLE_BANDS = ((0, 0.0, 9.0), (200, 0.25, 0.95), (500, 0.20, 0.85), (2000, 0.15, 0.75), (10000, 0.12, 0.70))
#: The same for one chunk.
CHUNK_BANDS = ((0, 0.0, 9.0), (1024, 0.17, 0.82), (4096, 0.15, 0.75))
CHUNK_BYTES = 4096
#: A document goes when more than this share of its chunked bytes lies outside the chunk limits.
BAD_SHARE = 0.5

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("ratio", T.DoubleType()),
    T.StructField("bad_share", T.DoubleType())])


def limits(bands, size: int) -> tuple[float, float]:
    """Lowest and highest ratio for ``size`` bytes."""
    low, high = 0.0, 9.0
    for start, a, b in bands:
        if size >= start:
            low, high = a, b
    return low, high


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows of ``window`` words that stand twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    m = n - window + 1
    key = np.zeros(m, dtype=np.uint64)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + m]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None, packer: zstandard.ZstdCompressor, whole=WHOLE_BANDS, chunk=CHUNK_BANDS,
            chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE) -> tuple:
    """The values of FIELDS for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, b"\t\n\x0b\x0c\r "))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = repeat_words(words)
    failed = n < 20 or 100 * repeated > 30 * n
    ratio = len(packer.compress(raw)) / len(raw) if raw else 0.0
    low, high = limits(whole, len(raw))
    fits = low <= ratio <= high
    bad = measured = 0
    for i in range(0, len(raw), chunk_bytes):
        part = raw[i:i + chunk_bytes]
        low, high = limits(chunk, len(part))
        if low == 0.0:
            continue
        measured += len(part)
        if not low <= len(packer.compress(part)) / len(part) <= high:
            bad += len(part)
    share = bad / measured if measured else 0.0
    return (n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, failed,
            not failed and fits and share <= bad_share, ratio, share)


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, whole=WHOLE_BANDS,
                  chunk=CHUNK_BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE) -> DataFrame:
    """The columns ``keep`` of each row (default ``doc_id``) and the measures of its text.

    A null text counts as empty: no words, so it fails the base rule.  Repeated
    rows are measured each on their own, an empty table gives an empty result.
    Columns that are not asked for are not read; of those in ``keep`` that have
    the name of a measure, the measure stands.
    """
    keep = [c for c in (keep or ["doc_id"]) if c not in FIELDS.names]
    schema = T.StructType([docs.schema[c] for c in keep] + FIELDS.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        for batch in batches:
            rows = [measure(t.as_py(), packer, whole, chunk, chunk_bytes, bad_share) for t in batch.column(len(keep))]
            got = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *got], names=schema.names)

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", **limits_) -> DataFrame:
    """The rows whose text passes, all columns as they were; nothing is shuffled."""
    names = docs.columns
    schema = docs.schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield batch.filter(pa.array([measure(t.as_py(), packer, **limits_)[6] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, schema)


ship(__name__)
