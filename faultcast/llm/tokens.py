"""Token counts (3): count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each
position; dynamic programming carries the best score and, instead of the path,
the number of pieces on it.  The tie rule is the tokenizers': a later candidate
replaces an earlier one only with a higher score, and candidates come by start,
so of equal scores the piece that starts first stands.  A character that no
piece of its own covers costs the lowest score less 10 and counts as its UTF-8
bytes where the vocabulary has byte pieces, else as one unknown piece per run.

Where no piece goes on past a space, texts fall apart at spaces (and at
characters that no piece has) without changing the result, so words are counted
once per task and looked up after.  A document is counted where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

SPACE = "▁"
#: Words kept per task; beyond it the store starts anew.
CACHE = 200_000


class Vocabulary(NamedTuple):
    """Scored pieces (no control, unknown and byte pieces), and whether unknown characters fall back to bytes."""
    pieces: dict[str, float]
    byte_fallback: bool
    dummy_prefix: bool


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file, read on the driver (tens of thousands of rows)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    pieces = {sp.id_to_piece(i): sp.get_score(i) for i in ids
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    return Vocabulary(pieces, any(sp.is_byte(i) for i in ids), True)


class Counter:
    """Counts pieces of texts; built once per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.unknown = min(vocabulary.pieces.values()) - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known = {}
        self.pattern = None
        if not any(SPACE in p.lstrip(SPACE) for p in vocabulary.pieces):
            letters = "".join(sorted(set("".join(vocabulary.pieces)) - {SPACE}))
            self.pattern = re.compile(f"{SPACE}*[{re.escape(letters)}]+|{SPACE}+|.", re.DOTALL)

    def viterbi(self, s: str) -> tuple[float, int]:
        """Best score and its number of pieces."""
        n = len(s)
        best: list[float] = [0.0] + [0.0] * n
        count = [0] * (n + 1)
        unknown = [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(s):
            ends[end].append(match)
        for i in range(1, n + 1):
            top, start, single = None, 0, False
            for size, score in ends[i - 1]:
                single |= size == 1
                value = best[i - size] + score
                if top is None or value > top or value == top and i - size < start:
                    top, start = value, i - size
            if not single:
                value = best[i - 1] + self.unknown
                if top is None or value > top:
                    top, start = value, -1
            best[i] = top
            if start >= 0:
                count[i] = count[start] + 1
            else:
                unknown[i] = True
                if self.v.byte_fallback:
                    count[i] = count[i - 1] + len(s[i - 1].encode("utf-8", "surrogatepass"))
                else:
                    count[i] = count[i - 1] + (not unknown[i - 1])
        return best[n], count[n]

    def __call__(self, text: str | None) -> tuple[float, int]:
        """Score and number of pieces of a text; (0, 0) for null and empty ones."""
        if not text:
            return 0.0, 0
        s = (SPACE if self.v.dummy_prefix else "") + text.replace(" ", SPACE)
        # without byte pieces a run of unknown characters is one piece, so texts can't be cut there
        if self.pattern is None or not self.v.byte_fallback:
            return self.viterbi(s)
        known, score, n = self.known, 0.0, 0
        for part in self.pattern.findall(s):
            got = known.get(part)
            if got is None:
                got = self.viterbi(part)
                if len(known) >= CACHE:
                    known.clear()
                if len(part) <= 64:
                    known[part] = got
            score += got[0]
            n += got[1]
        return score, n


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, score per row of ``docs``; the vocabulary travels as a broadcast (its size is its file's).

    Null and empty texts have 0 tokens.  Repeated rows give repeated results, an
    empty table an empty one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))  # plain: executors have no class of this module

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Vocabulary(*shared.value))
        for batch in batches:
            got = [counter(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())],
                names=["doc_id", "n_tokens", "score"])

    d = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, score double")


ship(__name__)
