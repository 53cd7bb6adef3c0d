"""Token counts by count-only Viterbi over a unigram vocabulary.

The vocabulary is the pieces and scores of a SentencePiece model file. A text is
read as the tokenizer reads it: a mark before it, every space a mark. Among all
ways to write it in pieces the one with the highest sum of scores counts; an
Aho-Corasick automaton lists the pieces that end at each character, and dynamic
programming carries the best score and its number of pieces, without the path.

Tie rule, as in the tokenizer: paths to a character are tried by their last
piece's start from left to right, and a later one wins only if it is strictly
better. A character with no piece of its own may be unknown at the lowest score
less 10; unknown characters count as one token for each UTF-8 byte.

No piece has a mark after another character (checked), so a best path breaks
before every such mark, and a word is decoded once while a bounded table holds
it. Scores of such model files are whole numbers, for which sums of words equal
the sum along the text exactly.

Defined cases: null and empty texts have no tokens and score 0; repeated ids keep
a row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The model file's path is a parameter.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pieces kept in a worker, and their characters.
_CACHE, _CACHE_CHARS = 150_000, 8 << 20
_segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def vocabulary_of(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces with their scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in ordinary]


class Counter:
    """Tokens and best score of texts."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"a mark inside the piece {piece!r}")
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0
        self.counts: list[int] = []
        self.scores: list[float] = []

    def segment(self, s: str) -> tuple[int, float]:
        """(tokens, score) of the best way to write ``s``."""
        ends: list[list[tuple[int, float]] | None] = [None] * len(s)
        for end, match in self.automaton.iter(s):  # at an end, the longest piece comes first
            if ends[end] is None:
                ends[end] = [match]
            else:
                ends[end].append(match)
        best, count, least = [0.0], [0], self.unknown
        for end, found in enumerate(ends):
            top, tokens, size = -np.inf, 0, 0
            if found:
                for size, score in found:
                    value = best[-size] + score
                    if value > top:
                        top, tokens = value, count[-size] + 1
            if size != 1:  # the last piece is the shortest one
                value = best[-1] + least
                if value > top:
                    top, tokens = value, count[-1] + len(s[end].encode())
            best.append(top)
            count.append(tokens)
        return count[-1], best[-1]

    def _index(self, s: str) -> int:
        i = self.at.get(s)
        if i is None:
            tokens, score = self.segment(s)
            i = self.at[s] = len(self.counts)
            self.held += len(s)
            self.counts.append(tokens)
            self.scores.append(score)
        return i

    def __call__(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if len(self.at) > _CACHE or self.held > _CACHE_CHARS:
            self._forget()
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            parts = _segments.findall(MARK + text.replace(" ", MARK))
        else:
            parts = [MARK + w for w in text.split(" ")]
        at = list(map(self.at.get, parts))
        if None in at:
            at = [self._index(p) if i is None else i for p, i in zip(parts, at)]
        return sum(map(self.counts.__getitem__, at)), float(sum(map(self.scores.__getitem__, at)))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score): a row for each row of ``docs``, in one pass."""
    # the model file is read once on the driver; a vocabulary has a fixed size
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in slices(batches, "text"):
            found = [counter(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double")
