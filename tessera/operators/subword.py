"""Subword tokens by byte-pair merges over a given vocabulary (T1's tokenizer hook).

A vocabulary file has a line ``base64(piece) rank`` for each piece, all 256 single bytes
among them; a rank is the piece's id. Text is cut into words by a pattern, and in each
word the neighbouring pair with the least rank is merged until none is left, so every
text has ids and ids give the text back. Words are encoded once per worker as long as
they fit a cache of bounded bytes; texts go through Arrow batches.
"""

from __future__ import annotations

import base64
import heapq
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern that goes with the public byte-level vocabularies.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_BYTES = 32 << 20


def read_vocabulary(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Pieces and ranks of a vocabulary file; its size is that of one file."""
    rows = spark.read.text(path).collect()
    return {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in rows if r.value.strip())}


class Subword:
    def __init__(self, ranks: dict[bytes, int], pattern: str = WORDS, cache_bytes: int = CACHE_BYTES):
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"the vocabulary lacks single bytes: {lacking[:5]}")
        self.ranks, self.words, self.room = ranks, regex.compile(pattern), cache_bytes
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.words.findall(text):
            ids = self.cache.get(word)
            if ids is None:
                ids = self.merged(word.encode())
                cost = 120 + 8 * len(word)
                if cost <= self.room:
                    self.room -= cost
                    self.cache[word] = ids
            out += ids
        return out

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word. A heap has the pairs that could be merged, so a long word
        costs n log n; entries whose pieces have changed since are passed over."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = self.ranks.get(word[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if j >= n or end[i] > j or end[j] != stop or end[i] == i:
                continue
            end[i], after[i] = stop, after[j]
            end[j] = j  # no piece begins here any more
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = after[i]
        return out


#: The tokenizer of this worker process, by the name its maker gave it.
_KEPT: dict[str, Subword] = {}


def subword_tokenizer(spark: SparkSession, path: str, pattern: str = WORDS):
    """A tokenizer for ``tokens.tokenize``: text column -> array of ids (empty for null)."""
    shared, name = spark.sparkContext.broadcast(read_vocabulary(spark, path)), uuid.uuid4().hex

    @F.arrow_udf("array<long>")
    def ids(texts: pa.Array) -> pa.Array:
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = Subword(shared.value, pattern)
        return pa.array([_KEPT[name].encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int64()))

    return ids


def texts_of(rows: pa.Array, known: pa.Array, pieces: pa.Array) -> pa.Array:
    """The text of each list of ids: one lookup for all ids of the batch, whose pieces
    then stand in one buffer in the order of the texts."""
    rows = rows.cast(pa.large_list(pa.int64()))
    found = pc.fill_null(pc.take(pieces, pc.index_in(rows.flatten(), value_set=known)), b"")
    at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))))
    _, ends, data = found.buffers()
    cuts, data = np.frombuffer(ends, np.int64)[found.offset + at].tolist() if len(found) else [0] * len(at), memoryview(data or b"")
    return pa.array([str(data[a:b], "utf-8", "replace") if ok else None for a, b, ok in zip(cuts, cuts[1:], rows.is_valid().to_pylist())], pa.string())


def decode(spark: SparkSession, path: str, ids: Column) -> Column:
    """The text of an array of ids; ids outside the vocabulary stand for nothing."""
    shared = spark.sparkContext.broadcast({i: piece for piece, i in read_vocabulary(spark, path).items()})

    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        found = shared.value
        return texts_of(rows, pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.large_binary()))

    return text(ids)
