"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, shingles are
``words`` words in a row, and an item is found in a document if at least
``threshold`` of its distinct shingles are among the document's (an item with
fewer words has one shingle: all of them, which is looked for as such).

Items are partitioned by their number of shingles into classes (2^(c-1), 2^c].
In class c with largest size u a document is read in windows of 2u shingles, one
every u, so that a passage of an item's length lies whole in a window and short
items meet sets of about their own size, not those of a long document. A set's
signature is its minimum in each of ``k`` buckets of one hash function (one
permutation hashing); a window and an item are candidates if they share a minimum
in any bucket. ``k`` is chosen by class (``buckets``) for the chance to miss a
passage that is wholly there to stay far below one in a million; shingles that
stand too far apart for a window are looked for by document in the exact step:
a candidate only needs one of its parts to meet a window.

A candidate is verified against all shingles of the whole document: hashes are
compared first and then the words themselves, so collisions cannot count.

The index holds the items' minima. It is sent to the tasks in blocks of at most
``block`` shingles, one pass over the documents for each block; a larger
benchmark takes more passes, never a larger broadcast. Documents are not
shuffled, and neither windows nor candidates leave their task.

Defined cases: null and empty documents match nothing; items without words are
not looked for; rows with equal ids are looked at each for itself; items with
equal texts are found each; extra columns are ignored by ``find`` and kept by
``clean``; empty tables give no matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes, written

WORDS = 5
THRESHOLD = 0.8
#: Shingles in a broadcast block of the index (about 100 bytes each).
BLOCK = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


class WordHashes(dict):
    """XXH64 of words; holds as many as a worker can keep and then starts afresh."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:  # longer ones are rarely seen again
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes."""
    if len(h) < width:
        return np.empty(0, dtype=np.uint64)
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            out = (out ^ h[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
    return out


def buckets(size: int) -> int:
    """Buckets of the signatures in the class up to ``size`` shingles: small items
    have few minima to meet by, so hardly any two shingles may share a bucket."""
    return 1 << 20 if size <= 16 else 1 << 12 if size <= 256 else 1 << 10


class Index:
    """Signatures and shingles of some items (item_id, text)."""

    def __init__(self, items: Iterable[tuple[int, bytes]], words: int = WORDS) -> None:
        self.words = words
        self.shingles: list[dict[int, tuple[bytes, ...]]] = []  # of an item: hash -> words
        self.ids: list[int] = []
        self.widths: list[int] = []
        found: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        cache = WordHashes()
        for item_id, text in items:
            t = tokens(text)
            if not t:
                continue
            width = min(words, len(t))
            hashes = shingle_hashes(cache.of(t), width).tolist()
            held = {h: tuple(t[i : i + width]) for i, h in enumerate(hashes)}
            size = 1 << (len(held) - 1).bit_length()
            k, least = buckets(size), {}
            for h in held:
                least[h % k] = min(h, least.get(h % k, h))
            for h in least.values():
                found[width, size][h].append(len(self.ids))
            self.ids.append(item_id)
            self.widths.append(width)
            self.shingles.append(held)
        #: (width, class size) -> (sorted minima, items of each)
        self.classes = {key: (np.array(sorted(x), dtype=np.uint64), [x[h] for h in sorted(x)]) for key, x in sorted(found.items())}
        #: a first, coarse test: which 22-bit tails of hashes occur
        self.tails = {}
        for width in {w for w, _ in self.classes}:
            tail = np.zeros(1 << 22, dtype=bool)
            for (w, _), (minima, _) in self.classes.items():
                if w == width:
                    tail[minima & np.uint64((1 << 22) - 1)] = True
            self.tails[width] = tail

    def candidates(self, hashes: np.ndarray, width: int) -> set[int]:
        """Items that share a minimum with a window of a document's shingles."""
        out: set[int] = set()
        at = np.flatnonzero(self.tails[width][hashes & np.uint64((1 << 22) - 1)])
        if not len(at):
            return out
        for (w, size), (minima, items) in self.classes.items():
            if w != width:
                continue
            place = np.minimum(np.searchsorted(minima, hashes[at]), len(minima) - 1)
            met = minima[place] == hashes[at]
            k = np.uint64(buckets(size))
            for p, x in zip(at[met].tolist(), place[met].tolist()):
                if not all(i in out for i in items[x]) and self._least(hashes, p, size, k):
                    out.update(items[x])
        return out

    @staticmethod
    def _least(hashes: np.ndarray, p: int, size: int, k: np.uint64) -> bool:
        """Is the shingle at ``p`` its bucket's minimum in a window that holds it?
        Windows begin at multiples of ``size`` and are 2 x ``size`` long."""
        for begin in (p // size * size, p // size * size - size):
            if begin >= 0:
                window = hashes[begin : begin + 2 * size]
                rivals = window[window < hashes[p]]
                if not (rivals % k == hashes[p] % k).any():
                    return True
        return False

    def matches(self, text: bytes, threshold: float, cache: WordHashes) -> list[tuple[int, int, int]]:
        """(item, shingles of it in the text, its shingles) of the items found."""
        t = tokens(text)
        h = cache.of(t)
        out = []
        for width in self.tails:
            hashes = shingle_hashes(h, width)
            maybe = self.candidates(hashes, width) if len(hashes) else ()
            if not maybe:
                continue
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            for i in sorted(maybe):
                held = self.shingles[i]
                wanted = np.fromiter(held, dtype=np.uint64, count=len(held))
                place = np.searchsorted(ranked, wanted)
                there = place < len(ranked)
                there[there] = ranked[place[there]] == wanted[there]
                common = sum(tuple(t[order[q] : order[q] + width]) == held[x] for q, x in zip(place[there].tolist(), wanted[there].tolist()))
                if common >= threshold * len(held) - 1e-9:
                    out.append((i, common, len(held)))
        return out


def _blocks(benchmark: DataFrame, words: int, block: int) -> Iterator[Index]:
    """Indexes of the items in blocks of at most ``block`` words (one item at least)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    held: list[tuple[int, bytes]] = []
    size = 0
    for r in items.toLocalIterator():
        text = r.text.encode()
        n = len(tokens(text))
        if held and size + n > block:
            yield Index(held, words)
            held, size = [], 0
        held.append((r.item_id, text))
        size += n
    if held:
        yield Index(held, words)


def find(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, matched, shingles, containment): a row for each item
    (item_id, text) found in a row of ``docs`` (doc_id, text)."""
    schema = "doc_id long, item_id long, matched int, shingles int, containment double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for index in _blocks(benchmark, words, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for b in slices(batches, "text"):
                out = [
                    {"doc_id": d, "item_id": shared.value.ids[i], "matched": m, "shingles": n, "containment": m / n}
                    for d, t in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")))
                    for i, m, n in shared.value.matches(t, threshold, cache)
                ]
                yield pa.RecordBatch.from_pylist(out, schema=_arrow)

        found.append(rows.mapInArrow(run, schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, found)


_arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int32()), ("shingles", pa.int32()), ("containment", pa.float64())])


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in which no item is found, in the columns of ``docs``:
    the rows pass through the workers and nothing is joined. Between the passes of a
    benchmark of several blocks they are written, so a task has one worker and one
    block."""
    passes = 0
    for index in _blocks(benchmark, words, block):
        docs = written(docs, "clean") if passes else docs
        passes += 1
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for b in slices(batches, "text"):
                yield b.filter(pa.array([not shared.value.matches(t, threshold, cache) for t in text_bytes(b.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
