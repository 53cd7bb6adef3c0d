"""Phrase collocations by Toivonen mining.

A word is a run of characters without space or tab in a piece; pieces end at
``.,;:!?``, line feeds, vertical tabs, form feeds and carriage returns; A-Z count as
a-z. Counts are per language. A phrase of up to ``LONGEST`` words is frequent with
``support`` contiguous occurrences inside pieces, overlaps included.

* A share of the documents (by hash of id and text) is mined level by level at a
  lowered support: the phrases proposed.
* A full pass over all documents counts the proposed phrases and their negative
  border exactly: all single words, and every phrase whose two parts shorter by a
  word are proposed.
* A frequent phrase of the border that was not proposed is a failure: longer phrases
  made with it may be frequent and are not counted yet. The failures are added to the
  proposed ones and another full pass counts what that admits anew, until a pass ends
  without failures. A pass adds a word of length at least, so there are at most
  ``LONGEST`` passes, and the frequent phrases are then complete and exact whatever the
  sample was.

The first pass, by far the largest, sums counts by 48-bit hashes of the phrases, six
bytes in place of text: sums that are never too small, so what stays below the support
is settled. The second pass counts by text what reached it, together with what the
failures admit; the passes after it count the few further phrases by text at once.

Tasks hold the proposed phrases as one Bloom filter of ``bits`` bits, whose size does
not follow the data. A false positive, or two phrases of one hash, admits a phrase that
need not be counted: that costs time only, also when the filter fills up.
Words are numbered and phrases grouped in numpy, a few megabytes of text at a time
(a longer text is cut between words, with the words before the cut as context). That
grouping is the combining before the shuffle; most phrases of a border are too rare
for another one in the same task.

Defined cases: null text counts as empty, null ``lang`` as ``und``; a language without
a phrase of the support has no rows; repeated rows count each time; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

LONGEST = 4
#: Space and tab part words, the others pieces.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(32 if b == 9 else 10 if b in BREAKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text looked at together.
PORTION = 2 << 20
PROBES = 3
#: Pairs of hash and count that a task holds before it gives them on.
HELD = 1 << 20
EXACT = "lang string, k int, phrase string, n long"


# -- hashes and the filter -------------------------------------------------------
def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """Hashes of an array of words, from their bytes times the powers of an odd number."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    power = np.cumprod(np.full(int(size.max()), 0x9FB21C651E98DF25, dtype=np.uint64))
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    part = (data.astype(np.uint64) + np.uint64(1)) * power[at]
    return _mix(np.add.reduceat(part, offsets[:-1] - offsets[0]) ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))


def joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of its last word."""
    return _mix(left * np.uint64(0xC2B2AE3D27D4EB4F) + word)


def marked(h: np.ndarray, k: int) -> np.ndarray:
    """A phrase's hash, cut to 48 bits (it is what the first pass shuffles), with its
    length in the last two."""
    return ((h >> np.uint64(16)) & ~np.uint64(3)) | np.uint64(k - 1)


def phrase_hashes(lang: str, k: int, phrases: pa.Array) -> np.ndarray:
    """The hashes of phrases of k words."""
    words = word_hashes(lang, pc.list_flatten(pc.split_pattern(phrases, " "))).reshape(-1, k)
    h = marked(words[:, 0], 1)
    for i in range(1, k):
        h = marked(joined(h, words[:, i]), i + 1)
    return h


def with_hash(counts: DataFrame) -> DataFrame:
    """The hashes h of the rows of (lang, k, phrase)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                for k in range(1, LONGEST + 1):
                    rows = batch.filter(pc.and_(pc.equal(batch.column("lang"), lang), pc.equal(batch.column("k"), k)))
                    yield pa.record_batch([pa.array(phrase_hashes(lang, k, rows.column("phrase")).view(np.int64))], names=["h"])

    return counts.select("lang", "k", "phrase").mapInArrow(hashed, "h long")


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = _mix(h) | np.uint64(1)
    for _ in range(PROBES):
        yield h % np.uint64(bits)
        h = h + step


class Filter:
    """A Bloom filter in 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def empty(cls, bits: int) -> Filter:
        return cls(np.zeros(-(-bits // 64), dtype=np.uint64))

    def packed(self) -> tuple[int, np.ndarray, np.ndarray]:
        """What is sent to tasks: words that are not zero, and their places."""
        at = np.flatnonzero(self.words).astype(np.int32)
        return len(self.words), at, self.words[at]

    @classmethod
    def unpacked(cls, packed: tuple[int, np.ndarray, np.ndarray]) -> Filter:
        size, at, values = packed
        words = np.zeros(size, dtype=np.uint64)
        words[at] = values
        return cls(words)

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for p in _places(h, 64 * len(self.words)):
            found &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found

    def with_hashes(self, hashes: DataFrame) -> Filter:
        """This filter with the hashes of column h added. The driver gets at most one row
        for each 64 bits."""
        bits = 64 * len(self.words)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = np.concatenate(list(_places(_unsigned(batch.column("h")), bits)))
                mask = (np.uint64(1) << (p & np.uint64(63))).view(np.int64)
                yield pa.record_batch([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array(mask)], names=["w", "mask"])

        rows = hashes.select("h").mapInArrow(places, "w long, mask long").groupBy("w").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = self.words.copy()
        words[rows["w"].to_numpy()] |= rows["mask"].to_numpy().view(np.uint64)
        return Filter(words)

    def missing(self, hashes: DataFrame) -> DataFrame:
        """A table of the hashes of column h that this filter does not hold."""
        shared = hashes.sparkSession.sparkContext.broadcast(self.packed())

        def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Filter.unpacked(shared.value)
            for batch in batches:
                yield batch.filter(pa.array(~own.holds(_unsigned(batch.column("h")))))

        found = written(hashes.select("h").mapInArrow(lacking, "h long"), "phrase-failures")
        shared.destroy()
        return found


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


# -- counting ---------------------------------------------------------------------
def portions(texts: Iterable[bytes], most: int = PORTION) -> Iterator[tuple[bytes, int]]:
    """Folded text (words parted by spaces, pieces by line feeds) in portions of about
    ``most`` bytes; the number says how many words at the beginning are context, of
    which only phrases that reach further count. Longer words stay whole."""
    held, size = [], 0
    for text in texts:
        text = text.translate(_FOLD)
        if len(text) <= most:
            if size and size + len(text) > most:
                yield b"\n".join(held), 0
                held, size = [], 0
            held.append(text)
            size += len(text) + 1
            continue
        begin, before = 0, []
        while len(text) - begin > most:
            cut = text.rfind(b"\n", begin, begin + most)
            if cut <= begin:
                cut = text.rfind(b" ", begin, begin + most)
            if cut <= begin:
                cut = min((c for c in (text.find(b" ", begin + 1), text.find(b"\n", begin + 1)) if c > 0), default=len(text))
            part = b" ".join([*before, text[begin:cut]])
            yield part, len(before)
            before = [] if text[cut : cut + 1] != b" " else part[part.rfind(b"\n") + 1 :].split(b" ")
            before = [w for w in before if w][1 - LONGEST :]
            begin = cut
        yield b" ".join([*before, text[begin:]]), len(before)
    if held:
        yield b"\n".join(held), 0


def numbered(folded: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, the number of each word, and its piece."""
    data = np.frombuffer(folded, dtype=np.uint8)
    inside = (data != 32) & (data != 10)
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(np.flatnonzero(data == 10), starts)


class Grams:
    """Phrases of one length in a portion: hash (with length), count, whether earlier
    passes admitted them, and their words' numbers in the vocabulary."""

    def __init__(self, vocab: pa.Array, words: list[np.ndarray], hashes: np.ndarray, counts: np.ndarray, was: np.ndarray):
        self.vocab, self.words, self.hashes, self.counts, self.was = vocab, words, hashes, counts, was

    def text(self, chosen: np.ndarray) -> pa.Array:
        columns = [self.vocab.take(pa.array(w[chosen])) for w in self.words]
        return pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]


def _near(code: np.ndarray, piece: np.ndarray, skip: int, word: np.ndarray, fresh: Filter, longest: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The words that may be in one phrase with a phrase of ``fresh``; runs of them are
    pieces of their own."""
    n = len(code)
    near, h, own = np.zeros(n + 1, dtype=np.int32), marked(word, 1)[code], word[code]
    for k in range(1, longest):
        if k > 1:
            h = marked(joined(h[:-1], own[k - 1 :]), k)
        at = np.flatnonzero(fresh.holds(h))
        reach = longest - k
        np.add.at(near, np.maximum(at - reach, 0), 1)
        np.add.at(near, np.minimum(at + k + reach, n), -1)
    kept = np.flatnonzero(np.cumsum(near[:n]) > 0)
    run = np.cumsum(np.diff(kept, prepend=-1) > 1)
    same = piece[kept]
    return code[kept], run + np.cumsum(np.diff(same, prepend=0) > 0), int(np.searchsorted(kept, skip))


def grams(lang: str, folded: bytes, skip: int, old: Filter | None, new: Filter | None, longest: int = LONGEST, fresh: Filter | None = None) -> Iterator[Grams]:
    """The words of a portion, then the phrases of two words, and so on: those whose
    parts all are in ``new``. Occurrences inside the first ``skip`` words don't count.
    With ``fresh``, only phrases with a part in it need be right."""
    vocab, code, piece = numbered(folded)
    n, size = len(code), max(1, len(vocab))
    if not n:
        return
    word = word_hashes(lang, vocab)
    if fresh is not None:
        code, piece, skip = _near(code, piece, skip, word, fresh, longest)
        n = len(code)
    if not n:
        return
    at = Grams(vocab, [np.arange(len(vocab))], marked(word, 1), np.bincount(code[skip:], minlength=len(vocab)), np.ones(len(vocab), dtype=bool))
    yield at
    ids = code  # number of the phrase at each position, -1: not admitted
    for k in range(2, longest + 1):
        known = new.holds(at.hashes)
        kept = known[ids] & (ids >= 0)
        spots = np.flatnonzero(kept[:-1] & kept[1:] & (piece[: len(kept) - 1] == piece[k - 1 :]))
        if not len(spots):
            return
        key, inverse = np.unique(ids[spots] * size + code[spots + k - 1], return_inverse=True)
        left, last = key // size, key % size
        was = np.zeros(len(key), dtype=bool)
        if old is not None:
            before = at.was & old.holds(at.hashes)
            rest = np.zeros(len(key), dtype=np.int64)
            rest[inverse] = ids[spots + 1]  # of equal phrases, equal
            was = before[left] & before[rest]
        counts = np.bincount(inverse[spots + k - 1 >= skip], minlength=len(key))
        ids = np.full(n - k + 1, -1, dtype=np.int64)
        ids[spots] = inverse
        at = Grams(vocab, [w[left] for w in at.words] + [last], marked(joined(at.hashes[left], word[last]), k), counts, was)
        yield at


def _parts(docs: DataFrame, schema: str, filters: tuple[Filter | None, ...], each: Callable, counted: Callable, label: str, state: Callable = lambda: None) -> DataFrame:
    """``each`` makes Arrow batches of every portion of the rows of (lang, text), with a
    state of the task that may hold back a rest. What ``counted`` makes of their table is
    written, and the filters leave the executors."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(None if f is None else f.packed() for f in filters))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [None if x is None else Filter.unpacked(x) for x in shared.value], state()
        for batch in slices(batches, "text", 2 * PORTION):
            for lang in pc.unique(batch.column("lang")).to_pylist():
                texts = pc.cast(batch.filter(pc.equal(batch.column("lang"), lang)).column("text"), pa.binary())
                for folded, skip in portions(x.as_py() for x in texts):
                    yield from each(own, lang, folded, skip, *held)
        if own is not None:
            yield from own.rest()

    found = written(counted(docs.mapInArrow(parts, schema)), label)
    shared.destroy()
    return found


class Sums:
    """Counts by hash, summed up before they leave a task."""

    def __init__(self):
        self.hashes, self.counts, self.size = [], [], 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.hashes.append(hashes)
        self.counts.append(counts)
        self.size += len(hashes)
        if self.size > HELD:
            self._sum()
            if self.size > HELD // 2:
                yield from self.rest()

    def _sum(self) -> None:
        hashes, inverse = np.unique(np.concatenate(self.hashes), return_inverse=True)
        self.counts = [np.bincount(inverse, weights=np.concatenate(self.counts), minlength=len(hashes)).astype(np.int64)]
        self.hashes, self.size = [hashes], len(hashes)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._sum()
            sums = pa.record_batch([pa.array(self.hashes[0].view(np.int64)), pa.array(self.counts[0])], names=["h", "n"])
            yield from (sums.slice(i, 1 << 16) for i in range(0, self.size, 1 << 16))
        self.__init__()


def hashed_counts(docs: DataFrame, lengths: tuple[int, ...], support: int, new: Filter) -> DataFrame:
    """Hashes h with at least ``support`` occurrences, among single words and the longer
    phrases of ``lengths`` whose parts are all in ``new``."""

    def each(sums, lang, folded, skip, new):
        for k, g in enumerate(grams(lang, folded, skip, None, new, max(lengths)), 1):
            if k in lengths:
                yield from sums.add(g.hashes[g.counts > 0], g.counts[g.counts > 0])

    def counted(rows: DataFrame) -> DataFrame:
        # dealt out by hash first, so that no second combining runs before the shuffle
        return rows.repartition("h").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= support).select("h")

    return _parts(docs, "h long, n long", (new,), each, counted, "phrase-hashes", Sums)


def exact_counts(docs: DataFrame, support: int, new: Filter, old: Filter, held: Filter | None = None, fresh: Filter | None = None) -> DataFrame:
    """(lang, k, phrase, n) of the phrases with the support among those whose parts
    are all in ``new`` and not all in ``old``; with ``held``, also of those that are in
    it, and with k = 0 the number of words of each language. Without it ``fresh`` has
    the phrases that are in ``new`` alone."""

    def each(_, lang, folded, skip, new, old, held, fresh):
        for k, g in enumerate(grams(lang, folded, skip, old, new, LONGEST, fresh), 1):
            out = ~g.was if k > 1 else np.zeros(len(g.counts), dtype=bool)
            if held is not None:
                out |= held.holds(g.hashes)
            out &= g.counts > 0
            if k == 1 and held is not None:
                yield _exact_batch(lang, 0, pa.array([""]), g.counts.sum(keepdims=True))
            if out.any():
                yield _exact_batch(lang, k, g.text(out), g.counts[out])

    def counted(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
        return counts.where((F.col("n") >= support) | ((F.col("k") == 0) & (F.col("n") > 0)))

    return _parts(docs, EXACT, (new, old, held, fresh), each, counted, "phrases")


def _exact_batch(lang: str, k: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.repeat(lang, len(n)), pa.array(np.full(len(n), k, dtype=np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "k", "phrase", "n"])


def sampled(docs: DataFrame, share: float) -> DataFrame:
    at = [F.xxhash64(*[F.col(c) for c in ("doc_id", "text") if c in docs.columns])]
    return docs.where(F.pmod(at[0], F.lit(1 << 20)) < int(share * (1 << 20)))


def frequent(docs: DataFrame, support: int = 30, share: float = 0.1, slack: float = 0.7, bits: int = 1 << 26, note: Callable[[int, int], None] | None = None) -> DataFrame:
    """(lang, k, phrase, n): all phrases of 1 to ``LONGEST`` words with ``support``
    occurrences, and with k = 0 the number of words of each language. ``share`` of the
    documents is mined at ``slack`` of the support expected there (2 at least).
    ``note`` gets the number of each full pass and of the failures found by it."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), *(["doc_id"] if "doc_id" in docs.columns else []))
    sample = written(sampled(rows, share).select("lang", "text"), "phrase-sample")
    rows, least = rows.select("lang", "text"), max(2, int(slack * support * share))
    new = Filter.empty(bits)
    for k in range(1, LONGEST):
        new = new.with_hashes(hashed_counts(sample, (k,), least, new))
    counted = hashed_counts(rows, tuple(range(1, LONGEST + 1)), support, new)
    held, fresh, found, number = Filter.empty(bits).with_hashes(counted), None, None, 1
    while True:
        failures = new.missing(counted.where(F.col("h").bitwiseAND(F.lit(3)) < LONGEST - 1))
        lost = failures.count()
        if note:
            note(number, lost)
        if not lost and found is not None:
            return found
        old, new = new, new.with_hashes(failures)
        if found is not None:
            held, fresh = None, Filter.empty(1 << 20).with_hashes(failures)
        exact = exact_counts(rows, support, new, old, held, fresh)
        counted, found, number = with_hash(exact.where("k > 0")), exact if found is None else found.unionByName(exact), number + 1


# -- scores ------------------------------------------------------------------------
def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def collocations(found: DataFrame, most: int = 2000, scale: int = 2_000_000, cover: int = 80) -> DataFrame:
    """The first ``most`` phrases of each language from ``frequent``'s table, scored at
    their weakest cut; a phrase goes if a longer frequent one around it has ``cover``
    percent of its occurrences."""
    phrases = found.where("k >= 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    longer = phrases.where("k >= 2").withColumn("w", F.split("phrase", " "))
    part = phrases.select("lang", "phrase", "a")
    cuts = longer.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j")).select(
        "lang", "phrase", "a", "j", F.array_join(F.slice("w", F.lit(1), F.col("j")), " ").alias("p1"), F.array_join(F.slice("w", F.col("j") + 1, F.size("w")), " ").alias("p2")
    )
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("p1"), F.col("a").alias("l")), ["lang", "p1"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("p2"), F.col("a").alias("r")), ["lang", "p2"])
    cuts = cuts.withColumn("score", F.expr(f"(cast(a AS decimal(20,0)) * {scale}) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "j", "l", "r")).alias("cut"))
    inner = longer.where("k >= 3").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = scored.join(held, ["lang", "phrase"], "left").where(F.col("around").isNull() | (_exact("around") * 100 < _exact("a") * cover))
    words = found.where("k = 0").select("lang", F.col("n").alias("total"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
