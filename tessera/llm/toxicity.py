"""Toxicity by a noisy channel: leetspeak, spacing and repetition are undone by
Viterbi decoding of a character lattice under a character language model, and
the restored words are scored.

Language model: trigram counts of lower-cased letters (``ALPHABET``; any other
letter is one class, everything else a word boundary) over all documents,
counted by partition and summed, interpolated with bigrams and letters.

Channel: a letter stands for itself; a sign of ``LEET`` stands for one of its
letters or for nothing; any other sign stands for nothing; a letter after
the same letter may be a repetition. ``restore`` returns the most probable
reading of a token, and of a run of at least ``SPACED`` single characters, where
each space may also be a true word boundary.

Classifier: beginnings of restored words (``LENGTHS`` letters) that toxic rows
hold more often than chance. They are chosen on a bounded sample of labelled rows
(``sample`` rows of each class, those with the smallest hash of doc_id) by
likelihood ratio of their presence, and must stand after different words, so that
what merely comes along with copies of one text stays out. A text's evidence for
a beginning is how unlikely its count in a window of ``WINDOW`` words would be in clean
text (Poisson tail at the rate of clean rows); the sum of what exceeds ``CHANCE``, in the
strongest window, goes through a logistic curve fitted on the sample, which is read as
texts are scored. A word that clean rows never hold thus tells the same in a text of any
length, and a beginning that clean rows hold now and then only where it crowds. Only
labels of the rows passed are seen.

When scoring, a token or a run of single characters is decoded only if some path of
its lattice can spell a beginning of the classifier, which one regular expression tells
(each letter or its signs once or more, any signs between); other tokens cannot change
the score. The beginning counts if the best path that spells it is at most ``MARGIN``
worse than the best of all.
Whole texts are read.

Defined cases: null and empty texts get the score of a text without any word of
the classifier; without rows of both labels every score is the share of label 1
(0.0 without labels); null labels and labels of unknown documents are ignored;
of repeated labels the largest counts; all rows are returned, with repeated ids.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
BOUNDARY, OTHER, N = 0, len(ALPHABET) + 1, len(ALPHABET) + 2
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "*": "aeiou"}
#: Log probabilities of the channel: a second and a later equal character is dropped,
#: a sign that could be a letter is dropped inside or at the end of a token, or is that letter.
DROP_SECOND, DROP_MORE, DROP_LEET, DROP_EDGE, SUBSTITUTE = -2.5, -0.5, -9.0, -3.0, -1.0
#: Single characters in a row that may be one word.
SPACED = 3
#: Labelled rows of each class; lengths of beginnings; most beginnings; least likelihood ratio; least documents
#: and contexts; least share of the toxic rows (millions of beginnings are tried, some are frequent by chance).
SAMPLE, LENGTHS, LEXICON, RATIO, LEAST, SUPPORT = 4_000, range(3, 13), 400, 30.0, 5, 0.01
#: Evidence (natural logarithm) that a beginning needs before it counts, and the most that counts.
CHANCE, MOST = 3.0, 8.0
#: Words of a window, in which evidence is counted; windows overlap by half.
WINDOW = 200
#: Log probability of a word boundary at a space between single characters; a reading that
#: spells a beginning counts if it is at most so much worse than the best one.
SPLIT, MARGIN = -6.0, 6.0
THRESHOLD = 0.7
#: Tokens kept in a worker's cache, and the most characters of one.
_CACHE, _KEEP = 100_000, 64

_ids = np.zeros(1 << 16, dtype=np.int32)
for _c in range(1 << 16):
    if chr(_c).isalpha():
        _ids[_c] = OTHER
for _k, _c in enumerate(ALPHABET, 1):
    _ids[ord(_c)] = _k
_word = re.compile(r"[^\W\d_]+")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LEET) + "«»„“”‘’–—…¿¡"


def letter_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    return _ids[np.where(points < 1 << 16, points, 0)]


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) over all of ``docs``; at most ``N`` ** 3 rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(N**3, dtype=np.int64)
        for b in slices(batches, "text", 4 << 20):
            ids = letter_ids("\n\n" + "\n\n".join(t for t in b.column("text").to_pylist() if t) + "\n\n")
            counts += np.bincount(ids[:-2] * (N * N) + ids[1:-1] * N + ids[2:], minlength=N**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["gram", "n"])

    grams = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram int, n long")
    return grams.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log P(c | a, b) as an array [a, b, c] of fixed size."""
    tri = np.zeros(N**3)
    for r in counts.toLocalIterator():
        tri[r.gram] = r.n
    tri = tri.reshape(N, N, N)
    tri[:, BOUNDARY, BOUNDARY] = 0  # runs of signs tell nothing about words
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1)) + 1
    p = 0.05 * uni / uni.sum()
    p = 0.25 * bi / np.maximum(bi.sum(axis=1, keepdims=True), 1) + p
    p = 0.7 * tri / np.maximum(tri.sum(axis=2, keepdims=True), 1) + p
    return np.log(p).astype(np.float32)


def _id(c: str) -> int:
    return int(_ids[ord(c)]) if ord(c) < 1 << 16 else 0


def _viterbi(lm: np.ndarray, token: str, prefix: str = "") -> tuple[float, str]:
    """Log probability and letters of the best reading of ``token`` that begins with
    ``prefix`` (minus infinity if none does). States are the last two letters and how
    much of the prefix is spelled; a state keeps its best path, the first one on ties."""
    inner = [i for i, c in enumerate(token) if c.isalnum()]
    first, last = (inner[0], inner[-1]) if inner else (len(token), -1)
    states = {(BOUNDARY, BOUNDARY, 0): (0.0, "")}
    for at, c in enumerate(token):
        options: list[tuple[str, float]] = []
        if c == " ":
            options = [("", 0.0), (" ", SPLIT)]
        elif c in LEET:
            options = [(x, SUBSTITUTE) for x in LEET[c]] + [("", DROP_MORE if at and token[at - 1] == c else DROP_LEET if first <= at <= last else DROP_EDGE)]
        elif c.isalpha():
            options = [(c, 0.0)]
            if at and token[at - 1] == c:
                options.append(("", DROP_MORE if at > 1 and token[at - 2] == c else DROP_SECOND))
        else:
            options = [("", 0.0)]
        after: dict[tuple[int, int, int], tuple[float, str]] = {}
        for (a, b, done), (score, path) in states.items():
            for out, cost in options:
                if not out:
                    key, value = (a, b, done), score + cost
                else:
                    i = _id(out)
                    if i == BOUNDARY and b == BOUNDARY:
                        key, value = (a, b, done), score + cost
                        out = ""
                    elif done < len(prefix) and out != prefix[done]:
                        continue
                    else:
                        key, value = (b, i, min(done + 1, len(prefix))), score + cost + float(lm[a, b, i])
                if key not in after or value > after[key][0]:
                    after[key] = (value, path + out)
        states = after
    ends = ((s + (float(lm[a, b, BOUNDARY]) if b else 0.0), p) for (a, b, done), (s, p) in states.items() if done == len(prefix))
    return max(ends, key=lambda x: x[0], default=(-math.inf, ""))


def decode(lm: np.ndarray, token: str) -> str:
    """The most probable reading of ``token`` (lower case; a space in it may be a
    word boundary or nothing)."""
    return _viterbi(lm, token)[1]


def spells(lm: np.ndarray, piece: str, start: str) -> bool:
    """Whether ``piece`` can be read as a word with that beginning about as well as in
    any other way. It holds a letter, so that numbers are not read as words."""
    if not any(c.isalpha() for c in piece):
        return False
    return _viterbi(lm, piece, start)[0] >= _viterbi(lm, piece)[0] - MARGIN


def _plain(token: str) -> bool:
    return token.isalpha() and all(a != b for a, b in zip(token, token[1:]))


def _bare(token: str) -> str:
    """``token`` without the signs at its ends that can only stand for nothing."""
    return token.strip(_EDGE)


def readable(words: Iterable[str]) -> re.Pattern:
    """Matches what has a lattice path that spells one of ``words``; the number of the
    group is that of the word in order."""
    signs: dict[str, str] = {}
    for sign, letters in LEET.items():
        for x in letters:
            signs[x] = signs.get(x, "") + sign
    nothing = r"[\W\d_]*"
    parts = []
    for w in sorted(words):
        runs = [(c, len(list(g))) for c, g in itertools.groupby(w)]
        each = [(f"[{re.escape(c + signs.get(c, ''))}]+", n - 1) for c, n in runs]
        parts.append("(" + nothing.join(x + (f"(?:{nothing}{x}){{0,{more}}}" if more else "") for x, more in each) + ")")
    return re.compile(f"{nothing}(?:{'|'.join(parts) or '(?!)'}){nothing}")


def _spaced_runs(tokens: list[str]) -> Iterator[tuple[int, str]]:
    """Runs of at least ``SPACED`` tokens of one character, joined by spaces, and where
    they begin."""
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) == 1
    edge = np.flatnonzero(np.diff(np.concatenate(([False], sizes, [False])).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= SPACED:
            yield a, " ".join(tokens[a:b])


def restore(lm: np.ndarray, text: str) -> str:
    """``text`` in lower case with every token, and every run of single characters, decoded."""
    tokens = text.lower().split()
    sizes = [len(t) == 1 for t in tokens]
    out, at = [], 0
    while at < len(tokens):
        end = at
        while end < len(tokens) and sizes[end]:
            end += 1
        if end - at >= SPACED:
            out.append(decode(lm, " ".join(tokens[at:end])))
            at = end
        else:
            out.append(tokens[at] if _plain(_bare(tokens[at])) else decode(lm, tokens[at]))
            at += 1
    return " ".join(x for x in out if x)


def _words_of(lm: np.ndarray, token: str) -> set[str]:
    """Words that a token may count as: its runs of letters and its reading."""
    token = _bare(token)
    if _plain(token):
        return {token}
    return {*_word.findall(token), *decode(lm, token).split()}


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one row for each labelled doc_id, the largest label."""
    return labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _sampled(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, toxic) of at most ``sample`` labelled rows of each class."""
    known, order = _known(labels), [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    return known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(sample))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: lm, starts (beginning -> rate in clean texts), the curve and the share of label 1. ``labels`` (doc_id, toxic)
    holds the rows to learn from; the language model is counted over all ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lm = language_model(trigram_counts(docs))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = _sampled(labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(lm)

    # at most 2 x sample ids: a table of proven size
    texts = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    rows = written(texts.mapInArrow(_reader(shared), "toxic int, n int, words array<string>, after array<long>"), "toxic")
    totals = {r.toxic: r for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).collect()}
    model = {"lm": lm, "starts": {}, "slope": 0.0, "middle": 0.0, "base": float(1 in totals)}
    if len(totals) < 2:
        return model
    pos, neg = totals[1].docs, totals[0].docs
    base = pos / (pos + neg)
    here = _known(labels).join(docs.select("doc_id"), "doc_id", "left_semi")
    known = {r.toxic: r.n for r in here.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model["base"] = known[1] / (known[0] + known[1])
    parts = rows.mapInArrow(_count_starts, "start string, p long, n long, kn long, contexts array<long>")
    counted = parts.groupBy("start").agg(*[F.sum(c).alias(c) for c in ("p", "n", "kn")], F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts"))
    expected, rest = F.col("n") * base, F.col("n") - F.col("p")
    gain = 2 * (F.col("p") * F.log(F.col("p") / expected) + F.when(rest > 0, rest * F.log(rest / (F.col("n") - expected))).otherwise(0.0))
    # three times as often in toxic rows as in clean ones, whatever the sample's shares are
    often = F.col("p") / pos > 3 * rest / neg
    counted = counted.where((F.col("p") >= max(LEAST, SUPPORT * pos)) & (F.col("contexts") >= LEAST) & often).withColumn("gain", gain).where(F.col("gain") > RATIO)
    for r in counted.orderBy(F.desc("gain"), F.desc(F.length("start")), "start").limit(20 * LEXICON).collect():
        if len(model["starts"]) < LEXICON and not any(s.startswith(r.start) or r.start.startswith(s) for s in model["starts"]):
            model["starts"][r.start] = (r.kn + 0.5) / (totals[0].words + 1)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = witness(told.value)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([tell(t) for t in b.column("text").to_pylist()], pa.float64())], names=["toxic", "z"])

    # read as it will be scored
    seen = [(r.toxic, r.z) for r in texts.mapInArrow(read, "toxic int, z double").collect()]
    # the sample holds up to as many rows of either class; the curve is for all labelled rows
    model["slope"], model["middle"] = _curve(seen, {0: known[0] / neg, 1: known[1] / pos})
    return model


def _reader(shared):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Restored words of each text, and for each the hash of the token before it."""
        cache: dict[str, list[str]] = {}
        for b in slices(batches, "text", 4 << 20):
            sizes, out, after = [], [], []
            for text in b.column("text").to_pylist():
                words: list[str] = []
                contexts: list[int] = []
                tokens = (text or "").lower().split()
                before = ""
                for t in tokens:
                    more = cache.get(t)
                    if more is None:
                        more = sorted(_words_of(shared.value, t))
                        if len(t) <= _KEEP:
                            if len(cache) > _CACHE:
                                cache.clear()
                            cache[t] = more
                    words += more
                    contexts += [zlib.crc32(before.encode())] * len(more)
                    before = t
                for _, run in _spaced_runs(tokens):
                    more = decode(shared.value, run).split()
                    words += more
                    contexts += [zlib.crc32(run.encode())] * len(more)
                sizes.append(len(tokens))
                out.append(words)
                after.append(contexts)
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.string())), pa.array(after, pa.list_(pa.int64()))],
                names=["toxic", "n", "words", "after"])

    return read


def _count_starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by beginning: toxic rows, rows, times in clean rows, and up to
    ``2 * LEAST`` contexts in toxic rows. A task sees part of a bounded sample."""
    held: dict[str, list] = {}
    for b in batches:
        for toxic, words, after in zip(*(b.column(c).to_pylist() for c in ("toxic", "words", "after"))):
            seen: dict[str, list] = {}
            for w, k in zip(words, after):
                for size in LENGTHS:
                    if size > len(w):
                        break
                    x = seen.get(w[:size])
                    if x is None:
                        seen[w[:size]] = [1, k]
                    else:
                        x[0] += 1
            for start, (times, k) in seen.items():
                h = held.setdefault(start, [0, 0, 0, set()])
                h[0] += toxic
                h[1] += 1
                h[2] += 0 if toxic else times
                if toxic and len(h[3]) < 2 * LEAST:
                    h[3].add(k)
    names = ["start", "p", "n", "kn", "contexts"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    items = [(s, *x[:3], sorted(x[3])) for s, x in held.items()]
    for at in range(0, len(items), 50_000):
        columns = zip(*items[at : at + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _start_of(starts: dict[str, float], word: str) -> str | None:
    for size in LENGTHS:
        if size > len(word):
            return None
        if word[:size] in starts:
            return word[:size]
    return None


def evidence(starts: dict[str, float], n: int, hits: Iterable[tuple[int, str]]) -> float:
    """What the beginnings found at places of a text of ``n`` words tell (0 to ``MOST``):
    that of its strongest window, so one word tells as much in a long text as in one of
    a window's size."""
    windows: dict[int, dict[str, int]] = {}
    for at, s in hits:
        k = 0 if n <= WINDOW else at // (WINDOW // 2)
        for w in (k,) if n <= WINDOW or not k else (k - 1, k):
            counts = windows.setdefault(w, {})
            counts[s] = counts.get(s, 0) + 1
    size = min(n, WINDOW)
    totals = (sum(max(0.0, _surprise(counts[s], size * starts[s]) - CHANCE) for s in sorted(counts)) for counts in windows.values())
    return min(max(totals, default=0.0), MOST)


def _surprise(k: int, mean: float) -> float:
    """-log P(Poisson(mean) >= k), from the first terms of the tail."""
    if k <= mean:
        return 0.0
    term, total = 1.0, 1.0
    for i in range(1, 200):
        term *= mean / (k + i)
        total += term
        if term < 1e-12:
            break
    return max(0.0, mean - k * math.log(mean) + math.lgamma(k + 1) - math.log(total))


def _curve(seen: list[tuple[int, float]], weight: dict[int, float]) -> tuple[float, float]:
    """Slope and middle of a logistic curve over the evidence, by Newton steps on
    rows weighted by class; the slope is held within bounds, as a sample may be
    separable."""
    y = np.array([a for a, _ in seen], dtype=float)
    w = np.array([weight[a] for a, _ in seen], dtype=float)
    x = np.column_stack([np.ones(len(seen)), [b for _, b in seen]])
    theta = np.array([-2.0, 0.5])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        theta += np.clip(np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-3 * theta), -1, 1)
        theta[1] = min(max(theta[1], 0.05), 3.0)
    return float(theta[1]), float(-theta[0] / theta[1])


def witness(model: dict) -> Callable[[str | None], float]:
    """A function from text to evidence."""
    lm, starts = model["lm"], model["starts"]
    if not starts:
        return lambda text: 0.0
    can_be, named = readable(starts), sorted(starts)

    class Hits(dict):
        """The beginnings that a token counts as; long tokens are not kept."""

        def __missing__(self, token: str) -> tuple[str, ...]:
            bare = _bare(token)
            words = [bare] if _plain(bare) else _word.findall(bare)
            if len(bare) >= 5 and bare[::2].isalpha() and len(set(bare[1::2])) == 1 and not bare[1].isalnum():
                words = [*words, bare[::2]]  # one sign after every letter
            found = {s for w in words if (s := _start_of(starts, w))}
            if not _plain(bare) and (m := can_be.match(bare)) and spells(lm, m.group(), named[m.lastindex - 1]):
                found.add(named[m.lastindex - 1])
            if len(token) <= _KEEP:
                if len(self) > _CACHE:
                    self.clear()
                self[token] = tuple(sorted(found))
            return tuple(sorted(found))

    cache = Hits()

    def tell(text: str | None) -> float:
        tokens = (text or "").lower().split()
        hits = [(i, s) for i, t in enumerate(tokens) for s in cache[t]]
        for at, run in _spaced_runs(tokens):
            for m in can_be.finditer(run):
                if spells(lm, m.group(), named[m.lastindex - 1]):
                    hits.append((at + m.start() // 2, named[m.lastindex - 1]))
        return evidence(starts, len(tokens), hits)

    return tell


def scorer(model: dict) -> Callable[[str | None], float]:
    """A function from text to score."""
    if not model["starts"]:
        return lambda text: float(model["base"])
    tell = witness(model)

    def score(text: str | None) -> float:
        z = model["slope"] * (tell(text) - model["middle"])
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

    return score


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` with ``score``: one pass, no shuffle. The column takes
    the place of one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for b in slices(batches, "text"):
            s = pa.array([score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, in the columns of ``docs``:
    the rows pass through the workers once and nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for b in slices(batches, "text"):
            yield b.filter(pa.array([score(t) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
