"""Language identification by a linear-chain conditional random field over words.

A word (what stands between white space, its letters in lower case) has features:
its beginnings and ends of one to three letters, its letter bigrams and trigrams
with word bounds (all hashed to ``HASHED`` values), and from a lexicon the share of
each language among its sightings. Forward-backward gives each word's language
probabilities in its text, so words of code-switched texts get labels of their
own; a document's language has the largest mean over its words.

Training takes a bounded sample: of each language ``sample`` documents, those with the
smallest hash of doc_id; of a document longer than ``LONGEST`` characters that many, in
``PIECES`` pieces spread over all of it. A word's label is its document's language. Pieces of some words of different documents are
put in a row, so that the transitions learn both to stay and to switch. Half of
the sampled documents give the lexicon and the other half the weights. Only text
and language of the rows passed are seen.

Defined cases: null texts and texts without letters are ``und`` with score 0;
words without letters carry no evidence and no vote; ties go to the language that
comes first by name; with no labelled rows all texts are ``und``; repeated ids
keep a row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import crf
from .common import slices

#: Sampled documents of each language; characters of one that are learned from, and pieces they come in.
SAMPLE, LONGEST, PIECES = 250, 20_000, 20
HASHED = 1 << 16
#: Words of a training chain, mean words of a piece of one document, chains a step, rounds.
CHAIN, PIECE, CHAINS, ROUNDS = 48, 16, 64, 2
LEXICON_LEAST = 2
UNKNOWN = "und"
#: Tokens kept in a worker between batches, and their characters.
_CACHE, _CACHE_CHARS = 100_000, 8 << 20
_no_letters = re.compile(r"[\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def letters(token: str) -> str:
    return token if token.isalpha() else _no_letters.sub("", token)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in one array, and each word's bounds in it.
    Every word has at least one (its length)."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    flat = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    out, owners = [(np.minimum(sizes, 20).astype(np.uint64) + np.uint64(1)) * _MUL], [np.arange(len(words))]
    with np.errstate(over="ignore"):
        grams = flat * _MUL
        grams ^= grams >> np.uint64(31)
        for n in (2, 3):
            grams = (grams[:-1] + flat[n - 1 :]) * _MUL
            grams ^= grams >> np.uint64(29)
            whole = owner[: len(flat) - n + 1] == owner[n - 1 :]
            out.append((grams + np.uint64(n))[whole])
            owners.append(owner[: len(flat) - n + 1][whole])
        for sign, edge in ((1, begins + 1), (-1, ends - 2)):
            h = np.full(len(words), 7 + sign, dtype=np.uint64)
            for n in (1, 2, 3):
                fits = sizes - 2 >= n
                at = np.where(fits, edge + sign * (n - 1), 0)
                h = (h + flat[at]) * _MUL
                h ^= h >> np.uint64(30)
                out.append(((h + np.uint64(10 * n)) * _MUL)[fits])
                owners.append(np.flatnonzero(fits))
    owner, values = np.concatenate(owners), np.concatenate(out)
    order = np.argsort(owner, kind="stable")
    values = ((values ^ (values >> np.uint64(33))) % np.uint64(HASHED)).astype(np.int64)[order]
    return values, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))


def _sample(docs: DataFrame, sample: int) -> list:
    """The sampled rows (text, lang), at most ``sample`` of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id")
    small = known.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("doc_id", "lang")
    # ids of the sample alone are broadcast: ``sample`` for each language
    rows = known.join(F.broadcast(small.withColumnRenamed("lang", "_l").distinct()), ["doc_id"]).where("lang = _l")
    # of a text longer than LONGEST, as many characters, in pieces spread over all of it
    size, step = F.length("text"), f"(length(text) - {LONGEST // PIECES}) / {PIECES - 1}"
    spread = F.expr(f"array_join(transform(sequence(0, {PIECES - 1}), i -> substring(text, 1 + cast(i * {step} AS int), {LONGEST // PIECES})), ' ')")
    rows = rows.withColumn("text", F.when(size <= LONGEST, F.col("text")).otherwise(spread))
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # one of rows that share an id
    return sorted(((r.doc_id, r.lang, r.text) for r in rows.collect()), key=lambda r: (r[0], r[1]))


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from labelled rows ``docs`` (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = _sample(docs, sample)
    names = sorted({lang for _, lang, _ in rows})
    number = {x: i for i, x in enumerate(names)}
    texts = [([w for w in map(letters, text.lower().split()) if w], number[lang]) for _, lang, text in rows]
    texts = [x for x in texts if x[0]]
    if not texts:
        return {"names": [], "lexicon": {}}
    rng = random.Random(11)
    rng.shuffle(texts)
    half = max(1, len(texts) // 2)
    lexicon = _lexicon(texts[:half], len(names))
    learn = texts[half:] or texts
    pieces = []
    for words, y in learn:
        at = 0
        while at < len(words):
            n = 1 + int(rng.expovariate(1 / PIECE))
            pieces.append((words[at : at + n], y))
            at += n
    rng.shuffle(pieces)
    flat = [(w, y) for words, y in pieces for w in words]
    while len(flat) < CHAIN:
        flat += flat
    trainer = crf.Trainer(HASHED, len(names), len(names))
    chains = [flat[i : i + CHAIN] for i in range(0, len(flat) - CHAIN + 1, CHAIN)]
    for _ in range(ROUNDS):
        rng.shuffle(chains)
        for i in range(0, len(chains), CHAINS):
            part = chains[i : i + CHAINS]
            words = [w for c in part for w, _ in c]
            labels = np.array([[y for _, y in c] for c in part])
            trainer.step(*features(words), _real(words, lexicon, len(names)), labels)
    return {"names": names, "lexicon": lexicon, "weights": trainer.weights.astype(np.float32), "dense": trainer.dense, "trans": trainer.trans, "start": trainer.start}


def _lexicon(texts: list[tuple[list[str], int]], size: int) -> dict[str, tuple[float, ...]]:
    counts: dict[str, list[int]] = {}
    for words, y in texts:
        for w in words:
            counts.setdefault(w, [0] * size)[y] += 1
    return {w: tuple(x / sum(c) for x in c) for w, c in counts.items() if sum(c) >= LEXICON_LEAST}


def _real(words: list[str], lexicon: dict, size: int) -> np.ndarray:
    none = (0.0,) * size
    return np.array([lexicon.get(w, none) for w in words], dtype=float).reshape(len(words), size)


class Labeller:
    """Word probabilities of texts; keeps the scores of words it has seen, in bounds."""

    def __init__(self, model: dict) -> None:
        self.names, self.lexicon = model["names"], model["lexicon"]
        self.size = len(self.names)
        if self.size:
            self.weights, self.dense, self.trans, self.start = model["weights"], model["dense"], model["trans"], model["start"]
        self._forget()

    def _forget(self) -> None:
        #: token -> row of scores; row 0 is for tokens without letters
        self.at: dict[str, int] = {}
        self.held = 0
        self.scores = np.zeros((1, self.size))

    def _rows(self, tokens: list[str]) -> np.ndarray:
        missing = list(dict.fromkeys(t for t in tokens if t not in self.at))
        self.held += sum(map(len, missing))
        words = [letters(t) for t in missing]
        known = [(t, w) for t, w in zip(missing, words) if w]
        for t, w in zip(missing, words):
            if not w:
                self.at[t] = 0
        for i in range(0, len(known), 50_000):
            part = known[i : i + 50_000]
            values, bounds = features([w for _, w in part])
            scores = np.add.reduceat(self.weights[values], bounds[:-1], axis=0) + _real([w for _, w in part], self.lexicon, self.size) @ self.dense
            self.at.update((t, len(self.scores) + j) for j, (t, _) in enumerate(part))
            self.scores = np.concatenate([self.scores, scores])
        return np.fromiter(map(self.at.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def words(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each text, and over all of them: bounds, whether they have letters, probabilities."""
        if len(self.at) > _CACHE or self.held > _CACHE_CHARS:
            self._forget()
        split = [(t or "").lower().split() for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in split])))
        rows = self._rows([w for x in split for w in x])
        first = np.zeros(len(rows), dtype=bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        return split, bounds, rows > 0, crf.posteriors(self.scores[rows], first, self.trans, self.start)

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        if not self.size:
            return [(UNKNOWN, 0.0)] * len(texts)
        _, bounds, voting, p = self.words(texts)
        total = np.concatenate([np.zeros((1, self.size)), np.cumsum(p * voting[:, None], axis=0)])
        votes = np.concatenate([[0], np.cumsum(voting)])
        sums, n = total[bounds[1:]] - total[bounds[:-1]], votes[bounds[1:]] - votes[bounds[:-1]]
        out = []
        for s, k in zip(sums, n.tolist()):
            i = int(s.argmax())
            out.append((self.names[i], min(1.0, max(0.0, float(s[i]) / k))) if k else (UNKNOWN, 0.0))
        return out


def _mapped(docs: DataFrame, model: dict, schema: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for b in slices(batches, "text", 2 << 20):
            yield make(labeller, b)

    return rows.mapInArrow(run, schema)


def languages(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score): a row for each row of ``docs``."""

    def make(labeller: Labeller, b: pa.RecordBatch) -> pa.RecordBatch:
        found = labeller.documents(b.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return _mapped(docs, model, "doc_id long, lang_pred string, score double", make)


def word_languages(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, words): each word of a text with its most probable language (``und``
    if it has no letters) and the probability."""

    def make(labeller: Labeller, b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        if not labeller.size:
            out = [[{"word": w, "lang": UNKNOWN, "p": 0.0} for w in (t or "").lower().split()] for t in texts]
        else:
            split, bounds, voting, p = labeller.words(texts)
            best = p.argmax(axis=1)
            out = [
                [{"word": w, "lang": labeller.names[best[a + i]] if voting[a + i] else UNKNOWN, "p": float(p[a + i, best[a + i]]) if voting[a + i] else 0.0} for i, w in enumerate(words)]
                for words, a in zip(split, bounds.tolist())
            ]
        kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], names=["doc_id", "words"])

    return _mapped(docs, model, "doc_id long, words array<struct<word: string, lang: string, p: double>>", make)
