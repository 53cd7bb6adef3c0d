"""Quality rules: base checks on document statistics and a verdict of gradient-boosted
trees over them.

Words are runs of characters other than ASCII white space. Base statistics of a whole
text: words, code points in words, signs of ``#*$%&|<>``, lines with a word that equal
an earlier line, and words that lie in a three-word window found twice or more (the
first occurrence included). A text fails the base checks below ``LEAST_WORDS`` words or
if more than half of its words lie in repeated windows.

The trees see the ratios of ``FEATURES``. They are grown here: Newton boosting of the
logistic loss over quantile bins, on statistics of a bounded sample of labelled rows
(``sample`` rows of each class, those with the smallest hash of doc_id, weighted back
to the classes' shares). Features of ``FALLING`` may only lower the verdict: a split
that would raise it is not taken, and the bound of a split's middle goes down to all
nodes below. The forest is flattened into arrays of features, thresholds, children and
values, and all rows of a batch walk all trees at once, one level a step. A document
is kept if it passes the base checks and its score, the probability of label 1, is at
least ``THRESHOLD``.

Defined cases: null and empty texts have no words and fail the base checks; without
rows of both labels every score is 1.0 (0.0 if there are only labels 0); null labels
and labels of unknown documents are ignored; of repeated labels the largest counts, of
documents with one doc_id one in the sample; all rows are returned, with repeated and
null ids; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_bytes, written

LEAST_WORDS = 50
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes that don't begin a code point inside a word.
_NOT_CHARS = SPACE + bytes(range(0x80, 0xC0))
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_NOT_POINT = bytes(b for b in range(256) if b not in b".,;:!?'\"()-")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_distinct", "n_upper", "n_digits", "n_points"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "distinct", "upper", "digits", "points"]
#: More of these never makes a document better.
FALLING = ["symbols", "dup_lines", "repeats"]
#: Texts beyond so many bytes have their windows counted in numpy.
LONG = 1 << 20


# -- statistics -------------------------------------------------------------------
def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n - 2:
        return 0
    count = Counter(windows)
    return _covered(np.fromiter((count[w] > 1 for w in windows), bool, n - 2))


def long_words(text: bytes) -> tuple[int, int, int]:
    """Words, different words and repeated words of a long text, with a few numbers for
    each word in place of objects."""
    data = np.frombuffer(text.translate(bytes(32 if b in SPACE else b for b in range(256))), dtype=np.uint8)
    inside = data != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    n = len(edge) // 2
    if not n:
        return 0, 0, 0
    offsets = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(edge[1::2] - edge[::2], out=offsets[1:])
    ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode().indices.to_numpy().astype(np.int64)
    size = int(ids.max()) + 1
    if n < 4:
        return n, size, 0
    _, pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    return n, size, _covered(count[window] > 1)


def _covered(found: np.ndarray) -> int:
    cover = np.zeros(len(found) + 2, dtype=bool)
    for i in range(3):
        cover[i : i + len(found)] |= found
    return int(cover.sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for one text."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    if len(text) > LONG:
        n, distinct, repeats = long_words(text)
    else:
        words = text.split()
        n, distinct, repeats = len(words), len(set(words)), repeated_words(words)
    return (n, len(text.translate(None, _NOT_CHARS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats,
            len(lines), distinct, len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _NOT_DIGIT)), len(text.translate(None, _NOT_POINT)))


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios of FEATURES from rows of COUNTS."""
    c = {name: counts[:, i].astype(float) for i, name in enumerate(COUNTS)}
    words, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        words / lines, c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_points"] / chars,
    ])


def base_failed(counts: np.ndarray) -> np.ndarray:
    words, repeats = counts[:, 0], counts[:, 4]
    return (words < LEAST_WORDS) | (100 * repeats > 50 * words)


# -- trees --------------------------------------------------------------------------
@dataclass
class Forest:
    """All nodes of all trees: a row goes left where feature <= threshold; leaves point
    to themselves. ``raw`` sums the leaves' values onto ``base``."""

    base: float = 0.0
    depth: int = 0
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, feature: int = 0, threshold: float = np.inf, value: float = 0.0) -> int:
        at = len(self.value)
        for column, x in ((self.feature, feature), (self.threshold, threshold), (self.left, at), (self.right, at), (self.value, value)):
            column.append(x)
        return at

    def arrays(self) -> dict[str, np.ndarray]:
        return {"roots": np.array(self.roots, dtype=np.int32), "feature": np.array(self.feature, dtype=np.int32), "threshold": np.array(self.threshold), "left": np.array(self.left, dtype=np.int32), "right": np.array(self.right, dtype=np.int32), "value": np.array(self.value)}

    def raw(self, x: np.ndarray, rows: int = 8192) -> np.ndarray:
        a, out = self.arrays(), np.full(len(x), self.base)
        if not self.roots:
            return out
        for begin in range(0, len(x), rows):
            part = x[begin : begin + rows]
            node = np.broadcast_to(a["roots"], (len(part), len(self.roots)))
            line = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[line, a["feature"][node]] <= a["threshold"][node], a["left"][node], a["right"][node])
            out[begin : begin + rows] += a["value"][node].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, falling: list[int], trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, shrink: float = 5.0, least: float = 5.0) -> Forest:
    """Boosted trees for P(y = 1); ``falling`` features never raise it. A node's sum of
    second derivatives is at least ``least``, ``shrink`` is added in its value."""
    if not len(y) or y.min() == y.max():
        return Forest(base=np.inf if not len(y) or y[0] else -np.inf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    mean = np.average(y, weights=weight)
    forest = Forest(base=float(np.log(mean / (1 - mean))), depth=depth)
    raw = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = weight * (y - p), weight * p * (1 - p)
        forest.roots.append(_split(forest, binned, edges, g, h, np.arange(len(y)), raw, depth, -np.inf, np.inf, falling, rate, shrink, least))
    return forest


def _split(forest, binned, edges, g, h, rows, raw, depth, low, high, falling, rate, shrink, least) -> int:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    here = float(np.clip(total_g / (total_h + shrink), low, high))
    best = None
    if depth and total_h >= 2 * least:
        for f, e in enumerate(edges):
            if not len(e):
                continue
            left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            left_v, right_v = np.clip(left_g / (left_h + shrink), low, high), np.clip(right_g / (right_h + shrink), low, high)
            # the loss taken off by giving a node the value v
            gain = sum(2 * a * v - (b + shrink) * v * v for a, b, v in ((left_g, left_h, left_v), (right_g, right_h, right_v))) - (2 * total_g * here - (total_h + shrink) * here * here)
            bad = (left_h < least) | (right_h < least)
            if f in falling:
                bad |= right_v > left_v
            gain = np.where(bad, -np.inf, gain)
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, (left_v[k] + right_v[k]) / 2)
    if best is None:
        raw[rows] += rate * here
        return forest.add(value=rate * here)
    _, f, k, middle = best
    at = forest.add(feature=f, threshold=float(edges[f][k]))
    on_left = binned[rows, f] <= k
    bounds = ((middle, high), (low, middle)) if f in falling else ((low, high), (low, high))
    forest.left[at] = _split(forest, binned, edges, g, h, rows[on_left], raw, depth - 1, *bounds[0], falling, rate, shrink, least)
    forest.right[at] = _split(forest, binned, edges, g, h, rows[~on_left], raw, depth - 1, *bounds[1], falling, rate, shrink, least)
    return at


# -- Spark --------------------------------------------------------------------------
def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.array([statistics(t) for t in text_bytes(batch.column("text"))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Forest:
    """Trees fitted on at most ``sample`` documents of each label."""
    known = docs.where("doc_id IS NOT NULL").select("doc_id").join(labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label")), "doc_id").distinct()
    known = written(known.withColumn("label", (F.col("label") > 0).cast("int")), "quality-labels")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    # a bound on the hash leaves some rows more than the sample to be ranked
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    bounds = [min(1 << 40, (1 << 40) * (sample + sample // 4 + 100) // max(1, sizes.get(v, 0))) for v in (0, 1)]
    near = known.where(F.col("h") <= F.when(F.col("label") == 0, F.lit(bounds[0])).otherwise(F.lit(bounds[1])))
    order = Window.partitionBy("label").orderBy("h", "doc_id")
    chosen = written(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).select("doc_id", "label"), "quality-sample")
    # the sample's ids alone are broadcast; one document for each
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = counted(texts).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("c")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "c.*").toPandas().sort_values("doc_id")
    counts, y = rows[COUNTS].to_numpy(np.int64).reshape(-1, len(COUNTS)), rows["label"].to_numpy(float)
    weight = np.array([sizes[int(v)] / max(1, (y == v).sum()) for v in y])
    weight = weight * len(y) / max(1e-9, weight.sum())
    return grow(features(counts), y, weight, [FEATURES.index(f) for f in FALLING])


def judged(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base statistics, base_failed, score and kept of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.array([statistics(t) for t in text_bytes(batch.column("text"))], dtype=np.int64).reshape(-1, len(COUNTS))
            failed, score = base_failed(rows), shared.value.score(features(rows))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=["doc_id", *BASE, "base_failed", "score", "kept"])

    rows = docs.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    return rows.mapInArrow(judge, schema)
