"""Main text of HTML pages by a linear-chain conditional random field over the
leaf blocks of the DOM.

A page is read with the standard parser (character references decoded; scripts,
styles, titles and the like left out). A head has no text of its own but that of
such elements, so it needs no end tag; formulas and the text inside objects, audio,
video and canvas are text like any other. A leaf block is a run of text between the
bounds of block elements, its white space turned into single spaces. Its features
are the tags and the words of class, id and role of all its ancestors (hashed, each once), its own tag
and neighbours' tags, and of its whole text the length, share of link text,
punctuation, capitals, digits, and for short texts all longer words. Viterbi decoding labels the
blocks of a page as main text or not.

The field is trained on a fixed number of labelled pages made by rule
(``page_samples``); their number is the bound of the sample. Pages pass through
the workers once; nothing is shuffled.

Defined cases: null or empty html and pages without main text give an empty text;
what the parser cannot make sense of is text; repeated ids keep a row each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import slices
from .page_samples import PAGES, labelled_pages

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html ins legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never main text: scripts, styles, parts of forms, and an
#: iframe's, which is markup for readers without frames.
SILENT = frozenset("script style title template textarea select option button datalist iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these, up to the bound.
CLOSES = {"p": ({"p"}, BLOCK - {"p"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HASHED = 1 << 14
DENSE = 9
ROUNDS = 4
_split = re.compile(r"[^a-z0-9]+")
#: Words that may tell a notice; short ones also stand in any prose.
_word = re.compile(r"\w{5,}|©")
_wide = re.compile(r"[^\x00-\x7f]+")
_CAPITALS = bytes(range(65, 91))


class Block:
    """A run of text, how much of it is linked, its place (own tag, parent's tag, depth up
    to 8), the hashed features of all its ancestors, and the innermost of these."""

    __slots__ = ("text", "linked", "place", "above", "inner")

    def __init__(self, text: str, linked: int, path: tuple[tuple[str, str], ...]) -> None:
        self.text, self.linked, self.inner = text, linked, None
        for tag, names in path:
            self.inner = (self.inner, tag, names)
        self.place = path[-1][0] if path else "", path[-2][0] if len(path) > 1 else "", min(len(path), 8)
        self.above = tuple(dict.fromkeys(f for x in path for f in _element_features(*x)))

    @classmethod
    def inside(cls, text: str, linked: int, around: list[tuple], above: tuple[int, ...]) -> Block:
        """The same from the open elements and features that a reader holds."""
        b = cls(text, linked, ())
        b.inner, b.above = around[-1] if around else None, above
        b.place = around[-1][1] if around else "", around[-2][1] if len(around) > 1 else "", min(len(around), 8)
        return b

    @property
    def path(self) -> tuple[tuple[str, str], ...]:
        """(tag, names) of all ancestors from the outermost, followed link by link."""
        out, at = [], self.inner
        while at is not None:
            out.append(at[1:])
            at = at[0]
        return tuple(reversed(out))


def _hash(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "replace")) % HASHED


@lru_cache(maxsize=20_000)
def _element_features(tag: str, names: str) -> tuple[int, ...]:
    return _hash(f"in {tag}"), *(_hash(f"name {w}") for w in _split.split(names) if w)


class _Reader(HTMLParser):
    """Collects the leaf blocks of a page. What is open is counted as it opens and
    closes, so a block costs the different features above it (``HASHED`` at most),
    however deep it stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, tuple[int, ...]]] = []  # (tag, its features)
        self.tags: dict[str, int] = {}  # of what is open
        self.around: list[tuple] = []  # the open block elements: (the one around it, tag, names)
        self.features: dict[int, int] = {}  # of these
        self.above: tuple[int, ...] | None = ()
        self.silent = self.links = self.linked = 0
        self.held: list[str] = []

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                if self.above is None:
                    self.above = tuple(self.features)
                self.blocks.append(Block.inside(text, self.linked, self.around, self.above))
            self.held = []
        self.linked = 0

    def _push(self, tag: str, names: str) -> None:
        own = _element_features(tag, names) if tag in BLOCK else ()
        self.open.append((tag, own))
        self.tags[tag] = self.tags.get(tag, 0) + 1
        if tag in BLOCK:
            self.around.append((self.around[-1] if self.around else None, tag, names))
        for f in own:
            n = self.features.get(f, 0)
            self.features[f] = n + 1
            if not n:
                self.above = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.held.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            elif self.tags.get("p"):
                self._close(*CLOSES["p"])
        names = " ".join(str(v) for k, v in attrs if k in ("class", "id", "role") and v)
        self._push(tag, names.lower())
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, ends: set, bound: set) -> None:
        """End the nearest open element of ``ends`` unless one of ``bound`` is nearer."""
        if not any(self.tags.get(t) for t in ends):
            return
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i][0]
            if tag in ends:
                self._pop(i)
                return
            if tag in bound:
                return

    def _pop(self, i: int) -> None:
        for tag, own in self.open[i:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            self.tags[tag] -= 1
            if tag in BLOCK:
                self.around.pop()
            for f in own:
                self.features[f] -= 1
                if not self.features[f]:
                    del self.features[f]
                    self.above = None
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.held.append(" ")
        if not self.tags.get(tag):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
            if self.open[i][0] in BLOCK and tag not in BLOCK:
                return  # an inline end tag does not end a block

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    reader = _Reader()
    if html:
        reader.feed(html)
        reader.close()
        reader.flush()
    return reader.blocks


@lru_cache(maxsize=20_000)
def _place_features(place: tuple[str, str, int]) -> tuple[int, ...]:
    tag, parent, depth = place
    return _hash(f"tag {tag}"), _hash(f"depth {depth}"), *([_hash(f"pair {parent} {tag}")] if depth > 1 else [])


def _path_features(path: tuple[tuple[str, str], ...]) -> tuple[int, ...]:
    """The features of a block's path."""
    b = Block("", 0, path)
    return tuple(dict.fromkeys(_place_features(b.place) + b.above))


def _counts(text: str) -> tuple[int, int, int]:
    """Punctuation marks, capitals and digits of the whole text."""
    plain = text.encode("ascii", "ignore")
    wide = "" if len(plain) == len(text) else "".join(_wide.findall(text))
    marks, capitals, digits = (len(plain) - len(plain.translate(None, kind)) for kind in (b".,;:!?", _CAPITALS, b"0123456789"))
    return marks, capitals + sum(map(str.isupper, wide)), digits + sum(map(str.isdigit, wide))


def features(page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features, bounds and real-valued features of a page's blocks."""
    out: list[int] = []
    bounds = [0]
    real = np.empty((len(page), DENSE))
    for i, b in enumerate(page):
        out += dict.fromkeys(_place_features(b.place) + b.above)
        if i and page[i - 1].place[2]:
            out.append(_hash(f"before {page[i - 1].place[0]}"))
        if i + 1 < len(page) and page[i + 1].place[2]:
            out.append(_hash(f"after {page[i + 1].place[0]}"))
        text = b.text
        n = len(text)
        if n <= 120:
            out += [_hash(f"word {w}") for w in _word.findall(text.lower())]
        bounds.append(len(out))
        marks, capitals, digits = _counts(text)
        real[i] = (
            1.0, math.log1p(n) / 5, min(b.linked, n) / n, marks / n * 5, text[-1] in ".!?:",
            capitals / n, digits / n, min(n, 30) / 30, i / max(1, len(page) - 1))
    return np.array(out, dtype=np.int64), np.array(bounds, dtype=np.int64), real


def labelled_blocks(page: list[tuple[str, int | None]]) -> tuple[list[Block], list[int]]:
    """Blocks of a training page with their labels: labels are written into the
    text as marks before the page is read."""
    html = "".join(x if y is None else _marked(x, y) for x, y in page)
    found, labels = blocks(html), []
    for b in found:
        labels.append(int("\ue001" in b.text))
        b.text = " ".join(b.text.replace("\ue000", "").replace("\ue001", "").split())
    return [b for b in found if b.text], [y for b, y in zip(found, labels) if b.text]


def _marked(html: str, y: int) -> str:
    """``html`` with the label's mark in front of each run of text."""
    mark = "\ue001" if y else "\ue000"
    return re.sub(r"(^|>)([^<>]*[^<>\s][^<>]*)", lambda m: m.group(1) + mark + m.group(2), html)


def train(pages: int = PAGES) -> dict:
    """The field's weights, from labelled pages made by rule; label 1 is main text."""
    data = [labelled_blocks(p) for p in labelled_pages(pages)]
    data = [(features(b), np.array([y])) for b, y in data if b]
    trainer = crf.Trainer(HASHED, DENSE, 2, rate=0.3)
    rng = random.Random(3)
    for _ in range(ROUNDS):
        rng.shuffle(data)
        for f, y in data:
            trainer.step(*f, y)
    return {"weights": trainer.weights.astype(np.float32), "dense": trainer.dense, "trans": trainer.trans, "start": trainer.start}


def labels(model: dict, page: list[Block]) -> np.ndarray:
    values, bounds, real = features(page)
    emit = np.add.reduceat(model["weights"][values], bounds[:-1], axis=0) + real @ model["dense"]
    return crf.viterbi(emit, model["trans"], model["start"])


def main_text(model: dict, html: str | None) -> str:
    page = blocks(html)
    if not page:
        return ""
    return "\n".join(b.text for b, y in zip(page, labels(model, page)) if y)


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """(page_id, url, text): a row for each row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 4 << 20):
            text = pa.array([main_text(shared.value, h) for h in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
