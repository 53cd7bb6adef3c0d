"""Dictionary search: which terms of a dictionary each text contains.

Texts pass an Aho-Corasick automaton in Arrow batches, so a text is read once for all
terms of an automaton. The dictionary is cut into blocks of ``block_bytes`` (an
automaton takes some 70 bytes for each byte of its terms), so memory does not follow
its size:

* A dictionary without keys that fits one block is broadcast; that is checked on its
  size, and texts are then searched where they are read, without a shuffle.
* Keys with ``FEW`` terms at most, and no more than a block of them or a slice of texts,
  are joined: a text meets the array of its key's terms.
* Any other dictionary meets the texts in sorted streams: terms and texts of a key go
  to one place, the terms first, and the texts stream past the automaton of their
  block. Keys with more than a block of terms or a slice of texts are dealt out over
  (block, slice): each slice of texts meets each block of terms, and nothing of a key is
  gathered beyond one block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

BLOCK_BYTES = 2 << 20
SLICE_BYTES = 256 << 20
#: So many terms are looked for one by one.
FEW = 4


class Terms:
    """The different terms of one block; empty terms are in no text."""

    def __init__(self, terms: Iterable[str]):
        self.terms = list(dict.fromkeys(t for t in terms if t))
        self.automaton = None
        if len(self.terms) > FEW:
            self.automaton = ahocorasick.Automaton()
            for t in self.terms:
                self.automaton.add_word(t, t)
            self.automaton.make_automaton()

    def found(self, text: str | None) -> list[str]:
        """The terms inside ``text``, each once."""
        if not text:
            return []
        if self.automaton is None:
            return [t for t in self.terms if t in text]
        return list({t for _, t in self.automaton.iter(text)})


def _matches(batch: pa.RecordBatch, names: list[str], rows: list[int], terms: list[str]) -> pa.RecordBatch:
    columns = [batch.column(n).take(pa.array(rows, pa.int64())) for n in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(terms, pa.string())], names=[*names, "term"])


def _types(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _search_in_place(texts: DataFrame, terms: list[str], keep: list[str]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Terms(shared.value)
        for batch in batches:
            hits = [(i, t) for i, x in enumerate(batch.column("text").to_pylist()) for t in held.found(x)]
            yield _matches(batch, keep, [i for i, _ in hits], [t for _, t in hits])

    return texts.select(*dict.fromkeys([*keep, "text"])).mapInArrow(search, f"{_types(texts, keep)}, term string")


def _search_streams(rows: DataFrame, group: list[str], keep: list[str]) -> DataFrame:
    """``rows`` has the columns of ``group``, ``kind`` (0: a term, 1: a text), ``text`` and
    ``keep``, sorted by group and kind within its partitions."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, terms, held = None, [], None
        for batch in batches:
            hits, found = [], []
            for i, (here, kind, text) in enumerate(zip(zip(*(batch.column(g).to_pylist() for g in group)), batch.column("kind").to_pylist(), batch.column("text").to_pylist())):
                if here != at:
                    at, terms, held = here, [], None
                if kind == 0:
                    terms.append(text)
                elif terms:
                    if held is None:
                        held = Terms(terms)
                    more = held.found(text)
                    hits += [i] * len(more)
                    found += more
            yield _matches(batch, keep, hits, found)

    return rows.mapInArrow(search, f"{_types(rows, keep)}, term string")


def _search_joined(terms: DataFrame, texts: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    held = terms.groupBy(*keys).agg(F.collect_set("term").alias("_terms"))
    inside = F.filter("_terms", lambda t: F.contains(F.col("text"), t))
    return texts.join(held, keys).select(*dict.fromkeys([*keys, *keep]), F.explode(inside).alias("term"))


def contained(terms: DataFrame, texts: DataFrame, keys: Sequence[str] = (), keep: Sequence[str] = ("text",),
              block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(keys, keep, term): a row for each row of ``texts`` (keys, text, keep) and each
    different term of ``terms`` (keys, term) with the same keys that its text contains,
    case-sensitive. Null keys meet nothing."""
    keys, keep = list(keys), list(keep)
    terms = terms.select(*keys, "term").where(F.length("term") > 0).dropna(subset=keys or None)
    texts = texts.select(*dict.fromkeys([*keys, *keep, "text"])).where(F.length("text") > 0).dropna(subset=keys or ["text"])
    size = F.octet_length("term") + 8
    if not keys:
        terms = terms.distinct()
        total = terms.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).collect()[0].n
        if total <= block_bytes:
            return _search_in_place(texts, [r.term for r in terms.collect()], keep)
    load = terms.select(*keys, size.alias("t"), F.lit(0).alias("x")).unionByName(texts.select(*keys, F.lit(0).alias("t"), F.octet_length("text").alias("x")))
    load = load.groupBy(*keys).agg(F.ceil(F.sum("t") / block_bytes).cast("int").alias("_blocks"), F.ceil(F.sum("x") / slice_bytes).cast("int").alias("_slices"),
                                   F.count_if(F.col("t") > 0).alias("_n"))
    large = (F.col("_blocks") > 1) | (F.col("_slices") > 1)
    joined = None
    if keys:  # keys that have both terms and texts, and many of them
        apart = stored(load.where((F.col("_blocks") > 0) & (F.col("_slices") > 0) & (large | (F.col("_n") > FEW))), "apart-keys")
        if apart.isEmpty():
            return _search_joined(terms, texts, keys, keep)
        those = apart.select(*keys)
        joined = _search_joined(terms.join(those, keys, "left_anti"), texts.join(those, keys, "left_anti"), keys, keep)
        terms, texts, load = terms.join(those, keys, "left_semi"), texts.join(those, keys, "left_semi"), apart
    hot = stored(load.where(large).drop("_n"), "hot-keys")
    one = [F.lit(0).alias("_block"), F.lit(0).alias("_slice")]
    if hot.isEmpty():
        left, right = terms.select("*", *one), texts.select("*", *one)
    else:
        least = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1))
        meet = (lambda df: df.join(hot, keys, "left")) if keys else (lambda df: df.crossJoin(F.broadcast(hot)))  # without keys hot has one row
        deal = lambda c, n: F.pmod(F.xxhash64(c), least(n).cast("long")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), least(n) - 1))
        left = meet(terms).select("*", every("_slices").alias("_slice"), deal("term", "_blocks").alias("_block")).drop("_blocks", "_slices")
        # equal texts are spread too
        right = meet(texts).withColumn("_any", F.xxhash64("text", F.monotonically_increasing_id()))
        right = right.select("*", every("_blocks").alias("_block"), deal("_any", "_slices").alias("_slice")).drop("_blocks", "_slices", "_any")
    group = [*keys, "_block", "_slice"]
    rest = [c for c in keep if c not in keys and c != "text"]
    left = left.select(*group, F.lit(0).alias("kind"), F.col("term").alias("text"), *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in rest])
    rows = left.unionByName(right.select(*group, F.lit(1).alias("kind"), "text", *rest))
    rows = rows.repartition(*group).sortWithinPartitions(*group, "kind")
    found = _search_streams(rows, group, [*keys, *[c for c in keep if c not in keys]])
    return found if joined is None else joined.unionByName(found)
