"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint: texts with A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles
of ``words`` words joined by one space (repeats count; fewer words: the whole
sequence; none: fingerprint zero). A shingle's hash is XXH64 of its UTF-8 bytes
with seed 42; a bit of the fingerprint is one if it is set in more than half of
the hashes.

Links: two fingerprints link at ``radius`` or fewer differing bits. Every bit
position i has a vector phi(i) in {0,1}^(radius+1) that is not zero; table v
keeps the bits with <phi(i), v> = 1. At most ``radius`` differing positions span
at most ``radius`` dimensions, so some v != 0 is orthogonal to all of them and
its table keeps none of them: every pair within the radius meets in a table, no
pair is left to chance. Equal fingerprints are collapsed first, so copies never
meet. A bucket of up to ``HOT`` different fingerprints is joined with itself; a
larger one meets in the middle: two fingerprints within ``radius`` have a common
point within half of it, so each one lists the points around it on the bits that
its table masks out, and each point links what lists it with its smallest.
Both ways are exact; no bucket is cut.

Nodes are fingerprints, numbered in a written table in the order of (their smallest
doc_id, that row's key), so different fingerprints whose smallest doc_ids are equal
are different nodes, and the smallest node of a component has its smallest doc_id.

Components: large-star and small-star rounds over the links until nothing
changes, each round written to the shared folder.

Joins are sorted ones, by hint: Spark sizes an exploded table like what it was
exploded from and a written one by its compressed files, and would send tables to
the driver that grow with the data. Only the table of offsets is broadcast.

Defined cases: null text counts as empty; empty texts have fingerprint zero and
link like any other; rows that share a doc_id keep a row each, and each belongs to
the component of its own fingerprint; a null doc_id
takes no part in the minimum but links like any other (a component may have a null id
if all are null);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, text_bytes, written

BITS = 64
SHINGLE_WORDS = 4
RADIUS = 4
#: Different fingerprints in a bucket from which points are listed instead of pairs.
HOT = 1024
_PIECE = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit integer."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    begins = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in tokens], out=begins[1:])
    width = min(words, len(tokens))
    first, last = begins[: len(tokens) - width + 1].tolist(), (begins[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(first), _PIECE):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + _PIECE], last[at : at + _PIECE])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(first), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a row for each row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = [fingerprint(t, words) for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The tables' masks (unsigned): 2^(radius+1) - 1 of them."""
    vectors = (1 << (radius + 1)) - 1
    phi = [i % vectors + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(free: int, radius: int) -> list[int]:
    """All words with at most ``radius`` of the bits of ``free`` set."""
    places = [1 << i for i in range(BITS) if free >> i & 1]
    return [_signed(sum(c)) for k in range(radius + 1) for c in combinations(places, k)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(points: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: enough links between ``points`` (rep, fp; fp unique) for
    the components of the graph of all pairs within ``radius`` bits."""
    keys = [F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius))]
    entries = points.select("rep", "fp", F.inline(F.array(*keys)))
    met = entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(entries.join(met.hint("merge"), ["t", "key"]).select("t", "key", "n", "rep", "fp"), "members")
    cold = members.where(F.col("n") <= hot)
    a, b = cold.alias("a"), cold.select("t", "key", "rep", "fp").alias("b")
    near = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (_distance(F.col("a.fp"), F.col("b.fp")) <= radius)
    pairs = a.join(b.hint("merge"), near).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    if not members.where(F.col("n") > hot).isEmpty():
        pairs = pairs.union(_hot_links(members.where(F.col("n") > hot), radius))
    return pairs.distinct()


def _hot_links(members: DataFrame, radius: int) -> DataFrame:
    """Links in large buckets. The table of offsets has a size that depends on
    the radius alone (31 x 497 rows for 4 bits)."""
    spark = members.sparkSession
    full = (1 << BITS) - 1
    rows = []
    for t, m in enumerate(masks(radius)):
        inner = set(ball(full & ~m, radius // 2))
        rows += [(t, d, d in inner) for d in ball(full & ~m, radius - radius // 2)]
    offsets = spark.createDataFrame(rows, "t short, d long, inner boolean")
    listed = members.join(F.broadcast(offsets), "t").select("t", "key", F.col("fp").bitwiseXOR(F.col("d")).alias("z"), "rep", "inner")
    centre = listed.groupBy("t", "key", "z").agg(F.min(F.when(F.col("inner"), F.col("rep"))).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1 and c is not null")
    pairs = listed.join(centre.hint("merge"), ["t", "key", "z"]).where("rep != c")
    return pairs.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b)
    reaches. Alternates large-star and small-star, which ends in one star for
    each component after O(log^2) rounds; minima are combined before shuffles
    and a star's rows are never gathered in one place."""
    edges = written(edges.select("a", "b"), "links")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        large = written(large, "large")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        linked = large.join(least.hint("merge"), "b")
        small = linked.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).distinct()
        edges = written(small, "small")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(",", "a", "b").cast("binary")))).first())
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a"), F.col("a")).distinct())
        before = now


def classes(rows: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(fp, component_id, stays): for each fingerprint of ``rows`` (doc_id, fp, key;
    key unique) the smallest doc_id of its component and the smallest key with it."""
    held = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    firsts = rows.groupBy("fp").agg(F.min(held).alias("first"), F.min("key").alias("any")).select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("stays"), "any")
    # classes without a doc_id come last: they link others and name a component only among themselves
    order = [F.col("component_id").asc_nulls_last(), F.coalesce("stays", "any")]
    ordered = firsts.repartitionByRange(*order).sortWithinPartitions(*order).drop("any")
    points = written(ordered.withColumn("rep", F.monotonically_increasing_id()), "points")
    found = components(links(points.select("rep", "fp"), radius, hot))
    moved = points.select("rep", "fp").join(found.where("node != component").hint("merge"), F.col("rep") == F.col("node")).select("fp", "component")
    firsts = points.select("rep", "component_id", "stays")
    moved = moved.join(firsts.hint("merge"), F.col("component") == F.col("rep")).select("fp", "component_id", "stays")
    return points.join(moved.select("fp").hint("merge"), "fp", "left_anti").select("fp", "component_id", "stays").union(moved)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of ``docs``; component_id
    is the smallest doc_id that it reaches over links, its own included."""
    rows = written(fingerprints(docs, words, id_col, text_col).withColumn("key", F.monotonically_increasing_id()), "fp")
    return rows.join(classes(rows, radius, hot).select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without those whose near copy with a smaller doc_id
    stays: one row of each component, with the columns of ``docs``. Rows count by
    themselves, also those that share a doc_id: of those in one component one stays,
    those in different components do not touch each other. Rows without doc_id stay.
    The rows are written once more, with a key each."""
    fp, key, lost = (fresh(docs.columns, x) for x in ("_fp", "_key", "_lost"))
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = pa.array([fingerprint(t, words) for t in text_bytes(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, fp])

    keyed = written(docs.mapInArrow(run, schema).withColumn(key, F.monotonically_increasing_id()), "keyed")
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(key).alias("key"))
    gone = rows.where("doc_id is not null").join(classes(rows, radius).select("fp", "stays").hint("merge"), "fp").where("key != stays").select(F.col("key").alias(lost))
    return keyed.join(gone, F.col(key) == F.col(lost), "left_anti").select(docs.columns)
