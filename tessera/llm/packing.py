"""Token ids in packed binary rows: best-fit-decreasing packing with a segment
tree over capacities.

A text becomes the ids of a byte-level BPE vocabulary followed by one end id. A
document longer than a row is split without loss: every full row's worth of ids
is a row of its own, and the rest (like every shorter document) is a piece. Of
each ``shard`` pieces in the order of the input, longest first, each goes into
the fullest open row that still has room; rows are found by their room in a
segment tree whose leaves are the room values.

Rows come out as binary matrices rows: ``ids`` (little-endian unsigned 16-bit,
``length`` of them, padded with the end id), ``positions`` (same type, starting
again at 0 in every segment, and 0 in the padding), the cumulative segment
lengths, and each segment's doc_id and offset of its first id in the document, so
every document can be put together again.

Texts are encoded by the tokenizer library; a long one in parts, cut before a single
space, where the vocabulary's pattern never joins, so its ids are those of the whole.

Scan tasks tokenize and pack by themselves: nothing is shuffled, a task holds one
shard and one text. The order of a table as read is that of its files (numbers in
their names count as numbers) and of the rows in a file, whatever files or splits
the scan puts in a task, and in which order: a shard is numbered by the place of its
first row, and ends where the task goes on with a split that does not follow. So the
order of shards is the order of the table (a mixture's order, for one); files with
fewer pieces than a shard make smaller shards. Any other input is taken in the order
of its partitions; a lost task must get its rows again in the same order.

Defined cases: null and empty texts are one end id; null and repeated ids are
kept as they are; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A rank file (base64 token, rank) of at most 65,535 entries; the path is a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pattern, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
SHARD = 4096
#: Characters of a text encoded at a time; it is cut before a single space, which the
#: pattern never joins with what stands before it.
_PART = 1 << 20
_single = re.compile(r"\S(?= \S)")
_ROWS = 256
#: Bits of a shard's number that hold the place of its first row in its file.
_PLACE = 40

SCHEMA = "shard long, row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, offsets array<int>"
_arrow = pa.schema([
    ("shard", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()),
    ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())),
])


class Encoder:
    """Ids of a text as little-endian unsigned 16-bit numbers, the end id last."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.end = max(ranks.values()) + 1
        if self.end > 0xFFFF:
            raise ValueError("ids do not fit 16 bits")
        self._encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        ids = array("H", self._encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str | None) -> bytes:
        parts, begin = [], 0
        while text and begin < len(text):
            cut = _single.search(text, begin + _PART)
            end = cut.start() + 1 if cut else len(text)
            parts.append(self._ids(text[begin:end]))
            begin = end
        return b"".join([*parts, self.end.to_bytes(2, "little")])


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Rooms:
    """Open rows by their room: a segment tree that has, over the values 0 to
    ``most``, whether some row has that room. Equal rooms: the row opened first."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.tree = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at and not self.tree[at]:
            self.tree[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the smallest room of at least ``need``, taken out."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        rows = self.rows[room]
        row = min(rows)
        rows.remove(row)
        if not rows:
            while at and not (at < self.size and (self.tree[2 * at] or self.tree[2 * at + 1])):
                self.tree[at] = 0
                at >>= 1
        return room, row


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Rows as lists of positions in ``lengths`` (each 1 to ``most``)."""
    rooms, rows = Rooms(most), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        if found is None:
            found = most, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            rooms.put(room - lengths[i], row)
    return rows


def _row(shard: int, number: int, pieces: list[tuple[int | None, int, bytes]], length: int, end: int) -> dict:
    sizes = [len(p[2]) // 2 for p in pieces]
    bounds = [0]
    for n in sizes:
        bounds.append(bounds[-1] + n)
    ids = np.full(length, end, dtype="<u2")
    ids[: bounds[-1]] = np.frombuffer(b"".join(p[2] for p in pieces), dtype="<u2")
    positions = np.zeros(length, dtype="<u2")
    for a, b in zip(bounds, bounds[1:]):
        positions[a:b] = np.arange(b - a)
    return {"shard": shard, "row": number, "n_tokens": bounds[-1], "ids": ids.tobytes(), "positions": positions.tobytes(),
            "cu_seqlens": bounds, "doc_ids": [p[0] for p in pieces], "offsets": [p[1] for p in pieces]}


def _from_files(docs: DataFrame) -> bool:
    """Whether rows of ``docs`` know their place in a file (Parquet tables as read)."""
    try:
        docs.select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length"), F.col("_metadata.row_index")).schema
    except AnalysisException:
        return False
    return True


def _natural(path: str) -> list:
    return [int(x) if i % 2 else x for i, x in enumerate(re.split(r"([0-9]+)", path))]


def _placed(docs: DataFrame, by_files: bool | None) -> tuple[DataFrame, dict[str | None, int]]:
    """The rows (doc_id, text) with their file, the bounds of their split in it and
    their place in the file, and the files' numbers in order (as many as the scan's
    listing holds on the driver anyway)."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if not (_from_files(docs) if by_files is None else by_files):
        part = F.spark_partition_id().cast("long")
        return docs.select(*columns, F.lit(None).cast("string").alias("file"), part.alias("begin"), part.alias("end"), F.monotonically_increasing_id().alias("at")), {None: 0}
    at = F.col("_metadata")
    files = [r.file for r in docs.select(at["file_path"].alias("file")).distinct().collect()]
    begin = at["file_block_start"]
    rows = docs.select(*columns, at["file_path"].alias("file"), begin.alias("begin"), (begin + at["file_block_length"]).alias("end"), at["row_index"].alias("at"))
    return rows, {f: i for i, f in enumerate(sorted(files, key=_natural))}


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD, by_files: bool | None = None) -> DataFrame:
    """Packed rows (``SCHEMA``) of ``docs`` (doc_id, text). ``by_files`` says whether the
    order is that of the files; left out, it is if rows know their place in a Parquet
    file. Say no for a table that was shuffled after reading."""
    if not 1 <= length <= 0xFFFF:
        raise ValueError("length must fit 16 bits")
    # the vocabulary file is read once on the driver: 65,535 entries at most
    rows, files = _placed(docs, by_files)
    shared = docs.sparkSession.sparkContext.broadcast((ranks_of(vocabulary), files))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, numbers = shared.value
        encoder = Encoder(ranks)
        full = 2 * length
        waiting: list[tuple[int | None, int, bytes]] = []
        out: list[dict] = []
        first, number = None, 0  # the shard, and its rows so far
        split = None

        def flush() -> Iterator[dict]:
            for i, chosen in enumerate(best_fit([len(p[2]) // 2 for p in waiting], length)):
                yield _row(first, number + i, [waiting[j] for j in chosen], length, encoder.end)

        for b in slices(batches, "text"):
            for doc_id, text, file, begin, end, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "file", "begin", "end", "at"))):
                if split != (file, begin, end):
                    follows = split is not None and split[0] == file and split[2] == begin
                    split = file, begin, end
                    if first is not None and not follows:
                        for row in flush():
                            out.append(row)
                            if len(out) >= _ROWS:
                                yield pa.RecordBatch.from_pylist(out, schema=_arrow)
                                out = []
                        waiting, number, first = [], 0, None
                if first is None:
                    first = (numbers[file] << _PLACE) + at
                ids = encoder(text)
                whole = len(ids) // full * full
                for offset in range(0, whole, full):
                    out.append(_row(first, number, [(doc_id, offset // 2, ids[offset : offset + full])], length, encoder.end))
                    number += 1
                    if len(out) >= _ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema=_arrow)
                        out = []
                if whole < len(ids):
                    waiting.append((doc_id, whole // 2, ids[whole:]))
                if len(waiting) == shard:
                    for row in flush():
                        out.append(row)
                        if len(out) >= _ROWS:
                            yield pa.RecordBatch.from_pylist(out, schema=_arrow)
                            out = []
                    waiting, number, first = [], 0, None
        out += flush()
        for at in range(0, len(out), _ROWS):
            yield pa.RecordBatch.from_pylist(out[at : at + _ROWS], schema=_arrow)

    return rows.mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet; a file's ``ids`` column is its id matrix."""
    packed.write.parquet(path)


def matrix(rows: list, column: str = "ids") -> np.ndarray:
    """The id (or position) matrix of collected rows."""
    return np.stack([np.frombuffer(r[column], dtype="<u2") for r in rows])
