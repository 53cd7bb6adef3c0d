"""Repair of conversations by Wagner-Fischer alignment with the grammar of roles.

A repaired conversation has the role initials ``(s?(ua)+)?``. Edits: Keep a turn (0),
Rerole it to user or assistant (2), Delete it (3), Insert an empty turn of user or
assistant (2). Blank turns and turns that repeat an earlier role and text must go; a
truncated turn that stays costs 1. The audit has the initials of the cheapest edits in
order, the ASCII-least of equally cheap ones.

Turns are ordered by turn (nulls first); of one turn by role, then by 128 bits of the
text's SHA-256. They are cut into chunks of ``CHUNK`` turns wherever range partitions
of that order end, so a conversation of any length is spread over tasks. Between chunks
the grammar is at one of four points: the beginning, after s, after u, after a. For
every point before and after, a chunk is aligned with each feasible length of the piece
of the grammar string between them: the alternating strings of one end are suffixes of
each other, so one Wagner-Fischer table from the end has all lengths. Cells outside
Ukkonen's band are left out: as many inserts or deletes as the excess or lack of
target characters must fit in what the incumbent's cost leaves above the forced edits;
the incumbent is a left-to-right repair, and the band widens until the best alignment
found fits it. Each cheapest length is traced, and the audits are compared.

The chunks of a conversation are then joined in order, keeping the cheapest way to each
point. All audits of the same turns end with an edit that takes a turn (inserts stand
before the turn that follows them), so none begins another and the least of the pieces
make the least of the whole. The same pass, sorted by conversation and order, streams
the turns past the audit and hashes the repaired text; it holds the audit, not the
turns. A SHA-256 over a conversation has one order, so this last pass of a
conversation is one task's work, whatever its size.

Defined cases: null role and text count as one space, roles by their first character
(none for an empty role); null turns come first and no gap counts them; null conv_id is
a conversation; repeated rows are duplicates (of blank ones each is blank); an empty
table gives no rows; other columns are ignored; a gap count beyond 64 bits is 2^63-1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FINE, CUT, BLANK = 0, 1, 2
#: Points of the grammar, and what may be added at the end to make it whole.
BEGIN, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDINGS = {BEGIN: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}
ROLES = {"u": "user", "a": "assistant"}
_FAR = 1 << 60
_SPACES = " \t\n\x0b\x0c\r"

Turn = tuple[str, bool, int]  # initial, must go, cost if it stays


# -- alignment of a chunk ---------------------------------------------------------
def _after(point: int) -> str:
    """The character of u and a that comes next."""
    return "a" if point == AFTER_U else "u"


def incumbent(turns: list[Turn], point: int) -> int:
    """Cost of a repair from left to right."""
    cost, due = 0, _after(point)
    for i, (initial, gone, extra) in enumerate(turns):
        if gone:
            cost += DELETE
            continue
        cost += extra
        if initial == due or (initial == "s" and point == BEGIN and i == 0):
            due = ("a" if due == "u" else "u") if initial == due else due
        elif initial in ROLES:
            cost += INSERT
        else:
            cost += REROLE
            due = "a" if due == "u" else "u"
    return cost


class Table:
    """Costs to align turns i.. with the alternating string of length j that ends with
    ``end``, inside the band; turns are used up at the end."""

    def __init__(self, turns: list[Turn], end: str, slack: int):
        n = len(turns)
        self.turns, self.end, self.low, self.rows = turns, end, [0] * (n + 1), [[0]] * (n + 1)
        ahead, other = 0, "u" if end == "a" else "a"
        for i in range(n - 1, -1, -1):
            initial, gone, extra = turns[i]
            ahead += not gone
            low, start, below = max(0, ahead - slack // DELETE), self.low[i + 1], self.rows[i + 1]
            size, before, row = len(below), _FAR, []
            for j in range(low, ahead + slack // INSERT + 1):
                k = j - start
                best = below[k] + DELETE if 0 <= k < size else _FAR
                if j:
                    if before + INSERT < best:
                        best = before + INSERT
                    if not gone and 1 <= k <= size:
                        cost = below[k - 1] + extra + (KEEP if initial == (end if j & 1 else other) else REROLE)
                        if cost < best:
                            best = cost
                row.append(best)
                before = best
            self.low[i], self.rows[i] = low, row

    def cost(self, i: int, j: int) -> int:
        k = j - self.low[i]
        return self.rows[i][k] if 0 <= k < len(self.rows[i]) else _FAR

    def char(self, j: int) -> str:
        return self.end if j & 1 else "u" if self.end == "a" else "a"

    def lengths(self, i: int, due: str) -> list[int]:
        """Target lengths at turn i whose first character is the one due."""
        return [j for j in range(self.low[i], self.low[i] + len(self.rows[i])) if j and self.char(j) == due]

    def trace(self, i: int, j: int) -> str:
        """The ASCII-least of the cheapest audits from a cell."""
        out, n = [], len(self.turns)
        while i < n:
            initial, gone, extra = self.turns[i]
            here = self.cost(i, j)
            if self.cost(i + 1, j) + DELETE == here:
                out.append("D")
                i += 1
            elif j and self.cost(i, j - 1) + INSERT == here:
                out.append("I")
                j -= 1
            else:
                out.append("K" if initial == self.char(j) else "R")
                i, j = i + 1, j - 1
        return "".join(out)


def align(turns: list[Turn], points: tuple[int, ...] = (BEGIN, AFTER_S, AFTER_U, AFTER_A)) -> list[tuple[int, int, int, str]]:
    """(point before, point after, cost, audit) of the cheapest alignments of a chunk."""
    n = len(turns)
    forced = sum(DELETE if gone else extra for _, gone, extra in turns)
    slack = max(incumbent(turns, p) for p in points) - forced + 4
    singles = [i for i, (initial, gone, _) in enumerate(turns) if initial == "s" and not gone]
    found = [(p, p, DELETE * n, "D" * n) for p in points if p in (BEGIN, AFTER_S)]
    if BEGIN in points and singles:  # the string s
        least = min(turns[i][2] for i in singles)
        # a later turn kept is more D first
        i = max(i for i in singles if turns[i][2] == least)
        found.append((BEGIN, AFTER_S, DELETE * (n - 1) + least, "D" * i + "K" + "D" * (n - 1 - i)))
    for after, end in ((AFTER_U, "u"), (AFTER_A, "a")):
        while True:
            table = Table(turns, end, slack)
            best = {p: _cheapest(table, p, after, singles) for p in points}
            worst = max(cost for cost, _ in best.values())
            if worst - forced <= slack:
                break
            slack = worst - forced if worst < _FAR else 2 * slack + 2
        for p, (cost, cells) in best.items():
            found.append((p, after, cost, min("D" * i + "K" * s + table.trace(i + s, j) for i, s, j in cells)))
    return found


def _cheapest(table: Table, point: int, after: int, singles: list[int]) -> tuple[int, list[tuple[int, int, int]]]:
    """The least cost from a point over all target lengths, and where it is met: i turns
    deleted and then one kept as s (or none of both), then the cell of length j."""
    cells = [(table.cost(0, j), (0, 0, j)) for j in table.lengths(0, _after(point)) + ([0] if point == after else [])]
    if point == BEGIN:
        cells += [(DELETE * i + table.turns[i][2] + table.cost(i + 1, j), (i, 1, j)) for i in singles for j in table.lengths(i + 1, "u")]
    least = min((cost for cost, _ in cells), default=_FAR)
    return least, [cell for cost, cell in cells if cost == least]


# -- chunks joined ----------------------------------------------------------------
class Joined:
    """The cheapest ways over the chunks seen so far, and their counts."""

    def __init__(self):
        self.best = {BEGIN: (0, 0)}  # point: cost, rank of its audit among the points' audits
        self.back: list[dict[int, tuple[int, str]]] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.low, self.high, self.initial = 0, None, None, None

    def add(self, chunk: dict) -> None:
        ways: dict[int, tuple[int, int, str, int]] = {}
        for w in chunk["ways"]:
            if w["before"] in self.best:
                cost, rank = self.best[w["before"]]
                way = (cost + w["cost"], rank, w["audit"], w["before"])
                if w["after"] not in ways or way < ways[w["after"]]:
                    ways[w["after"]] = way
        order = sorted(ways, key=lambda p: ways[p][1:3])
        self.best = {p: (ways[p][0], order.index(p)) for p in ways}
        self.back.append({p: (way[3], way[2]) for p, way in ways.items()})
        for name in self.counts:
            self.counts[name] += chunk[name]
        if self.initial is not None and self.initial + chunk["first"] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = chunk["last"]
        if chunk["low"] is not None:
            self.turns += chunk["turns"] - (self.high == chunk["low"])
            self.low = chunk["low"] if self.low is None else self.low
            self.high = chunk["high"]

    def audit(self) -> tuple[int, str]:
        cost, _, point = min((cost + INSERT * len(ENDINGS[p]), rank, p) for p, (cost, rank) in self.best.items())
        parts = [ENDINGS[point]]
        for step in reversed(self.back):
            point, part = step[point]
            parts.append(part)
        return cost, "".join(reversed(parts))

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)


class Replay:
    """Turns streamed past the audit give the repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, None

    def _due(self) -> str:
        return "a" if self.last == "u" else "u"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.last = self._due()
            yield "I", ROLES[self.last], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.last = role[:1]
            yield edit, role, text
        elif edit == "R":
            self.last = self._due()
            yield edit, ROLES[self.last], text


# -- Spark --------------------------------------------------------------------------
def damaged(turns: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text) with faults put in by crc32 of conv_id:turn;
    ``copies`` says how often a row stands there."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault, text = F.col("fault"), F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("fault")).where(fault != 0)
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
    )


_ORDER = ["known", "turn", "role", "digest"]
_WAYS = "array<struct<before:int,after:int,cost:long,audit:string>>"
_LONG, _TEXT = pa.int64(), pa.string()
_WAY = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", _LONG), ("audit", _TEXT)])
#: The same in Arrow, after conv_id.
_ARROW_CHUNK = [("known", pa.bool_()), ("turn", _LONG), ("role", _TEXT), ("digest", pa.binary()), ("place", pa.int32()),
                *((c, _LONG) for c in ("n", "blank", "duplicate", "truncated", "illegal")), ("first", _TEXT), ("last", _TEXT),
                *((c, _LONG) for c in ("turns", "low", "high")), ("ways", pa.list_(_WAY))]
_CHUNK = f"n long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long, ways {_WAYS}"


def _keyed(turns: DataFrame) -> DataFrame:
    space = F.lit(" ")
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), copies.cast("int").alias("copies"))
    return rows.withColumns({"known": F.col("turn").isNotNull(), "digest": F.substring(F.unhex(F.sha2("text", 256)), 1, 16)})


def _state() -> Column:
    text = F.col("text")
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.right(F.rtrim(text, F.lit(_SPACES)), F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names))


def chunks(keyed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Aligned chunks of the rows of ``_keyed``: the key of the first turn, the place
    in its partition, and the fields of ``_CHUNK``. No text is shuffled."""
    spark = keyed.sparkSession
    slim = keyed.select("conv_id", *_ORDER, "copies", _state().alias("state"))
    text = ["conv_id", "role", "digest"]
    at = F.struct("known", F.coalesce("turn", F.lit(0)).alias("turn"))
    again = slim.where(F.col("state") != BLANK).groupBy(*text).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at")).where("first_at <> last_at").drop("last_at")
    again = again.select(*[F.col(c).alias(c) for c in text], "first_at")
    later = F.col("first_at").isNotNull() & ~(F.col("first_at.known").eqNullSafe(F.col("known")) & F.col("first_at.turn").eqNullSafe(F.coalesce("turn", F.lit(0))))
    marked = slim.join(again, _same(slim, again, text), "left").select(*[slim[c] for c in slim.columns], later.alias("later"))
    marked = written(marked, "turn-marks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = marked.repartitionByRange(parts, "conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, before, number, whole, schema = [], None, None, 0, False, None
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), *_ARROW_CHUNK])
            for r in batch.to_pylist():
                key = (r["conv_id"], r["turn"], r["role"], r["digest"])
                for copy in range(r["copies"]):
                    if held is not None and (held.conv != r["conv_id"] or len(held.turns) >= chunk):
                        whole = held.conv != r["conv_id"]
                        out.append(held.row())
                        held = None
                    if held is None:
                        held, number = _Chunk(r, number, whole), number + 1
                    held.add(r, r["later"] or key == before)
                    before = key
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if held is not None:
            out.append(held.row())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kind = ordered.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(cut, f"conv_id {kind}, known boolean, turn long, role string, digest binary, place int, {_CHUNK}")


class _Chunk:
    def __init__(self, r: dict, place: int, whole: bool):
        self.conv, self.whole, self.turns, self.before = r["conv_id"], whole, [], None
        self.out = {"conv_id": r["conv_id"], **{c: r[c] for c in _ORDER}, "place": place, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None}

    def add(self, r: dict, again: bool) -> None:
        initial, out = r["role"][:1], self.out
        blank, cut = r["state"] == BLANK, r["state"] == CUT
        again &= not blank
        out["blank"] += blank
        out["duplicate"] += again
        out["truncated"] += cut and not again
        if self.turns and self.turns[-1][0] + initial not in ("su", "ua", "au"):
            out["illegal"] += 1
        if r["turn"] is not None and r["turn"] != out["high"]:
            out["turns"] += 1
            out["low"] = r["turn"] if out["low"] is None else out["low"]
            out["high"] = r["turn"]
        self.turns.append((initial, blank or again, TRUNCATED * cut))

    def row(self) -> dict:
        """A chunk known to begin its conversation needs one point before it."""
        ways = align(self.turns, (BEGIN,) if self.whole else (BEGIN, AFTER_S, AFTER_U, AFTER_A))
        ways = [dict(zip(("before", "after", "cost", "audit"), w)) for w in ways]
        return self.out | {"n": len(self.turns), "first": self.turns[0][0], "last": self.turns[-1][0], "ways": ways}


def _streamed(turns: DataFrame, ids: DataFrame | None, chunk: int, fields: list[tuple[str, pa.DataType]], each) -> DataFrame:
    """Conversations, their chunks and their turns in one sorted stream; ``each`` makes
    a folder of it for every task."""
    keyed = _keyed(turns)
    names = (turns if ids is None else ids).select("conv_id").distinct()
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split(" ", 1) for f in _CHUNK.split(", "))]
    none = {"known": "boolean", "turn": "long", "role": "string", "digest": "binary", "place": "int", "text": "string"}
    rows = names.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], *empty)
    rows = rows.unionByName(chunks(keyed, chunk).withColumns({"kind": F.lit(1), "text": F.lit(None).cast("string")}))
    rows = rows.unionByName(keyed.select("conv_id", F.lit(2).alias("kind"), *_ORDER, F.col("copies").alias("place"), "text", *empty))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER, "place")
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, out, arrow = each(), [], None
        for batch in batches:
            arrow = pa.schema([batch.schema.field("conv_id"), *fields])
            for part in range(0, batch.num_rows, 500):
                for r in batch.slice(part, 500).to_pylist():
                    out.extend(folder.take(r))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        out.extend(folder.end())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    names = {_LONG: "long", _TEXT: "string"}
    return ordered.mapInArrow(fold, f"conv_id {kind}, " + ", ".join(f"{c} {names[t]}" for c, t in fields))


class _Folder:
    """Takes the sorted stream of a task row by row."""

    def __init__(self):
        self.joined = self.replay = None

    def take(self, r: dict) -> Iterator[dict]:
        if r["kind"] == 0:
            yield from self.end()
            self.conv, self.joined, self.replay = r["conv_id"], Joined(), None
            self.begin()
        elif r["kind"] == 1:
            self.joined.add(r)
        else:
            self._audited()
            for _ in range(r["place"]):
                for edit in self.replay.turn(r["role"], r["text"]):
                    yield from self.edited(*edit)

    def _audited(self) -> None:
        if self.replay is None:
            self.cost, audit = self.joined.audit()
            self.replay = Replay(audit)

    def end(self) -> Iterator[dict]:
        if self.joined is not None:
            self._audited()
            for edit in self.replay.inserted():
                yield from self.edited(*edit)
            yield from self.closed()


class _Audit(_Folder):
    def begin(self) -> None:
        self.hash, self.some = hashlib.sha256(), False

    def edited(self, edit: str, role: str, text: str) -> Iterator[dict]:
        self.hash.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True
        return iter(())

    def closed(self) -> Iterator[dict]:
        yield {"conv_id": self.conv, "gaps": self.joined.gaps(), **self.joined.counts, "cost": self.cost, "audit": self.replay.audit, "repaired_sha256": self.hash.hexdigest()}


class _Turns(_Folder):
    def begin(self) -> None:
        self.place = 0

    def edited(self, edit: str, role: str, text: str) -> Iterator[dict]:
        yield {"conv_id": self.conv, "place": self.place, "edit": edit, "role": role, "text": text}
        self.place += 1

    def closed(self) -> Iterator[dict]:
        return iter(())


def audits(turns: DataFrame, ids: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation of ``ids`` (of ``turns`` if left out): gaps, faults,
    cost, audit, and the SHA-256 of the repaired ``role:text`` joined by newlines."""
    return _streamed(turns, ids, chunk, [(c, _LONG) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", _TEXT), ("repaired_sha256", _TEXT)], _Audit)


def repaired(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit, role, text."""
    return _streamed(turns, None, chunk, [("place", _LONG), ("edit", _TEXT), ("role", _TEXT), ("text", _TEXT)], _Turns)
