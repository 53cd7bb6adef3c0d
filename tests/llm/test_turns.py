"""Conversation repair against whole alignments without bands or chunks."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, kind string, audit int"


def whole(rows):
    """Least (cost, audit) over all targets, by the full recursion."""
    n, best = len(rows), None
    for target in [""] + [s + "ua" * k for k in range(1, n + 3) for s in ("", "s")]:

        @functools.cache
        def go(i, j, target=target):
            if i == n and j == len(target):
                return 0, ""
            ways = []
            if i < n:
                initial, gone, extra = rows[i]
                ways.append((3, "D", i + 1, j, 0))
                if j < len(target) and not gone:
                    ways += [(0, "K", i + 1, j + 1, extra)] * (initial == target[j]) + [(2, "R", i + 1, j + 1, extra)] * (target[j] in "ua")
            if j < len(target) and target[j] in "ua":
                ways.append((2, "I", i, j + 1, 0))
            found = [(c + e + go(x, y)[0], a + go(x, y)[1]) for c, a, x, y, e in ways]
            return min(found, default=(10**9, ""))

        got = go(0, 0)
        best = got if best is None or got < best else best
    return best


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def brute(conv, rows):
    """The contract's columns for the damaged rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()[:16]))
    seen, marks, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marks.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = whole(marks)
    out, left = [], list(rows)
    for edit in audit:
        due = "assistant" if out and out[-1].startswith("u") else "user"
        if edit == "I":
            out.append(f"{due}:")
        else:
            _, _, role, text = left.pop(0)
            out += {"K": [f"{role}:{text}"], "R": [f"{due}:{text}"], "D": []}[edit]
    return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turn = rng.choice([0, 0, 1, 5])
        for i in range(rng.randint(1, 9)):
            role = rng.choice([("user", "assistant")[i % 2]] * 5 + ["system", "user", "tool", "", None, "Ünit"])
            text = rng.choice(["yes.", "no", "ok!", "a?\n", "a. \t", " ", "", None, "é…", f"t{i}.", f"t{i}.", f"t{i}"])
            rows.append((c if c % 40 else None, None if rng.random() < 0.04 else turn, role, text))
            turn += rng.choice([1, 1, 1, 1, 2, 0])
    return rows + [(500, 1, "user", "a.")] * 3 + [(501, None, None, None)] * 2 + [(502, 2**62, "user", "b."), (502, -(2**62), "assistant", "c.")]


@pytest.mark.parametrize("chunk", [2, 3, turns.CHUNK])
def test_audits_equal_brute_force(spark, chunk):
    rows = conversations(chunk)
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = turns.audits(turns.damaged(given), given, chunk=chunk)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    held = {c: [] for c, *_ in rows}
    for r in damage(rows):
        held[r[0]].append(r)
    want = [brute(c, mine) for c, mine in held.items()]
    want = [(*w[:1], min(w[1], 2**63 - 1), *w[2:]) for w in want]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_one_long_conversation_over_many_chunks(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice([("user", "assistant")[t % 2]] * 12 + ["user", "system"]), rng.choice([f"text {t}."] * 12 + ["", "same.", f"cut {t}"])) for t in range(900)]
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    small, large = (turns.audits(given, chunk=c).collect() for c in (16, 2000))
    assert small == large and len(small[0].audit.replace("I", "")) == 900


def test_repaired_turns_are_legal_and_hash_to_the_audit(spark):
    given = spark.createDataFrame([(*r, "x", 1) for r in conversations(9, 40)], SCHEMA)
    found = {r.conv_id: r for r in turns.audits(given).collect()}
    held = {}
    for r in sorted(turns.repaired(given).collect(), key=lambda r: r.place):
        held.setdefault(r.conv_id, []).append(r)
    for conv, row in found.items():
        mine = held.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == row.repaired_sha256


def test_empty_table_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turns.audits(turns.damaged(none), none).collect() == []
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    given = spark.createDataFrame([(gone, 0, "user", "a.", "x", 1)], SCHEMA)
    assert [tuple(r) for r in turns.audits(turns.damaged(given), given).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_covers_every_conversation(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    held = {c: [] for c, *_ in rows}
    for r in damage(rows):
        held[r[0]].append(r)
    assert sorted(map(tuple, QUERIES["op11_conversations"](spark, sf).collect())) == sorted(brute(c, mine) for c, mine in held.items())
