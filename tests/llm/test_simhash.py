"""Covering search, components and the whole operator against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(points, radius):
    parent = {p: p for p, _ in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(points):
        for b, y in points[:i]:
            if (x ^ y).bit_count() <= radius:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {p: root(p) for p in parent}


def unsigned(x):
    return x & (1 << 64) - 1


def test_masks_cover_every_small_difference():
    rng = random.Random(3)
    for radius in (1, 3, 4):
        tables = simhash.masks(radius)
        for _ in range(2000):
            d = sum(1 << i for i in rng.sample(range(64), rng.randint(0, radius)))
            assert any(m & d == 0 for m in tables)


@pytest.mark.parametrize("hot", [1024, 2])
@pytest.mark.parametrize("radius", [3, 4])
def test_links_give_the_components_of_all_pairs(spark, hot, radius):
    rng = random.Random(hot + radius)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(25)}
    points = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in points], "rep long, fp long")
    got = {r.node: r.component for r in simhash.components(simhash.links(df, radius, hot)).collect()}
    want = slow_components(points, radius)
    assert {i: got.get(i, i) for i, _ in points} == want


def test_whole_operator(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        text = rng.choices(words, k=120)
        for _ in range(4):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(120)] = "X"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Ärger A"), (n + 4, "Ärger a"), (n + 5, "one  two\nthree\x0bfour five"), (n + 6, "x " * 70000), (n + 6, "x " * 70000), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", "fp", 1) for i, t in rows], "doc_id long, text string, component_id string, fp string, n int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [(i, slow_fingerprint(t or "")) for i, t in rows]
    points = sorted({f: min(i for i, g in fps if g == f and i is not None) for _, f in fps}.items(), key=lambda x: x[1])
    want = slow_components([(i, f) for f, i in points], 4)
    rep = dict(points)
    assert sorted((r.doc_id is None, r.doc_id, unsigned(r.fp), r.component_id) for r in got) == sorted((i is None, i, f, want[rep[f]]) for i, f in fps)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))


def test_rows_that_share_an_id_count_by_their_text(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    a, b, c, d, e = (" ".join(rng.choices(words, k=120)) for _ in range(5))
    rows = [
        (5, a, "first"), (5, b, "first"), (5, b, "again"),  # b is a copy of document 3's text, a is not
        (3, b, "b"), (8, a, "copy"), (9, a, "copy"),
        (20, c, "c"), (20, d, "d"), (21, c, "copy"), (22, d, "copy"), (20, e, "e"), (20, e, "again"),
        (None, c, "null"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp string")
    name = {a: "a", b: "b", c: "c", d: "d", e: "e"}
    got = sorted(((r.doc_id, name[r.text]) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(5, "a"), (3, "b"), (20, "c"), (20, "d"), (20, "e"), (None, "c")], key=str)
    component = {(r.doc_id, unsigned(r.fp)): r.component_id for r in simhash.near_duplicates(docs).collect()}
    want = {a: 5, b: 3, c: 20, d: 20, e: 20}
    assert component == {(i, slow_fingerprint(t)): want[t] for i, t, _ in rows}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_a_row_without_id_links_others(spark):
    rows = [(7, 0b0, 0), (None, 0b1111, 1), (9, 0b11111111, 2), (None, 63 << 50, 3), (None, (63 << 50) + 1, 4), (12, 0xFFFF << 40, 5)]
    found = {r.fp: (r.component_id, r.stays) for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long, key long")).collect()}
    assert found == {0: (7, 0), 0b1111: (7, 0), 0b11111111: (7, 0), 63 << 50: (None, None), (63 << 50) + 1: (None, None), 0xFFFF << 40: (12, 5)}


def test_joins_of_tables_that_grow_are_never_broadcast(spark, monkeypatch):
    plans, write = {}, simhash.written

    def seen(df, label):
        plans[label] = str(df._jdf.queryExecution().executedPlan())
        return write(df, label)

    monkeypatch.setattr(simhash, "written", seen)
    rows = [(i, f"w{i // 2} a b c d e f g h i j k l m n o p q r s t" + " x" * (i % 2)) for i in range(40)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    plans["found"] = str(found._jdf.queryExecution().executedPlan())
    assert {"members", "links", "large", "small"} <= set(plans)
    assert [label for label, plan in plans.items() if "Broadcast" in plan or "SortMergeJoin" not in plan and label in ("members", "links", "large", "small", "found")] == []


def test_rows_meet_their_classes_in_a_sorted_join(spark, monkeypatch):
    monkeypatch.setattr(simhash, "classes", lambda rows, radius: rows.groupBy("fp").agg(F.min("key").alias("stays")))
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d")], "doc_id long, text string")
    kept = simhash.keep_one(docs)
    plan = str(kept._jdf.queryExecution().executedPlan())
    assert "SortMergeJoin [fp" in plan and "BroadcastHashJoin [fp" not in plan
    assert kept.count() == 2
