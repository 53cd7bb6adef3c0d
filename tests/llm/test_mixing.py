"""The schedule against a plain simulation, and its promise for every prefix."""

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from tessera.llm import mixing


def edf(parts, shares):
    done, out = {s: 0 for s, _ in parts}, []
    for t in range(shares):
        ready = [(-(-(done[s] + 1) * shares // w), s) for s, w in parts if done[s] < w and done[s] * shares // w <= t]
        _, s = min(ready)
        done[s] += 1
        out.append(s)
    return out


@pytest.mark.parametrize("shares", [10, 97, 1000])
def test_schedule_is_earliest_deadline_first(spark, shares):
    rng = random.Random(shares)
    weights = spark.createDataFrame([(f"={i}", rng.random() ** 3 + 0.001) for i in range(8)], "key string, weight double")
    parts = mixing.whole_shares(weights, shares)
    rows = {r.key: r.w for r in parts.collect()}
    assert sum(rows.values()) == shares and min(rows.values()) >= 1
    got = [r.key for r in mixing.schedule(parts, shares).orderBy("place").collect()]
    assert got == edf(sorted(rows.items()), shares)
    ran = Counter()
    for t, s in enumerate(got, 1):
        ran[s] += 1
        assert all(abs(ran[x] - t * w / shares) < 1 for x, w in rows.items())


def test_all_rows_are_kept_and_weights_hold(spark):
    rng = random.Random(4)
    rows = [(i, "text", rng.choice(["big"] * 6 + ["a", "b", None])) for i in range(3000)] + [(5, None, "a"), (None, "x", "b"), (None, "x", "b")]
    docs = spark.createDataFrame([(i, t, s, 1, "k") for i, t, s in rows], "doc_id long, text string, source string, key int, b string")
    out = mixing.mix(docs, block=4, shares=50, bucket=64)
    assert out.columns[:5] == docs.columns
    got = out.collect()
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(str(r) for r in rows)
    sizes = Counter(r.source for r in got)
    w = {r.source: r["_w"] for r in got}
    for s, n in sizes.items():
        mine = sorted((r["_block"], r["_place"]) for r in got if r.source == s)
        assert mine == [(i // 4, i % 4) for i in range(n)]
    slots = {(r.source, r["_block"]): r["_slot"] for r in got}
    assert len(set(slots.values())) == len(slots)
    for (s, i), t in slots.items():
        assert i * 50 // w[s] <= t < -(-(i + 1) * 50 // w[s])
    end = min(-(-(sizes[s] // 4) * 50 // w[s]) for s in sizes)
    for t in range(1, end):
        for s in sizes:
            assert abs(sum(1 for (x, _), u in slots.items() if x == s and u < t) - t * w[s] / 50) < 1


def test_mixed_order_is_the_order_of_the_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t", f"s{i % 3 if i % 2 else 0}") for i in range(2000)], "doc_id long, text string, source string")
    out = mixing.mixed(docs, block=4, shares=20)
    assert out.columns == docs.columns
    want = [r.doc_id for r in mixing.mix(docs, block=4, shares=20).orderBy("_slot", "_place").collect()]
    assert [r.doc_id for r in out.collect()] == want


def test_given_weights_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, source string")
    assert mixing.mix(docs, mixing.given(spark, {"a": 1, "b": 3, None: 2, "zz": 1}), 10, 1).count() == 3
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(PySparkException):
        mixing.mix(docs, mixing.given(spark, {"a": 1, "b": 3})).collect()
    with pytest.raises(PySparkException):
        mixing.mix(docs, shares=2).collect()


def test_more_sources_than_a_thousand(spark, monkeypatch):
    rows = [(i, f"s{i % 1203}") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, block=2).collect()
    assert sorted((r.doc_id, r.source) for r in got) == rows
    assert len({(r["_slot"], r["_place"]) for r in got}) == len(rows)
    with pytest.raises(PySparkException):
        mixing.mix(docs, shares=1000).collect()
    monkeypatch.setattr(mixing, "SMALL", 0)  # joined without a broadcast
    few = docs.withColumn("source", (docs.doc_id % 7).cast("string"))
    assert mixing.mix(few).count() == len(rows)


def test_distance_from_real_weights(spark):
    """After t slots a source is within a block of its rounded share, whose distance
    from the real weight is at most a share in a round."""
    weights = {"a": 0.5, "b": 1 / 3, "c": 0.1, "d": 1 - 0.5 - 1 / 3 - 0.1}
    docs = spark.range(6000).selectExpr("id AS doc_id", "element_at(array('a','b','c','d'), cast(id % 4 AS int) + 1) AS source")
    got = mixing.mix(docs, mixing.given(spark, weights), block=1).collect()
    ends = {s: max(r["_slot"] for r in got if r.source == s) for s in weights}
    last = min(ends.values())
    ran = Counter()
    slots = {r["_slot"]: r.source for r in got}
    for t in range(1, last + 1):
        ran[slots[t - 1]] += 1
        assert all(abs(ran[s] - t * w) < 1 + t / 1000 for s, w in weights.items())


def test_columns_named_like_the_slots(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6), (2, "b", 7, 8), (3, "a", 9, 10)], "doc_id long, source string, _slot int, _Place int")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
