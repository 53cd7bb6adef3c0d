"""Statistics against brute force, trees against their promises, accuracy on held-out rows."""

import random
import re

import numpy as np
import pytest

from tessera.llm import quality
from tessera.llm.common import crc_mod

DOCS = "doc_id long, text string, score string, kept int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + j for i, x in enumerate(g) if g.count(x) > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def texts(seed, n=300):
    rng = random.Random(seed)
    vocab = ["a", "bb", "é", "日本", "#x", "a|b", "x y", "\x1c", "<p>"]
    return [None, "", " \n\t", "a", "a a a a", "a b a b a b"] + ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t ", "\r\n", "\x0b", " \n\n"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_statistics_equal_brute_force(monkeypatch):
    for t in texts(1):
        data = (t or "").encode()
        assert quality.statistics(data)[:5] == brute(t)
    whole = [quality.statistics((t or "").encode()) for t in texts(2)]
    monkeypatch.setattr(quality, "LONG", 0)
    assert [quality.statistics((t or "").encode()) for t in texts(2)] == whole


def test_base_checks():
    rows = np.array([[49, 0, 0, 0, 0], [50, 0, 0, 0, 25], [50, 0, 0, 0, 26], [0, 0, 0, 0, 0]])
    assert quality.base_failed(rows).tolist() == [True, False, True, True]


def test_flat_arrays_equal_a_walk_and_falling_features_never_raise():
    rng = np.random.default_rng(5)
    x = rng.random((1500, 4))
    # the first feature helps in the labels, but must not
    y = ((x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(0, 0.2, 1500)) > 0.5).astype(float)
    forest = quality.grow(x, y, np.ones(1500), [0, 2], trees=20)
    raw = forest.raw(x[:200], rows=64)
    for row, got in zip(x[:200], raw):
        want = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            want += forest.value[node]
        assert got == pytest.approx(want)
    for f in (0, 2):
        moved = x[:200].copy()
        before = forest.raw(moved)
        for step in np.linspace(0, 1, 30):
            moved[:, f] = np.maximum(moved[:, f], step)
            after = forest.raw(moved)
            assert (after <= before + 1e-12).all()
            before = after
    # a third of the signal is out of reach
    assert np.mean((forest.score(x) > 0.5) == y) > 0.72


def test_one_class_and_no_rows():
    x = np.random.default_rng(0).random((10, 3))
    for y, want in ((np.ones(10), 1.0), (np.zeros(10), 0.0)):
        assert quality.grow(x, y, np.ones(10), [0]).score(x).tolist() == [want] * 10
    assert quality.grow(x[:0], np.zeros(0), np.zeros(0), [0]).score(x).tolist() == [1.0] * 10


def test_odd_rows(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(1, good, "s", 1), (1, good, "s", 1), (None, good, "s", 1), (2, None, "s", 1), (3, "", None, 0), (4, "a b c " * 40, "s", 1), (5, "word " * 300_000, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (99, 1), (None, 0)], "doc_id long, quality int")
    out = quality.judged(docs, quality.train(docs, labels))
    assert out.columns == ["doc_id", *quality.BASE, "base_failed", "score", "kept"]
    got = out.collect()
    assert sorted(str((r.doc_id, r.n_words)) for r in got) == sorted(str((i, brute(t)[0] if i != 5 else 300_000)) for i, t, *_ in rows)
    assert {r.doc_id: r.base_failed for r in got} == {1: False, None: False, 2: True, 3: True, 4: True, 5: True}
    assert all(not r.kept for r in got if r.base_failed)
    none = spark.createDataFrame([], DOCS)
    assert quality.judged(none, quality.train(none, labels)).collect() == []
    assert all(r.score == 1.0 for r in quality.judged(docs, quality.train(docs, labels.limit(0))).collect())


def test_held_out_labels_and_the_query(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judged(docs, quality.train(docs, labels.where(crc_mod("doc_id", 4) != 0)))
    held = out.join(labels.where(crc_mod("doc_id", 4) == 0), "doc_id").where("NOT base_failed").collect()
    kept_good = [r.kept for r in held if r.quality == 1]
    lost_bad = [not r.kept for r in held if r.quality == 0]
    assert sum(kept_good) / len(kept_good) > 0.97 and sum(lost_bad) / max(1, len(lost_bad)) > 0.7
    rows = QUERIES["op12_quality"](spark, sf).collect()
    by_id = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(by_id)
    for r in rows[::23]:
        n = brute(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
