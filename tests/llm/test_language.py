"""Forward-backward and training against enumeration; accuracy on held-out rows."""

import itertools
import os

import numpy as np
import pytest

from tessera.llm import crf, language
from tessera.llm.common import crc_mod, table

SF = "/root/testdata/sf0.01"


def enumerated(emit, trans, start):
    n, size = emit.shape
    p = np.zeros((n, size))
    for y in itertools.product(range(size), repeat=n):
        s = start[y[0]] + sum(emit[t, y[t]] for t in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        for t in range(n):
            p[t, y[t]] += np.exp(s)
    return p / p.sum(axis=1, keepdims=True)


def test_posteriors_match_enumeration():
    rng = np.random.default_rng(0)
    trans, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [1, 4, 6, 2, 1, 5]
    emits = [rng.normal(size=(n, 3)) * 3 for n in sizes]
    first = np.zeros(sum(sizes), dtype=bool)
    first[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
    got = crf.posteriors(np.concatenate(emits), first, trans, start)
    assert np.allclose(got, np.concatenate([enumerated(e, trans, start) for e in emits]))
    gamma, _ = crf.pair_posteriors(emits[2][None], trans, start)
    assert np.allclose(gamma[0], enumerated(emits[2], trans, start))
    for e in emits:
        ways = itertools.product(range(3), repeat=len(e))
        best = max(ways, key=lambda y: start[y[0]] + sum(e[t, y[t]] for t in range(len(e))) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        assert crf.viterbi(e, trans, start).tolist() == list(best)


def test_blocks_do_not_change_long_chains(monkeypatch):
    rng = np.random.default_rng(1)
    emit, trans, start = rng.normal(size=(1000, 4)) * 2, rng.normal(size=(4, 4)), rng.normal(size=4)
    first = np.zeros(1000, dtype=bool)
    first[[0, 500, 501, 730]] = True
    one = crf.posteriors(emit, first, trans, start)
    monkeypatch.setattr(crf, "_STEP", 7)
    assert np.allclose(one, crf.posteriors(emit, first, trans, start))
    assert crf.posteriors(emit[:0], first[:0], trans, start).shape == (0, 4)


def test_features_do_not_depend_on_the_neighbours():
    words = ["a", "été", "word", "x" * 300, "b"]
    values, bounds = language.features(words)
    for i, w in enumerate(words):
        alone, b = language.features([w])
        assert alone.tolist() == values[bounds[i] : bounds[i + 1]].tolist() and len(alone)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_accuracy_and_code_switching(spark):
    docs = table(spark, SF, "documents")
    model = language.train(docs.where(crc_mod("doc_id", 4) != 2), sample=100)
    truth = {r.doc_id: r.lang for r in docs.where(crc_mod("doc_id", 4) == 2).select("doc_id", "lang").collect()}
    got = {r.doc_id: r.lang_pred for r in language.languages(docs, model).collect() if r.doc_id in truth}
    assert np.mean([got[i] == x for i, x in truth.items()]) > 0.97
    pure = {}
    for r in docs.where(crc_mod("doc_id", 4) == 2).orderBy("doc_id").collect():
        if r.lang in ("en", "de") and len(r.text.split()) > 60 and all(map(language.letters, r.text.split()[:50])):
            pure.setdefault(r.lang, r.text)
    a, b = (pure[x].split()[:50] for x in ("en", "de"))
    row = language.word_languages(spark.createDataFrame([(1, " ".join(a + b))], "doc_id long, text string"), model).first()
    labels = [w.lang for w in row.words]
    assert np.mean([x == "en" for x in labels[:50]]) > 0.8 and np.mean([x == "de" for x in labels[50:]]) > 0.8


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "", None), (None, "the end", "en"), (6, "12 !! \n", "en"), (7, "the " * 60000, "en")]
    rows += [(10 + i, ["the cat and the dog and", "der hund und die katze und"][i % 2] + " x" * (i // 2 % 3), ["en", "de"][i % 2]) for i in range(40)]
    docs = spark.createDataFrame([(i, t, x, 1, "s") for i, t, x in rows], "doc_id long, text string, lang string, score int, words string")
    model = language.train(docs)
    out = language.languages(docs, model).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
        assert 0 <= r.score <= 1
    assert by[3] == by[4] == by[6] == [("und", 0.0)]
    assert by[1][0][0] == "en" and [x for x, _ in by[2]] == ["de", "de"] and by[7][0][0] == "en"
    none = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.languages(docs, none).collect()} == {"und"}
    assert language.languages(docs.limit(0), model).count() == 0
    assert language.word_languages(docs, none).count() == len(rows)


def test_long_texts_alone_are_learned_from(spark):
    long = {"en": "the cat and the dog and ", "de": "der hund und die katze und "}
    rows = [(i, long[x] * 1500, x) for i, x in enumerate(["en", "de"] * 4)] + [(4, long["en"] * 1500 + "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) > language.LONGEST for _, t, _ in rows)
    sampled = language._sample(docs, 2)
    assert len(sampled) == 4 and all(0.9 * language.LONGEST < len(t) <= language.LONGEST + language.PIECES for _, _, t in sampled)
    model = language.train(docs)
    assert {r.lang_pred for r in language.languages(docs.where("lang = 'de'"), model).collect()} == {"de"}
    # the pieces reach over the whole text
    mixed = spark.createDataFrame([(1, "a" * 30_000 + "b" * 30_000 + "c" * 30_000, "en")], docs.schema)
    assert set(language._sample(mixed, 1)[0][2]) == set("abc ")
