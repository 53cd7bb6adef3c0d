"""Decoding against all paths of small lattices, counts against brute force, held-out accuracy."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import toxicity as tox
from tessera.llm.common import crc_mod, table

SF = "/root/testdata/sf0.01"
PROSE = ["you are an idiot and that is trash", "the moron said it is good", "a fine day in the town", "the clown and the loser met"] * 30


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_trigram_counts(spark):
    texts = ["Ab ab", None, "", "É1x"]
    got = {r.gram: r.n for r in tox.trigram_counts(docs_of(spark, texts).repartition(3)).collect()}
    want = Counter()
    for t in texts:
        if t:
            ids = [0, 0, *(tox._id(c) for c in t.lower()), 0, 0]
            want.update(a * tox.N**2 + b * tox.N + c for a, b, c in zip(ids, ids[1:], ids[2:]) if (a, b, c) != (0, 0, 0))
    got.pop(0, None)
    assert got == {k: v for k, v in want.items()}


def test_viterbi_finds_the_best_path(spark):
    lm = tox.language_model(tox.trigram_counts(docs_of(spark, PROSE)))
    rng = random.Random(1)

    def worth(token, choice):
        a = b = 0
        z, out = 0.0, ""
        for at, (c, x) in enumerate(zip(token, choice)):
            again = at > 0 and token[at - 1] == c
            if x:
                if c in tox.LEET:
                    z += tox.SUBSTITUTE
                i = tox._id(x)
                z += float(lm[a, b, i])
                a, b, out = b, i, out + x
            elif c in tox.LEET:
                inner = [i for i, y in enumerate(token) if y.isalnum()]
                z += tox.DROP_MORE if again else tox.DROP_LEET if inner and inner[0] <= at <= inner[-1] else tox.DROP_EDGE
            elif c.isalpha():
                z += tox.DROP_MORE if at > 1 and token[at - 2] == c else tox.DROP_SECOND
        return z + (float(lm[a, b, 0]) if b else 0.0), out

    for _ in range(60):
        token = "".join(rng.choices("idot1034$.aa", k=rng.randint(1, 6)))
        options = []
        for at, c in enumerate(token):
            if c in tox.LEET:
                options.append([*tox.LEET[c], ""])
            elif c.isalpha():
                options.append([c] + ([""] if at and token[at - 1] == c else []))
            else:
                options.append([""])
        best = max(worth(token, x)[0] for x in itertools.product(*options))
        readings = {out for x in itertools.product(*options) for z, out in [worth(token, x)] if abs(z - best) < 1e-6}
        assert tox.decode(lm, token) in readings


def test_restores_obfuscated_words(spark):
    lm = tox.language_model(tox.trigram_counts(docs_of(spark, PROSE)))
    for seen, meant in [("1d10t", "idiot"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("i.d.i.o.t", "idiot"), ("t r a s h", "trash"), ("cloooown", "clown"), ("l0ser!!!", "loser")]:
        assert tox.restore(lm, seen) == meant


def test_readable_never_misses_a_path():
    words = ["idiot", "scum", "worthless"]
    pattern = tox.readable(words)
    for token in ["1d10t", "$cum", "s-c-u-m", "sccccum", "worthle$s", "w0rthle55", "i d i o t", "!d!0t..."]:
        assert pattern.match(token)
    assert not pattern.match("scan")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = tox.train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    rows = tox.scored(docs, model).join(labels, "doc_id").where(crc_mod("doc_id", 3) == 1).collect()
    hit = [r.score >= tox.THRESHOLD for r in rows]
    right = np.mean([h == bool(r.toxic) for h, r in zip(hit, rows)])
    assert right > 0.95
    assert sum(h for h, r in zip(hit, rows) if r.toxic) > 0.6 * sum(r.toxic for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", None), (None, "idiot " * 3, "y"), (2, "word " * 50000, "z"), (3, "fine", "w")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.train(docs, none)
    assert [r.score for r in tox.scored(docs, model).collect()] == [0.0] * 5
    labels = spark.createDataFrame([(1, None), (9, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    assert all(r.score == 0.5 for r in tox.scored(docs, model).collect())
    assert tox.keep_clean(docs, model).columns == docs.columns
    empty = docs.limit(0)
    assert tox.scored(empty, tox.train(empty, none)).count() == 0


LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="driver tables not present")
def test_a_balanced_sample_learns_the_same_words(spark):
    """The sample's shares of the classes follow its size, not the corpus: the words
    must not depend on them."""
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    toxic = labels.where("toxic = 1").count()
    small = tox.train(docs, labels, sample=toxic)  # as many clean rows as toxic ones
    rows = tox.scored(docs, small).join(labels, "doc_id").collect()
    assert sum(r.score >= tox.THRESHOLD for r in rows if r.toxic) > 0.8 * toxic
    assert sum(r.score >= tox.THRESHOLD for r in rows if not r.toxic) < 0.01 * len(rows)


@pytest.fixture(scope="module")
def larger_model(spark):
    if not os.path.isdir(LARGER):
        pytest.skip("driver tables not present")
    return tox.train(table(spark, LARGER, "documents"), table(spark, LARGER, "labels"))


def test_one_word_tells_the_same_at_any_length(spark, larger_model):
    score, rng = tox.scorer(larger_model), random.Random(2)
    clean = "the day was fine and they went to town".split()
    for word in ["idiot", "worthless"]:
        for n in (100, 400, 2_000, 20_000, 1_000_000):
            words = rng.choices(clean, k=n)
            assert score(" ".join(words)) < 0.1
            words[rng.randrange(n)] = word
            assert score(" ".join(words)) >= tox.THRESHOLD


def test_every_obfuscated_form_of_every_learned_word_is_found(spark, larger_model):
    """Spaced, stretched, leet, and signs between the letters, inside clean prose."""
    score, prose = tox.scorer(larger_model), "a fine day in the old town " * 6
    never = min(larger_model["starts"].values())  # beginnings that no clean row holds
    learned = [w for w, rate in larger_model["starts"].items() if rate == never]
    assert len(learned) > 8
    leet = str.maketrans({"o": "0", "e": "3", "a": "@", "s": "$", "i": "1"})
    for w in learned:
        forms = [w, " ".join(w), w[0] + 4 * w[1] + w[2:], w[:-1] + 5 * w[-1], w[0] + w[1:-1].translate(leet) + w[-1], ".".join(w), "*".join(w), w.upper() + "!!!"]
        for form in forms:
            assert score(prose + form + " " + prose) >= tox.THRESHOLD, form


def test_clean_spellings_stay(larger_model):
    score = tox.scorer(larger_model)
    for text in ["a b c d e f g h i j k l m n o p", "10107 1010 5011 105 1050", "x * y * z + 3 = 4", "le$$ or m0re $5 (c) [i] 100%", "gooood looong cooool"]:
        assert score("a fine day in the old town " * 6 + text) < 0.3


def test_windows_count_what_stands_close():
    starts = {"abc": 1e-3, "abcd": 1e-3}
    one = tox.evidence(starts, 5000, [(10, "abc")])
    assert one == tox.evidence(starts, 200, [(3, "abc")]) == tox.evidence(starts, 5000, [(10, "abc"), (900, "abc"), (2000, "abcd")])
    assert tox.evidence(starts, 5000, [(99, "abc"), (101, "abc"), (150, "abcd")]) > 2 * one and tox.evidence(starts, 10, []) == 0


def test_a_text_without_spaces(spark, larger_model):
    score = tox.scorer(larger_model)
    assert score("x" * 300_000) < 0.3 and score("idiot." * 20_000) >= 0
