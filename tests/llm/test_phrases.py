"""Phrase mining against brute force, whatever the sample proposes."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, support, most, cover=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for w in pieces(text or ""):
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= support}
    out = []
    for lang in n:
        left = []
        for (g, p), a in f.items():
            if g != lang or len(p) < 2:
                continue
            score, _, l, r = min((2_000_000 * a // (f[g, p[:i]] + f[g, p[i:]]), i, f[g, p[:i]], f[g, p[i:]]) for i in range(1, len(p)))
            around = [c for (h, q), c in f.items() if h == g and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * c >= cover * a for c in around):
                left.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(left)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed, rows=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["New", "york", "é", "É", "x\u0085y"]
    stock = [" ".join(rng.choices(vocab, k=rng.randint(2, 6))) for _ in range(12)]
    out = []
    for i in range(rows):
        parts = [rng.choice(stock) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12))]
        out.append((i if i % 9 else None, rng.choice(["en", "en", "de", None]), "".join(p + rng.choice([" ", "\t ", ". ", "\n", ",", "! "]) for p in parts)))
    return out + [(1, "en", None), (2, None, ""), (3, "fr", " \t. "), (4, "en", "w1 w2 w3 w4 " * 40), (4, "en", "w1 w2 w3 w4 " * 40)]


@pytest.mark.parametrize("share, support", [(0.3, 6), (0.0, 6), (1.0, 12), (0.02, 4)])
def test_equals_brute_force(spark, share, support):
    """With an empty sample everything comes from border failures."""
    rows = corpus(support)
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, g, t in rows], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    passes = []
    found = phrases.frequent(docs, support=support, share=share, bits=1 << 16, note=lambda number, lost: passes.append(lost))
    got = phrases.collocations(found, most=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute([(g, t) for _, g, t in rows], support, 25)
    assert passes[-1] == 0 and len(passes) <= phrases.LONGEST
    if share == 0.0:
        assert len(passes) == phrases.LONGEST  # words, pairs and triples fail in turn


def test_a_full_filter_only_costs_time(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, g) for i, g, t in rows], "doc_id long, text string, lang string")
    got = phrases.collocations(phrases.frequent(docs, support=5, share=0.3, bits=64), most=10_000)
    assert sorted(map(tuple, got.collect())) == brute([(g, t) for _, g, t in rows], 5, 10_000)


def test_empty_table_and_no_phrase(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(phrases.frequent(docs)).collect() == []
    docs = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert phrases.collocations(phrases.frequent(docs)).collect() == []


def test_long_texts_are_cut_without_losing_or_doubling_phrases():
    rng = random.Random(8)
    every = phrases.Filter(np.full(16, 2**64 - 1, dtype=np.uint64))
    for _ in range(60):
        text = "".join(rng.choice(["ab", "C", "ddd", "é", "x" * rng.randint(1, 90)]) + rng.choice([" ", " ", "  ", "\t", ".", " \n"]) for _ in range(rng.randint(0, 150)))
        texts = [text, "", "a b", text[: rng.randint(0, 40)]]
        got = Counter()
        for folded, skip in phrases.portions((t.encode() for t in texts), most=40):
            for g in phrases.grams("en", folded, skip, None, every):
                some = g.counts > 0
                got.update(dict(zip(g.text(some).to_pylist(), g.counts[some].tolist())))
        want = Counter()
        for t in texts:
            for w in pieces(t):
                want.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        assert got == want


def test_hashes_of_phrases_are_those_of_portions():
    every = phrases.Filter(np.full(16, 2**64 - 1, dtype=np.uint64))
    for k, g in enumerate(phrases.grams("fr", "a bé ccc a bé\nd".encode(), 0, None, every), 1):
        assert phrases.phrase_hashes("fr", k, g.text(g.counts > 0)).tolist() == g.hashes.tolist()
        assert (g.hashes & np.uint64(3) == k - 1).all()


def test_scores_are_exact_past_64_bits(spark):
    big = 9_000_000_000_000_000_000
    found = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)], phrases.EXACT)
    row = phrases.collocations(found).collect()[0]
    assert row.score == 2_000_000 * (big - 2) // (big + big - 1)
