"""Counts against the tokenizer library's unigram model over the same pieces."""

import os
import random

import pytest

from tessera.llm import token_counts as tc

needs = pytest.mark.skipif(not os.path.exists(tc.VOCABULARY), reason="vocabulary file not present")


def library(pieces):
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)] + pieces
    return Tokenizer(models.Unigram(vocab, 0, True))


@needs
def test_counts_equal_the_library(spark):
    pieces = tc.vocabulary_of(tc.VOCABULARY)
    other = library(pieces)
    rng = random.Random(6)
    texts = ["", None, "a", " a", "a  b", "  ", "x\ny", "naïve Ärger", "日本語 text", "▁x ▁", "\U0001f600 ok", "a " * 3000]
    texts += ["".join(rng.choices(["the", "ing", " ", "  ", "st", "é", "\n", "q", "Z9", "ß", "字"], k=rng.randint(1, 30))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs).collect()}
    for i, t in enumerate(texts):
        want = len(other.encode(tc.MARK + t.replace(" ", tc.MARK), add_special_tokens=False).ids) if t else 0
        assert got[i] == want, repr(t)


def test_ties_and_scores_match_all_paths():
    """Small vocabularies with many ties, against the plain forward rule."""
    rng = random.Random(8)
    for _ in range(200):
        pieces = [(p, float(-rng.randint(0, 3))) for p in {"".join(rng.choices("ab▁", k=rng.randint(1, 3))) for _ in range(6)} if tc.MARK not in p.lstrip(tc.MARK)]
        if not pieces:
            continue
        counter = tc.Counter(pieces)
        text = "".join(rng.choices("abc ", k=rng.randint(1, 12)))
        s = tc.MARK + text.replace(" ", tc.MARK)
        ends = {0: (0.0, 0)}
        for a in range(len(s)):
            single = False
            for p, score in sorted(pieces, key=lambda x: len(x[0])):
                if s.startswith(p, a):
                    single |= len(p) == 1
                    v = ends[a][0] + score
                    if a + len(p) not in ends or v > ends[a + len(p)][0]:
                        ends[a + len(p)] = (v, ends[a][1] + 1)
            if not single:
                v = ends[a][0] + counter.unknown
                if a + 1 not in ends or v > ends[a + 1][0]:
                    ends[a + 1] = (v, ends[a][1] + len(s[a].encode()))
        assert counter(text) == (ends[len(s)][1], ends[len(s)][0])


@needs
def test_empty_table(spark):
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
