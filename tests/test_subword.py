"""Subword ids against a public library, and their way back."""

import base64
import os
import random

import pytest

from tessera.operators import tokens as T
from tessera.operators.subword import WORDS, Subword, decode, subword_tokenizer

FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="needs the vocabulary file")


def odd_texts(seed, n=60):
    rng = random.Random(seed)
    return ["", " ", "a" * 3000, "ab" * 2000, "日本語 text\n\n  x", "it's we'll 12,345.67 \u0000‍"] + [
        "".join(rng.choice(["the ", "and", "xq", "é", "日", " ", "\n", "1", "''", "😀", "\t"]) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def test_ids_equal_the_public_library_and_decode(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    public = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    own, small = Subword(ranks), Subword(ranks, cache_bytes=500)
    texts = odd_texts(1)
    for t in texts:
        assert own.encode(t) == small.encode(t) == public.encode_ordinary(t)
    assert small.room >= 0 and len(small.cache) < 6
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [None])], "id int, text string").repartition(3)
    ids = T.tokenize(df, "text", subword_tokenizer(spark, FILE))
    back = ids.select("id", "ids", decode(spark, FILE, ids["ids"]).alias("back")).collect()
    assert {r.id: r.back for r in back} == {i: t or "" for i, t in enumerate(texts + [None])}
    assert {r.id: list(r.ids) for r in back} == {i: public.encode_ordinary(t or "") for i, t in enumerate(texts + [None])}


def test_merges_follow_the_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cc": 259}
    s = Subword(ranks)
    assert s.merged(b"abcc") == [258, ord("c")] and s.merged(b"abc") == [258] and s.merged(b"xbcb") == [ord("x"), 257, ord("b")]
    with pytest.raises(ValueError):
        Subword({b"a": 0})


def test_length_guard_on_subword_ids(spark):
    import tiktoken

    from tessera.plans import q_prep

    sf = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    public = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in q_prep._composed(spark, sf).collect()}
    limits = {"falcon-7b": 2048, "llama-3-8b": 8192, "mpt-30b-chat": 8192, "Mixtral-8x7B-Instruct-v0.1": 32768, "other": None}
    rows = q_prep.length_guard_subword(spark, sf).collect()
    assert len(rows) == len(texts) * len(limits)
    count = {i: len(public.encode_ordinary(t)) for i, t in texts.items()}
    for r in rows:
        n, limit = count[r.doc_id], limits[r.variant]
        status = "no_limit" if limit is None else "ok" if n + q_prep.MAX_NEW_TOKENS["entity_and_entity_type"] <= limit else "too_long"
        assert (r.n_tokens, r.limit, r.status) == (n, limit, status)
    assert len({r.status for r in rows}) == 3


def test_ids_of_a_batch_become_texts_at_once():
    import pyarrow as pa

    from tessera.operators.subword import texts_of

    known, pieces = pa.array([7, 9, 8], pa.int64()), pa.array([b"\xc3", b"\xa9", b"ab"], pa.large_binary())
    rows = pa.array([[1], [7, 9], None, [], [8, 5, None, 8], [9, 8]], pa.list_(pa.int64()))
    want = ["", "é", None, "", "abab", "�ab"]
    assert texts_of(rows, known, pieces).to_pylist() == want and texts_of(rows.slice(2, 3), known, pieces).to_pylist() == want[2:5]
    assert texts_of(rows.slice(0, 0), known, pieces).to_pylist() == []
