"""Dictionary search against substring tests, by broadcast and in sorted streams."""

import random

import pytest

from tessera.operators import extraction as X
from tessera.operators.search import FEW, Terms, contained


def words(rng, n, most=6):
    return ["".join(rng.choice("abé \n") for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_terms_are_found_once_each():
    rng = random.Random(1)
    for n in (0, 1, FEW, FEW + 1, 40):
        terms = words(rng, n)
        for text in [None, "", *words(rng, 50, 30)]:
            assert sorted(Terms(terms).found(text)) == sorted({t for t in terms if t and text and t in text})


@pytest.mark.parametrize("block_bytes, slice_bytes", [(1 << 20, 1 << 20), (64, 1 << 20), (64, 300), (1 << 20, 300), (1, 1)])
@pytest.mark.parametrize("keyed", [False, True])
def test_equals_substring_tests(spark, keyed, block_bytes, slice_bytes):
    """With small limits every key is hot: blocks of terms meet slices of texts."""
    rng = random.Random(7)
    pick = lambda: rng.choice(["hot"] * 4 + ["k1", "k2", None])
    terms = [(pick(), "x", t) for t in [*words(rng, 60, 4), None]]
    texts = [(i, pick(), t) for i, t in enumerate([*words(rng, 60, 25), None, "ab" * 500])]
    left = spark.createDataFrame(terms, "k string, id string, term string").repartition(3)
    right = spark.createDataFrame(texts, "id int, k string, text string").repartition(3)
    keys = ["k"] if keyed else []
    got = contained(left, right, keys, ["id", "text"], block_bytes, slice_bytes)
    assert got.columns == [*keys, "id", "text", "term"]
    same = (lambda a, b: a is not None and a == b) if keyed else (lambda a, b: True)
    want = {(*([k] if keyed else []), i, x, t) for i, k, x in texts for k2, _, t in terms if t and x and t in x and same(k, k2)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_repeated_texts_stay_and_empty_sides_give_nothing(spark):
    left = spark.createDataFrame([("a",), ("a",), ("",)], "term string")
    right = spark.createDataFrame([(1, "cat"), (1, "cat"), (2, "dog")], "id int, text string")
    for limit in (1 << 20, 1):
        assert sorted(map(tuple, contained(left, right, keep=["id"], block_bytes=limit).collect())) == [(1, "a"), (1, "a")]
        assert contained(left.limit(0), right, keep=["id"], block_bytes=limit).collect() == []
        assert contained(left, right.limit(0), keep=["id"], block_bytes=limit).collect() == []


def test_a_small_dictionary_is_searched_where_texts_are_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.createDataFrame([(1, "the"), (2, "en"), (2, "la")], "item_id int, text string")
    plan = contained(items.select(items.text.alias("term")), docs.select("doc_id", "text"), keep=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1
    found = X.find_mentions(docs, items)
    want = {(r.doc_id, i) for r in docs.collect() for i, t in [(1, "the"), (2, "en"), (2, "la")] if r.text and t in r.text}
    assert {tuple(r) for r in found.collect()} == want
