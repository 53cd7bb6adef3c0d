"""Every item that brute force finds is found, and no other."""

import random

import pytest

from tessera.llm import decontaminate as dec


def brute(docs, items, threshold=0.8):
    def grams(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    def words(t):
        return (t or "").encode().lower().split()

    out = []
    for d, t in docs:
        for i, u in items:
            w = words(u)
            if w:
                want = grams(w, min(5, len(w)))
                common = len(want & grams(words(t), min(5, len(w))))
                if common >= threshold * len(want) - 1e-9:
                    out.append((d, i, common, len(want)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.item_id, r.matched, r.shingles) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [dec.BLOCK, 60])
def test_find_matches_brute_force(spark, block):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of"] * 200
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 6, 9, 14, 30, 53, 90, 300])))) for i in range(60)]
    items += [(100, None), (101, ""), (102, " \n"), (103, items[7][1]), (None, items[8][1]), (104, "of the of the of the of the"), (105, "ÉTÉ Wörter EINS zwei DREI vier")]
    docs = [(0, None), (1, ""), (2, "of the"), (2, "of the of the of the of the"), (3, "Été wörter eins zwei drei vier"), (4, "ÉTÉ WÖRTER EINS ZWEI DREI VIER fünf")]
    for n in range(5, 90):
        words = rng.choices(vocabulary, k=rng.choice([20, 200, 3000]))
        for _ in range(rng.randint(0, 3)):
            passage = (rng.choice(items)[1] or "").upper().split()
            for _ in range(rng.choice([0, 0, 0, 1, 2, 3])):
                if passage:
                    passage[rng.randrange(len(passage))] = "zz"
            if passage and rng.random() < 0.2:  # torn apart
                half = len(passage) // 2
                words[:0] = passage[:half]
                words += passage[half:]
            else:
                at = rng.randrange(len(words))
                words[at:at] = passage
        docs.append((n, rng.choice([" ", "\n", "\t "]).join(words)))
    docs.append((None, docs[20][1]))
    d = spark.createDataFrame([(a, t, "x") for a, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = found(dec.find(d, b, block=block))
    assert got == brute(docs, items)
    hit = {(r[0]) for r in got}
    kept = dec.clean(d, b, block=block)
    assert kept.columns == d.columns
    dirty = {i for i, (a, t) in enumerate(docs) if brute([(a, t)], items)}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(a) for i, (a, _) in enumerate(docs) if i not in dirty)
    assert hit


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dec.find(d, b.limit(0)).count() == 0
    assert dec.find(d.limit(0), b).count() == 0
    assert dec.clean(d, b.limit(0)).count() == 1


def test_classes_choose_signatures_that_do_not_miss():
    """Share of common shingles that are minima on both sides, by class, for a
    passage that lies whole in a long text."""
    rng = random.Random(2)
    for size in (1, 3, 10, 49, 400):
        item = [f"i{rng.random()}" for _ in range(size + 4)]
        index = dec.Index([(0, " ".join(item).encode())])
        for _ in range(20):
            text = [f"t{rng.random()}" for _ in range(rng.randint(0, 3000))]
            at = rng.randint(0, len(text))
            text[at:at] = item
            assert index.matches(" ".join(text).encode(), 0.8, dec.WordHashes()) == [(0, size, size)]


def test_many_blocks_keep_one_worker_a_task(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(5, 20))) for i in (2, 5, 7, 11)], "item_id long, text string")
    left = dec.clean(docs, items, block=15)
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 3, 4, 6, 8, 9, 10]
    assert left._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
