import hashlib
import random
from collections import defaultdict

import pytest

from tessera.llm import exact


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[normal(t)].append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        keep, stays = (max(known) if known else None), False
        for i in ids:
            kept = i == keep and not stays
            stays |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("widths", [exact.WIDTHS, (1, 2, 4), (3,)])
def test_classes_match_brute_force(spark, widths):
    rng = random.Random(len(widths))
    texts = ["".join(rng.choices("aAbÄ", k=rng.randint(0, 9))) for _ in range(60)] + ["É" * 40, "é" * 40, "x" * 63, "x" * 64, "X" * 64, "x" * 65, None, ""]
    if widths == exact.WIDTHS:
        texts += ["y" * 70000 + "a", "y" * 70000 + "A", "y" * 70000 + "b", "z" * 2112, "z" * 2113]
    rows = [(i, rng.choice(texts)) for i in range(150)] + [(7, "dup"), (7, "dup"), (7, "DUP"), (3, "dup"), (None, "dup"), (None, "only"), (None, "Only"), (None, "y")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, digit string")
    got = [tuple(r) for r in exact.exact_classes(docs, widths=widths).collect()]
    assert order(got) == order(brute(rows))


def test_empty(spark):
    assert exact.exact_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
