"""All matching pairs, links and removals against brute force."""

import random

import pytest

from tessera.llm import line_dedup as ld


def brute(rows, threshold):
    at = [((i is not None, i or 0), i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    at.sort(key=lambda r: (r[0], r[2]))
    sets = [frozenset(x.split()) for *_, x in at]
    out = []
    for p, (_, i, k, x) in enumerate(at):
        near = [q for q in range(len(at)) if sets[q] and sets[p] and len(sets[p] & sets[q]) >= threshold * len(sets[p] | sets[q]) - 1e-9]
        first = min(q for q in range(len(at)) if at[q][3] == x)
        out.append((i, k, at[first][1], at[first][2], len({at[q][3] for q in near} - {x}), not any(q < p for q in near)))
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_lines_match_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "Été"] * 20
    texts = []
    for _ in range(90):
        lines = []
        for _ in range(rng.randint(0, 5)):
            if texts and rng.random() < 0.5:
                line = rng.choice(rng.choice(texts).split("\n")).split()
                for _ in range(rng.choice([0, 0, 1, 2])):
                    if line:
                        line[rng.randrange(len(line))] = rng.choice(vocabulary)
                if line and rng.random() < 0.3:
                    line.append(rng.choice(vocabulary))
                rng.shuffle(line)
            else:
                line = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 4, 5, 6, 9, 14, 40, 90]))
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        texts.append("\n".join(lines))
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "\n\n"), (103, " the of \r\nthe of"), (None, texts[3])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, line string")
    got = sorted((tuple(r) for r in ld.lines(docs, threshold).collect()), key=str)
    assert got == brute(rows, threshold)


def test_broadcast_is_only_a_shortcut(spark, monkeypatch):
    rows = [(1, "a b c d e\nx"), (2, "a b c d e f"), (3, "x\ny z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ld, "SMALL", 0)
    assert sorted((tuple(r) for r in ld.lines(docs).collect()), key=str) == brute(rows, 0.8)


def test_dedup_removes_lines(spark):
    rows = [(1, "keep this line here\nalone", "s"), (2, "first\nkeep this line here\nlast", None), (3, None, "s"), (4, "alone\n\nalone", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = ld.dedup(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "keep this line here\nalone", 2: "first\nlast", 3: None, 4: ""}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = ld.lines(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_empty_table(spark):
    assert ld.lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_of_near_copies_is_counted_without_its_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(30)]
    texts = []
    for i in range(40):
        line = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            line[rng.randrange(30)] = rng.choice(["x", "y", f"own{i}"])
        texts.append(" ".join(line) + "\nother words " + " ".join(rng.sample(base, 6)))
    rows = [*enumerate(texts), (None, texts[7]), (None, None)]
    left = []

    def seen(entries, threshold, old=ld._candidates):
        left.append(old(entries, threshold).count())
        return old(entries, threshold)

    monkeypatch.setattr(ld, "_candidates", seen)
    got = sorted((tuple(r) for r in ld.lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = brute(rows, 0.8)
    assert got == want
    links = sum({r[2:4]: r[4] for r in want}.values()) // 2
    assert links > 400 and left[0] < links / 3


def test_lines_of_a_family_are_paired_only_if_they_match(spark, monkeypatch):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        line = [f"b{i}" for i in range(30)]
        for i in rng.sample(range(30), rng.choice([1, 2, 2, 3])):
            line[i] = rng.choice(["x", "y", f"own{rng.randrange(40)}"])
        texts.append(" ".join(line))
    rows = [*enumerate(texts), (100, "f\n \t\x0b\f\r\nf\n \t\x0b\f\r")]
    counts = []

    def seen(entries, threshold, old=ld._candidates):
        counts.append(old(entries, threshold).count())
        return old(entries, threshold)

    monkeypatch.setattr(ld, "_candidates", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ld.lines(docs).collect()), key=str) == brute(rows, 0.8)
    found = ld.classes(docs)
    sets = ld._sets(found, 0.8)
    matches = ld._matches(found, ld._entries(sets, ld._families(found, sets, 0.8)), 0.8).count()
    assert 0 < matches <= counts[0] < 1.05 * matches  # a few are of no family


def test_groups_with_like_middles_are_one(spark):
    base = [f"b{i}" for i in range(40)]
    rows = [(7, base), (3, base[1:] + ["x"]), (5, base[:-1]), (1, [f"c{i}" for i in range(40)]), (2, ["b1"])]
    got = ld._united(spark.createDataFrame(rows, "fam long, middle array<string>")).collect()
    assert {r.fam: r.to for r in got} == {7: 3, 3: 3, 5: 3, 1: 1, 2: 2}


def test_signatures_and_prefixes_hold_what_the_join_needs(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(rng.sample(base, n) + [f"own{n}"]) for n in (70, 78, 79, 80, 81, 84, 90, 99, 100)] + ["a b", "b a", "b  a", "a"]
    rows = [*enumerate(texts), (50, "\n".join(texts[:2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ld.classes(docs)
    sets = ld._sets(found, 0.8)
    assert {r.n: r.sign2 is not None for r in sets.collect()} == {n: n > ld.ONE_SIGN for n in (1, 2, 71, 79, 80, 81, 82, 85, 91, 100, 101)}
    # a word of one class is counted as a place of the prefix and not kept in it
    assert all(r.start == 1 and len(r.prefix) == r.n - -(-4 * r.n // 5) for r in sets.where("n > 3").collect())
    assert sorted((tuple(r) for r in ld.lines(docs).collect()), key=str) == brute(rows, 0.8)


def test_bands_are_joined_alike_without_a_broadcast(spark, monkeypatch):
    rows = [(i, " ".join([f"b{k}" for k in range(30) if k != i % 5])) for i in range(12)] + [(20, "x y z v w " * 3 + "own"), (21, None)]
    rows = [(i, None if t is None else t + f" own{i % 3}") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 0.8)
    assert sorted((tuple(r) for r in ld.lines(docs).collect()), key=str) == want
    monkeypatch.setattr(ld, "SMALL", 0)
    assert sorted((tuple(r) for r in ld.lines(docs).collect()), key=str) == want
