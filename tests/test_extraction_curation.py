"""Containment joins and curated scoring against plain-Python brute force."""

import json

from pyspark.sql import functions as F

from tessera.operators import curation as C
from tessera.operators import extraction as X


def test_match_contained_brute_force(spark):
    gold = spark.createDataFrame(
        [("p", "x", e) for e in ["ab", "abc", "zz", "q", "longer entity"]] + [("p", "y", "ab")],
        "uid string, label string, entity string")
    parsed = spark.createDataFrame(
        [("p", "x", v, i) for i, v in enumerate(["xxabcxx", "ab", "a longer entity here", "nothing", "qq"])]
        + [("p", "y", "zab", 0)], "uid string, label string, value string, first_pos long")
    got = sorted(tuple(r) for r in X.match_contained(gold, parsed).collect())
    brute = sorted((g.uid, g.label, g.entity, p.value) for g in gold.collect() for p in parsed.collect()
                   if g.uid == p.uid and g.label == p.label and g.entity in p.value)
    assert got == brute
    assert sum(1 for r in brute if r[2] == "ab") == 3  # a gold entity repeats per containing value (Q4)


def test_find_mentions_brute_force(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "hello world ab"),
                                  (3, "nothing here at all"), (4, "quick brown fox jumps again")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(10, "quick brown fox jumps"), (11, "lo wor"), (12, "ab"), (13, "zzz"),
                                   (14, "rown f"), (15, "her"), (16, ""), (17, "x"), (18, "e"),
                                   (19, "hello world")], "item_id long, text string")
    got = sorted(tuple(r) for r in X.find_mentions(docs, items).collect())
    brute = sorted((d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text and i.text in d.text)
    assert got == brute
    for some in ("item_id = 10", "item_id in (11, 14)", "item_id in (12, 17)"):
        plan = X.find_mentions(docs, items.where(some))._jdf.queryExecution().executedPlan().toString()
        # the only product is with the one row of gram lengths (the documents' grams are used twice)
        assert plan.count("NestedLoopJoin") <= 2 and "CartesianProduct" not in plan


def _cell(d):
    return json.dumps(d)


REVIEW = [
    # title, uid, annotation, prediction, wrong fragment, rejected
    ("T1", "u1", {"host": ["E. coli"], "plasmid": ["pA, pB", "pA"], "not relevant": ["junk"]},
     {"host": ["e. coli"], "plasmid": ["PA, pC", "pc"]}, '"plasmid": ["pc"],,', False),
    ("T2", "u2", {"host": ["Bacillus", "B. subtilis"], "promoter": ["pLac"]},
     {"promoter": ["plac, pTet"], "host": ["yeast"]}, None, True),
    ("T3", "u3", {"plasmid": ["Pz", "pz"]}, {"plasmid": ["pz"], "host": ["Yeast"]}, '  "host": ["x"] , ', False),
]
SYN = [("Bacillus subtilis", ["bacillus", "b. subtilis"], []), ("Escherichia coli", ["e. coli"], ["E. coli"])]


def _parse(values, syn_ci):
    out = {}
    for label, vals in values.items():
        if label == "not relevant":
            continue
        items = []
        for v in vals:
            names = [x.strip() for x in v.split(",") if x.strip()]
            names = [syn_ci.get(x.lower(), x) for x in names]
            seen = []
            for x in names:
                if x not in seen:
                    seen.append(x)
            items += seen
        out[label] = items
    return out


def brute_curation(compat):
    syn_ci = {v: canon for canon, vs, _ in SYN for v in vs}
    rows = []
    for title, uid, anno, pred, wrong, rejected in REVIEW:
        a, p = _parse(anno, syn_ci), _parse(pred, syn_ci)
        for label, ents in a.items():
            for e in ents:
                hit = label in p and e.lower() in [x.lower() for x in p[label]]
                rows.append((uid, "gold", label, e, label, (("none" if rejected else label) if hit else "none")))
                if hit:
                    p[label] = [x for x in p[label] if (x.lower() != e if compat else x.lower() != e.lower())]
        w = {}
        if not rejected and wrong is not None:
            w = _parse(json.loads("{" + wrong.strip().rstrip(",") + "}"), syn_ci)
        for label, ents in p.items():
            for e in ents:
                bad = label in w and e.lower() in [x.lower() for x in w[label]]
                rows.append((uid, "pred", label, e, label, "none" if bad or rejected else label))
    return sorted(rows)


def _review_df(spark):
    return spark.createDataFrame(
        [(t, u, _cell(a), _cell(p), "{}", w, r) for t, u, a, p, w, r in REVIEW],
        "title string, uid string, annotation string, prediction string, true string, wrong string, rejected boolean")


def test_curated_pairs_match_sequential_semantics(spark):
    review = C.parse_review(_review_df(spark))
    items = C.curated_items(review, C.synonym_table(spark, SYN))
    for compat in (False, True):
        got = sorted((r.uid, r.side, r.label, r.entity, r.pred, r.true)
                     for r in C.curated_pairs(items, C.review_flags(review), compat).collect())
        assert got == brute_curation(compat), compat
    hosts = {(r.uid, r.side): r.host for r in C.single_host(items, "host").collect()}
    # u2's two gold host values both become 'Bacillus subtilis' but stay two
    # items (distinct within a value only), so that side is not single-host
    assert hosts == {("u1", "gold"): "Escherichia coli", ("u1", "pred"): "Escherichia coli",
                     ("u2", "pred"): "yeast", ("u3", "pred"): "Yeast"}
    idx = C.host_index_rows(items, C.review_flags(review), review.select("uid", "title"), "host")
    rows = idx.collect()
    assert not [r for r in rows if r.uid == "u2"]  # rejected row: its predictions never enter
    nested = C.host_index(idx, parts=3).collect()
    assert sum(len(r.tools) for r in nested) == len(rows) and all(0 <= r.part < 3 for r in nested)
    whole = C.host_index(idx).collect()
    assert len(whole) == len({r.species for r in rows}) and sum(len(r.tools) for r in whole) == len(rows)


def test_fragment_and_exact_synonym(spark):
    df = spark.createDataFrame([(' "a": ["x", "y"],,, ',), (None,)], "w string")
    got = [r[0] for r in df.select(C.parse_json_fragment(F.col("w"))).collect()]
    assert got[0] == {"a": ["x", "y"]} and got[1] == {}
    items = spark.createDataFrame([("u", "gold", "host", 0, 0, "E. coli"), ("u", "gold", "host", 0, 1, "e. COLI"),
                                   ("u", "gold", "host", 1, 0, "E. coli")],
                                  "uid string, side string, label string, vpos int, npos int, entity string")
    out = sorted((r.vpos, r.entity) for r in C.apply_synonyms(items, C.synonym_table(spark, SYN)).collect())
    assert out == [(0, "Escherichia coli"), (1, "Escherichia coli")]  # distinct within a value only
