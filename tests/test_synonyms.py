"""Synonyms by broadcast and by the split join give the same rows."""

import random

from tessera.operators import curation as C


def test_split_join_equals_broadcast_and_a_plain_lookup(spark):
    rng = random.Random(5)
    names = ["Hot"] * 30 + ["hot", "warm", "Warm", "cold", "Unknown", "one sentence", "One sentence"]
    rows = [(f"u{rng.randrange(40)}", "gold", "host", rng.randrange(3), i, rng.choice(names)) for i in range(600)]
    items = spark.createDataFrame(rows, "uid string, side string, label string, vpos int, npos int, entity string").repartition(3)
    entries = [("ci", "hot", "H", 0), ("ci", "warm", "W", 2), ("ci", "warm", "W9", 9), ("exact", "Hot", "exact hot", -1), ("exact", "Warm", "exact warm", 3), ("exact", "one sentence", "S", 1), ("ci", "one sentence", "C", 1)]
    syn = spark.createDataFrame(entries, "kind string, variant string, canonical string, prio int")

    def canonical(name):
        found = [(p, k == "ci", c) for k, v, c, p in entries if (v == name if k == "exact" else v == name.lower())]
        return max(found)[2] if found else name

    want = {}
    for uid, side, label, vpos, npos, name in rows:
        key = (uid, side, label, vpos, canonical(name))
        want[key] = min(npos, want.get(key, npos))
    for limit, hot in ((100, 2), (0, 1), (0, 2), (0, 100)):
        got = C.apply_synonyms(items, syn, broadcast_rows=limit, hot_names=hot)
        assert got.columns == ["uid", "side", "label", "vpos", "entity", "npos"]
        assert {tuple(r)[:5]: r.npos for r in got.collect()} == want
    assert C.apply_synonyms(items.limit(0), syn, broadcast_rows=0).collect() == []


def test_hot_names_are_kept_out_of_the_join_by_name(spark):
    items = spark.range(2000).selectExpr("if(id % 2 = 0, 'hot', concat('n', id)) AS entity", "id")
    syn = spark.createDataFrame([("hot", "H", 0), ("n1", "N", 0)], "variant string, canonical string, prio int")
    assert C._hot_names(items, items.entity, 1) == ["hot"]
    got = C._looked_up(items, items.entity, syn, ["c", "p"], False, 1)
    assert {(r.entity, r.c): r["count"] for r in got.where("c IS NOT NULL").groupBy("entity", "c").count().collect()} == {("hot", "H"): 1000, ("n1", "N"): 1}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
