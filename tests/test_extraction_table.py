"""The one-pass extraction table against a fold in Python."""

import json
import random

from tessera.operators import extraction as X


def test_equals_a_plain_fold(spark):
    rng = random.Random(2)
    papers = [(f"p{i}", f'Title "{i}"\n') for i in range(30)] + [("p3", "again"), ("p99", None)]
    text = lambda: "".join(rng.choice('ab"é\\\n') for _ in range(rng.randint(1, 4)))
    label = lambda: rng.choice(["Gene", "gene", "host", "not relevant", "Not Relevant"])
    notes = [(f"p{rng.randrange(32)}", label(), text()) for _ in range(300)] + [("p1", None, "x"), ("p1", "gene", "")]
    found = [(f"p{rng.randrange(32)}", rng.choice(["gene", "host", "tool"]), text() + text(), rng.randrange(9)) for _ in range(400)]
    found += [("p0", "gene", "".join(t for _, _, t in notes if t), i) for i in (3, 1)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    table = X.extraction_table(frame([(t, u, 1) for u, t in papers], "title string, uid string, pos int"), frame(notes, "uid string, label string, entity string"), frame(found, "uid string, label string, value string, pos int"))
    got = sorted((r.uid, str(r.title), json.loads(r.annotation), json.loads(r.prediction), json.loads(r.true)) for r in table.collect())
    want = []
    for u, title in papers:
        gold, pred = {}, {}
        mine = [(lab, e) for p, lab, e in notes if p == u and lab and e]
        if not any(lab != "not relevant" for lab, _ in mine):
            continue
        for lab, e in mine:
            gold.setdefault(lab.lower(), set()).add(e)
        for _, lab, v, _ in sorted((r for r in found if r[0] == u), key=lambda r: (r[3], r[2])):
            if v not in pred.setdefault(lab, []):
                pred[lab].append(v)
        true = {lab: sorted(e for v in vs for e in gold.get(lab, ()) if e in v) for lab, vs in pred.items()}
        want.append((u, str(title), {k: sorted(v) for k, v in gold.items()}, pred, true))
    assert got == sorted(want) and len(got) > 25
    assert all(list(json.loads(r.annotation)) == sorted(json.loads(r.annotation)) for r in table.collect())


def test_one_exchange_by_paper(spark):
    schema = "uid string, label string, entity string, value string, pos int, title string"
    df = spark.createDataFrame([], schema)
    plan = X.extraction_table(df, df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
