"""Scores against a brute-force implementation of the documented semantics,
plus the invariants visible in the published score table."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import metrics as M


def brute(pairs, labels=None):
    """Per-class precision/recall/F1 with 0 for undefined ratios; label set =
    union of true and predicted unless given."""
    labs = sorted({t for t, _ in pairs} | {p for _, p in pairs}) if labels is None else list(labels)
    out = {}
    for c in labs:
        tp = sum(1 for t, p in pairs if t == c and p == c)
        npred = sum(1 for _, p in pairs if p == c)
        sup = sum(1 for t, _ in pairs if t == c)
        P = tp / npred if npred else 0.0
        R = tp / sup if sup else 0.0
        F = 2 * tp / (npred + sup) if npred + sup else 0.0
        out[c] = (tp, npred, sup, P, R, F)
    return out


def brute_scores(pairs):
    pc = brute(pairs)
    n = len(pairs)
    tp = sum(v[0] for v in pc.values())
    npred = sum(v[1] for v in pc.values())
    k = len(pc)
    return {
        "accuracy": sum(1 for t, p in pairs if t == p) / n,
        "macro_p": sum(v[3] for v in pc.values()) / k, "macro_r": sum(v[4] for v in pc.values()) / k,
        "macro_f": sum(v[5] for v in pc.values()) / k,
        "micro_p": tp / npred, "micro_r": tp / n, "micro_f": 2 * tp / (npred + n),
        "weighted_p": sum(v[3] * v[2] for v in pc.values()) / n,
        "weighted_r": sum(v[4] * v[2] for v in pc.values()) / n,
        "weighted_f": sum(v[5] * v[2] for v in pc.values()) / n,
    }


LABELS = ["a", "b", "c", "d", "none"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(LABELS[:4]), st.sampled_from(LABELS)), min_size=1, max_size=60))
def test_compute_metrics_matches_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "true string, pred string")
    got = M.compute_metrics(df, digits=None).first().asDict()
    exp = brute_scores(pairs)
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, abs=1e-12), k
    # invariants of the published table: micro P = R = F1 = accuracy = weighted recall
    assert got["micro_p"] == pytest.approx(got["accuracy"])
    assert got["micro_r"] == pytest.approx(got["accuracy"])
    assert got["micro_f"] == pytest.approx(got["accuracy"])
    assert got["weighted_r"] == pytest.approx(got["accuracy"])


def test_grouped_and_restricted(spark):
    rnd = random.Random(7)
    rows = [(f"m{rnd.randint(0, 2)}", rnd.choice(LABELS[:4]), rnd.choice(LABELS)) for _ in range(400)]
    df = spark.createDataFrame(rows, "model string, true string, pred string")
    got = {r.model: r.asDict() for r in M.compute_metrics(df, ["model"], digits=None).collect()}
    for m in got:
        exp = brute_scores([(t, p) for mm, t, p in rows if mm == m])
        assert got[m]["macro_f"] == pytest.approx(exp["macro_f"])
    types = ["a", "b", "z"]  # 'z' absent: scores 0
    rep = {r.type: r for r in M.restricted_metrics(df.where("model = 'm0'"), types, digits=None).collect()}
    pairs = [(t, p) for mm, t, p in rows if mm == "m0"]
    bf = brute(pairs, types)
    assert rep["z"].precision == 0 and rep["z"].support == 0
    assert rep["a"].recall == pytest.approx(bf["a"][4] * 100)
    tp = sum(v[0] for v in bf.values()); npred = sum(v[1] for v in bf.values()); sup = sum(v[2] for v in bf.values())
    assert rep["micro"].precision == pytest.approx(100 * tp / npred)
    assert rep["micro"].recall == pytest.approx(100 * tp / sup)
    assert rep["macro"].f1 == pytest.approx(100 * sum(v[5] for v in bf.values()) / 3)


def test_confusion_grid_and_drops(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "x"), ("x", "a"), ("b", "b")]
    df = spark.createDataFrame(pairs, "true string, pred string")
    long = M.confusion(df, ["a", "b"]).collect()
    assert len(long) == 4
    assert sum(r.n for r in long) == 3  # rows with an out-of-list label vanish
    cell = {(r.true, r.pred): r.n for r in long}
    assert cell[("a", "b")] == 1 and cell[("b", "a")] == 0
    t = {(r.true, r.pred): r.n for r in M.confusion(df, ["a", "b"], transpose=True).collect()}
    assert t[("b", "a")] == 1
    wide = {r["true"]: r.asDict() for r in M.confusion_wide(df, ["a", "b"]).collect()}
    assert wide["a"]["b"] == 1


def test_label_accuracy_and_filtered(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("none", "c")]
    df = spark.createDataFrame([(p, t) for t, p in pairs], "pred string, true string")
    la = {r.label: (r.matches, r.total) for r in M.label_accuracy(df).collect()}
    assert la == {"a": (1, 2), "b": (1, 2)}
    f = M.filtered_metrics(df, ignore="none", positive="a", digits=None).first()
    kept = [(t, p) for t, p in pairs if t != "none"]
    assert f.n == len(kept)
    assert f.micro_f == pytest.approx(sum(1 for t, p in kept if t == p) / len(kept))
    assert f.pos_p == pytest.approx(brute(kept)["a"][3])


def test_agreement_family(spark):
    a = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "pos long, ok boolean")
    b = spark.createDataFrame([(i, i % 3 == 0) for i in range(10)], "pos long, ok boolean")
    ag = M.agreement(a, b, ["pos"]).first()
    exp = sum(1 for i in range(10) if (i % 2 == 0) == (i % 3 == 0))
    assert ag.agree == exp and ag.rate == pytest.approx(exp / 10)
    ca = M.conditional_agreement(a, b, ["pos"]).first()
    assert ca.n == 5
    yn = {(r.true, r.pred): r.n for r in M.yes_no_confusion(a, b, ["pos"]).collect()}
    assert yn[("no", "no")] == 0 and yn[("no", "yes")] == 0  # true-'no' row empty by construction
    assert yn[("yes", "yes")] + yn[("yes", "no")] == 5


def test_confusion_keeps_keys_without_a_listed_answer(spark):
    pairs = spark.createDataFrame([("m1", "a", "a"), ("m2", "a", "zzz")], "model string, true string, pred string")
    got = {(r.model, r.true, r.pred): r.n for r in M.confusion(pairs, ["a", "b"], keys=["model"]).collect()}
    assert len(got) == 8 and sum(n for (m, *_), n in got.items() if m == "m2") == 0 and got["m1", "a", "a"] == 1
