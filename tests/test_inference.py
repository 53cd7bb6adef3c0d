"""Budgeted batches: budgets, retries, quarantine, kept state."""

import random

from tessera.operators import inference as I


def test_batches_keep_the_budget_and_every_row():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.choice([0, 1, 3, 10, 50]) for _ in range(rng.randint(0, 60))]
        batches = list(I.length_batches(lengths, 60, 7))
        assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
        assert all(len(b) <= 7 and (len(b) == 1 or max(lengths[i] for i in b) * len(b) <= 60) for b in batches)


def failing():
    def predict(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [t.upper() for t in texts] + (["more"] if "short" in texts else [])
    return predict


def counting():
    calls = []

    def predict(texts):
        calls.append(len(texts))
        return [str(len(calls)) for _ in texts]
    return predict


def flaky():
    """Each predictor fails from its third call on; a new one works again."""
    left = [2]

    def predict(texts):
        left[0] -= 1
        if left[0] < 0:
            raise MemoryError("full")
        return ["x" + t for t in texts]
    return predict


def test_failing_prompts_are_set_apart(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "bad", "c", "so bad", None, "short", "d " * 500] * 20)]
    df = spark.createDataFrame(rows, "id int, prompt string").repartition(3)
    got = {r.id: r for r in I.generate_batches(df, failing, budget=40, most_rows=8).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        if t in ("bad", "so bad", "short"):
            assert r.status == "failed" and r.response is None and ("no answer" in r.error or "2 answers to 1" in r.error)
        else:
            assert (r.status, r.response, r.error) == ("ok", (t or "").upper(), None)
        assert r.batch_tokens <= 40 or r.batch_rows == 1


def test_a_new_predictor_repeats_a_failed_batch(spark):
    df = spark.range(100).selectExpr("id", "concat('p', id) AS prompt").coalesce(1)
    got = I.generate_batches(df, flaky, budget=4, most_rows=2).collect()
    assert all(r.status == "ok" and r.response == "x" + r.prompt for r in got)
    none = I.generate_batches(df.limit(0), flaky)
    assert none.collect() == [] and none.columns == ["id", "prompt", "response", "status", "error", "batch_rows", "batch_tokens"]


def test_a_kept_predictor_outlives_its_task(spark):
    df = spark.range(64).selectExpr("id", "'p' AS prompt")
    first = I.generate_batches(df.coalesce(1), counting, keep="test-counting")
    second = max(max(int(r.response) for r in first.collect()) for _ in range(12))
    alone = max(int(r.response) for r in I.generate_batches(df.coalesce(1), counting).collect())
    assert alone == 1 and second > 1
