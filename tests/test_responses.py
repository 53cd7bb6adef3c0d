"""Closed-vocabulary cleaning (R1-R3), prompt echo removal (P9), batch
inference surface (M1)."""

from pyspark.sql import functions as F

from tessera.operators import responses as R
from tessera.operators.inference import generate
from tessera.plans.fixtures import choice_channel_factory

VOCAB = ["plasmid", "organism host", "promoter", "RBS", "DNA transfer"]


def test_clean_response_rules(spark):
    rows = [
        (1, "The answer is plasmid", "pX", "plasmid"),
        (2, "plasmid or promoter", "pX", "promoter"),        # tie -> gold among hits
        (3, "plasmid or promoter", "pX", "RBS"),             # tie, gold absent -> None
        (4, "no idea", "pX", "plasmid"),                     # no hit -> None
        (5, "PROMOTER.", "pX", "promoter"),                  # case-insensitive
        (6, "promoter-x is a plasmid", "promoter-x", "plasmid"),  # entity removed first
        (7, "RBS and plasmid", "", "RBS"),                   # gold lower-cased (Q2 default)
    ]
    df = spark.createDataFrame(rows, "id long, response string, entity string, label string")
    got = {r.id: r.cleaned for r in R.clean_response(df, VOCAB).collect()}
    assert got == {1: "plasmid", 2: "promoter", 3: "None", 4: "None", 5: "promoter", 6: "plasmid", 7: "rbs"}
    compat = {r.id: r.cleaned for r in R.clean_response(df, VOCAB, lower_gold=False).collect()}
    assert compat[7] == "None"  # mixed-case gold never wins a tie on the compat path
    first = {r.id: r.cleaned for r in R.clean_response(df, VOCAB, tie_break="first").collect()}
    assert first[3] == "plasmid"
    pairs = {r.id: (r.pred, r.true) for r in R.score_pairs(df, VOCAB).collect()}
    assert pairs[3] == ("none", "rbs") and pairs[1] == ("plasmid", "plasmid")


def test_align_lists_idempotent(spark):
    df = spark.createDataFrame([(["b", "a", "x", "x"], ["a", "c", "b", "d"]), (["z"] * 3, list("abcdefghijkl"))],
                               "p array<string>, t array<string>")
    p, t = R.align_lists(F.col("p"), F.col("t"))
    rows = df.select(p.alias("p"), t.alias("t")).collect()
    assert rows[0].p == ["a", "b", "x", "NONE"] and rows[0].t == ["a", "b", "c", "d"]
    assert len(rows[1].t) == 12 and rows[1].p == ["z"] + ["NONE"] * 11  # nothing is cut by default
    p10, t10 = R.align_lists(F.col("p"), F.col("t"), cap=10)
    cut = df.select(p10.alias("p"), t10.alias("t")).collect()[1]
    assert len(cut.t) == 10 and cut.p == ["z"] + ["NONE"] * 9
    again = spark.createDataFrame([(rows[0].p, rows[0].t)], "p array<string>, t array<string>")
    p2, t2 = R.align_lists(F.col("p"), F.col("t"))
    r2 = again.select(p2.alias("p"), t2.alias("t")).first()
    assert set(r2.t) == set(rows[0].t)


def test_strip_prompt_by_length(spark):
    df = spark.createDataFrame([("Q: hi", "Q: hi  answer  "), ("abc", "XYZ tail")], "prompt string, text string")
    got = [r[0] for r in df.select(R.strip_prompt(F.col("text"), F.col("prompt"))).collect()]
    assert got == ["answer", "tail"]  # cut by length, no equality check


def test_generate_keeps_keys(spark):
    prompts = [(i, f'Question: pick. Options: "a", "b", "c". Text: row {i}') for i in range(50)]
    df = spark.createDataFrame(prompts, "id long, prompt string").repartition(4)
    out = generate(df, choice_channel_factory, "prompt", "resp", batch_size=7).collect()
    assert len(out) == 50
    for r in out:
        assert r.resp.startswith(r.prompt + " ") and r.resp[-1] in "abc"
