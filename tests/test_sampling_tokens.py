"""Distributed rank, exact splits, few-shot, batches, padding and packing
against plain loops."""

import math
import random

from pyspark.sql import functions as F

from tessera.operators import sampling as D
from tessera.operators import tokens as T


def test_global_rank_equals_sorted_order(spark):
    rnd = random.Random(3)
    keys = [rnd.randint(0, 10_000) for _ in range(3000)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k long")
    o = D.seeded_order(df, "id")
    got = {r.id: r.rn for r in D.hashed_rank(o, "ord", "id").collect()}
    assert got == {r.id: r.rn for r in D.global_rank(o, ["ord", "id"]).collect()}
    import hashlib
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert got == {i: n + 1 for n, i in enumerate(order)}
    plan = D.hashed_rank(o, "ord", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # only the per-bucket count table


def test_split_sizes_and_disjoint(spark):
    n = 1775
    df = spark.createDataFrame([(i, "click" if i % 3 else "view") for i in range(n)], "id long, label string")
    s = D.split_dataset(df, "id")
    sizes = {r.split: r.n for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    t = math.ceil(0.1 * n)
    assert sizes == {"test": t, "validation": t, "train": n - 2 * t} and t == 178
    assert s.select("id").distinct().count() == n
    vocab = spark.createDataFrame([("click", 0), ("view", 1), ("absent", 2)], "label string, id int")
    shots = D.few_shot(s.where("split = 'train'"), vocab, 2).collect()
    assert sorted(r.label for r in shots) == ["click", "click", "view", "view"]
    b = D.assign_batches(s.where("split = 'test'").drop("rn"), ["ord", "id"], 8, hashed=True)
    counts = sorted(r.c for r in b.groupBy("batch").agg(F.count("*").alias("c")).collect())
    assert counts[0] == t % 8 and counts[-1] == 8 and len(counts) == math.ceil(t / 8)


def test_pad_mask_pack_against_loop(spark):
    rnd = random.Random(5)
    docs = [(d, [rnd.randint(2, 50) for _ in range(rnd.randint(0, 30))]) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, ids array<long>")
    b = D.assign_batches(df, ["doc_id"], 8)
    p = T.tokenize_pad(b, "ids", "batch").collect()
    for r in p:
        assert len(r.padded) == max(len(x) for d, x in docs if d // 8 == r.doc_id // 8)
        assert r.padded[len(r.padded) - len(r.ids):] == r.ids and sum(r.attention) == len(r.ids)
    m = df.select(T.mask_labels(F.array(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("m")).first().m
    assert m == [-100, 5]
    seq_len, eos = 8, 1
    packed = T.pack_sequences(df.withColumn("grp", F.col("doc_id") % 3), "ids", ["doc_id"], seq_len, eos,
                              group=["grp"]).collect()
    expect = {}
    for g in range(3):
        stream = [t for d, x in docs if d % 3 == g for t in x + [eos]]
        for s in range(len(stream) // seq_len):
            expect[(g, s)] = stream[s * seq_len:(s + 1) * seq_len]
    assert {(r.grp, r.seq): list(r.input_ids) for r in packed} == expect


def test_few_shot_plans_group_limit(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("label"),
                                  F.md5(F.col("id").cast("string")).alias("ord"))
    vocab = spark.createDataFrame([("0", 0), ("1", 1)], "label string, id int")
    plan = D.few_shot(df, vocab, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # partial top-n before the shuffle


def test_context_limits_and_zero_shot(spark):
    from tessera.operators import prompts as P
    rows = [("Falcon", "falcon-7b"), ("MPT", "mpt-7b-chat"), ("MPT", "mpt-30b-chat"), ("LLaMA-3", "x"),
            ("Mistral", "Mixtral-8x7B-Instruct-v0.1"), ("Other", "y")]
    df = spark.createDataFrame(rows, "family string, variant string")
    got = [r[0] for r in df.select(P.context_limit(F.col("family"), F.col("variant"))).collect()]
    assert got == [2048, 2048, 8192, 8192, 32768, None]
    recs = spark.createDataFrame([(1, "u1", "t", "click")], "id long, entity string, text string, label string")
    ev = P.format_examples(recs, P.template_catalogue(spark), "llama3", "test", F.lit('"click"')).first()
    assert ev.answer == "click" and ev.prompt_text.startswith("Question:")
    tr = P.format_examples(recs, P.template_catalogue(spark), "llama3", "train", F.lit('"click"')).first()
    assert tr.prompt_text == tr.answer and tr.answer.endswith(" click\n\n")


def test_global_rank_with_a_hot_key_and_text_ids(spark):
    # a third of the rows share one order key; ids are sparse hashes
    n = 30000
    rows = [(f"{(i * 7919) % 65536:04x}{i:08d}", "8888" if i % 3 == 0 else f"k{i % 700}") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, k string")
    got = {r.id: r.rn for r in D.global_rank(df, ["k", "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    batches = {r.id: r.batch for r in D.assign_batches(df, ["id"], 1000).collect()}
    assert batches == {r[0]: i // 1000 for i, r in enumerate(sorted(rows))}


def test_split_reads_its_table_twice_at_most(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    spark.range(5000).selectExpr("id", "concat('text ', id) as text").write.parquet(path)
    s = D.split_dataset(spark.read.parquet(path), "id")
    s.collect()
    plan = s._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count(path) <= 1  # the rows; the keys were read once before, for the ranks
    split = {r.id: r.split for r in s.collect()}
    assert sum(x == "test" for x in split.values()) == 500


def test_token_ids_do_not_collide(spark):
    words = spark.range(60000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("t"))
    ids = words.select(F.explode(T.hash_token_ids(F.col("t"))).alias("i"))
    assert ids.distinct().count() == 60000


def test_packing_has_no_row_for_each_token(spark):
    df = spark.createDataFrame([(i, [5] * 100) for i in range(50)], "doc_id long, ids array<long>")
    plan = T.pack_sequences(df, "ids", ["doc_id"], 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
