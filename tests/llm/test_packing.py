"""Exact ids, exact round trip, and packing against a plain best fit."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing

VOCABULARY = packing.VOCABULARY
needs = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="vocabulary file not present")
ODD = ["", "a", " a", "  a", "a ", "a  ", "a   b", "a \n b", "a\n \nb", "a\n\n b", "\n a", " \n", "a\t b", "a \tb", "don't we'll I'M", "x\xa0 y", "x   y",
       "a\x1c b \x1cc", "naïve Ärger 123 45.6 %%% !?", "<|endoftext|> x", "日本 語", "é f", "w" * 500, "tab\t\tend  \n\n  z"]


@needs
def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    encoder = packing.Encoder(packing.ranks_of(VOCABULARY))
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choices(["a", "b ", " ", "  ", "\n", "\t", "'s", "é", "9", ".", " The"], k=rng.randint(1, 40))) for _ in range(400)]
    for t in texts:
        got = np.frombuffer(encoder(t), dtype="<u2").tolist()
        assert got[-1] == encoder.end
        assert got[:-1] == other.encode(t, add_special_tokens=False).ids, repr(t)


@needs
def test_parts_of_long_texts_join_to_the_ids_of_the_whole(monkeypatch):
    encoder = packing.Encoder(packing.ranks_of(VOCABULARY))
    rng = random.Random(12)
    texts = ["".join(rng.choices(["a", "b ", " ", "  ", "\n", " \n", "\t", "'s", " 's", "é", "9", ".", " The", "\x1c", "\u3000"], k=rng.randint(1, 90))) for _ in range(500)] + ["x" * 5000]
    whole = [encoder(t) for t in texts]
    for size in (0, 1, 7):
        monkeypatch.setattr(packing, "_PART", size)
        assert [encoder(t) for t in texts] == whole


def test_best_fit_is_best_fit():
    rng = random.Random(1)
    for most in (1, 5, 64, 100):
        lengths = [rng.randint(1, most) for _ in range(300)]
        rows, room = [], []
        for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
            fit = min(((r, j) for j, r in enumerate(room) if r >= lengths[i]), default=None)
            if fit is None:
                rows.append([i])
                room.append(most - lengths[i])
            else:
                rows[fit[1]].append(i)
                room[fit[1]] -= lengths[i]
        assert packing.best_fit(lengths, most) == rows
    assert packing.best_fit([], 5) == []


@needs
@pytest.mark.parametrize("length,shard", [(16, 7), (2048, 4096)])
def test_round_trip(spark, length, shard):
    rng = random.Random(length)
    texts = ODD + [None] + [" ".join(rng.choices(["some", "Words", "here,", "and", "x"], k=rng.randint(1, 200))) for _ in range(60)] + ["long " * 9000]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, part int")
    rows = packing.pack(docs, length=length, shard=shard).collect()
    encoder = packing.Encoder(packing.ranks_of(VOCABULARY))
    parts = defaultdict(dict)
    ids, positions = packing.matrix(rows), packing.matrix(rows, "positions")
    assert ids.shape == positions.shape == (len(rows), length)
    assert len({(r.shard, r.row) for r in rows}) == len(rows)
    for r, x, p in zip(rows, ids, positions):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert (x[r.n_tokens :] == encoder.end).all() and not p[r.n_tokens :].any()
        for d, o, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            assert p[a:b].tolist() == list(range(b - a))
            assert o not in parts[d]
            parts[d][o] = x[a:b]
    for i, t in enumerate(texts):
        joined, at = [], 0
        while at in parts[i]:
            joined.append(parts[i].pop(at))
            at += len(joined[-1])
        assert not parts[i]
        assert np.concatenate(joined).astype("<u2").tobytes() == encoder(t)


@needs
def test_ids_may_be_null_or_repeated_and_tables_empty(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs).collect()
    assert len(rows) == 1 and sorted(map(str, rows[0].doc_ids)) == ["1", "1", "None"]
    assert packing.pack(docs.limit(0)).count() == 0


@needs
def test_shards_follow_the_files_however_they_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    # later files are larger, and one is cut into several splits
    rows = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(f" {i}"))) for i in range(4)]).alias("text"))
    sizes = [10, 40, 150, 600, 1200, 2000]
    bounds = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        (rows.where(f"doc_id >= {a} and doc_id < {b}").coalesce(1).write.option("parquet.block.size", 40_000)
             .option("parquet.page.size.row.check.min", 10).option("parquet.block.size.row.check.min", 10).parquet(f"{path}/{i}"))
    os.makedirs(f"{path}/all")
    for i in range(len(sizes)):
        (part,) = [f for f in os.listdir(f"{path}/{i}") if f.endswith(".parquet")]
        # the names' numbers have a digit more at the end
        os.link(f"{path}/{i}/{part}", f"{path}/all/part-{99996 + i}.parquet")
    conf = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for most in ("16k", "100k", "400k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            held = defaultdict(list)
            for r in packing.pack(spark.read.parquet(f"{path}/all"), shard=100).collect():
                held[r.shard] += r.doc_ids
            order = [i for s in sorted(held) for i in sorted(held[s])]
            assert order == list(range(4000)), most
            assert max(map(len, held.values())) <= 100
    finally:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.files.minPartitionNum")


@needs
def test_tables_in_other_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(60)], "doc_id long, text string")
    for kind in ("json", "orc", "parquet"):
        path = str(tmp_path / kind)
        docs.repartition(3).write.format(kind).save(path)
        back = spark.read.schema(docs.schema).format(kind).load(path)
        for table in (back, back.where("doc_id >= 0").select("text", "doc_id"), back.repartition(2)):
            rows = packing.pack(table, length=64, by_files=False if table is not back else None).collect()
            assert sorted({i for r in rows for i in r.doc_ids}) == list(range(60))
            assert len({(r.shard, r.row) for r in rows}) == len(rows)
