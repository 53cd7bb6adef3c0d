"""Report write/read round trips, loose reports, vocabulary source, sinks,
and the streaming score = batch score."""

import glob
import json
import os

from pyspark.sql import functions as F

from tessera.functions.fixed import KBASE_LABELS
from tessera.operators import metrics as M
from tessera.sources import readers as S
from tessera.sources import sinks as K
from tessera.streaming.scores import stream_scores


def test_report_round_trip_multi_part(spark, tmp_dir):
    rows = spark.range(1, 3001).select(F.col("id").alias("num"),
                                       F.when(F.col("id") % 3 == 0, "B").otherwise("a, x").alias("pred"),
                                       F.lit("A").alias("true"))
    metrics = M.compute_metrics(rows)
    path = os.path.join(tmp_dir, "rep")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = K.report_lines(spark, rows, metrics, {"data_name": "kbase"}, "prompt line 1\n9, looks, like, a row",
                               originals=rows.select("num", F.lit("e").alias("entity"), "pred", "true"))
        K.write_report(lines, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob.glob(os.path.join(path, "part-*"))) > 1
    back = S.read_report(spark, path, 3).select("num", "pred", "true")
    exp = rows.select("num", F.lower(F.split("pred", ", ").getItem(0)).alias("pred"),
                      F.concat(F.when(F.col("pred").contains(", "), F.lit("x, ")).otherwise(F.lit("")), F.lit("a")).alias("true"))
    assert back.count() == 3000
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, exp.collect()))


def test_four_column_and_loose(spark, tmp_dir):
    rows = spark.createDataFrame([(1, "p1, brand", "x", "x"), (2, "p2", "y", "z")], "num long, src string, pred string, true string")
    path = os.path.join(tmp_dir, "rep4")
    K.write_report(K.report_lines(spark, rows, M.compute_metrics(rows), {}, with_src=True), path)
    back = sorted(tuple(r) for r in S.read_report(spark, path, 4).select("num", "src", "pred", "true").collect())
    assert back == [(1, "p1, brand", "x", "x"), (2, "p2", "y", "z")]
    lpath = os.path.join(tmp_dir, "loose.txt")
    with open(lpath, "w") as f:
        f.write("Src, Pred, True:\n" + "*" * 68 + "\n" + "a,,b, c\nd,e,f,g\nh, i ,j\n")
    loose = S.read_report_loose(spark, lpath).collect()
    assert sorted((r.pos, r.line) for r in loose) == [(1, "a,,b, c"), (2, "d,e,f,g"), (3, "h, i ,j")]
    got = {r.line: (r.ok, r.src, r.pred, r.true) for r in loose}
    assert got["a,,b, c"] == (True, "a", "b", "c") and got["d,e,f,g"][0] is False


def test_reports_are_split_and_need_their_mark(spark, tmp_dir):
    import pytest
    from pyspark.errors import PySparkException
    path = os.path.join(tmp_dir, "big.txt")
    with open(path, "w") as f:
        f.write("1, header, line\n" + "*" * 68 + "\n" + "".join(f"{i}, p{i}, t{i}\n" for i in range(1, 20001)) + "#" * 68 + "\n9, no, no\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = S.read_report(spark, path, 3).collect()
        assert sorted(r.num for r in got) == list(range(1, 20001))
        loose = S.read_report_loose(spark, path, 3).orderBy("pos").collect()
        assert [r.pos for r in loose] == list(range(1, 20003)) and loose[123].line == "124, p124, t124"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    bad = os.path.join(tmp_dir, "bad.txt")
    with open(bad, "w") as f:
        f.write("1, a, b\n2, c, d\n")
    with pytest.raises(PySparkException):
        S.read_report(spark, bad, 3).collect()


def test_report_headers(spark):
    rows = spark.createDataFrame([(1, "a", "a")], "num long, pred string, true string")
    m = M.compute_metrics(rows)
    head = lambda info: [r.line for r in K.report_lines(spark, rows, m, info).where("section = 0").orderBy("num").collect()]
    assert ">> KEGG data type: pathway" in head({"data_name": "kegg", "kegg_data_type": "pathway"})
    assert ">> Number of INDRA classes: 6" in head({"data_name": "indra", "num_classes": 6})
    lines = head({"model_config": {"a": 1}, "generation_config": {"b": 2}})
    assert lines[lines.index(">> Model configuration:") + 1] == "{'a': 1}" and lines[lines.index(">> Generation configuration:") + 1] == "{'b': 2}"


def test_label_vocab_source(spark, tmp_dir):
    p = os.path.join(tmp_dir, "types.json")
    with open(p, "w") as f:
        json.dump({lab: {"id": i} for i, lab in enumerate(KBASE_LABELS)}, f, indent=4)
    v = S.read_label_vocab(spark, p, 14).orderBy("id").collect()
    assert [r.label for r in v] == KBASE_LABELS
    assert S.read_label_vocab(spark, p, 5).count() == 5


def test_leaderboard_and_pairs_sinks(spark, tmp_dir):
    pairs = spark.createDataFrame([("m1", "a", "a"), ("m1", "a", "b"), ("m2", "b", "b")], "model string, true string, pred string")
    board = M.compute_metrics(pairs, ["model"], digits=None)
    j = json.loads(K.leaderboard_json(board).first().value)
    assert j["m1"]["accuracy"] == 0.5 and j["m2"]["macro_f"] == 1.0
    out = os.path.join(tmp_dir, "pairs")
    K.write_pairs(spark.createDataFrame([("s2", "p"), ("s1", "q")], "src string, pred string"), out)
    assert [r.value for r in spark.read.text(out).collect()] == ["s1, q", "s2, p"]


def test_stream_equals_batch(spark, tmp_dir):
    import random
    rnd = random.Random(11)
    rows = [(i, rnd.choice("abc"), rnd.choice("abcd")) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, true string, pred string")
    src = os.path.join(tmp_dir, "src")
    df.repartition(5).write.parquet(src)
    stream = spark.readStream.schema("id long, true string, pred string").option("maxFilesPerTrigger", 2).parquet(src)
    s = stream_scores(spark, stream, os.path.join(tmp_dir, "snap"), os.path.join(tmp_dir, "ckpt")).first().asDict()
    assert len(glob.glob(os.path.join(tmp_dir, "snap", "epoch=*"))) > 1  # a folder for each epoch
    b = M.compute_metrics(df).first().asDict()
    assert s == b


def test_type_table_and_confusion_sink(spark, tmp_dir):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "true string, pred string")
    rep = M.restricted_metrics(pairs, ["a", "b"])
    lines = {r.type: r.line for r in M.format_type_report(rep).collect()}
    assert lines["a"].split() == ["a", "100.00", "50.00", "66.67", "2"]
    assert lines["micro"].split()[1:] == ["75.00", "75.00", "75.00", "4"]
    path = os.path.join(tmp_dir, "conf")
    K.write_confusion(M.confusion(pairs, ["a", "b"]), ["a", "b"], path)
    wide = {r["true"]: (r["a"], r["b"]) for r in spark.read.parquet(f"{path}/wide").collect()}
    assert wide == {"a": (1, 1), "b": (0, 2)}
    assert spark.read.parquet(f"{path}/long").count() == 4
