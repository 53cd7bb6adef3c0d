"""Appends and streams that see the same rows again."""

import glob
import os
import random

from tessera.operators import metrics as M
from tessera.sources import sinks as K
from tessera.streaming.scores import stream_scores

LOG = "run string, epoch long, step long, micro_f1 double"


def test_an_epoch_appended_again_is_there_once(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    row = lambda run, epoch, f: spark.createDataFrame([(run, epoch, s, f) for s in (1, 2)], LOG)
    K.append_metric_log(row("a", 0, 0.1), path)
    K.append_metric_log(row("a", 1, 0.2).where("step = 1"), path)  # half of it
    K.append_metric_log(row("a", 1, 0.3), path)
    K.append_metric_log(row("b", 1, 0.4).unionByName(row("a", 0, 0.1)), path)
    got = sorted(map(tuple, K.read_metric_log(spark, path, LOG).select("run", "epoch", "step", "micro_f1").collect()))
    assert got == [("a", 0, 1, 0.1), ("a", 0, 2, 0.1), ("a", 1, 1, 0.3), ("a", 1, 2, 0.3), ("b", 1, 1, 0.4), ("b", 1, 2, 0.4)]


def test_layout_replaces_the_runs_it_brings(spark, tmp_dir):
    from pyspark.sql import functions as F

    path = f"{tmp_dir}/runs"
    df = spark.createDataFrame([("m1", 1), ("m1", 2), ("m2", 3)], "model string, x int")
    for ts in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        for part in (df, df.where("model = 'm1'")):
            K.write_run_layout(K.with_run_columns(part, F.col("model"), F.lit("o/v"), "d", "t", ts), path)
    got = spark.read.parquet(path)
    assert got.count() == 6 and got.select("run_ts").distinct().count() == 2


def test_each_id_counts_once_and_epochs_write_changes(spark, tmp_dir):
    rng = random.Random(3)
    schema = "k string, id long, true string, pred string"
    rows = [(rng.choice("xy"), i, rng.choice("abc"), rng.choice("abcd")) for i in range(400)]
    src = os.path.join(tmp_dir, "src")
    for i in range(8):
        mine = rows[50 * i : 50 * i + 50] + rng.sample(rows[: 50 * i + 1], min(20, 50 * i + 1))
        spark.createDataFrame(mine, schema).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(src)
    got = stream_scores(spark, stream, f"{tmp_dir}/snap", f"{tmp_dir}/ckpt", keys=["k"], once=["id"])
    want = M.compute_metrics(spark.createDataFrame(rows, schema), ["k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(glob.glob(f"{tmp_dir}/snap/epoch=*")) == 4
    # the state survives: a run over new files alone goes on from it, and repeats stay out
    spark.createDataFrame(rows[:30] + [("x", 1000, "a", "a")], schema).write.parquet(f"{src}/more")
    again = stream_scores(spark, stream, f"{tmp_dir}/snap", f"{tmp_dir}/ckpt", keys=["k"], once=["id"])
    want = M.compute_metrics(spark.createDataFrame(rows + [("x", 1000, "a", "a")], schema), ["k"])
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))
    later = sorted(glob.glob(f"{tmp_dir}/snap/epoch=*"))[4:]
    assert sum(spark.read.parquet(e).count() for e in later) == 1  # only (x, a, a) changed
