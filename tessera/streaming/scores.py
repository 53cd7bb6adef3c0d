"""Running score over a stream of (true, pred) pairs (ST1).

Structured Streaming keeps the sparse confusion table (at most |L|^2 rows
per key) as state; every micro-batch writes the counts that it changed, and the ten
scores are computed from each count's latest value. A source may deliver a response
again: with ``once``, the ids seen are keyed state too (on disk, in the RocksDB store,
as it grows with the ids), and each id counts once, however late it comes again. No
event time exists in this data, so there is no watermark. The checkpoint lives in the
shared checkpoint directory, so a restarted query resumes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.responses import score_pairs


def running_confusion(stream: DataFrame, keys: Sequence[str] = (), true: str = "true", pred: str = "pred") -> DataFrame:
    return stream.groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def metrics_from_confusion(conf: DataFrame, keys: Sequence[str] = (), digits: int | None = M.ROUND) -> DataFrame:
    """E6 from a (keys, true, pred, n) confusion table."""
    out = M.scores_from_classes(M._class_scores(M.class_counts(conf, keys), keys), keys)
    if digits is not None:
        out = out.select(*keys, "n", "correct", "n_classes", *[F.round(m, digits).alias(m) for m in M.METRIC_NAMES])
    return out


def cleaned_pairs(stream: DataFrame, vocab: Sequence[str], keys: Sequence[str] = (), **options) -> DataFrame:
    """R2 on a stream of responses (keys, entity, label, response): each micro-batch
    is stripped and cleaned to (keys, pred, true) before it is counted."""
    return score_pairs(stream, list(vocab), keys=list(keys), **options)


def latest_counts(changes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, true, pred, n): the value of the last epoch that changed a count."""
    return changes.groupBy(*keys, "true", "pred").agg(F.max_by("n", "epoch").alias("n"))


def stream_scores(spark: SparkSession, pairs: DataFrame, snapshot_dir: str, checkpoint_dir: str,
                  keys: Sequence[str] = (), once: Sequence[str] = ()) -> DataFrame:
    """Run the stream of pairs over all files available now, then return the scores.
    Rows with the same ``once`` columns count as one (the first delivery).

    Every epoch has a folder of its own with the counts that changed, so a reader never
    meets one that is being replaced, and an epoch that runs again after a failure
    writes the same rows to the same place."""
    conf = running_confusion(pairs.dropDuplicates([*keys, *once]) if once else pairs, keys)

    def write_changes(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{snapshot_dir}/epoch={epoch_id:08d}")

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    if once:
        spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (conf.writeStream.outputMode("update").foreachBatch(write_changes)
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    finally:
        if once:
            spark.conf.set(store, before) if before else spark.conf.unset(store)
    q.awaitTermination()
    return metrics_from_confusion(latest_counts(spark.read.parquet(snapshot_dir), keys), keys)
