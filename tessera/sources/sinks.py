"""Sinks: generation dumps, extraction table, host index, run reports,
confusion tables, leaderboard, pair lists, metric log, run layout (K1-K9).

Every sink is a distributed write; ordered text outputs use a global sort
(range partitioning), so part files come out in order without funnelling
rows through one task.
"""

from __future__ import annotations

import pprint
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import (REPORT_CONFIG_BLOCKS, REPORT_DATASET_LINES, REPORT_METRICS_END, REPORT_ROWS_END,
                               REPORT_ROWS_START, REPORT_RULE)
from ..functions.text import literal_table
from ..operators.metrics import METRIC_NAMES
from ..session import stored


def write_generations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: generations with nested annotations and ``pred`` as JSON lines."""
    df.write.mode(mode).json(path)


def write_json_arrays(df: DataFrame, path: str, mode: str = "overwrite", line_sep: str = "\n") -> None:
    """Rows as JSON arrays of objects, one array in each part file (the form of S1 and S2).
    Rows stream through; ``line_sep`` stands between the records."""
    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows:
                marks = pa.array(["," if begun else "[", ","]).take(pa.array(np.minimum(np.arange(batch.num_rows), 1)))
                value = batch.column("value")
                begun = True
                yield pa.record_batch([pc.binary_join_element_wise(marks.cast(value.type), value, pa.scalar("", value.type))], names=["value"])
        if begun:
            yield pa.record_batch([pa.array(["]"])], names=["value"])

    lines = df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(bracketed, "value string")
    lines.write.mode(mode).option("lineSep", line_sep).text(path)


def sorted_json_map(m: Column) -> Column:
    """JSON text of a map with keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def write_extraction_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: Title, UID, Annotation, Model Prediction, True as CSV with header."""
    (df.select(F.col("title").alias("Title"), F.col("uid").alias("UID"), F.col("annotation").alias("Annotation"),
               F.col("prediction").alias("Model Prediction"), F.col("true").alias("True"))
     .write.mode(mode).option("header", True).option("escape", '"').csv(path))


def host_index_lines(rows: DataFrame) -> DataFrame:
    """K3 as text: (last, species, type, name, title, uid, row, value). In that order the
    values are the lines of one JSON array ``[{species, tools: [{type, name, references}]}]``
    with one tool a line, so neither a species nor a tool is ever held in a row.

    The first row of a species opens its record (and closes the one before); which row
    that is comes from a minimum by species, joined back on the row's number."""
    rows = stored(rows.where(F.col("species").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "host-rows")
    order = ["type", "name", "title", "uid", "row"]
    first = rows.groupBy("species").agg(F.min(F.struct(*order)).alias("f"))
    opening = first.select(F.col("f.row").alias("row"), F.lit(True).alias("opens"))
    least = rows.agg(F.min("species").alias("least"))  # one row
    tool = F.to_json(F.struct("type", "name", F.array("title", "uid").alias("references")))
    species = F.to_json(F.struct("species"))
    opened = F.concat(F.when(F.col("species") == F.col("least"), "[").otherwise("]},"), species.substr(F.lit(1), F.length(species) - 1), F.lit(',"tools":['), tool)
    lines = rows.join(opening, "row", "left").crossJoin(F.broadcast(least))
    lines = lines.select(F.lit(0).alias("last"), "species", *order, F.when(F.col("opens"), opened).otherwise(F.concat(F.lit(","), tool)).alias("value"))
    end = least.select(F.lit(1).alias("last"), *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ["species", *order]], F.when(F.col("least").isNull(), "[]").otherwise("]}]").alias("value"))
    return lines.unionByName(end)


def write_host_index(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: the host index rows (C8) as one JSON array over ordered part files. The sort
    cuts its ranges at species, tool and reference, so a species of any size is spread
    over tasks, which stream their lines."""
    lines = host_index_lines(rows)
    lines.orderBy("last", "species", "type", "name", "title", "uid", "row").select("value").write.mode(mode).text(path)


def _fmt4(c) -> Column:
    return F.format_string("%.4f", c)


def report_lines(spark: SparkSession, rows: DataFrame, metrics: DataFrame, info: Mapping[str, object],
                 task_prompt: str = "", originals: DataFrame | None = None, with_src: bool = False) -> DataFrame:
    """K4: report as ordered lines (section, num, sub, line).

    rows: (num, [src], pred, true); ``src`` may be an array, printed as
    '(a, b)' sorted. metrics: one row of the ten scores. originals:
    (num, entity, pred, true) raw texts."""
    head = [f">> N-shots: {info.get('n_shots', 0)}",
            f">> Number of processes: {info.get('num_processes', 1)}",
            f">> Batch size per process: {info.get('batch_size', 1)}, Total batch size: "
            f"{int(info.get('batch_size', 1)) * int(info.get('num_processes', 1))}",
            f">> Test sample size: {info.get('test_sample_size', -1)}"]
    kind = REPORT_DATASET_LINES.get(str(info.get("data_name")))
    if kind is not None:
        head.append(kind.format(info.get("kegg_data_type", "") if info.get("data_name") == "kegg" else info.get("num_classes", 14)))
    head.append(f">> Execution time: {info.get('exec_time', '')}")
    for title, key in REPORT_CONFIG_BLOCKS:
        if info.get(key):
            head += [title, *pprint.pformat(info[key]).split("\n")]
    head.append(">> Task prompt:")
    head += task_prompt.split("\n") + [REPORT_RULE]
    header = literal_table(spark, [(0, i, 0, s) for i, s in enumerate(head)],
                           "section int, num long, sub int, line string")
    base = len(head)
    m = metrics.select(
        F.concat(F.lit(">>             Accuracy: "), _fmt4("accuracy")).alias("l0"),
        F.concat(F.lit(">> (macro)    Precision: "), _fmt4("macro_p"), F.lit(", Recall: "), _fmt4("macro_r"),
                 F.lit(", F1: "), _fmt4("macro_f")).alias("l1"),
        F.concat(F.lit(">> (micro)    Precision: "), _fmt4("micro_p"), F.lit(", Recall: "), _fmt4("micro_r"),
                 F.lit(", F1: "), _fmt4("micro_f")).alias("l2"),
        F.concat(F.lit(">> (weighted) Precision: "), _fmt4("weighted_p"), F.lit(", Recall: "),
                 _fmt4("weighted_r"), F.lit(", F1: "), _fmt4("weighted_f")).alias("l3"),
        F.lit(REPORT_METRICS_END).alias("l4"),
        F.lit("Num, Src, Pred, True:" if with_src else "Num, Pred, True:").alias("l5"),
        F.lit(REPORT_ROWS_START).alias("l6"))
    mlines = m.select(F.posexplode(F.array(*[f"l{i}" for i in range(7)])).alias("i", "line")).select(
        F.lit(0).alias("section"), (F.col("i") + base).cast("long").alias("num"), F.lit(0).alias("sub"), "line")
    if with_src:
        src = F.col("src")
        if rows.schema["src"].dataType.typeName() == "array":
            src = F.concat(F.lit("("), F.array_join(F.array_sort("src"), ", "), F.lit(")"))
        body = F.concat_ws(", ", F.col("num").cast("string"), src, F.col("pred"), F.col("true"))
    else:
        body = F.concat_ws(", ", F.col("num").cast("string"), F.col("pred"), F.col("true"))
    data = rows.select(F.lit(1).alias("section"), F.col("num").cast("long"), F.lit(0).alias("sub"), body.alias("line"))
    out = header.unionByName(mlines).unionByName(data)
    if originals is not None:
        marks = literal_table(spark, [(2, 0, 0, REPORT_ROWS_END), (2, 0, 1, "<< Original texts >>")],
                              "section int, num long, sub int, line string")
        o = originals.select(F.col("num").cast("long"), F.explode(F.array(
            F.struct(F.lit(0).alias("sub"), F.concat(F.lit(">> No: "), F.col("num").cast("string")).alias("line")),
            F.struct(F.lit(1).alias("sub"), F.concat(F.lit(">> Entity: "), F.col("entity")).alias("line")),
            F.struct(F.lit(2).alias("sub"), F.concat(F.lit(">> Pred: "), F.col("pred")).alias("line")),
            F.struct(F.lit(3).alias("sub"), F.concat(F.lit(">> True: "), F.col("true")).alias("line")))).alias("x"))
        o = o.select(F.lit(3).alias("section"), "num", F.col("x.sub").alias("sub"), F.col("x.line").alias("line"))
        out = out.unionByName(marks).unionByName(o)
    return out


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4 write: globally sorted text; part files are in report order."""
    lines.orderBy("section", "num", "sub").select("line").write.mode(mode).text(path)


def write_reports(lines: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """K4 write of many reports in one sort: a folder ``by=value`` for each, whose part
    files are in report order."""
    order = [c for c in ("section", "num", "sub") if c in lines.columns]
    lines.orderBy(by, *order).select(by, "line").write.mode(mode).partitionBy(by).text(path)


def confusion_tables(long: DataFrame, labels: Sequence[str]):
    """K5: (long, wide) confusion tables from E8's long form."""
    wide = long.groupBy("true", "true_idx").pivot("pred", list(labels)).agg(F.sum("n")).orderBy("true_idx")
    return long, wide.drop("true_idx")


def write_confusion(long: DataFrame, labels: Sequence[str], path: str, mode: str = "overwrite") -> None:
    lg, wide = confusion_tables(long, labels)
    lg.write.mode(mode).parquet(f"{path}/long")
    wide.write.mode(mode).parquet(f"{path}/wide")


def leaderboard_json(board: DataFrame) -> DataFrame:
    """K6: one JSON object {model: {metric: value}} (4 decimals); the fold
    is over one small row per model."""
    entry = F.struct(F.col("model"), F.struct(*[F.round(c, 4).alias(c) for c in METRIC_NAMES]))
    return board.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def write_leaderboard(board: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K6 write: the one JSON object as a text file."""
    leaderboard_json(board).coalesce(1).write.mode(mode).text(path)


def write_pairs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K7: 'src, pred' lines, sorted by source."""
    df.orderBy("src").select(F.concat_ws(", ", "src", "pred").alias("value")).write.mode(mode).text(path)


def append_metric_log(df: DataFrame, path: str, commit: Sequence[str] = ("run", "epoch")) -> None:
    """K8: add per-epoch validation scores (run, epoch, step, micro_f1, macro_f1, ...) to a
    log. A (run, epoch) is a folder, and an append replaces the folders that it brings: a
    driver that appends an epoch again after a failure, also half of one, leaves it once."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*commit).parquet(path))


def read_metric_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's rows in the given schema (the commit columns included)."""
    return spark.read.schema(schema).parquet(path)


def with_run_columns(df: DataFrame, model: Column, model_type: Column, dataset: str, task: str,
                     run_ts: str) -> DataFrame:
    """K9: add model / variant / dataset / task / run_ts; variant is the last
    '/' segment of the model type (the whole id when it has no '/')."""
    keep = [c for c in df.columns if c not in ("model", "variant", "dataset", "task", "run_ts")]
    return df.select(*keep, model.alias("model"), F.substring_index(model_type, "/", -1).alias("variant"),
                     F.lit(dataset).alias("dataset"), F.lit(task).alias("task"),
                     F.lit(run_ts).cast("timestamp").alias("run_ts"))


def write_run_layout(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K9: results by model / variant / dataset / task / run time. Overwriting replaces
    the runs that ``df`` brings and leaves the others."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("model", "variant", "dataset", "task", "run_ts").parquet(path))
