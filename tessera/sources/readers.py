"""Sources: mention records, papers, label vocabulary, generations, run
reports, loose reports, review sheets (S1-S9).

Reads are declarative (schema given, no inference) so Catalyst prunes
columns and pushes filters into the scan. JSON arrays and quoted CSV, which Spark reads
whole-file, are cut into records in parallel (``records``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import NOT_RELEVANT, REPORT_ROWS_END, REPORT_ROWS_START
from ..functions.text import strip
from ..operators.sampling import running_total
from ..session import stored
from .records import read_csv, read_json_array

MENTION_SCHEMA = "id bigint, text string, entity string, label string"
ANNOTATION = ("array<struct<id:bigint,label:string,start_offset:int,end_offset:int,entity:string,"
              "which_text:string,text:string>>")
PAPER_SCHEMA = f"title string, uid string, full_text string, annotations {ANNOTATION}"
GENERATION_SCHEMA = f"title string, doi string, annotations {ANNOTATION}, text string, pred string"
REVIEW_SCHEMA = ("title string, uid string, annotation string, prediction string, true string, "
                 "wrong string, rejected boolean")


def read_mentions(spark: SparkSession, path: str, exclude: Sequence[str] = (NOT_RELEVANT,),
                  multiline: bool = True) -> DataFrame:
    """Mention records (JSON arrays, or JSON lines with ``multiline=False``; both are
    read in splits), excluded labels dropped (exact, case-sensitive); records without a
    label are kept."""
    df = read_json_array(spark, path, MENTION_SCHEMA) if multiline else spark.read.schema(MENTION_SCHEMA).json(path)
    return df.where(F.col("label").isNull() | ~F.col("label").isin(list(exclude)))


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Papers with nested annotations from Parquet, JSON arrays ("json") or JSON lines
    ("jsonl"); ``uid`` is also exposed as ``doi`` as in the generation records."""
    reader = spark.read.schema(PAPER_SCHEMA)
    df = read_json_array(spark, path, PAPER_SCHEMA) if fmt == "json" else reader.parquet(path) if fmt == "parquet" else reader.json(path)
    return df.withColumn("doi", F.col("uid"))


def first_labels(vocab: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` labels of a vocabulary (label, id) by rank of id (all
    by default). A vocabulary is a small table, so one sort ranks it."""
    if n is None:
        return vocab
    return vocab.orderBy("id", "label").limit(n)


def read_label_vocab(spark: SparkSession, path: str, n_classes: int | None = None) -> DataFrame:
    """S3: ordered label vocabulary {label: {id}} -> (label, id), all labels or the
    first ``n_classes`` by id."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), "map<string,struct<id:int>>")
    v = raw.select(F.explode(m).alias("label", "s")).select("label", F.col("s.id").alias("id"))
    return first_labels(v, n_classes)


def read_generations(spark: SparkSession, *paths: str) -> DataFrame:
    """Generation dumps of several files, concatenated (no de-duplication)."""
    return spark.read.schema(GENERATION_SCHEMA).json(list(paths))


def report_text(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(report, part, block, mid, line): every line of the reports with its place.

    A report is a file, or a folder of part files (``part-NNNNN...``), whose number
    orders them. Files are read in splits: the split's first byte and the line's
    number in its scan task order the lines of a file. The lines are written
    once, so that all uses see the same numbers."""
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths))
    file = F.col("_metadata.file_path")
    part = F.regexp_extract(file, "/part-([0-9]+)[^/]*$", 1)
    report = F.when(part != "", F.regexp_extract(file, "^(.*)/[^/]*$", 1)).otherwise(file)
    lines = raw.select(report.alias("report"), F.coalesce(part.try_cast("long"), F.lit(0).cast("long")).alias("part"),
                       F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"),
                       F.col("value").alias("line"))
    return stored(lines, "report")


def _rows_after_mark(spark: SparkSession, paths: Sequence[str] | str, to_end: bool) -> DataFrame:
    """The lines after a report's row mark (and before the mark of the original
    texts, unless ``to_end``). A report without a row mark is an error."""
    lines = report_text(spark, paths).withColumn("at", F.struct("part", "block", "mid"))
    mark = lambda m: F.min(F.when(F.col("line") == m, F.col("at")))
    marks = lines.groupBy("report").agg(mark(REPORT_ROWS_START).alias("begin"), mark(REPORT_ROWS_END).alias("end"))
    begin = F.when(F.col("begin").isNotNull(), F.col("begin")).otherwise(
        F.raise_error(F.concat(F.lit("no row mark in "), F.col("report"))).cast("struct<part:bigint,block:bigint,mid:bigint>"))
    rows = lines.join(F.broadcast(marks), "report").where(F.col("at") > begin)
    if not to_end:
        rows = rows.where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    return rows.select(F.col("report").alias("file"), "part", "block", "mid", "line")


def read_report(spark: SparkSession, paths, cols: int = 3) -> DataFrame:
    """S5 (cols=3): (file, num, pred, true), values stripped and lower-cased;
    the third field keeps any further ', '.
    S6 (cols=4): (file, num, src, pred, true), src may hold ', '; stripped,
    not lower-cased. ``file`` is the report: a file or a folder of part files."""
    lines = _rows_after_mark(spark, paths, to_end=False).where(F.col("line") != "")
    if cols == 3:
        parts = F.split(F.col("line"), ", ", 3)
        return lines.select("file", strip(F.element_at(parts, 1)).cast("long").alias("num"),
                            F.lower(strip(F.element_at(parts, 2))).alias("pred"),
                            F.lower(strip(F.element_at(parts, 3))).alias("true"))
    if cols == 4:
        rx = "^(.*?), (.*), (.*), (.*)$"
        g = lambda i: strip(F.regexp_extract(F.col("line"), rx, i))
        return lines.select("file", g(1).cast("long").alias("num"), g(2).alias("src"),
                            g(3).alias("pred"), g(4).alias("true"))
    raise ValueError(cols)


def read_report_loose(spark: SparkSession, paths, n_fields: int = 3) -> DataFrame:
    """(file, pos, line, ok, [src], pred, true): a comma report with noise:
    ',,' collapsed, then split on ','. ``pos`` is the line's number after the row
    mark, counting every line, so two reports can be joined line by line. Rows with
    the wrong field count are kept with ``ok = false`` (quarantine) and null fields.
    Reads every line after the row mark."""
    lines = running_total(_rows_after_mark(spark, paths, to_end=True), F.lit(1), ["part", "block", "mid"], ["file"], "pos")
    parts = F.split(F.replace(F.col("line"), F.lit(",,"), F.lit(",")), ",")
    ok = F.size(parts) == n_fields
    names = ["src", "pred", "true"][-n_fields:]
    cols = [F.when(ok, strip(F.element_at(parts, i + 1))).alias(n) for i, n in enumerate(names)]
    return lines.where(F.col("line") != "").select("file", "pos", "line", ok.alias("ok"), *cols)


def read_host_index(spark: SparkSession, path: str) -> DataFrame:
    """(species, type, name, title, uid) from the lines of ``sinks.write_host_index``,
    read in splits: a line belongs to the last record opened in its split or, before
    any, in the splits before it (one row each)."""
    lines = report_text(spark, path).withColumn("body", F.regexp_replace("line", "^(\\[|\\]\\},|,)(?=\\{)", ""))
    tool = "struct<type:string,name:string,references:array<string>>"
    opens = F.startswith("body", F.lit('{"species":'))
    head = F.from_json(F.concat("body", F.lit("]}")), f"species string, tools array<{tool}>")
    rows = lines.where(F.startswith("body", F.lit("{"))).select("report", "part", "block", "mid", F.when(opens, head).alias("head"), F.when(~opens, F.from_json("body", tool)).alias("tool"))
    split = ["report", "part", "block"]
    ends = rows.where("head IS NOT NULL").groupBy(*split).agg(F.max_by("head.species", "mid").alias("ends"))
    before = Window.partitionBy("report").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.select(*split).distinct().join(ends, split, "left").select(*split, F.last("ends", True).over(before).alias("carried"))
    inside = Window.partitionBy(*split).orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumn("own", F.last("head.species", True).over(inside)).join(carried, split)
    t = F.coalesce("tool", F.element_at("head.tools", 1))
    named = named.select(F.coalesce("own", "carried").alias("species"), t.alias("t"))
    return named.select("species", "t.type", "t.name", F.element_at("t.references", 1).alias("title"), F.element_at("t.references", 2).alias("uid"))


def read_review(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Review rows (JSON-in-cell columns + rejected flag) from CSV (quoted cells may
    hold line breaks; read in splits) or Parquet; parse with ``curation.parse_review``."""
    if fmt == "csv":
        return read_csv(spark, path, REVIEW_SCHEMA)
    return spark.read.schema(REVIEW_SCHEMA).parquet(path)
