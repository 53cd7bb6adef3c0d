"""Exact dedup by distributed MSD radix partitioning.

Texts (null counts as empty) are compared as UTF-8 bytes after lower-casing A-Z.
Level k takes the next ``widths[k]`` bytes as its digit: rows are counted by
(group, digit) with partial aggregation, a digit that one row has is a single
text, a digit shorter than its width is where texts have ended and are equal,
and all others become groups of the next level, which sees only their rest. The
digits grow, so a few levels reach the end of very long texts, and each byte of
a text is compared once, and only while a group still holds two rows. Equality
is equality of all bytes; the SHA-256 that is returned takes no part in it.

A group holds one number and one row in the shuffles that count; rows meet their
group's number by a join whose large partitions Spark splits, and each level is
written to the shared folder.

Defined cases: rows without doc_id count as the smallest; of rows that share the
largest doc_id and their text, one stays; rows with one doc_id and different
texts are different rows; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Digit widths in bytes by level; the last one holds for all further levels.
WIDTHS = (64, 2048, 65536, 1 << 20)


def _normal(text: Column) -> Column:
    """The text as bytes with A-Z lower-cased. Where all characters are ASCII,
    ``lower`` does just that; elsewhere it would change other letters too."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase)).cast("binary")


def _level(rows: DataFrame, counted: DataFrame, level: int, width: int) -> DataFrame:
    """``rows`` (doc_id, text_sha256, part, body) after a level: ``done`` rows have
    their class, the others their next group in ``part`` and their rest in ``body``."""
    groups = counted.groupBy("part", "digit").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).where("n > 1")
    groups = written(groups.withColumn("next", F.monotonically_increasing_id()), f"digits{level}")
    rows = rows.withColumn("digit", F.substring("body", 1, width)).withColumn("rest", F.expr(f"substring(body, {width + 1})"))
    # groups grow with the data: always a sorted join, never a broadcast one
    met = rows.join(groups.hint("merge"), ["part", "digit"], "left")
    done = F.col("n").isNull() | (F.octet_length("digit") < width)
    return written(
        met.select(
            "doc_id", "text_sha256", F.lit(level).alias("level"), F.col("next").alias("part"), done.alias("done"),
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
            F.when(~done, F.col("rest")).alias("body"),
        ),
        f"level{level}",
    )


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each row of
    ``docs``; keep_id is the largest doc_id of the rows with an equal text."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("part"), _normal(text).alias("body"))
    # a text's first bytes are among the first bytes of as many characters
    heads = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("part"), F.substring(_normal(F.substring(text, 1, widths[0])), 1, widths[0]).alias("digit"))
    levels = [_level(rows.withColumn("text_sha256", F.sha2("body", 256)), heads, 0, widths[0])]
    while not (active := levels[-1].where("not done")).isEmpty():
        k = len(levels)
        width = widths[min(k, len(widths) - 1)]
        active = active.select("doc_id", "text_sha256", "part", "body")
        levels.append(_level(active, active.select("doc_id", "part", F.substring("body", 1, width).alias("digit")), k, width))
    found = reduce(DataFrame.unionByName, [x.where("done").drop("body") for x in levels])
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if found.where(top & (F.col("group_size") > 1)).groupBy("level", "part").count().where("count > 1").isEmpty():
        return found.withColumn("kept", top).select(columns)
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "tied")
    stays = found.where(top & (F.col("group_size") > 1)).groupBy("level", "part").agg(F.min("row").alias("stays"))
    single = F.col("group_size") == 1
    return found.join(stays, ["level", "part"], "left").withColumn("kept", single | F.coalesce(F.col("row") == F.col("stays"), F.lit(False))).select(columns)
