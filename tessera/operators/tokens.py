"""Token sequences: tokenise, pad per batch, mask, pack.

The default tokenizer is JVM-side (whitespace split, md5-derived ids) so the
hot path stays in codegen; a Python tokenizer can be plugged in as an Arrow
batch UDF. Batches and offsets are worked out on (id, length) alone. Packing cuts
each example at sequence bounds and regroups the pieces: a sequence gathers at
most ``seq_len`` tokens in as many rows as examples meet in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixed import LOSS_IGNORE_ID, PAD_ID
from .sampling import running_total

TOKEN_SPLIT = "[ \\n]+"
EOS_ID = 1


def hash_token_ids(text: Column) -> Column:
    """Whitespace tokens -> 60-bit ids (first 15 md5 hex digits + 2; 0 = pad, 1 = eos)."""
    toks = F.filter(F.split(text, TOKEN_SPLIT), lambda t: t != "")
    return F.transform(toks, lambda t: (F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long") + 2))


def python_tokenizer(fn: Callable[[list[str]], list[list[int]]]):
    """Wrap a batch tokenizer ``list[str] -> list[list[int]]`` as a pandas UDF."""
    import pandas as pd

    @F.pandas_udf("array<long>")
    def _tok(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s.fillna("").tolist()))

    return _tok


def tokenize(df: DataFrame, text: str, tokenizer=None, name: str = "ids") -> DataFrame:
    ids = hash_token_ids(F.col(text)) if tokenizer is None else tokenizer(F.col(text))
    return df.withColumn(name, ids)


def batch_lengths(lengths: DataFrame, batch: str, n: str = "n", name: str = "longest") -> DataFrame:
    """The longest ``n`` of each batch. Batches are bounded, so the window is too."""
    return lengths.withColumn(name, F.max(n).over(Window.partitionBy(batch)))


def pad(df: DataFrame, ids: str, longest: str, side: str = "left", pad_id: int = PAD_ID) -> DataFrame:
    """Pad every sequence to ``longest``; adds ``padded`` and ``attention`` (0/1)."""
    n_pad = F.col(longest) - F.size(ids)
    pads = F.array_repeat(F.lit(pad_id).cast("long"), n_pad.cast("int"))
    ones = F.array_repeat(F.lit(1), F.size(ids))
    zeros = F.array_repeat(F.lit(0), n_pad.cast("int"))
    if side == "left":
        return df.withColumn("padded", F.concat(pads, F.col(ids))).withColumn("attention", F.concat(zeros, ones))
    if side == "right":
        return df.withColumn("padded", F.concat(F.col(ids), pads)).withColumn("attention", F.concat(ones, zeros))
    raise ValueError(side)


def tokenize_pad(df: DataFrame, ids: str, batch: str, side: str = "left", pad_id: int = PAD_ID) -> DataFrame:
    """T1 on rows that have their batch: ``batch_lengths`` and ``pad``."""
    return pad(batch_lengths(df.withColumn("_n", F.size(ids)), batch, "_n", "_max"), ids, "_max", side, pad_id).drop("_n", "_max")


def mask_labels(col: Column, pad_id: int = PAD_ID) -> Column:
    """Pad positions in labels become -100 (ignored by the loss)."""
    return F.transform(col, lambda x: F.when(x == pad_id, F.lit(LOSS_IGNORE_ID).cast("long")).otherwise(x))


def pack_sequences(df: DataFrame, ids: str, order_by: Sequence[str], seq_len: int, eos: int = EOS_ID,
                   group: Sequence[str] = (), labels: str | None = None, length: Column | None = None) -> DataFrame:
    """Append eos to every example, concatenate in ``order_by`` order
    within ``group``, cut into ``seq_len`` pieces and drop each group's short
    tail. Returns (group, seq, input_ids, labels). ``length`` is the length of
    ``ids`` where a cheaper expression than its size gives it."""
    end = F.array(F.lit(eos).cast("long"))
    n = (F.size(ids) if length is None else length).cast("long") + 1
    ex = running_total(df, n, order_by, group, "_end")
    ex = ex.select(*group, F.concat(F.col(ids), end).alias("_i"), F.concat(F.col(labels or ids), end).alias("_l"),
                   (F.col("_end") - n).alias("_s"), "_end")
    # an example that ends in sequence k has a piece in each sequence from its first to k
    seqs = F.sequence(F.floor(F.col("_s") / seq_len), F.floor((F.col("_end") - 1) / seq_len))
    ex = ex.withColumn("seq", F.explode(seqs))
    at = F.greatest(F.col("_s"), F.col("seq") * seq_len)
    n_piece = F.least(F.col("_end"), (F.col("seq") + 1) * seq_len) - at
    cut = lambda c: F.slice(c, (at - F.col("_s") + 1).cast("int"), n_piece.cast("int"))
    pieces = ex.select(*group, F.col("seq").cast("long").alias("seq"), F.struct(at.alias("at"), cut("_i").alias("i"), cut("_l").alias("l")).alias("piece"))
    rows = pieces.groupBy(*group, "seq").agg(F.sort_array(F.collect_list("piece")).alias("_t"))
    flat = lambda f: F.flatten(F.transform("_t", lambda p: p[f]))
    return rows.select(*group, "seq", flat("i").alias("input_ids"), flat("l").alias("labels")).where(F.size("input_ids") == seq_len)
