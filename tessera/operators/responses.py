"""Closed-vocabulary response cleaning.

All row-local column expressions: they fuse into the scan's whole-stage
codegen and never shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ALIGN_PAD
from ..functions.text import normalise, str_array, strip


def vocab_column(vocab, lower: bool = True) -> Column:
    """A vocabulary as an array column: a Python list becomes a literal, a
    column name / Column is used as is (e.g. from a one-row cross join)."""
    if isinstance(vocab, (list, tuple)):
        return str_array([v.lower() for v in vocab] if lower else list(vocab))
    col = F.col(vocab) if isinstance(vocab, str) else vocab
    return F.transform(col, lambda x: F.lower(x)) if lower else col


def vocab_hits(response: Column, entity: Column, vocab) -> Column:
    """Vocabulary labels found as substrings of the response after every copy
    of the entity is deleted (both lower case), in vocabulary order."""
    resp = F.replace(F.lower(response), F.lower(entity), F.lit(""))
    return F.filter(vocab_column(vocab), lambda lab: F.contains(resp, lab))


def choose_label(hits: Column, gold: Column, tie_break: str = "gold") -> Column:
    """R1 decision: one hit wins; several hits resolve by ``tie_break``:
    'gold' (the gold label if among them), 'first', or 'none'."""
    single = F.size(hits) == 1
    multi = F.size(hits) > 1
    out = F.when(single, F.element_at(hits, 1))
    if tie_break == "gold":
        out = out.when(multi & F.array_contains(hits, gold), gold)
    elif tie_break == "first":
        out = out.when(multi, F.element_at(hits, 1))
    elif tie_break != "none":
        raise ValueError(f"unknown tie_break {tie_break!r}")
    return out.otherwise(F.lit("None"))


def clean_response(df: DataFrame, vocab, response: str = "response", entity: str = "entity",
                   true: str = "label", tie_break: str = "gold", lower_gold: bool = True) -> DataFrame:
    """Add ``hits`` and ``cleaned`` (a vocabulary label or 'None').

    ``lower_gold=False`` reproduces the path where the gold label keeps its
    case, so mixed-case labels never win a tie (quirk Q2)."""
    gold = F.lower(F.col(true)) if lower_gold else F.col(true)
    hits = vocab_hits(F.col(response), F.col(entity), vocab)
    return df.withColumn("hits", hits).withColumn("cleaned", choose_label(F.col("hits"), gold, tie_break))


def score_pairs(df: DataFrame, vocab, response: str = "response", entity: str = "entity",
                true: str = "label", keys: Sequence[str] = ("id",), tie_break: str = "gold",
                lower_gold: bool = True, src: str | None = None) -> DataFrame:
    """R2: strip, clean and lower-case into (keys, [src], pred, true)."""
    stripped = df.withColumn("_resp", strip(F.col(response))).withColumn("_true", strip(F.col(true)))
    cleaned = clean_response(stripped, vocab, "_resp", entity, "_true", tie_break, lower_gold)
    cols = [*keys] + ([F.col(src).alias("src")] if src else [])
    return cleaned.select(*cols, F.lower("cleaned").alias("pred"), F.lower("_true").alias("true"))


def align_lists(pred: Column, true: Column, cap: int | None = None, pad: str = ALIGN_PAD):
    """Common items first, then the rest (each part sorted); predictions are
    padded with ``pad`` up to the gold length. ``cap`` (``fixed.ALIGN_CAP`` for the
    original's lists of ten) cuts both lists; by default nothing is cut."""
    common = F.array_sort(F.array_intersect(pred, true))
    new_pred = F.concat(common, F.array_sort(F.array_except(pred, common)))
    new_true = F.concat(common, F.array_sort(F.array_except(true, common)))
    if cap is not None:
        new_pred, new_true = F.slice(new_pred, 1, cap), F.slice(new_true, 1, cap)
    padded = F.concat(new_pred, F.array_repeat(F.lit(pad), F.greatest(F.size(new_true) - F.size(new_pred), F.lit(0))))
    return padded, new_true


def strip_prompt(text: Column, prompt: Column) -> Column:
    """Cut the echoed prompt by its length (no equality check), then strip."""
    return strip(text.substr(F.length(prompt) + 1, F.length(text) + 1))


def split_in_vocab(pairs: DataFrame, labels, pred: str = "pred"):
    """P10: (kept, out-of-vocabulary) rows; only the prediction is tested
    against the lower-cased label list."""
    inside = F.array_contains(vocab_column(labels), F.col(pred))
    return pairs.where(inside), pairs.where(~inside | F.col(pred).isNull())


__all__ = ["vocab_column", "vocab_hits", "choose_label", "clean_response", "score_pairs",
           "align_lists", "strip_prompt", "split_in_vocab", "normalise"]
