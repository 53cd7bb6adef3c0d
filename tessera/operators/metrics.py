"""Classification scores over (true, pred) pairs (E1-E15, K5 data side).

Every score is derived from one sparse confusion aggregate
``groupBy(keys, true, pred).count()``: the only pass over the big input, with
map-side partial aggregation, so hot labels or hot keys never gather raw rows
in one task. Everything after it runs on at most |keys| x |L|^2 rows.

Semantics follow scikit-learn's ``precision_recall_fscore_support``: the
label set is the union of observed true and predicted labels unless given,
an undefined ratio scores 0, and F1 = 2tp / (2tp + fp + fn).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import literal_table

ROUND = 6


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_counts(pairs: DataFrame, keys: Sequence[str] = (), true: str = "true",
                     pred: str = "pred") -> DataFrame:
    """Sparse confusion table (keys, true, pred, n)."""
    return (pairs.groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_counts(conf: DataFrame, keys: Sequence[str] = (),
                 labels: Sequence[str] | None = None) -> DataFrame:
    """Per-class tp / n_pred / support from a confusion table.

    With ``labels`` the classes are exactly that list (absent ones score 0)
    and counts of other labels are ignored, as for a restricted label list.
    """
    # one pass: every confusion cell credits its true label and its pred label
    n = F.col("n").cast("long")
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("true").alias("label"), n.alias("support"),
                 F.when(F.col("true") == F.col("pred"), n).otherwise(zero).alias("tp"), zero.alias("n_pred")),
        F.struct(F.col("pred").alias("label"), zero.alias("support"), zero.alias("tp"), n.alias("n_pred")))
    both = conf.select(*keys, F.inline(sides))
    if labels is not None:
        both = both.where(F.col("label").isin(list(labels)))
        if keys:
            key_rows = conf.select(*keys).distinct()
        else:
            key_rows = conf.sparkSession.range(1).select()
        grid = key_rows.crossJoin(  # |keys| x |labels|: labels is a fixed small list
            literal_table(conf.sparkSession, [(x,) for x in labels], "label string"))
        zeros = grid.select(*keys, "label", F.lit(0).cast("long").alias("support"),
                            F.lit(0).cast("long").alias("tp"),
                            F.lit(0).cast("long").alias("n_pred"))
        both = both.unionByName(zeros)
    return (both.groupBy(*keys, "label")
            .agg(F.sum("tp").cast("long").alias("tp"),
                 F.sum("n_pred").cast("long").alias("n_pred"),
                 F.sum("support").cast("long").alias("support")))


def per_class(pairs: DataFrame, keys: Sequence[str] = (), labels: Sequence[str] | None = None,
              true: str = "true", pred: str = "pred") -> DataFrame:
    """(keys, label, tp, fp, fn, support, precision, recall, f1)."""
    cc = class_counts(confusion_counts(pairs, keys, true, pred), keys, labels)
    return _class_scores(cc, keys)


def _class_scores(cc: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cc.select(
        *keys, "label", "tp",
        (F.col("n_pred") - F.col("tp")).alias("fp"),
        (F.col("support") - F.col("tp")).alias("fn"),
        "support", "n_pred",
        _ratio(F.col("tp"), F.col("n_pred")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("n_pred") + F.col("support")).alias("f1"),
    )


def scores_from_classes(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """E1+E3+E4+E5 from per-class rows: one row of ten scores per key."""
    tp, npred, sup = F.sum("tp"), F.sum("n_pred"), F.sum("support")
    agg = scored.groupBy(*keys).agg(
        sup.cast("long").alias("n"),
        tp.cast("long").alias("correct"),
        F.count(F.lit(1)).cast("long").alias("n_classes"),
        _ratio(tp, sup).alias("accuracy"),
        F.avg("precision").alias("macro_p"),
        F.avg("recall").alias("macro_r"),
        F.avg("f1").alias("macro_f"),
        _ratio(tp, npred).alias("micro_p"),
        _ratio(tp, sup).alias("micro_r"),
        _ratio(2 * tp, npred + sup).alias("micro_f"),
        _ratio(F.sum(F.col("precision") * F.col("support")), sup).alias("weighted_p"),
        _ratio(F.sum(F.col("recall") * F.col("support")), sup).alias("weighted_r"),
        _ratio(F.sum(F.col("f1") * F.col("support")), sup).alias("weighted_f"),
    )
    return agg


METRIC_NAMES = ["accuracy", "macro_p", "macro_r", "macro_f", "micro_p", "micro_r",
                "micro_f", "weighted_p", "weighted_r", "weighted_f"]


def compute_metrics(pairs: DataFrame, keys: Sequence[str] = (), true: str = "true",
                    pred: str = "pred", digits: int | None = ROUND) -> DataFrame:
    """Ten scores (plus n, correct, n_classes) per key group."""
    out = scores_from_classes(per_class(pairs, keys, None, true, pred), keys)
    if digits is not None:
        out = out.select(*keys, "n", "correct", "n_classes",
                         *[F.round(m, digits).alias(m) for m in METRIC_NAMES])
    return out


def accuracy(pairs: DataFrame, keys: Sequence[str] = (), true: str = "true",
             pred: str = "pred") -> DataFrame:
    """E1."""
    return pairs.groupBy(*keys).agg(
        F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))


def restricted_metrics(pairs: DataFrame, labels: Sequence[str], keys: Sequence[str] = (),
                       true: str = "true", pred: str = "pred",
                       digits: int | None = ROUND) -> DataFrame:
    """Per-type rows plus 'micro' and 'macro' rows over a given label list.

    Values are x100 as in the printed type table; support is per type and the
    total on the summary rows.
    """
    cc = class_counts(confusion_counts(pairs, keys, true, pred), keys, labels)
    sc = _class_scores(cc, keys)
    per_type = sc.select(*keys, F.col("label").alias("type"),
                         (F.col("precision") * 100).alias("precision"),
                         (F.col("recall") * 100).alias("recall"),
                         (F.col("f1") * 100).alias("f1"), "support")
    tp, npred, sup = F.sum("tp"), F.sum("n_pred"), F.sum("support")
    micro_p, micro_r = _ratio(tp, npred), _ratio(tp, sup)
    micro = sc.groupBy(*keys).agg(
        F.lit("micro").alias("type"),
        (micro_p * 100).alias("precision"), (micro_r * 100).alias("recall"),
        (_ratio(2 * micro_p * micro_r, micro_p + micro_r) * 100).alias("f1"),
        sup.cast("long").alias("support"))
    macro = sc.groupBy(*keys).agg(
        F.lit("macro").alias("type"),
        (F.avg("precision") * 100).alias("precision"), (F.avg("recall") * 100).alias("recall"),
        (F.avg("f1") * 100).alias("f1"), sup.cast("long").alias("support"))
    out = per_type.unionByName(micro).unionByName(macro)
    if digits is not None:
        out = out.select(*keys, "type", *[F.round(c, digits).alias(c) for c in
                                          ("precision", "recall", "f1")], "support")
    return out


def format_type_report(report: DataFrame) -> DataFrame:
    """Printed form of E7: fixed-width text lines, values with two decimals."""
    return report.select(
        "type",
        F.format_string("%20s %12s %12s %12s %12s", F.col("type"),
                        F.format_string("%.2f", "precision"), F.format_string("%.2f", "recall"),
                        F.format_string("%.2f", "f1"), F.col("support").cast("string"))
        .alias("line"))


def confusion(pairs: DataFrame, labels: Sequence[str], keys: Sequence[str] = (),
              true: str = "true", pred: str = "pred", transpose: bool = False) -> DataFrame:
    """Long confusion over a fixed label list, zero cells included.

    Rows whose prediction (or true label) is outside the list are dropped.
    ``transpose`` swaps the axes (predictions on rows).
    """
    if transpose:
        true, pred = pred, true
    conf = (pairs.where(F.col(pred).isin(list(labels)) & F.col(true).isin(list(labels)))
            .groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))
    spark = pairs.sparkSession
    lab = literal_table(spark, [(x, i) for i, x in enumerate(labels)], "label string, idx int")
    grid = lab.select(F.col("label").alias("true"), F.col("idx").alias("true_idx")).crossJoin(
        lab.select(F.col("label").alias("pred"), F.col("idx").alias("pred_idx")))
    if keys:  # a key whose answers are all outside the list still has its zeros
        grid = pairs.select(*keys).distinct().crossJoin(grid)
    # grid is |keys| x |labels|^2 rows, independent of the input size.
    out = (grid.join(conf, [*keys, "true", "pred"], "left")
           .select(*keys, "true", "pred", "true_idx", "pred_idx",
                   F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))
    return out


def confusion_wide(pairs: DataFrame, labels: Sequence[str], keys: Sequence[str] = (),
                   true: str = "true", pred: str = "pred", transpose: bool = False) -> DataFrame:
    """K5: one row per true label, one column per predicted label."""
    long = confusion(pairs, labels, keys, true, pred, transpose)
    return (long.groupBy(*keys, "true", "true_idx").pivot("pred", list(labels))
            .agg(F.sum("n")).orderBy(*keys, "true_idx").drop("true_idx"))


def label_accuracy(pairs: DataFrame, true: str = "true", pred: str = "pred",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Per label of the first list, matches / total, labels with a match only."""
    agg = pairs.groupBy(*keys, F.col(pred).alias("label")).agg(
        F.sum((F.col(pred) == F.col(true)).cast("long")).alias("matches"),
        F.count(F.lit(1)).alias("total"))
    return (agg.where(F.col("matches") > 0)
            .select(*keys, "label", "matches", "total",
                    F.round(F.col("matches") / F.col("total"), 4).alias("accuracy"))
            .orderBy(F.desc("matches"), "label"))


def filtered_metrics(pairs: DataFrame, ignore: str | None = None, positive: str | None = None,
                     keys: Sequence[str] = (), true: str = "true", pred: str = "pred",
                     digits: int | None = ROUND) -> DataFrame:
    """Drop rows whose true label is ``ignore`` and score micro over the rest;
    with ``positive`` also score that single class (binary average)."""
    kept = pairs.where(F.col(true) != F.lit(ignore)) if ignore is not None else pairs
    sc = per_class(kept, keys, None, true, pred)
    tp, npred, sup = F.sum("tp"), F.sum("n_pred"), F.sum("support")
    aggs = [sup.cast("long").alias("n"), _ratio(tp, npred).alias("micro_p"),
            _ratio(tp, sup).alias("micro_r"), _ratio(2 * tp, npred + sup).alias("micro_f")]
    if positive is not None:
        pos = F.col("label") == F.lit(positive)
        aggs += [F.coalesce(F.max(F.when(pos, F.col("precision"))), F.lit(0.0)).alias("pos_p"),
                 F.coalesce(F.max(F.when(pos, F.col("recall"))), F.lit(0.0)).alias("pos_r"),
                 F.coalesce(F.max(F.when(pos, F.col("f1"))), F.lit(0.0)).alias("pos_f")]
    out = sc.groupBy(*keys).agg(*aggs)
    if digits is not None:
        out = out.select(*[F.round(c, digits).alias(c) if c not in ("n", *keys) else F.col(c)
                           for c in out.columns])
    return out


def agreement(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Agreement of two boolean correctness columns joined on position."""
    j = a.select(*on, F.col("ok").alias("a_ok")).join(
        b.select(*on, F.col("ok").alias("b_ok")), list(on), "inner")
    same = (F.col("a_ok") == F.col("b_ok")).cast("long")
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum(same).cast("long").alias("agree"),
                 F.round(F.avg(same.cast("double")), ROUND).alias("rate"))


def conditional_agreement(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Agreement restricted to rows where the first task was right."""
    return agreement(a.where(F.col("ok")), b, on)


def yes_no_confusion(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """yes/no confusion of E12 (true = first task, pred = second)."""
    j = a.where(F.col("ok")).select(*on, F.col("ok").alias("a_ok")).join(
        b.select(*on, F.col("ok").alias("b_ok")), list(on), "inner")
    yn = lambda c: F.when(F.col(c), F.lit("yes")).otherwise(F.lit("no"))
    pairs = j.select(yn("a_ok").alias("true"), yn("b_ok").alias("pred"))
    return confusion(pairs, ["yes", "no"])

