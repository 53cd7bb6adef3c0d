"""Cross-model set algebra over tagged result rows (X1-X9, K7 data side).

Input rows: (keys..., model, model_rank, num, src, pred, true). All set
operations are grouped aggregations (count / count-distinct / max_by) with
partial aggregation, never per-model driver loops or list intersections.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import metrics as M


def tag_union(rows: DataFrame, models: Mapping[str, str], file: str = "file") -> DataFrame:
    """Report rows (of ``read_report`` over all reports) with ``model`` and
    ``model_rank`` from a mapping of model to report path, in its order. A report
    that no path ends is an error."""
    name, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (model, path) in enumerate(models.items()):
        mine = F.col(file).endswith(path.rstrip("/"))
        name, rank = F.when(mine, F.lit(model)).otherwise(name), F.when(mine, F.lit(i)).otherwise(rank)
    known = F.coalesce(name, F.raise_error(F.concat(F.lit("no model for report "), F.col(file))).cast("string"))
    return rows.select("*", known.alias("model"), rank.alias("model_rank")).drop(file)


def source_groups(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per source: row count, distinct predictions, one prediction, and the
    first-seen true value (lowest model rank, then line number)."""
    return df.groupBy(*keys, "src").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("pred").alias("n_preds"),
        F.min("pred").alias("pred"),
        F.min_by("true", F.struct("model_rank", "num")).alias("true"))


def complete_items(df: DataFrame, n_models=None, keys: Sequence[str] = ()) -> DataFrame:
    """Sources with exactly ``n_models`` rows (a duplicate disqualifies).
    Without ``n_models`` the number of distinct models in ``df`` is used (a
    one-row aggregate joined to the per-source groups)."""
    g = source_groups(df, keys)
    if n_models is None:
        nm = df.agg(F.count_distinct("model").alias("_nm"))
        return g.crossJoin(nm).where(F.col("n_rows") == F.col("_nm")).drop("_nm")
    return g.where(F.col("n_rows") == n_models)


def unanimous(df: DataFrame, n_models=None, keys: Sequence[str] = ()):
    """(right, wrong): complete sources on which every model gave the same
    answer, split by whether it equals the first-seen true value."""
    same = complete_items(df, n_models, keys).where(F.col("n_preds") == 1)
    right = same.where(F.col("pred") == F.col("true")).select(*keys, "src", "pred")
    wrong = same.where(F.col("pred") != F.col("true")).select(*keys, "src", "pred")
    return right, wrong


def with_source_pred(df: DataFrame) -> DataFrame:
    """X4 input: y_true = src, y_pred = src when right, else the prediction."""
    return df.withColumn("y_true", F.col("src")).withColumn(
        "y_pred", F.when(F.col("pred") == F.col("true"), F.col("src")).otherwise(F.col("pred")))


def source_macro_f1(df: DataFrame, keys: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Macro F1 over sources per model (labels = sources and wrong answers)."""
    pc = M.per_class(with_source_pred(df), keys, None, "y_true", "y_pred")
    return pc.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def match_extremes(df: DataFrame, k: int = 10, keys: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """(keys, src, hits, kind): hits = rows of the model whose y_pred equals
    the source (counted over all rows, quirk Q9); kind 'full' when hits == k,
    'none' when 0, else null."""
    sp = with_source_pred(df)
    hits = sp.groupBy(*keys, F.col("y_pred").alias("src")).agg(F.count(F.lit(1)).alias("hits"))
    srcs = sp.select(*keys, "src").distinct()
    j = srcs.join(hits, [*keys, "src"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    kind = F.when(F.col("hits") == k, F.lit("full")).when(F.col("hits") == 0, F.lit("none"))
    return j.withColumn("kind", kind)


def model_summary(df: DataFrame, k: int = 10, keys: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Macro F1 and the number of full / none sources per model."""
    f1 = source_macro_f1(df, keys)
    ex = match_extremes(df, k, keys).groupBy(*keys).agg(
        F.sum((F.col("kind") == "full").cast("long")).alias("n_full"),
        F.sum((F.col("kind") == "none").cast("long")).alias("n_none"))
    return f1.join(ex, list(keys), "left").select(
        *keys, F.round("macro_f1", 6).alias("macro_f1"),
        F.coalesce("n_full", F.lit(0)).cast("long").alias("n_full"),
        F.coalesce("n_none", F.lit(0)).cast("long").alias("n_none"))


def top_models(summary: DataFrame, n, group: str = "dataset") -> DataFrame:
    """Models ranked by macro F1 (desc, ties by name) per dataset; top ``n``.
    ``n`` may be an int or a column (e.g. the model count of a dataset)."""
    w = Window.partitionBy(group).orderBy(F.desc("macro_f1"), F.col("model"))
    ranked = summary.withColumn("rank", F.row_number().over(w).cast("long"))
    limit = n if not isinstance(n, int) else F.lit(n)
    return ranked.where(F.col("rank") <= limit)


def common_to_all(extremes: DataFrame, top: DataFrame, group: str = "dataset") -> DataFrame:
    """Sources of a kind (full / none) shared by every top model."""
    t = top.select(group, "model")
    n_top = t.groupBy(group).agg(F.count(F.lit(1)).alias("n_top"))
    ex = extremes.where(F.col("kind").isNotNull()).join(t, [group, "model"], "left_semi")
    agg = ex.groupBy(group, "kind", "src").agg(F.count_distinct("model").alias("n_models"))
    return agg.join(n_top, group).where(F.col("n_models") == F.col("n_top")).select(group, "kind", "src")


def unique_to_model(extremes: DataFrame, top: DataFrame, semantics: str = "strict",
                    group: str = "dataset") -> DataFrame:
    """Full-match sources unique to one top model.

    strict: held by exactly one model. compat (Q7): every shared source stays
    with its last holder in rank order."""
    t = top.select(group, "model", "rank")
    full = extremes.where(F.col("kind") == "full").join(t, [group, "model"], "inner")
    agg = full.groupBy(group, "src").agg(F.count(F.lit(1)).alias("n"), F.max_by("model", "rank").alias("model"))
    if semantics == "strict":
        agg = agg.where(F.col("n") == 1)
    elif semantics != "compat":
        raise ValueError(semantics)
    return agg.select(group, "model", "src")
