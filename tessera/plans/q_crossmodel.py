"""Registered cross-model queries (X1-X9, K7 data) over F3b / F3c."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossmodel as XM
from . import fixtures as fx
from .fixtures import memo
from .oracle import SOURCE_PAIRS, TEN_PAIRS
from .registry import register

GROUPS = f"""{SOURCE_PAIRS},
grp AS (SELECT src, count(*) AS n_rows, count(DISTINCT pred) AS n_preds, min(pred) AS pred,
               arg_min("true", model_rank * 1000000 + num) AS "true" FROM spairs GROUP BY src),
complete AS (SELECT * FROM grp WHERE n_rows = (SELECT count(DISTINCT model) FROM spairs))"""


@register("complete_items", f"WITH {GROUPS}\nSELECT src, \"true\" FROM complete")
def complete_items(spark, sf):
    """X1+X2: sources answered by every model exactly once."""
    return XM.complete_items(fx.source_pairs(spark, sf)).select("src", "true")


@register("unanimous_right", f"WITH {GROUPS}\nSELECT src, pred FROM complete WHERE n_preds = 1 AND pred = \"true\"")
def unanimous_right(spark, sf):
    """Sources all models answered identically and correctly."""
    right, _ = XM.unanimous(fx.source_pairs(spark, sf))
    return right


@register("unanimous_wrong", f"WITH {GROUPS}\nSELECT src, pred FROM complete WHERE n_preds = 1 AND pred <> \"true\"")
def unanimous_wrong(spark, sf):
    """Sources all models answered with the same wrong answer."""
    _, wrong = XM.unanimous(fx.source_pairs(spark, sf))
    return wrong


TEN = f"""{TEN_PAIRS},
sp AS (SELECT *, src AS y_true, CASE WHEN pred = "true" THEN src ELSE pred END AS y_pred FROM tpairs),
conf AS (SELECT dataset, model, y_true AS t, y_pred AS p, count(*) AS n FROM sp GROUP BY ALL),
cls0 AS (SELECT dataset, model, label, sum(tp) AS tp, sum(n_pred) AS n_pred, sum(support) AS support FROM (
    SELECT dataset, model, t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS n_pred, n AS support FROM conf
    UNION ALL SELECT dataset, model, p, 0, n, 0 FROM conf) u GROUP BY ALL),
f1s AS (SELECT dataset, model, avg(coalesce(2.0 * tp / nullif(n_pred + support, 0), 0)) AS macro_f1
        FROM cls0 GROUP BY ALL),
hits AS (SELECT dataset, model, y_pred AS src, count(*) AS hits FROM sp GROUP BY ALL),
srcs AS (SELECT DISTINCT dataset, model, src FROM sp),
ext AS (SELECT s.dataset, s.model, s.src, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits,
               CASE WHEN coalesce(h.hits, 0) = 10 THEN 'full' WHEN coalesce(h.hits, 0) = 0 THEN 'none' END AS kind
        FROM srcs s LEFT JOIN hits h ON h.dataset = s.dataset AND h.model = s.model AND h.src = s.src),
summ AS (SELECT f.dataset, f.model, round(f.macro_f1, 6) AS macro_f1,
                CAST(sum(CASE WHEN kind = 'full' THEN 1 ELSE 0 END) AS BIGINT) AS n_full,
                CAST(sum(CASE WHEN kind = 'none' THEN 1 ELSE 0 END) AS BIGINT) AS n_none
         FROM f1s f JOIN ext e ON e.dataset = f.dataset AND e.model = f.model GROUP BY f.dataset, f.model, f.macro_f1),
top AS (SELECT * FROM (SELECT summ.*, CAST(row_number() OVER (PARTITION BY dataset ORDER BY macro_f1 DESC, model) AS BIGINT) AS rank
                       FROM summ) r
        WHERE rank <= (SELECT count(DISTINCT model) FROM tpairs WHERE dataset = 'string')),
textr AS (SELECT e.*, t.rank FROM ext e JOIN top t ON t.dataset = e.dataset AND t.model = e.model)"""


@memo
def _ten(spark, sf):
    return fx.ten_row_pairs(spark, sf)


@memo
def _top(spark, sf):
    df = _ten(spark, sf)
    summ = XM.model_summary(df)
    n = df.where(F.col("dataset") == "string").agg(F.count_distinct("model").alias("n_top"))
    return df, XM.top_models(summ.crossJoin(n), F.col("n_top")).drop("n_top")


@register("source_macro_f1", f"WITH {TEN}\nSELECT dataset, model, round(macro_f1, 6) AS macro_f1 FROM f1s")
def source_macro_f1(spark, sf):
    """Macro F1 over sources per dataset and model."""
    return XM.source_macro_f1(_ten(spark, sf)).select("dataset", "model", F.round("macro_f1", 6).alias("macro_f1"))


@register("full_match", f"WITH {TEN}\nSELECT dataset, model, src FROM ext WHERE kind = 'full'")
def full_match(spark, sf):
    """Sources answered right in all ten rows."""
    return XM.match_extremes(_ten(spark, sf)).where(F.col("kind") == "full").select("dataset", "model", "src")


@register("none_match", f"WITH {TEN}\nSELECT dataset, model, src FROM ext WHERE kind = 'none'")
def none_match(spark, sf):
    """Sources never produced."""
    return XM.match_extremes(_ten(spark, sf)).where(F.col("kind") == "none").select("dataset", "model", "src")


@register("model_summary", f"WITH {TEN}\nSELECT dataset, model, macro_f1, n_full, n_none FROM summ")
def model_summary(spark, sf):
    """Macro F1, full and none counts per model."""
    return XM.model_summary(_ten(spark, sf))


@register("top_models", f"WITH {TEN}\nSELECT dataset, model, macro_f1, rank FROM top")
def top_models(spark, sf):
    """Models ranked by macro F1, top N (N = models of 'string')."""
    _, top = _top(spark, sf)
    return top.select("dataset", "model", "macro_f1", "rank")


@register("common_all", f"""WITH {TEN}
SELECT dataset, kind, src FROM textr WHERE kind IS NOT NULL GROUP BY dataset, kind, src
HAVING count(DISTINCT model) = (SELECT count(*) FROM top t WHERE t.dataset = textr.dataset)""")
def common_all(spark, sf):
    """Full / none sources common to all top models."""
    df, top = _top(spark, sf)
    return XM.common_to_all(XM.match_extremes(df), top)


@register("unique_strict", f"""WITH {TEN}
SELECT dataset, min(model) AS model, src FROM textr WHERE kind = 'full' GROUP BY dataset, src HAVING count(*) = 1""")
def unique_strict(spark, sf):
    """Full-match sources held by exactly one top model."""
    df, top = _top(spark, sf)
    return XM.unique_to_model(XM.match_extremes(df), top, "strict")


@register("unique_last_holder", f"""WITH {TEN}
SELECT dataset, arg_max(model, rank) AS model, src FROM textr WHERE kind = 'full' GROUP BY dataset, src""")
def unique_last_holder(spark, sf):
    """X8 compat (Q7): each full-match source kept by its last holder in rank order."""
    df, top = _top(spark, sf)
    return XM.unique_to_model(XM.match_extremes(df), top, "compat")
