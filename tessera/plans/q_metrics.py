"""Registered score queries: E1-E15, K5, E10/K6 over the F3 pair fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.responses import split_in_vocab
from . import fixtures as fx
from .oracle import PAIRS, TASKS, metrics_sql, str_list
from .registry import register

TYPES = ["click", "purchase", "signup", "view"]          # restricted label list (E7)
CONF_LABELS = ["click", "error", "purchase", "signup", "view", "none"]  # E8 grid

_c, _s = metrics_sql("pairs", ["model"])


@register("metrics10", f"WITH {PAIRS},\n{_c}\n{_s}")
def metrics10(spark, sf):
    """E1+E3+E4+E5+E6: ten scores per model."""
    return M.compute_metrics(fx.model_pairs(spark, sf), keys=["model"])


@register("per_class", f"""WITH {PAIRS},
conf AS (SELECT model, "true" AS t, pred AS p, count(*) AS n FROM pairs GROUP BY ALL),
cls0 AS (
  SELECT model, label, sum(tp) AS tp, sum(n_pred) AS n_pred, sum(support) AS support FROM (
    SELECT model, t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS n_pred, n AS support FROM conf
    UNION ALL SELECT model, p, 0, n, 0 FROM conf) u GROUP BY ALL)
SELECT model, label, CAST(tp AS BIGINT) AS tp, CAST(n_pred - tp AS BIGINT) AS fp,
  CAST(support - tp AS BIGINT) AS fn, CAST(support AS BIGINT) AS support,
  round(coalesce(tp::DOUBLE / nullif(n_pred, 0), 0), 6) AS precision,
  round(coalesce(tp::DOUBLE / nullif(support, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(n_pred + support, 0), 0), 6) AS f1
FROM cls0""")
def per_class(spark, sf):
    """Per-class counts and scores per model."""
    pc = M.per_class(fx.model_pairs(spark, sf), keys=["model"])
    return pc.select("model", "label", "tp", "fp", "fn", "support",
                     *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_types = str_list(TYPES)


@register("type_report", f"""WITH {PAIRS},
lab AS (SELECT unnest({_types}) AS label),
conf AS (SELECT model, "true" AS t, pred AS p, count(*) AS n FROM pairs GROUP BY ALL),
cls0 AS (
  SELECT model, label, sum(tp) AS tp, sum(n_pred) AS n_pred, sum(support) AS support FROM (
    SELECT model, t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS n_pred, n AS support FROM conf
    UNION ALL SELECT model, p, 0, n, 0 FROM conf
    UNION ALL SELECT m.model, l.label, 0, 0, 0 FROM (SELECT DISTINCT model FROM pairs) m CROSS JOIN lab l) u
  WHERE label IN (SELECT label FROM lab) GROUP BY ALL),
cls AS (SELECT *, coalesce(tp::DOUBLE / nullif(n_pred, 0), 0) AS prec,
  coalesce(tp::DOUBLE / nullif(support, 0), 0) AS rec,
  coalesce(2.0 * tp / nullif(n_pred + support, 0), 0) AS f1 FROM cls0),
mic AS (SELECT model, coalesce(sum(tp)::DOUBLE / nullif(sum(n_pred), 0), 0) AS p,
  coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0), 0) AS r, sum(support) AS s FROM cls GROUP BY model)
SELECT model, label AS type, round(prec * 100, 6) AS precision, round(rec * 100, 6) AS recall,
  round(f1 * 100, 6) AS f1, CAST(support AS BIGINT) AS support FROM cls
UNION ALL SELECT model, 'micro', round(p * 100, 6), round(r * 100, 6),
  round(coalesce(2 * p * r / nullif(p + r, 0), 0) * 100, 6), CAST(s AS BIGINT) FROM mic
UNION ALL SELECT model, 'macro', round(avg(prec) * 100, 6), round(avg(rec) * 100, 6),
  round(avg(f1) * 100, 6), CAST(sum(support) AS BIGINT) FROM cls GROUP BY model""")
def type_report(spark, sf):
    """Per-type and micro/macro rows over a restricted label list, x100."""
    return M.restricted_metrics(fx.model_pairs(spark, sf), TYPES, keys=["model"])


_conf = str_list(CONF_LABELS)


@register("confusion_long", f"""WITH {PAIRS},
heard AS (SELECT model, "true", pred FROM pairs UNION ALL SELECT 'silent', "true", 'none' FROM pairs),
lab2 AS (SELECT unnest({_conf}) AS label, CAST(generate_subscripts({_conf}, 1) - 1 AS INTEGER) AS idx),
c AS (SELECT model, "true" AS t, pred AS p, count(*) AS n FROM heard
      WHERE pred IN (SELECT label FROM lab2) AND "true" IN (SELECT label FROM lab2) GROUP BY ALL)
SELECT m.model, a.label AS "true", b.label AS pred, a.idx AS true_idx, b.idx AS pred_idx,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT model FROM heard) m CROSS JOIN lab2 a CROSS JOIN lab2 b
LEFT JOIN c ON c.model = m.model AND c.t = a.label AND c.p = b.label""")
def confusion_long(spark, sf):
    """Confusion over a fixed label grid, zero cells included; the model that
    never gives a label of the list keeps its row of zeros."""
    pairs = fx.model_pairs(spark, sf).select("model", "true", "pred")
    silent = pairs.select(F.lit("silent").alias("model"), "true", F.lit("none").alias("pred"))
    return M.confusion(pairs.unionByName(silent), CONF_LABELS, keys=["model"])


@register("confusion_t", f"""WITH {PAIRS},
lab2 AS (SELECT unnest({_conf}) AS label, CAST(generate_subscripts({_conf}, 1) - 1 AS INTEGER) AS idx),
c AS (SELECT model, pred AS t, "true" AS p, count(*) AS n FROM pairs
      WHERE pred IN (SELECT label FROM lab2) AND "true" IN (SELECT label FROM lab2) GROUP BY ALL)
SELECT m.model, a.label AS "true", b.label AS pred, a.idx AS true_idx, b.idx AS pred_idx,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT model FROM pairs) m CROSS JOIN lab2 a CROSS JOIN lab2 b
LEFT JOIN c ON c.model = m.model AND c.t = a.label AND c.p = b.label""")
def confusion_t(spark, sf):
    """Transposed confusion (predictions on rows)."""
    return M.confusion(fx.model_pairs(spark, sf), CONF_LABELS, keys=["model"], transpose=True)


_wide_cols = ",\n  ".join(f"CAST(sum(CASE WHEN p = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{x}\""
                          for x in CONF_LABELS)


@register("confusion_wide", f"""WITH {PAIRS},
lab2 AS (SELECT unnest({_conf}) AS label),
c AS (SELECT model, "true" AS t, pred AS p FROM pairs
      WHERE pred IN (SELECT label FROM lab2) AND "true" IN (SELECT label FROM lab2)),
g AS (SELECT DISTINCT m.model, l.label FROM c m CROSS JOIN lab2 l)
SELECT g.model, g.label AS "true",
  {_wide_cols.replace("p = ", "c.p = ")}
FROM g LEFT JOIN c ON c.model = g.model AND c.t = g.label GROUP BY g.model, g.label""")
def confusion_wide(spark, sf):
    """K5: pivoted confusion table."""
    return M.confusion_wide(fx.model_pairs(spark, sf), CONF_LABELS, keys=["model"])


@register("label_accuracy", f"""WITH {PAIRS}
SELECT model, pred AS label, CAST(sum(CASE WHEN pred = "true" THEN 1 ELSE 0 END) AS BIGINT) AS matches,
  CAST(count(*) AS BIGINT) AS total,
  round(sum(CASE WHEN pred = "true" THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS accuracy
FROM pairs GROUP BY model, pred HAVING sum(CASE WHEN pred = "true" THEN 1 ELSE 0 END) > 0""")
def label_accuracy(spark, sf):
    """Per-label match count, total and accuracy (labels with a match)."""
    return M.label_accuracy(fx.model_pairs(spark, sf), keys=["model"])


@register("metrics_ignore", f"""WITH {PAIRS},
k AS (SELECT * FROM pairs WHERE "true" <> 'error'),
conf AS (SELECT model, "true" AS t, pred AS p, count(*) AS n FROM k GROUP BY ALL),
cls0 AS (
  SELECT model, label, sum(tp) AS tp, sum(n_pred) AS n_pred, sum(support) AS support FROM (
    SELECT model, t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS n_pred, n AS support FROM conf
    UNION ALL SELECT model, p, 0, n, 0 FROM conf) u GROUP BY ALL),
cls AS (SELECT *, coalesce(tp::DOUBLE / nullif(n_pred, 0), 0) AS prec,
  coalesce(tp::DOUBLE / nullif(support, 0), 0) AS rec,
  coalesce(2.0 * tp / nullif(n_pred + support, 0), 0) AS f1 FROM cls0)
SELECT model, CAST(sum(support) AS BIGINT) AS n,
  round(coalesce(sum(tp)::DOUBLE / nullif(sum(n_pred), 0), 0), 6) AS micro_p,
  round(coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0), 0), 6) AS micro_r,
  round(coalesce(2.0 * sum(tp) / nullif(sum(n_pred) + sum(support), 0), 0), 6) AS micro_f,
  round(coalesce(max(CASE WHEN label = 'click' THEN prec END), 0), 6) AS pos_p,
  round(coalesce(max(CASE WHEN label = 'click' THEN rec END), 0), 6) AS pos_r,
  round(coalesce(max(CASE WHEN label = 'click' THEN f1 END), 0), 6) AS pos_f
FROM cls GROUP BY model""")
def metrics_ignore(spark, sf):
    """Scores with an ignored gold class and a positive-class average."""
    return M.filtered_metrics(fx.model_pairs(spark, sf), ignore="error", positive="click", keys=["model"])


_vocab_in = str_list(TYPES)


@register("oov_rows", f"""WITH {PAIRS}
SELECT model, id, pred, "true" FROM pairs WHERE NOT list_contains({_vocab_in}, pred)""")
def oov_rows(spark, sf):
    """P10: predictions outside the label list."""
    _, oov = split_in_vocab(fx.model_pairs(spark, sf), TYPES)
    return oov.select("model", "id", "pred", "true")


@register("oov_split", f"""WITH {PAIRS}
SELECT model, CAST(sum(CASE WHEN list_contains({_vocab_in}, pred) THEN 1 ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN list_contains({_vocab_in}, pred) THEN 0 ELSE 1 END) AS BIGINT) AS oov
FROM pairs GROUP BY model""")
def oov_split(spark, sf):
    """P10: kept / out-of-vocabulary counts per model."""
    kept, oov = split_in_vocab(fx.model_pairs(spark, sf), TYPES)
    k = kept.groupBy("model").agg(F.count(F.lit(1)).alias("kept"))
    o = oov.groupBy("model").agg(F.count(F.lit(1)).alias("oov"))
    return k.join(o, "model", "full").select(
        "model", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"),
        F.coalesce("oov", F.lit(0)).cast("long").alias("oov"))


_lc, _ls = metrics_sql("pairs", ["model"])


@register("leaderboard", f"WITH {PAIRS},\n{_lc}\n" + _ls.replace(", 6)", ", 4)").replace(
    "SELECT model, CAST(sum(support) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS correct,\n  CAST(count(*) AS BIGINT) AS n_classes,",
    "SELECT model,"))
def leaderboard(spark, sf):
    """E10/K6 data: scores per model at four decimals."""
    m = M.compute_metrics(fx.model_pairs(spark, sf), keys=["model"], digits=None)
    return m.select("model", *[F.round(c, 4).alias(c) for c in M.METRIC_NAMES])


@register("agreement", f"""WITH {TASKS}
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN ta.ok = tb.ok THEN 1 ELSE 0 END) AS BIGINT) AS agree,
  round(avg(CASE WHEN ta.ok = tb.ok THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM ta JOIN tb USING (pos)""")
def agreement(spark, sf):
    """Agreement of two tasks' correctness."""
    a, b = fx.task_outcomes(spark, sf)
    return M.agreement(a, b, ["pos"])


@register("conditional_agreement", f"""WITH {TASKS}
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN ta.ok = tb.ok THEN 1 ELSE 0 END) AS BIGINT) AS agree,
  round(avg(CASE WHEN ta.ok = tb.ok THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM ta JOIN tb USING (pos) WHERE ta.ok""")
def conditional_agreement(spark, sf):
    """Agreement where the first task was right."""
    a, b = fx.task_outcomes(spark, sf)
    return M.conditional_agreement(a, b, ["pos"])


@register("yes_no", f"""WITH {TASKS},
lab AS (SELECT * FROM (VALUES ('yes', 0), ('no', 1)) t(label, idx)),
c AS (SELECT CASE WHEN ta.ok THEN 'yes' ELSE 'no' END AS t, CASE WHEN tb.ok THEN 'yes' ELSE 'no' END AS p,
             count(*) AS n FROM ta JOIN tb USING (pos) WHERE ta.ok GROUP BY ALL)
SELECT a.label AS "true", b.label AS pred, CAST(a.idx AS INTEGER) AS true_idx, CAST(b.idx AS INTEGER) AS pred_idx,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM lab a CROSS JOIN lab b LEFT JOIN c ON c.t = a.label AND c.p = b.label""")
def yes_no(spark, sf):
    """yes/no confusion of the conditional agreement."""
    a, b = fx.task_outcomes(spark, sf)
    return M.yes_no_confusion(a, b, ["pos"])
