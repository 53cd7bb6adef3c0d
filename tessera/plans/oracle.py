"""DuckDB oracle SQL: the fixtures of ``fixtures.py`` and shared score blocks,
written independently as plain SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Sequence

from .fixtures import (FIXTURE_NOT_RELEVANT, FIXTURE_REFUSALS, PAIR_MODELS, SOURCE_MODELS,
                       TEN_ROW_MODELS)

# Python str.strip() whitespace, in RE2 syntax.
WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\pZ]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def values(rows: Sequence[tuple], cols: str) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({cols}))"


def str_list(items: Sequence[str]) -> str:
    return "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in items) + "]"


def hexd(expr: str, pos: int = 1) -> str:
    return f"substr(md5({expr}), {pos}, 1)"


PAIR_MODELS_SQL = values([(m, t, i) for i, (m, t) in enumerate(PAIR_MODELS)], "model, thr, model_rank")
SOURCE_MODELS_SQL = values([(m, t, i) for i, (m, t) in enumerate(SOURCE_MODELS)], "model, thr, model_rank")
TEN_MODELS_SQL = values([(m, t, i) for i, (m, t) in enumerate(TEN_ROW_MODELS)], "model, thr, model_rank")

# --------------------------------------------------------------- fixtures
MENTIONS = """mentions AS (
  SELECT event_id AS id, 'user_' || user_id AS entity, event_type AS label,
         'user_' || user_id || ' did ' || event_type || ' with ' || props AS text
  FROM events)"""

VOCAB = f"""vocab AS (
  SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS id
  FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type <> '{FIXTURE_NOT_RELEVANT}') v),
vocab_arr AS (SELECT list(label ORDER BY id) AS vocab FROM vocab)"""

PAIRS = f"""pairs AS (
  SELECT m.model, e.event_id AS id, e.event_type AS "true",
    CASE WHEN {hexd("m.model || ':' || e.event_id")} < m.thr THEN e.event_type
         WHEN {hexd("m.model || ':' || e.event_id")} < 'e' THEN coalesce(p.event_type, 'none')
         ELSE 'none' END AS pred
  FROM events e LEFT JOIN events p ON p.event_id + 1 = e.event_id
  CROSS JOIN {PAIR_MODELS_SQL} m)"""

SOURCE_PAIRS = f"""spairs AS (
  SELECT m.model, m.model_rank, p_partkey + 1 AS num, p_name || ', ' || p_brand AS src,
    CASE WHEN {hexd("m.model || ':' || p_partkey")} < m.thr THEN p_type ELSE 'none' END AS pred,
    p_type AS "true"
  FROM part CROSS JOIN {SOURCE_MODELS_SQL} m)"""

TEN_PAIRS = f"""ents AS (
  SELECT 'string' AS dataset, s_suppkey AS key, s_name AS name FROM supplier
  UNION ALL SELECT 'kegg', c_custkey, c_name FROM customer),
ents2 AS (
  SELECT e.*, nx.name AS next_name FROM ents e
  JOIN (SELECT dataset, count(*) AS size FROM ents GROUP BY dataset) s USING (dataset)
  LEFT JOIN ents nx ON nx.dataset = e.dataset AND nx.key = (e.key + 1) % s.size),
tpairs AS (
  SELECT dataset, m.model, m.model_rank, key * 10 + k + 1 AS num, name AS src,
    CASE WHEN key % 10 = 0 OR (key % 10 <> 4 AND {hexd("m.model || ':' || k || ':' || name")} < m.thr) THEN name
         WHEN key % 2 = 0 THEN next_name ELSE 'unknown' END AS pred,
    name AS "true"
  FROM ents2 CROSS JOIN range(10) r(k) CROSS JOIN {TEN_MODELS_SQL} m)"""

TASKS = f"""ta AS (SELECT event_id AS pos, {hexd("'ta:' || event_id")} < 'c' AS ok FROM events),
tb AS (SELECT event_id AS pos, {hexd("'tb:' || event_id")} < 'a' AS ok FROM events)"""

RESPONSES = f"""{MENTIONS},
{VOCAB},
resp0 AS (
  SELECT m.*, v.vocab, list_position(v.vocab, m.label) - 1 AS g,
         instr('0123456789abcdef', {hexd("'r:' || m.id", 2)}) - 1 AS d,
         {hexd("'r:' || m.id")} AS h
  FROM mentions m CROSS JOIN vocab_arr v WHERE m.label <> '{FIXTURE_NOT_RELEVANT}'),
responses AS (
  SELECT id, entity, label, text,
    CASE WHEN h <= '5' THEN 'The answer is ' || label
         WHEN h <= '7' THEN label || ' or ' || vocab[(g + 1 + d % 3) % len(vocab) + 1]
         WHEN h <= '9' THEN vocab[(g + 1 + d % 3) % len(vocab) + 1] || ' and ' || vocab[(g + 1 + (d + 1) % 3) % len(vocab) + 1]
         WHEN h = 'a' THEN 'I cannot tell.'
         WHEN h <= 'c' THEN upper(label) || '.'
         ELSE entity || ' is a ' || label END AS response
  FROM resp0)"""


def _initial_upper(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


_T = _initial_upper("p_type")
LINES = f"""li AS (
  SELECT l.*, p.p_name, p.p_brand, p.p_type,
         'order-' || l_orderkey AS uid, 'Order ' || l_orderkey AS title,
         {hexd("l_orderkey || ':' || l_linenumber || ':' || l_partkey")} AS hg
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
glines AS (
  SELECT uid, title, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    CASE WHEN l_returnflag = 'N' THEN 'not relevant' ELSE p_type END AS anno_label,
    CASE WHEN {hexd("'e:' || l_orderkey || ':' || l_linenumber")} = 'f' THEN ' ' ELSE p_name END AS anno_entity,
    CASE WHEN hg <= '3' THEN l_linenumber || '. ' || {_T} || ': ' || p_name
         WHEN hg <= '5' THEN '* "' || lower(p_type) || '": ' || p_name || ', ' || p_brand
         WHEN hg <= '7' THEN '- ' || {_T} || 's: ' || p_name || ' strain'
         WHEN hg = '8' THEN {_T} || ': ' || {str_list(FIXTURE_REFUSALS)}[l_linenumber % 8 + 1] || ' here'
         WHEN hg = '9' THEN {_T} || ' (' || p_name || ')'
         WHEN hg = 'a' THEN 'The order lists ' || p_name || ' among its parts.'
         WHEN hg = 'b' THEN {_T} || ' kind: ' || p_name
         ELSE {_T} || ': ' || p_name END AS line
  FROM li),
gens AS (
  SELECT uid, title,
    string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, line,
               anno_label, anno_entity) AS pred
  FROM glines GROUP BY uid, title),
anno_rows AS (
  SELECT uid, lower(anno_label) AS label, anno_label AS raw_label, {strip_sql("anno_entity")} AS entity
  FROM glines WHERE length({strip_sql("anno_entity")}) > 0),
relevant AS (SELECT uid FROM anno_rows GROUP BY uid HAVING max(CASE WHEN raw_label <> 'not relevant' THEN 1 ELSE 0 END) = 1),
pvocab AS (SELECT list(DISTINCT lower(p_type) ORDER BY lower(p_type)) AS vocab FROM part)"""


def metrics_sql(src: str, keys: Sequence[str] = (), true: str = '"true"', pred: str = "pred",
                prefix: str = "") -> str:
    """CTEs ``{prefix}conf``, ``{prefix}cls`` and the final select of ten scores."""
    kc = "".join(f"{k}, " for k in keys)
    p = prefix
    ctes = f"""{p}conf AS (SELECT {kc}{true} AS t, {pred} AS p, count(*) AS n FROM {src} GROUP BY ALL),
{p}cls0 AS (
  SELECT {kc}label, sum(tp) AS tp, sum(n_pred) AS n_pred, sum(support) AS support FROM (
    SELECT {kc}t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS n_pred, n AS support FROM {p}conf
    UNION ALL SELECT {kc}p AS label, 0 AS tp, n AS n_pred, 0 AS support FROM {p}conf) u GROUP BY ALL),
{p}cls AS (
  SELECT *, coalesce(tp::DOUBLE / nullif(n_pred, 0), 0) AS prec,
            coalesce(tp::DOUBLE / nullif(support, 0), 0) AS rec,
            coalesce(2.0 * tp / nullif(n_pred + support, 0), 0) AS f1
  FROM {p}cls0)"""
    sel = f"""SELECT {kc}CAST(sum(support) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS correct,
  CAST(count(*) AS BIGINT) AS n_classes,
  round(coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0), 0), 6) AS accuracy,
  round(avg(prec), 6) AS macro_p, round(avg(rec), 6) AS macro_r, round(avg(f1), 6) AS macro_f,
  round(coalesce(sum(tp)::DOUBLE / nullif(sum(n_pred), 0), 0), 6) AS micro_p,
  round(coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0), 0), 6) AS micro_r,
  round(coalesce(2.0 * sum(tp) / nullif(sum(n_pred) + sum(support), 0), 0), 6) AS micro_f,
  round(coalesce(sum(prec * support) / nullif(sum(support), 0), 0), 6) AS weighted_p,
  round(coalesce(sum(rec * support) / nullif(sum(support), 0), 0), 6) AS weighted_r,
  round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0), 6) AS weighted_f
FROM {p}cls GROUP BY ALL"""
    return ctes, sel
