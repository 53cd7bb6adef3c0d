"""Registered curation queries (S8, S9, C1-C9, R3) over the F7 review rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import literal_table
from ..operators import curation as C
from ..operators.responses import align_lists as _align
from ..session import stored
from . import fixtures as fx
from .fixtures import memo
from .oracle import metrics_sql, strip_sql
from .registry import register


@memo
def _items(spark, sf):
    review = C.reviewed(C.parse_review(fx.review_rows(spark, sf)))
    # pipeline boundary: curated items feed pairs, scores, hosts and lists; they bring
    # their review's flag along (the sheet has one row for each uid)
    return stored(C.curated_items(review, fx.part_synonyms(spark, sf), ["uid", "rejected"]), "items")


BASE = f"""base AS (
  SELECT 'order-' || l_orderkey AS uid, 'Order ' || l_orderkey AS title, l_orderkey, l_linenumber, l_partkey,
         l_suppkey, l_extendedprice, l_linestatus, l_returnflag, p_name, p_brand, lower(p_type) AS ptype,
         substr(md5('p:' || l_orderkey || ':' || l_linenumber), 1, 1) AS hp,
         substr(md5('w:' || l_orderkey || ':' || l_linenumber), 1, 1) = '3' AS is_wrong,
         substr(md5('order-' || l_orderkey), 1, 1) = '0' AS rejected
  FROM lineitem JOIN part ON l_partkey = p_partkey),
flags AS (SELECT uid, bool_or(rejected) AS rejected, min(title) AS title FROM base GROUP BY uid),
gv AS (SELECT uid, CASE WHEN l_returnflag = 'N' THEN 'not relevant' ELSE ptype END AS label, l_linestatus,
              string_agg(p_name, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_name) AS value
       FROM base GROUP BY ALL),
gvals AS (SELECT uid, label, CAST(row_number() OVER (PARTITION BY uid, label ORDER BY l_linestatus) - 1 AS INTEGER) AS vpos,
                 value FROM gv),
pitems AS (SELECT *, CASE WHEN hp = '0' THEN p_name || ', ' || p_brand WHEN hp <= '9' THEN p_name
                          WHEN hp <= 'b' THEN upper(p_name) END AS item FROM base WHERE hp <= 'b'),
pv AS (SELECT uid, ptype AS label, 0 AS vpos,
              string_agg(item, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, item) AS value
       FROM pitems GROUP BY ALL),
wv AS (SELECT uid, ptype AS label,
              CAST(row_number() OVER (PARTITION BY uid, ptype ORDER BY l_linenumber, l_partkey, l_suppkey,
                                      l_extendedprice, p_name) - 1 AS INTEGER) AS vpos, p_name AS value
       FROM base WHERE is_wrong AND NOT rejected),
vals AS (SELECT uid, 'gold' AS side, label, vpos, value FROM gvals WHERE label <> 'not relevant'
         UNION ALL SELECT uid, 'pred', label, vpos, value FROM pv
         UNION ALL SELECT uid, 'wrong', label, vpos, value FROM wv),
names AS (SELECT uid, side, label, vpos, CAST(generate_subscripts(string_split(value, ','), 1) - 1 AS INTEGER) AS npos,
                 unnest(string_split(value, ',')) AS raw FROM vals),
c1 AS (SELECT uid, side, label, CAST(vpos AS INTEGER) AS vpos, npos, {strip_sql("raw")} AS entity FROM names
       WHERE length({strip_sql("raw")}) > 0),
syn AS (SELECT DISTINCT lower(p_name) AS variant, string_split(p_name, ' ')[-1] AS canonical FROM part
        WHERE p_name LIKE 'red %' OR p_name LIKE 'blue %'),
c2 AS (SELECT c1.uid, c1.side, c1.label, c1.vpos, c1.npos, coalesce(s.canonical, c1.entity) AS entity
       FROM c1 LEFT JOIN syn s ON s.variant = lower(c1.entity)),
items AS (SELECT uid, side, label, vpos, entity, min(npos) AS npos FROM c2 GROUP BY ALL),
hosts AS (SELECT uid, side, min(entity) AS host FROM items WHERE label = '{fx.FIXTURE_HOST}' AND side IN ('gold', 'pred')
          GROUP BY uid, side HAVING count(*) = 1),
g AS (SELECT *, lower(entity) AS lkey FROM items WHERE side = 'gold'),
st AS (SELECT uid, label, lkey, min(vpos * 100000 + npos) AS first FROM g GROUP BY ALL),
pk AS (SELECT DISTINCT uid, label, lower(entity) AS lkey FROM items WHERE side = 'pred'),
gs AS (SELECT g.uid, g.side, g.label, g.entity, g.vpos, g.npos, g.label AS pred,
              CASE WHEN pk.uid IS NOT NULL AND g.vpos * 100000 + g.npos = st.first AND NOT f.rejected
                   THEN g.label ELSE 'none' END AS "true"
       FROM g JOIN st ON st.uid = g.uid AND st.label = g.label AND st.lkey = g.lkey
       LEFT JOIN pk ON pk.uid = g.uid AND pk.label = g.label AND pk.lkey = g.lkey
       JOIN flags f ON f.uid = g.uid),
p AS (SELECT *, lower(entity) AS lkey FROM items WHERE side = 'pred'),
rem AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.uid = p.uid AND g.label = p.label AND g.lkey = p.lkey)),
wk AS (SELECT DISTINCT uid, label, lower(entity) AS lkey FROM items WHERE side = 'wrong'),
rs AS (SELECT rem.uid, rem.side, rem.label, rem.entity, rem.vpos, rem.npos, rem.label AS pred,
              CASE WHEN wk.uid IS NOT NULL OR f.rejected THEN 'none' ELSE rem.label END AS "true",
              (wk.uid IS NULL AND NOT f.rejected) AS accepted
       FROM rem LEFT JOIN wk ON wk.uid = rem.uid AND wk.label = rem.label AND wk.lkey = rem.lkey
       JOIN flags f ON f.uid = rem.uid),
cpairs AS (SELECT uid, side, label, entity, vpos, npos, lower(pred) AS pred, lower("true") AS "true" FROM gs
           UNION ALL SELECT uid, side, label, entity, vpos, npos, lower(pred), lower("true") FROM rs)"""


@register("explode_entities", f"WITH {BASE}\nSELECT uid, side, label, vpos, npos, entity FROM c1")
def explode_entities(spark, sf):
    """Review cells parsed and split into entity rows."""
    return C.explode_sides(C.reviewed(C.parse_review(fx.review_rows(spark, sf))))


@register("synonyms", f"WITH {BASE}\nSELECT uid, side, label, vpos, npos, entity FROM items")
def synonyms(spark, sf):
    """C2+C3: canonical names, one copy per source value."""
    items = _items(spark, sf)
    return items.select("uid", "side", "label", "vpos", "npos", "entity")


@register("synonyms_hot", f"""WITH {BASE},
i AS (SELECT uid, side, label, vpos, npos, CASE WHEN substr(md5(uid || ':' || side || ':' || label || ':' || vpos || ':' || npos), 1, 1) < '8'
             THEN 'Hot Name' ELSE entity END AS entity FROM c1),
ci AS (SELECT variant, canonical FROM syn UNION ALL SELECT 'hot name', 'hot'),
ex AS (SELECT DISTINCT upper(p_name) AS variant, CASE WHEN p_name LIKE 'red %' THEN 'exact red' ELSE 'exact blue' END AS canonical,
              CASE WHEN p_name LIKE 'red %' THEN 1 ELSE -1 END AS prio FROM part WHERE p_name LIKE 'red %' OR p_name LIKE 'blue %')
SELECT uid, side, label, vpos, min(npos) AS npos, entity FROM (
  SELECT i.uid, i.side, i.label, i.vpos, i.npos, CASE WHEN ci.canonical IS NOT NULL AND (ex.canonical IS NULL OR 0 >= ex.prio) THEN ci.canonical
         WHEN ex.canonical IS NOT NULL THEN ex.canonical ELSE i.entity END AS entity
  FROM i LEFT JOIN ci ON ci.variant = lower(i.entity) LEFT JOIN ex ON ex.variant = i.entity) z GROUP BY ALL""")
def synonyms_hot(spark, sf):
    """C2+C3: one name in half the items, exact names with priorities, and a synonym
    table that is taken as too large to broadcast."""
    items = C.explode_sides(C.reviewed(C.parse_review(fx.review_rows(spark, sf))))
    digit = F.substring(F.md5(F.concat_ws(":", "uid", "side", "label", "vpos", "npos")), 1, 1)
    items = stored(items.withColumn("entity", F.when(digit < "8", "Hot Name").otherwise(F.col("entity"))), "hot-items")
    ci = fx.part_synonyms(spark, sf)
    part = fx.load(spark, sf, "part").where("p_name LIKE 'red %' OR p_name LIKE 'blue %'")
    red = F.startswith(F.col("p_name"), F.lit("red "))
    exact = part.select(F.lit("exact").alias("kind"), F.upper("p_name").alias("variant"), F.when(red, "exact red").otherwise("exact blue").alias("canonical"),
                        F.when(red, 1).otherwise(-1).alias("prio")).distinct()
    hot = literal_table(spark, [("ci", "hot name", "hot", 0)], "kind string, variant string, canonical string, prio int")
    out = C.apply_synonyms(items, ci.unionByName(exact).unionByName(hot), broadcast_rows=0)
    return out.select("uid", "side", "label", "vpos", "npos", "entity")


@register("single_host", f"WITH {BASE}\nSELECT uid, side, host FROM hosts")
def single_host(spark, sf):
    """C4: papers whose gold or predicted side names exactly one host."""
    items = _items(spark, sf)
    return C.single_host(items, fx.FIXTURE_HOST)


@register("curated_pairs", f"WITH {BASE}\nSELECT * FROM cpairs")
def curated_pairs(spark, sf):
    """Scored gold items and leftover predictions."""
    items = _items(spark, sf)
    return C.curated_pairs(items, None)


_cc, _cs = metrics_sql("cpairs")


@register("curated_scores", f"WITH {BASE},\n{_cc}\n{_cs}")
def curated_scores(spark, sf):
    """Ten scores over the curated pairs."""
    items = _items(spark, sf)
    return C.curated_scores(C.curated_pairs(items, None))


@register("host_index", f"""WITH {BASE},
hg AS (SELECT h.host AS species, i.label AS type, i.entity AS name, i.uid, 'gold' AS side
       FROM items i JOIN hosts h ON h.uid = i.uid AND h.side = 'gold' WHERE i.side = 'gold'),
hp AS (SELECT h.host AS species, rs.label AS type, rs.entity AS name, rs.uid, 'pred' AS side
       FROM rs JOIN hosts h ON h.uid = rs.uid AND h.side = 'pred' WHERE rs.accepted)
SELECT x.species, x.type, x.name, f.title, x.uid, x.side
FROM (SELECT * FROM hg UNION ALL SELECT * FROM hp) x JOIN flags f ON f.uid = x.uid""")
def host_index(spark, sf):
    """Host -> tools rows (long form of the nested index)."""
    items = _items(spark, sf)
    return C.host_index_rows(items, None, fx.review_rows(spark, sf).select("uid", "title"), fx.FIXTURE_HOST)


@register("align_lists", f"""WITH {BASE},
pl AS (SELECT uid, label, list(entity) AS p FROM items WHERE side = 'pred' GROUP BY ALL),
tl AS (SELECT uid, label, list(entity) AS t FROM items WHERE side = 'gold' GROUP BY ALL),
j AS (SELECT coalesce(pl.uid, tl.uid) AS uid, coalesce(pl.label, tl.label) AS label,
             coalesce(p, []::VARCHAR[]) AS p, coalesce(t, []::VARCHAR[]) AS t
      FROM pl FULL JOIN tl ON pl.uid = tl.uid AND pl.label = tl.label),
c AS (SELECT *, list_sort(list_distinct(list_intersect(p, t))) AS common FROM j),
n AS (SELECT uid, label,
        list_concat(common, list_sort(list_distinct(list_filter(p, lambda x: NOT list_contains(common, x))))) AS np,
        list_concat(common, list_sort(list_distinct(list_filter(t, lambda x: NOT list_contains(common, x))))) AS nt
      FROM c)
SELECT uid, label,
  array_to_string(list_concat(np, list_transform(range(greatest(len(nt) - len(np), 0)), lambda x: 'NONE')), '|') AS pred_list,
  array_to_string(nt, '|') AS true_list
FROM n""")
def align_lists(spark, sf):
    """Aligned predicted / gold entity lists per paper and label."""
    items = _items(spark, sf)
    # rows without a key stay apart by side
    apart = F.when(F.col("uid").isNull() | F.col("label").isNull(), F.col("side"))
    listed = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("entity")))
    j = items.where(F.col("side").isin("pred", "gold")).groupBy("uid", "label", apart.alias("apart")).agg(listed("pred").alias("p"), listed("gold").alias("t"))
    p, t = _align(F.col("p"), F.col("t"))
    return j.select("uid", "label", F.array_join(p, "|").alias("pred_list"), F.array_join(t, "|").alias("true_list"))
