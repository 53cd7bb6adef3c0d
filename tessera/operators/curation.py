"""Curated extraction scoring and the host index (S8 parsing, S9, C1-C9).

The reference walks each reviewed row sequentially, consuming matched
predictions as it goes. The same outcome is expressed relationally:

* a gold item matches when its (paper, label, lower(entity)) key is among the
  predicted keys and it is the key's first occurrence (default), or no
  earlier occurrence of the key was already lower case (``compat``, Q5);
* predictions left over are those whose key no gold item consumed.

Both are decided from per-key aggregates (min position), computed with
partial aggregation and joined back, so a hot key never lands whole in one
window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import HOST_LABEL, NONE_LABEL, NOT_RELEVANT, SPECIES_SYNONYMS
from ..functions.text import bind, literal_table, rstrip_chars, strip
from . import metrics as M

ENTITY_MAP = "map<string,array<string>>"


# ------------------------------------------------------------------ S8 / S9
def parse_json_fragment(c: Column) -> Column:
    """Strip, drop trailing commas, wrap in braces, parse; a null cell is an
    empty map, a broken fragment is null. Of a repeated key the last value stays."""
    body = rstrip_chars(strip(c), ",")
    return F.when(c.isNull(), _EMPTY()).otherwise(_last_values(F.from_json(F.concat(F.lit("{"), body, F.lit("}")), ENTITY_MAP)))


def _EMPTY() -> Column:
    return F.create_map().cast(ENTITY_MAP)


def _last_values(m: Column) -> Column:
    """A parsed JSON map with one entry for each key: the last one written."""
    def last(m: Column) -> Column:
        entries, keys = F.map_entries(m), F.reverse(F.map_keys(m))
        kept = F.filter(entries, lambda e, i: i == F.size(entries) - F.array_position(keys, e["key"]))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(kept)).otherwise(m)

    # as a lambda's variable the map is parsed once, not again in every use
    return F.element_at(F.transform(F.array(m), last), 1)


def parse_review(df: DataFrame) -> DataFrame:
    """S8 cells -> typed columns: annotation / prediction maps, wrong map,
    rejected flag, and ``status``: ok, or the first cell that cannot be parsed
    ('annotation', 'prediction', 'wrong'). Rows that are not ok have a null map
    there and belong in quarantine (``reviewed`` / ``review_quarantine``), not in
    the scores. The 'true' cell is read but unused."""
    rejected = F.coalesce(F.col("rejected").cast("boolean"), F.lit(False))
    parsed = bind(
        df, ["title", "uid"],
        anno_map=_last_values(F.from_json("annotation", ENTITY_MAP)),
        pred_map=_last_values(F.from_json("prediction", ENTITY_MAP)),
        wrong_map=F.when(rejected, _EMPTY()).otherwise(parse_json_fragment(F.col("wrong"))),
        rejected=rejected)
    status = (F.when(F.col("anno_map").isNull(), F.lit("annotation")).when(F.col("pred_map").isNull(), F.lit("prediction"))
              .when(F.col("wrong_map").isNull(), F.lit("wrong")).otherwise(F.lit("ok")))
    return parsed.withColumn("status", status)


def reviewed(parsed: DataFrame) -> DataFrame:
    """The parsed review rows that can be scored."""
    return parsed.where(F.col("status") == "ok")


def review_quarantine(parsed: DataFrame) -> DataFrame:
    """(title, uid, status): rows with a cell that cannot be parsed."""
    return parsed.where(F.col("status") != "ok").select("title", "uid", "status")


# ------------------------------------------------------------------ C1 - C3
def explode_entities(df: DataFrame, map_col: str, side: str, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """(keys, side, label, vpos, npos, entity): every value split on commas,
    stripped, empties dropped; the 'not relevant' label is skipped."""
    m = df.select(*keys, F.explode(F.col(map_col)).alias("label", "vals")) \
        .where(F.col("label") != NOT_RELEVANT)
    v = m.select(*keys, "label", F.posexplode("vals").alias("vpos", "value"))
    n = v.select(*keys, "label", "vpos", F.posexplode(F.split("value", ",")).alias("npos", "raw"))
    return n.select(*keys, F.lit(side).alias("side"), "label", F.col("vpos").cast("int").alias("vpos"),
                    F.col("npos").cast("int").alias("npos"), strip(F.col("raw")).alias("entity")) \
        .where(F.length("entity") > 0)


def synonym_table(spark: SparkSession, entries=SPECIES_SYNONYMS) -> DataFrame:
    """Synonym dimension (kind, variant, canonical, prio): 'ci' variants are
    matched on the lower-cased name, 'exact' sentences verbatim. A later
    entry wins when both match (prio = list position)."""
    rows = []
    for prio, (canonical, variants, sentences) in enumerate(entries):
        rows += [("ci", v.lower(), canonical, prio) for v in variants]
        rows += [("exact", s, canonical, prio) for s in sentences]
    return literal_table(spark, rows, "kind string, variant string, canonical string, prio int")


#: Variants of a synonym table that may be broadcast.
SYNONYM_ROWS = 100_000
#: Names that are looked up apart where the table is larger.
HOT_NAMES = 100


def _hot_names(items: DataFrame, name: Column, most: int) -> list[str]:
    """The most frequent names, by a heavy-hitter sketch of bounded size."""
    top = items.select(name.alias("_n")).agg(F.expr(f"approx_top_k(_n, {most}, {100 * most})").alias("top"))
    return [r["item"] for r in (top.collect()[0].top or []) if r["item"] is not None]


def _looked_up(items: DataFrame, name: Column, table: DataFrame, names: Sequence[str], small: bool, hot_names: int) -> DataFrame:
    """``items`` with the columns ``names`` (canonical, prio) of the variant equal to
    ``name``. A table that is not small is joined by name; the hottest names, at most
    ``hot_names`` rows of it, are broadcast, and their items go to that join under
    salted keys that meet nothing, so they are spread evenly."""
    canonical, prio = names
    table = table.select(F.col("variant").alias("_v"), F.col("canonical").alias(canonical), F.col("prio").alias(prio))
    if small:
        return items.join(F.broadcast(table), name == F.col("_v"), "left").drop("_v")
    hot = _hot_names(items, name, hot_names)
    first = table.where(F.col("_v").isin(hot)).select(F.col("_v").alias("_h"), F.col(canonical).alias("_hc"), F.col(prio).alias("_hp"))
    salt = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    keyed = items.join(F.broadcast(first), name == F.col("_h"), "left").withColumn("_k", F.when(name.isin(hot), salt).otherwise(name))
    j = keyed.join(table.hint("merge"), F.col("_k") == F.col("_v"), "left")
    return j.withColumns({canonical: F.coalesce("_hc", canonical), prio: F.coalesce("_hp", prio)}).drop("_h", "_hc", "_hp", "_k", "_v")


def apply_synonyms(items: DataFrame, synonyms: DataFrame, broadcast_rows: int = SYNONYM_ROWS, hot_names: int = HOT_NAMES) -> DataFrame:
    """Canonicalise ``entity`` by the synonym table, then C3: keep one copy
    per source value (distinct within a value, not across values)."""
    syn = synonyms.groupBy("kind", "variant").agg(F.max_by("canonical", "prio").alias("canonical"),
                                                   F.max("prio").alias("prio"))
    small = syn.limit(broadcast_rows + 1).count() <= broadcast_rows
    j = _looked_up(items, F.lower(F.col("entity")), syn.where(F.col("kind") == "ci"), ["_c1", "_p1"], small, hot_names)
    j = _looked_up(j, F.col("entity"), syn.where(F.col("kind") == "exact"), ["_c2", "_p2"], small, hot_names)
    canon = (F.when(F.col("_c1").isNotNull() & (F.col("_c2").isNull() | (F.col("_p1") >= F.col("_p2"))), F.col("_c1"))
             .when(F.col("_c2").isNotNull(), F.col("_c2")).otherwise(F.col("entity")))
    cols = [c for c in items.columns if c not in ("entity", "npos")]
    return (j.select(*cols, "npos", canon.alias("entity"))
            .groupBy(*cols, "entity").agg(F.min("npos").alias("npos")))


def explode_sides(review: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """C1 for the three sides (gold, pred, wrong) in one pass over the rows."""
    sides = F.array(F.struct(F.lit("gold").alias("side"), F.col("anno_map").alias("m")),
                    F.struct(F.lit("pred").alias("side"), F.col("pred_map").alias("m")),
                    F.struct(F.lit("wrong").alias("side"), F.col("wrong_map").alias("m")))
    s = review.select(*keys, F.inline(sides))
    m = s.select(*keys, "side", F.explode("m").alias("label", "vals")).where(F.col("label") != NOT_RELEVANT)
    v = m.select(*keys, "side", "label", F.posexplode("vals").alias("vpos", "value"))
    n = v.select(*keys, "side", "label", "vpos", F.posexplode(F.split("value", ",")).alias("npos", "raw"))
    return bind(n, [*keys, "side", "label"], vpos=F.col("vpos").cast("int"), npos=F.col("npos").cast("int"),
                entity=strip(F.col("raw"))).where(F.length("entity") > 0)


def curated_items(review: DataFrame, synonyms: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """C1-C3 for the three sides of parsed review rows."""
    return apply_synonyms(explode_sides(review, keys), synonyms)


# ------------------------------------------------------------------ C4
def single_host(items: DataFrame, host_label: str = HOST_LABEL, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """C4: (keys, side, host) where the side lists exactly one host item
    (counted over the multiset left by C3)."""
    return (items.where((F.col("label") == host_label) & F.col("side").isin("gold", "pred"))
            .groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("_n"), F.min("entity").alias("host"))
            .where(F.col("_n") == 1).select(*keys, "side", "host"))


# ------------------------------------------------------------------ C5 - C7
def _scored(items: DataFrame, flags: DataFrame | None, compat: bool, keys: Sequence[str]) -> DataFrame:
    """The gold items and the predictions that no gold item consumed, scored: (keys, side,
    label, entity, vpos, npos, pred, true, accepted).

    What the rows of a key (keys, label, lower(entity)) say of each other is one
    aggregate of all sides, joined back once. Items that have a column ``rejected`` bring
    their review's flag along; others get it from ``flags``."""
    k = [*keys, "label", "lkey"]
    rows = items.withColumn("lkey", F.lower(F.col("entity")))
    on, pos = (lambda side: F.col("side") == side), F.struct("vpos", "npos")
    gold, low = on("gold"), F.col("entity") == F.col("lkey")
    stats = rows.groupBy(*k).agg(
        F.min(F.when(gold, pos)).alias("first"), F.min(F.when(gold & low, pos)).alias("first_lower"),
        F.max(on("pred")).alias("_has_pred"), F.max(on("wrong")).alias("_wrong"))
    j = rows.where(gold & F.col("lkey").isNotNull() | on("pred")).join(stats, k, "left")
    if "rejected" not in items.columns:
        j = j.join(flags, list(keys), "left")
    rejected, is_wrong = (F.coalesce(F.col(c), F.lit(False)) for c in ("rejected", "_wrong"))
    consumed = F.col("first_lower" if compat else "first").isNotNull()
    first_ok = (F.col("first_lower").isNull() | (pos <= F.col("first_lower"))) if compat else pos == F.col("first")
    known = F.col("label").isNotNull()
    for c in keys:
        known = known & F.col(c).isNotNull()
    j = j.where(F.when(gold, known).otherwise(~consumed))
    right = F.when(gold, F.coalesce(F.col("_has_pred"), F.lit(False)) & first_ok).otherwise(~is_wrong) & ~rejected
    return j.select(*keys, "side", "label", "entity", "vpos", "npos", F.col("label").alias("pred"),
                    F.when(right, F.col("label")).otherwise(F.lit(NONE_LABEL)).alias("true"), (~is_wrong & ~rejected).alias("accepted"))


def score_gold(items: DataFrame, flags: DataFrame | None, compat: bool = False,
               keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Every gold item scored. pred column = its label; true column = the
    label when matched and the row is accepted, else 'none'."""
    return _scored(items, flags, compat, keys).where(F.col("side") == "gold").drop("accepted")


def remaining_predictions(items: DataFrame, compat: bool = False, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Predictions not consumed by a gold match (left anti join on the key).

    Default: any gold item with the key consumes it. compat (Q5): only a gold
    item whose entity is already lower case does."""
    k = [*keys, "label", "lkey"]
    rows = items.withColumn("lkey", F.lower(F.col("entity")))
    gold = rows.where(F.col("side") == "gold")
    if compat:
        gold = gold.where(F.col("entity") == F.col("lkey"))
    return rows.where(F.col("side") == "pred").join(gold.select(*k).distinct(), k, "left_anti")


def score_remaining(items: DataFrame, flags: DataFrame | None, compat: bool = False,
                    keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Leftover predictions: 'none' if listed wrong or the row is
    rejected, else the label. Adds ``accepted``."""
    return _scored(items, flags, compat, keys).where(F.col("side") == "pred")


def curated_pairs(items: DataFrame, flags: DataFrame | None, compat: bool = False,
                  keys: Sequence[str] = ("uid",)) -> DataFrame:
    """C5 + C7 as one long (pred, true) table, lower-cased (C9 input)."""
    pairs = _scored(items, flags, compat, keys).drop("accepted")
    return pairs.withColumn("pred", F.lower("pred")).withColumn("true", F.lower("true"))


# ------------------------------------------------------------------ C8, C9
def host_index_rows(items: DataFrame, flags: DataFrame | None, titles: DataFrame, host_label: str = HOST_LABEL,
                    compat: bool = False, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """C8 long form (species, type, name, title, keys, side): gold items of
    single-host papers always; leftover predictions only when accepted."""
    hosts = single_host(items, host_label, keys).join(titles, list(keys), "left")
    cols = [*keys, "side", "label", "entity"]
    gold = items.where(F.col("side") == "gold").select(*cols)
    rem = score_remaining(items, flags, compat, keys).where(F.col("accepted")).select(*cols)
    rows = gold.unionByName(rem).join(hosts, [*keys, "side"])
    return rows.select(F.col("host").alias("species"), F.col("label").alias("type"), F.col("entity").alias("name"), "title", *keys, "side")


def host_index(rows: DataFrame, parts: int = 1) -> DataFrame:
    """C8 nested form for the K3 sink: (species, part, tools) with a sorted
    tools array of {type, name, references[title, uid]}.

    The caller gives the number of hash parts that every species has, so the
    shape of the records does not depend on the data: 1 is the original's file
    (one record a species), more keep a record small where a species is large.
    The long form (``host_index_rows``) is the primary, unfolded output."""
    tagged = rows.withColumn("part", F.pmod(F.xxhash64("uid", "type", "name"), F.lit(parts).cast("long")))
    tool = F.struct(F.col("type"), F.col("name"), F.array(F.col("title"), F.col("uid")).alias("references"))
    return tagged.groupBy("species", "part").agg(F.sort_array(F.collect_list(tool)).alias("tools"))


def curated_scores(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The ten scores over curated pairs."""
    return M.compute_metrics(pairs, keys)


def review_flags(review: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    return review.select(*keys, "rejected")
