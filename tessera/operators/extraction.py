"""Free-text extraction parsing and annotation matching.

Parsing is a chain of row-local expressions over exploded lines; the only
shuffles are the (uid, label, value) de-duplication and the matching joins.
Containment is a dictionary search (``operators.search``), never a comparison of all
pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import LABEL_ALIASES, NOT_RELEVANT, PLURAL_EXEMPT, REFUSAL_PREFIXES
from ..functions.text import WS_CLASS, bind, map_values, split_lines, strip
from .responses import vocab_column
from .search import Terms, contained


# ------------------------------------------------------------------ G1-G5
def response_lines(df: DataFrame, text: str = "pred", keys: Sequence[str] = ("uid",),
                   carry: Sequence[str] = ()) -> DataFrame:
    """G1: (keys, pos, line): stripped non-empty lines, ``pos`` 0-based.
    ``carry`` columns ride along (e.g. a one-row vocabulary array)."""
    ex = df.select(*keys, *carry, F.posexplode(split_lines(F.col(text))).alias("pos", "raw"))
    lines = bind(ex, [*keys, *carry], pos=F.col("pos").cast("long"), line=strip(F.col("raw")))
    return lines.select(*keys, "pos", "line", *carry).where(F.length("line") > 0)


def clean_line(c: Column) -> Column:
    """Drop leading digits/asterisks, then leading whitespace/dots/hyphens,
    then every double quote (one pass each, in that order)."""
    x = F.regexp_replace(c, "^[\\p{Nd}*]+", "")
    x = F.regexp_replace(x, "^" + WS_CLASS[:-1] + ".-]*", "")
    return F.replace(x, F.lit('"'), F.lit(""))


def canonical_label(c: Column, aliases: Mapping[str, str] = LABEL_ALIASES,
                    plural_exempt: Sequence[str] = PLURAL_EXEMPT) -> Column:
    """Lower case, drop one trailing 's' (not for exempt labels), then
    rewrite aliases. The plural rule runs first."""
    return map_values(_singular(F.lower(c), plural_exempt), aliases)


def _singular(low: Column, plural_exempt: Sequence[str] = PLURAL_EXEMPT) -> Column:
    return F.when(low.endswith("s") & ~low.isin(list(plural_exempt)), low.substr(F.lit(1), F.length(low) - 1)).otherwise(low)


def _starts_with_vocab(low: Column, vocab) -> Column:
    if isinstance(vocab, (list, tuple)):
        out = F.lit(False)
        for lab in vocab:
            out = out | F.startswith(low, F.lit(lab.lower()))
        return out
    voc = vocab if isinstance(vocab, Column) else vocab_column(vocab)
    return F.exists(voc, lambda lab: F.startswith(low, lab))


def classify_lines(gens: DataFrame, vocab, aliases: Mapping[str, str] = LABEL_ALIASES,
                   refusals: Sequence[str] = REFUSAL_PREFIXES, text: str = "pred",
                   keys: Sequence[str] = ("uid",)) -> DataFrame:
    """G1-G7 on every line: (keys, pos, line, label, value, status) with
    status ok / no_label / no_separator / unknown_label / refusal."""
    carry = [vocab] if isinstance(vocab, str) else []
    if carry:  # lower-case the vocabulary once per document, not per line
        gens = gens.withColumn(vocab, F.transform(F.col(vocab), lambda lab: F.lower(lab)))
    lines = response_lines(gens, text, keys, carry)
    base = [*keys, "pos", "line", *carry]
    x = bind(lines, base, _c=clean_line(F.col("line")))
    c = F.col("_c")
    colon = F.instr(c, ":")
    low_vocab = vocab if not carry else F.col(vocab)
    # what an expression uses often is bound first: the steps of ``canonical_label`` too
    x = bind(x, [*base, "_c"], _low=F.lower(c), _written=F.lower(strip(c.substr(F.lit(1), colon - 1))),
             _value=strip(c.substr(colon + 1, F.length(c) + 1)))
    x = bind(x, [*base, "_value"], _is_label=_starts_with_vocab(F.col("_low"), low_vocab), _sep=F.contains(c, F.lit(": ")),
             _one=_singular(F.col("_written")), _low_value=F.lower("_value"))
    x = bind(x, [*base, "_value", "_is_label", "_sep", "_low_value"], _label=map_values("_one", aliases))
    in_vocab = (F.col("_label").isin([v.lower() for v in vocab]) if isinstance(vocab, (list, tuple))
                else F.array_contains(F.col(vocab), F.col("_label")))
    low_value = F.col("_low_value")
    refusal = F.lit(False)
    for r in refusals:
        refusal = refusal | F.startswith(low_value, F.lit(r))
    status = (F.when(~F.col("_is_label"), F.lit("no_label"))
              .when(~F.col("_sep"), F.lit("no_separator"))
              .when(~in_vocab, F.lit("unknown_label"))
              .when(refusal, F.lit("refusal"))
              .otherwise(F.lit("ok")))
    return x.select(*keys, "pos", "line", F.when(F.col("_sep"), F.col("_label")).alias("label"),
                    F.when(F.col("_sep"), F.col("_value")).alias("value"), status.alias("status"))


def parse_extractions(gens: DataFrame, vocab, aliases: Mapping[str, str] = LABEL_ALIASES,
                      refusals: Sequence[str] = REFUSAL_PREFIXES, text: str = "pred",
                      keys: Sequence[str] = ("uid",)) -> DataFrame:
    """(keys, label, value, first_pos): distinct values per label,
    case-sensitive, ordered by first occurrence."""
    return distinct_values(classify_lines(gens, vocab, aliases, refusals, text, keys), keys)


def distinct_values(classified: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """The values of the lines that are extractions, once each."""
    return classified.where(F.col("status") == "ok").groupBy(*keys, "label", "value").agg(F.min("pos").alias("first_pos"))


def unparsed_lines(classified: DataFrame) -> DataFrame:
    """Lines that yield no extraction, with the reason."""
    return classified.where(F.col("status") != "ok")


def empty_papers(papers: DataFrame, parsed: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Papers without any extraction."""
    return papers.join(parsed.select(*keys).distinct(), list(keys), "left_anti")


# ------------------------------------------------------------------ A1, A2, P11
def annotation_rows(gens: DataFrame, lower_label: bool = True, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Flattened annotations with a stripped entity; empty entities skipped."""
    ex = gens.select(*keys, F.posexplode("annotations").alias("apos", "a"))
    lab = F.lower(F.col("a.label")) if lower_label else F.col("a.label")
    return bind(ex, [*keys, "apos"], label=lab, entity=strip(F.col("a.entity"))).where(F.length("entity") > 0)


def group_annotations(gens: DataFrame, lower_label: bool = True, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """A1: distinct (keys, label, entity); 'not relevant' groups kept.

    ``lower_label=False`` keeps the annotation label's case (quirk Q3)."""
    return annotation_rows(gens, lower_label, keys).select(*keys, "label", "entity").distinct()


def relevant_papers(gens: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Papers with at least one usable annotation whose label is not
    'not relevant'."""
    rows = annotation_rows(gens, False, keys)
    return (rows.groupBy(*keys)
            .agg(F.max((F.col("label") != NOT_RELEVANT).cast("int")).alias("_rel"))
            .where(F.col("_rel") == 1).select(*keys))


def multi_label_entities(gens: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """A2: entities annotated with more than one label in a paper."""
    rows = annotation_rows(gens, True, keys)
    agg = rows.groupBy(*keys, "entity").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return agg.where(F.size("labels") > 1).select(
        *keys, "entity", F.size("labels").cast("long").alias("n_labels"),
        F.array_join("labels", "|").alias("labels"))


# ------------------------------------------------------------------ A3, A4
def match_contained(gold: DataFrame, parsed: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """A3: (keys, label, entity, value) for every predicted value of the same
    paper and label that contains the gold entity (case-sensitive); a gold
    entity repeats once per containing value (quirk Q4).

    Entities and values of a (paper, label) meet in one sorted stream; groups of any
    size are dealt out by ``search.contained``."""
    k = [*keys, "label"]
    found = contained(gold.select(*k, F.col("entity").alias("term")), parsed.select(*k, F.col("value").alias("text")), k)
    return found.select(*k, F.col("term").alias("entity"), F.col("text").alias("value"))


def extraction_table(papers: DataFrame, annotations: DataFrame, extractions: DataFrame,
                     keys: Sequence[str] = ("uid",), relevant_only: bool = True) -> DataFrame:
    """A4: one row per paper: annotation / prediction / true maps as JSON text with
    sorted keys; prediction values keep first-seen order, matched lists are sorted and
    keep multiplicity (A3).

    ``papers`` (keys, title), ``annotations`` (keys, label, entity; the label as written)
    and ``extractions`` (keys, label, value, pos), both with repeats, meet in one shuffle
    by paper and are folded as they pass, sorted; a paper's own row is all that a task
    holds. With ``relevant_only``, papers without an annotation but 'not relevant' have
    no row (P11)."""
    k = list(keys)
    null = lambda t: F.lit(None).cast(t)
    rows = papers.select(*k, F.lit(0).alias("kind"), null("string").alias("label"), null("long").alias("pos"), F.col("title").alias("text"))
    rows = rows.unionByName(annotations.where(F.col("label").isNotNull() & (F.length("entity") > 0)).select(
        *k, F.when(F.col("label") == NOT_RELEVANT, 1).otherwise(2).alias("kind"), F.lower("label").alias("label"), null("long").alias("pos"), F.col("entity").alias("text")))
    rows = rows.unionByName(extractions.where(F.col("label").isNotNull()).select(*k, F.lit(3).alias("kind"), "label", F.col("pos").cast("long").alias("pos"), F.col("value").alias("text")))
    rows = rows.repartition(*k).sortWithinPartitions(*k, "kind", "label", "pos", "text")
    names = ("annotation", "prediction", "true")
    entries = pa.list_(pa.struct([("k", pa.string()), ("v", pa.list_(pa.string()))]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paper, out, schema = None, [], None
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in k), ("title", pa.string()), *((n, entries) for n in names)])
            for r in batch.to_pylist():
                key = tuple(r[c] for c in k)
                if paper is None or paper.key != key:
                    out += paper.rows(k, relevant_only) if paper else []
                    paper = _Paper(key)
                paper.add(r)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        out += paper.rows(k, relevant_only) if paper else []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in k)
    found = rows.mapInArrow(fold, f"{kinds}, title string, " + ", ".join(f"{n} array<struct<k:string,v:array<string>>>" for n in names))
    return found.select("title", *k, *[F.to_json(F.map_from_entries(F.col(n))).alias(n) for n in names])


class _Paper:
    """One paper of the fold in ``extraction_table``; rows come sorted by kind, label,
    position and text."""

    def __init__(self, key: tuple):
        self.key, self.titles, self.relevant = key, [], False
        self.gold: dict[str, dict[str, None]] = {}
        self.pred: dict[str, dict[str, None]] = {}

    def add(self, r: dict) -> None:
        if r["kind"] == 0:
            self.titles.append(r["text"])
        else:
            self.relevant |= r["kind"] == 2
            side = self.pred if r["kind"] == 3 else self.gold
            side.setdefault(r["label"], {})[r["text"]] = None

    def rows(self, keys: list[str], relevant_only: bool) -> list[dict]:
        if relevant_only and not self.relevant:
            return []
        found = {}
        for label, values in self.pred.items():
            terms = Terms(self.gold.get(label, ()))
            found[label] = sorted(e for v in values for e in terms.found(v))
        cells = {
            "annotation": [{"k": label, "v": sorted(v)} for label, v in sorted(self.gold.items())],
            "prediction": [{"k": label, "v": list(v)} for label, v in sorted(self.pred.items())],
            "true": [{"k": label, "v": v} for label, v in sorted(found.items())],
        }
        return [dict(zip(keys, self.key)) | {"title": t} | cells for t in self.titles]


# ------------------------------------------------------------------ A5
def find_mentions(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A5: (doc_key, item_key) for every item text contained in a document (an empty
    item is in none). Documents are searched for all item texts at a time."""
    d = docs.select(F.col(doc_key).alias("_d"), F.col(doc_text).alias("text"))
    it = items.select(F.col(item_key).alias("_i"), F.col(item_text).alias("term"))
    hits = contained(it.select("term"), d, keep=["_d"])
    return hits.join(it, "term").select(F.col("_d").alias(doc_key), F.col("_i").alias(item_key)).distinct()


__all__ = ["response_lines", "clean_line", "canonical_label", "classify_lines", "parse_extractions", "unparsed_lines",
           "empty_papers", "annotation_rows", "group_annotations", "relevant_papers",
           "multi_label_entities", "match_contained", "extraction_table", "find_mentions",
           "extraction_scores", "classify_lines"]


def extraction_scores(gold: DataFrame, parsed: DataFrame, vocab_row: DataFrame,
                      keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Per-label precision / recall / F1 of free-text extraction.

    precision = predicted values containing a gold entity / predicted values;
    recall = gold entities found in a predicted value / gold entities (gold
    restricted to the vocabulary). Only per-label aggregates leave the join."""
    matches = match_contained(gold, parsed, keys)
    g = (gold.crossJoin(vocab_row).where(F.array_contains(F.col("vocab"), F.col("label")))
         .groupBy("label").agg(F.count(F.lit(1)).alias("n_gold")))
    p = parsed.groupBy("label").agg(F.count(F.lit(1)).alias("n_pred"))
    m = matches.groupBy("label").agg(
        F.count_distinct(*keys, "entity").alias("matched_gold"),
        F.count_distinct(*keys, "value").alias("matched_pred"))
    labs = g.select("label").union(p.select("label")).distinct()
    j = labs.join(g, "label", "left").join(p, "label", "left").join(m, "label", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    prec = F.coalesce(F.try_divide(z("matched_pred").cast("double"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(z("matched_gold").cast("double"), F.col("n_gold")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return j.select("label", z("n_gold").alias("n_gold"), z("n_pred").alias("n_pred"),
                    z("matched_gold").alias("matched_gold"), z("matched_pred").alias("matched_pred"),
                    F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
                    F.round(f1, 6).alias("f1"))
