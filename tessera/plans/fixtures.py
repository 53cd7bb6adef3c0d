"""Stand-in inputs derived from the driver's tables (FIXTURES.md part C).

The reference's own inputs (mention records, papers, model outputs, review
sheets) are not shipped, so each is derived deterministically from a driver
table with md5-based choices that DuckDB reproduces. Everything is lazy and
scales with the source table; folds are per order (a bounded group).
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ..functions.fixed import REFUSAL_PREFIXES
from ..functions.text import bind, hex_digit, initial_upper, literal_table, str_array
from ..session import ensure_checkpoint_dir, stored

# Fixed values for the fixtures: the label that plays "not relevant" in F1,
# model thresholds (first md5 hex digit below it = right answer), the alias
# that exercises canonicalisation, and the host label of F7.
FIXTURE_NOT_RELEVANT = "error"
PAIR_MODELS = [("m1", "b"), ("m2", "8"), ("m3", "5")]
SOURCE_MODELS = [("m0", "b"), ("m1", "a"), ("m2", "8"), ("m3", "8"), ("m4", "6")]
TEN_ROW_MODELS = [("m0", "f"), ("m1", "f"), ("m2", "e"), ("m3", "2"), ("m4", "1")]
FIXTURE_ALIASES = {"small kind": "small"}
FIXTURE_HOST = "economy"
FIXTURE_REFUSALS = REFUSAL_PREFIXES


_cache: dict = {}
#: Seconds that writing the derived inputs took, by name (for the bench).
FIXTURE_SECONDS: dict[str, float] = {}


@contextlib.contextmanager
def fresh():
    """Builders called inside start without what earlier queries have built, so
    that a query reads its tables as they are now and pays for its own inputs."""
    global _cache
    held, _cache = _cache, {}
    try:
        yield
    finally:
        _cache = held


def memo(fn):
    """Within one query, reuse the DataFrame a builder returns for the same
    arguments: identical sub-plans, whose exchanges Spark then reuses."""
    @functools.wraps(fn)
    def wrapper(spark, sf_dir, *args):
        ensure_checkpoint_dir(spark)  # checkpoints / scratch tables need it
        key = (fn.__module__, fn.__qualname__, id(spark), sf_dir, args)
        if key not in _cache:
            _cache[key] = fn(spark, sf_dir, *args)
        return _cache[key]
    return wrapper


def materialized(fn):
    """Write a derived input as a parquet table under the shared checkpoint
    directory and read it back. These fixtures stand in for inputs that are
    files in a real run (generation dumps, review sheets); downstream plans
    then scan a table (pruned, parallel) instead of re-running the fold in
    every branch of a query."""
    @functools.wraps(fn)
    def wrapper(spark, sf_dir, *args):
        began = time.perf_counter()
        back = stored(fn(spark, sf_dir, *args), f"fixture-{fn.__name__}")
        FIXTURE_SECONDS[fn.__name__] = FIXTURE_SECONDS.get(fn.__name__, 0.0) + time.perf_counter() - began
        return back
    return wrapper


@memo
def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _models(spark: SparkSession, models) -> DataFrame:
    # A fixed handful of model ids: a constant-size dimension.
    return literal_table(spark, [(m, t, i) for i, (m, t) in enumerate(models)],
                         "model string, thr string, model_rank int")


# ---------------------------------------------------------------- F1 / F2
@memo
def mentions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mention records (id, entity, label, text) from ``events``."""
    ev = load(spark, sf_dir, "events")
    entity = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return ev.select(
        F.col("event_id").alias("id"), entity.alias("entity"), F.col("event_type").alias("label"),
        F.concat(entity, F.lit(" did "), F.col("event_type"), F.lit(" with "), F.col("props"))
        .alias("text"))


@memo
def mention_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordered label vocabulary (label, id) = distinct event types but the
    not-relevant one, id by name."""
    ev = load(spark, sf_dir, "events")
    labels = (ev.select(F.col("event_type").alias("label")).distinct()
              .where(F.col("label") != FIXTURE_NOT_RELEVANT))
    # The window runs over the distinct label set only (a handful of rows).
    return labels.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1)
                         .cast("int").alias("id"))


def vocab_array(vocab: DataFrame, lower: bool = False) -> DataFrame:
    """One-row frame holding the vocabulary as an ordered array column ``vocab``."""
    lab = F.lower(F.col("label")) if lower else F.col("label")
    return vocab.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("id"), lab.alias("l")))),
                                 lambda s: s["l"]).alias("vocab"))


# ---------------------------------------------------------------- F3
def _prev_type(ev: DataFrame) -> DataFrame:
    prev = ev.select((F.col("event_id") + 1).alias("event_id"), F.col("event_type").alias("prev_type"))
    return ev.join(prev, "event_id", "left")


@memo
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, id, true, pred) per event for three models."""
    ev = _prev_type(load(spark, sf_dir, "events").select("event_id", "event_type"))
    m = _models(spark, PAIR_MODELS)
    h = hex_digit(F.concat(F.col("model"), F.lit(":"), F.col("event_id").cast("string")))
    pred = (F.when(h < F.col("thr"), F.col("event_type"))
            .when(h < F.lit("e"), F.coalesce(F.col("prev_type"), F.lit("none")))
            .otherwise(F.lit("none")))
    return ev.crossJoin(F.broadcast(m)).select(  # m: three literal rows
        "model", F.col("event_id").alias("id"), F.col("event_type").alias("true"), pred.alias("pred"))


@memo
def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five models, one row per part: (model, model_rank, num, src, pred, true)."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    m = _models(spark, SOURCE_MODELS)
    h = hex_digit(F.concat(F.col("model"), F.lit(":"), F.col("p_partkey").cast("string")))
    return part.crossJoin(F.broadcast(m)).select(
        "model", "model_rank", (F.col("p_partkey") + 1).alias("num"),
        F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand")).alias("src"),
        F.when(h < F.col("thr"), F.col("p_type")).otherwise(F.lit("none")).alias("pred"),
        F.col("p_type").alias("true"))


@memo
def ten_row_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier ('string') and customer ('kegg') x k in 0..9 x five models."""
    sup = load(spark, sf_dir, "supplier").select(
        F.lit("string").alias("dataset"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    cus = load(spark, sf_dir, "customer").select(
        F.lit("kegg").alias("dataset"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    ents = sup.unionByName(cus)
    sizes = ents.groupBy("dataset").agg(F.count(F.lit(1)).alias("size"))
    nxt = ents.select("dataset", F.col("key").alias("nkey"), F.col("name").alias("next_name"))
    ents = (ents.join(sizes, "dataset")
            .withColumn("nkey", (F.col("key") + 1) % F.col("size"))
            .join(nxt, ["dataset", "nkey"], "left"))
    ks = spark.range(10).select(F.col("id").cast("int").alias("k"))
    m = _models(spark, TEN_ROW_MODELS)
    h = hex_digit(F.concat_ws(":", F.col("model"), F.col("k").cast("string"), F.col("name")))
    wrong = F.when(F.col("key") % 2 == 0, F.col("next_name")).otherwise(F.lit("unknown"))
    return ents.crossJoin(ks).crossJoin(F.broadcast(m)).select(  # 10 x 5 literal rows
        "dataset", "model", "model_rank", (F.col("key") * 10 + F.col("k") + 1).alias("num"),
        F.col("name").alias("src"),
        # every model always knows keys 0, 10, 20 and never 4, 14, 24
        F.when((F.col("key") % 10 == 0) | ((F.col("key") % 10 != 4) & (h < F.col("thr"))), F.col("name")).otherwise(wrong).alias("pred"),
        F.col("name").alias("true"))


@memo
def task_outcomes(spark: SparkSession, sf_dir: str):
    """F3d: per-event correctness of two tasks 'ta' and 'tb'."""
    ev = load(spark, sf_dir, "events").select("event_id")
    a = ev.select(F.col("event_id").alias("pos"),
                  (hex_digit(F.concat(F.lit("ta:"), F.col("event_id").cast("string"))) < "c").alias("ok"))
    b = ev.select(F.col("event_id").alias("pos"),
                  (hex_digit(F.concat(F.lit("tb:"), F.col("event_id").cast("string"))) < "a").alias("ok"))
    return a, b


# ---------------------------------------------------------------- F4
@memo
def mention_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relevant mentions with a raw model response of six shapes."""
    ment = mentions_raw(spark, sf_dir).where(F.col("label") != FIXTURE_NOT_RELEVANT)
    va = vocab_array(mention_vocab(spark, sf_dir))
    df = ment.crossJoin(va)  # one-row vocabulary array
    n = F.size("vocab")
    g = F.array_position(F.col("vocab"), F.col("label")) - 1
    key = F.concat(F.lit("r:"), F.col("id").cast("string"))
    d = F.instr(F.lit("0123456789abcdef"), hex_digit(key, 2)) - 1
    other1 = F.element_at(F.col("vocab"), ((g + 1 + d % 3) % n + 1).cast("int"))
    other2 = F.element_at(F.col("vocab"), ((g + 1 + (d + 1) % 3) % n + 1).cast("int"))
    h = hex_digit(key)
    resp = (F.when(h <= "5", F.concat(F.lit("The answer is "), F.col("label")))
            .when(h <= "7", F.concat(F.col("label"), F.lit(" or "), other1))
            .when(h <= "9", F.concat(other1, F.lit(" and "), other2))
            .when(h == "a", F.lit("I cannot tell."))
            .when(h <= "c", F.concat(F.upper(F.col("label")), F.lit(".")))
            .otherwise(F.concat(F.col("entity"), F.lit(" is a "), F.col("label"))))
    return df.select("id", "entity", "label", "text", resp.alias("response"))


# ---------------------------------------------------------------- F5
@memo
def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag",
        "l_linestatus")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey, "inner")


@memo
def generation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 long form: one annotation and one response line per line item."""
    x = _line_items(spark, sf_dir)
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                      F.col("l_partkey").cast("string"))
    hg = hex_digit(key)
    T, t = initial_upper(F.col("p_type")), F.lower(F.col("p_type"))
    refusal = F.element_at(str_array(FIXTURE_REFUSALS), (F.col("l_linenumber") % 8 + 1).cast("int"))
    line = (F.when(hg <= "3", F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), T, F.lit(": "), F.col("p_name")))
            .when(hg <= "5", F.concat(F.lit('* "'), t, F.lit('": '), F.col("p_name"), F.lit(", "), F.col("p_brand")))
            .when(hg <= "7", F.concat(F.lit("- "), T, F.lit("s: "), F.col("p_name"), F.lit(" strain")))
            .when(hg == "8", F.concat(T, F.lit(": "), refusal, F.lit(" here")))
            .when(hg == "9", F.concat(T, F.lit(" ("), F.col("p_name"), F.lit(")")))
            .when(hg == "a", F.concat(F.lit("The order lists "), F.col("p_name"), F.lit(" among its parts.")))
            .when(hg == "b", F.concat(T, F.lit(" kind: "), F.col("p_name")))
            .otherwise(F.concat(T, F.lit(": "), F.col("p_name"))))
    blank = hex_digit(F.concat(F.lit("e:"), F.col("l_orderkey").cast("string"), F.lit(":"),
                               F.col("l_linenumber").cast("string"))) == "f"
    return x.select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("uid"),
        F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("title"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.when(F.col("l_returnflag") == "N", F.lit("not relevant")).otherwise(F.col("p_type")).alias("anno_label"),
        F.when(blank, F.lit(" ")).otherwise(F.col("p_name")).alias("anno_entity"),
        line.alias("line"))


ANNOTATION_TYPE = ("array<struct<id:bigint,label:string,start_offset:int,end_offset:int,"
                   "entity:string,which_text:string,text:string>>")


@memo
@materialized
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """papers (uid, title, annotations, pred) with a free-text response."""
    g = generation_lines(spark, sf_dir)
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "line",
                     "anno_label", "anno_entity")
    # an order's number names its uid and title
    folded = g.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(order)).alias("items"))
    okey = F.col("l_orderkey").cast("string")
    anno = F.transform(F.col("items"), lambda s: F.struct(
        (s["l_linenumber"]).cast("bigint").alias("id"), s["anno_label"].alias("label"),
        (s["l_linenumber"] * 10).cast("int").alias("start_offset"),
        (s["l_linenumber"] * 10 + F.length(s["anno_entity"])).cast("int").alias("end_offset"),
        s["anno_entity"].alias("entity"), F.lit("abstract").alias("which_text"),
        F.lit(None).cast("string").alias("text")))
    pred = F.array_join(F.transform(F.col("items"), lambda s: s["line"]), "\n")
    return folded.select(F.concat(F.lit("order-"), okey).alias("uid"), F.concat(F.lit("Order "), okey).alias("title"),
                         anno.alias("annotations"), pred.alias("pred"))


@memo
def paper_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of the paper task: lower-case part types, id by name."""
    part = load(spark, sf_dir, "part")
    labels = part.select(F.lower("p_type").alias("label")).distinct()
    return labels.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int").alias("id"))


# ---------------------------------------------------------------- F6
@memo
def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers: title = first line (blank when doc_id % 7 = 0),
    full_text = the rest."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    first = F.substring_index(F.col("text"), "\n", 1)
    rest = F.when(F.instr(F.col("text"), "\n") > 0,
                  F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit(""))
    return docs.select("doc_id", "source",
                       F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(first).alias("title"),
                       rest.alias("full_text"))


@memo
def source_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context limit per document source: 2048 * 2^(k mod 4) for source 'srcK';
    one source in five has no limit (null) to exercise the missing-limit row."""
    docs = load(spark, sf_dir, "documents")
    k = F.regexp_extract(F.col("source"), "([0-9]+)$", 1).cast("int")
    return docs.select("source").distinct().select(
        "source", F.when(k % 5 == 4, F.lit(None).cast("int"))
        .otherwise((F.lit(2048) * F.pow(F.lit(2), k % 4)).cast("int")).alias("limit"))


# ---------------------------------------------------------------- F7
@memo
@materialized
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review sheet rows (title, uid, annotation, prediction, true, wrong,
    rejected) with JSON text cells, folded per order in one aggregation.

    annotation: gold label -> one value per line status (names joined by
    ', '); prediction: part type -> one value of predicted items (some
    upper-cased, some with the brand appended); wrong: JSON fragment of
    names flagged wrong, with a trailing comma."""
    x = _line_items(spark, sf_dir)
    okey = F.col("l_orderkey").cast("string")
    lkey = F.concat(okey, F.lit(":"), F.col("l_linenumber").cast("string"))
    hp = hex_digit(F.concat(F.lit("p:"), lkey))
    # only what the cells are made of goes through the shuffle, by the order's number
    item = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_name", F.lower("p_type").alias("ptype"),
        (F.col("l_returnflag") == "N").alias("none"), "l_linestatus",
        F.when(hp == "0", 0).when(hp <= "9", 1).when(hp <= "b", 2).cast("tinyint").alias("form"),
        F.when(hp == "0", F.col("p_brand")).alias("brand"),
        (hex_digit(F.concat(F.lit("w:"), lkey)) == "3").alias("is_wrong"))
    folded = x.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    folded = bind(folded, ["l_orderkey"], items=F.transform("items", lambda i: F.struct(
        i["p_name"].alias("p_name"), i["ptype"].alias("ptype"), i["l_linestatus"].alias("l_linestatus"),
        F.when(i["none"], F.lit("not relevant")).otherwise(i["ptype"]).alias("glabel"), i["is_wrong"].alias("is_wrong"),
        F.when(i["form"] == 0, F.concat(i["p_name"], F.lit(", "), i["brand"])).when(i["form"] == 1, i["p_name"])
        .when(i["form"] == 2, F.upper(i["p_name"])).alias("pitem"))))
    distinct = lambda its, c: F.sort_array(F.array_distinct(F.transform(its, lambda i: i[c])))
    folded = bind(
        folded, ["l_orderkey", "items"], uid=F.concat(F.lit("order-"), okey), g_labels=distinct(F.col("items"), "glabel"),
        p_items=F.filter("items", lambda i: i["pitem"].isNotNull()), w_items=F.filter("items", lambda i: i["is_wrong"]))

    def q(c: Column) -> Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    def entry(lab: Column, vals: Column) -> Column:
        return F.concat(q(lab), F.lit(": ["), F.array_join(vals, ", "), F.lit("]"))

    its = F.col("items")
    anno = F.concat(F.lit("{"), F.array_join(F.transform(F.col("g_labels"), lambda lab: entry(lab, F.transform(
        F.array_sort(F.array_distinct(F.transform(F.filter(its, lambda i: i["glabel"] == lab), lambda i: i["l_linestatus"]))),
        lambda st: q(F.array_join(F.transform(
            F.filter(its, lambda i: (i["glabel"] == lab) & (i["l_linestatus"] == st)), lambda i: i["p_name"]), ", "))))),
        ", "), F.lit("}"))
    p_items, w_items = F.col("p_items"), F.col("w_items")
    pred = F.concat(F.lit("{"), F.array_join(F.transform(distinct(p_items, "ptype"), lambda lab: entry(lab, F.array(q(F.array_join(
        F.transform(F.filter(p_items, lambda i: i["ptype"] == lab), lambda i: i["pitem"]), ", "))))), ", "), F.lit("}"))
    wrong = F.when(F.size(w_items) > 0, F.concat(F.array_join(F.transform(distinct(w_items, "ptype"), lambda lab: entry(lab, F.transform(
        F.filter(w_items, lambda i: i["ptype"] == lab), lambda i: q(i["p_name"])))), ", "), F.lit(",")))
    return folded.select(F.concat(F.lit("Order "), okey).alias("title"), "uid", anno.alias("annotation"), pred.alias("prediction"),
                         F.lit("{}").alias("true"), wrong.alias("wrong"), (hex_digit("uid") == "0").alias("rejected"))


@memo
def part_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 synonym table: 'red X' and 'blue X' part names mean X (case-insensitive)."""
    part = load(spark, sf_dir, "part")
    return (part.where(F.col("p_name").startswith("red ") | F.col("p_name").startswith("blue "))
            .select(F.lower("p_name").alias("variant"),
                    F.substring_index(F.col("p_name"), " ", -1).alias("canonical"))
            .distinct()
            .select(F.lit("ci").alias("kind"), "variant", "canonical", F.lit(0).alias("prio")))


# ---------------------------------------------------------------- F8
@memo
def echoed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: user turn followed by the next assistant turn; the 'generated' text
    echoes the prompt: prompt || ' ' || completion."""
    conv = load(spark, sf_dir, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    j = u.join(a, ["conv_id", "turn"], "inner")
    return j.select("conv_id", "turn", "prompt", "completion",
                    F.concat(F.col("prompt"), F.lit(" "), F.col("completion")).alias("generated"))


# ---------------------------------------------------------------- M1
_OPTIONS = re.compile(r'"([^"]*)"')


def choice_channel_factory():
    """Deterministic test predictor: picks one of the quoted options of the
    last 'Options:' list in the prompt by the first md5 hex digit of the
    prompt, and echoes the prompt before it (full-text output)."""
    def predict(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            seg = p[p.rfind("Options: ") + len("Options: "):]
            seg = seg[:seg.find(". Text: ")] if ". Text: " in seg else seg
            opts = _OPTIONS.findall(seg) or [""]
            k = int(hashlib.md5(p.encode("utf-8")).hexdigest()[0], 16) % len(opts)
            out.append(p + " " + opts[k])
        return out
    return predict


def failing_channel_factory():
    """Test predictor that answers with the prompt's md5 and raises on a batch with a
    prompt whose md5 begins with ff."""
    def predict(prompts: list[str]) -> list[str]:
        digests = [hashlib.md5(p.encode("utf-8")).hexdigest() for p in prompts]
        if any(d.startswith("ff") for d in digests):
            raise RuntimeError("no answer")
        return [f"answer {d}" for d in digests]
    return predict
