"""Registered source/sink round trips and the streaming score: K1-K9,
S2-S8, ST1. Each writes to a fresh directory under the checkpoint dir."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import REPORT_ROWS_START
from ..functions.text import literal_table
from ..operators import crossmodel as XM
from ..operators import curation as C
from ..operators import metrics as M
from ..operators import sampling as D
from ..sources import readers as S
from ..sources import sinks as K
from ..sources.records import read_csv
from ..session import scratch_path, stored
from ..streaming.scores import cleaned_pairs
from ..streaming.scores import stream_scores as _stream_scores
from . import fixtures as fx
from .fixtures import PAIR_MODELS, memo
from .oracle import LINES, MENTIONS, PAIRS, SOURCE_PAIRS, VOCAB, metrics_sql
from .q_crossmodel import GROUPS
from .q_curation import BASE as CURATION
from .q_curation import host_index as _host_index_rows
from .q_extraction import extraction_table as _extraction_table
from .q_metrics import CONF_LABELS, confusion_long
from .q_text import CLEANED
from .registry import ORACLE, register


@memo
def _numbered(spark, sf):
    """The pairs of all models, numbered by id within each model."""
    return stored(D.running_total(fx.model_pairs(spark, sf), F.lit(1), ["id"], ["model"], "num"), "numbered")


@memo
def _reports3(spark, sf):
    """A folder with a three-column report for each model (a handful)."""
    base, rows = scratch_path(spark, "reports3"), _numbered(spark, sf)
    scores = stored(M.compute_metrics(rows, ["model"]), "scores")
    info = {"n_shots": 0, "batch_size": 8, "data_name": "kbase", "num_classes": 4, "generation_config": {"max_new_tokens": 10}}

    def lines(m):
        mine = rows.where(F.col("model") == m)
        texts = mine.select("num", F.concat(F.lit("user_"), F.col("id")).alias("entity"), "pred", "true")
        return K.report_lines(spark, mine.select("num", "pred", "true"), scores.where(F.col("model") == m), info, task_prompt="(zero-shot)", originals=texts)

    return _write_all(lines, [m for m, _ in PAIR_MODELS], base)


def _write_all(lines, models, base):
    """The reports of all models (a handful) in one write; model: folder."""
    K.write_reports(reduce(DataFrame.unionByName, [lines(m).withColumn("model", F.lit(m)) for m in models]), base, "model")
    return {m: f"{base}/model={m}" for m in models}


def _read_reports3(spark, sf):
    models = _reports3(spark, sf)
    return XM.tag_union(S.read_report(spark, list(models.values()), cols=3), models)


@register("report_roundtrip3", f"""WITH {PAIRS}
SELECT model, row_number() OVER (PARTITION BY model ORDER BY id) AS num, lower(pred) AS pred, lower("true") AS "true" FROM pairs""")
def report_roundtrip3(spark, sf):
    """K4 + S5 + X1: a three-column run report for each model, parsed back as one table."""
    return _read_reports3(spark, sf).select("model", "num", "pred", "true")


_rc, _rs = metrics_sql("lowered", ["model"])
_BOARD_SQL = _rs.replace(", 6)", ", 4)").replace(
    "SELECT model, CAST(sum(support) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS correct,\n  CAST(count(*) AS BIGINT) AS n_classes,",
    "SELECT model,")


@register("leaderboard_from_reports", f"""WITH {PAIRS},
lowered AS (SELECT model, lower(pred) AS pred, lower("true") AS "true" FROM pairs),
{_rc}
{_BOARD_SQL}""")
def leaderboard_from_reports(spark, sf):
    """X1 -> E10 -> K6: a folder of reports scored by model, written as one JSON
    object and read back."""
    board = M.compute_metrics(_read_reports3(spark, sf), keys=["model"], digits=None)
    path = scratch_path(spark, "leaderboard")
    K.write_leaderboard(board, path)
    back = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("model", "m"))
    return back.select("model", *[F.col("m")[c].alias(c) for c in M.METRIC_NAMES])


@register("report_header", f"""WITH {PAIRS},
{_rc.replace("FROM lowered", "FROM pairs")},
sc AS ({_rs}),
h AS (SELECT * FROM (VALUES (0, '>> N-shots: 0'), (1, '>> Number of processes: 1'),
  (2, '>> Batch size per process: 8, Total batch size: 8'), (3, '>> Test sample size: -1'),
  (4, '>> Number of KBase classes: 4'), (5, '>> Execution time: '), (6, '>> Generation configuration:'),
  (7, '{{''max_new_tokens'': 10}}'), (8, '>> Task prompt:'), (9, '(zero-shot)'), (10, '{"-" * 68}')) t(i, line)),
f AS (SELECT model, unnest([11, 12, 13, 14, 15, 16, 17]) AS i, unnest([
  format('>>             Accuracy: {{:.4f}}', accuracy),
  format('>> (macro)    Precision: {{:.4f}}, Recall: {{:.4f}}, F1: {{:.4f}}', macro_p, macro_r, macro_f),
  format('>> (micro)    Precision: {{:.4f}}, Recall: {{:.4f}}, F1: {{:.4f}}', micro_p, micro_r, micro_f),
  format('>> (weighted) Precision: {{:.4f}}, Recall: {{:.4f}}, F1: {{:.4f}}', weighted_p, weighted_r, weighted_f),
  '{"=" * 68}', 'Num, Pred, True:', '{"*" * 68}']) AS line FROM sc)
SELECT model, CAST(i AS BIGINT) AS i, line FROM (SELECT DISTINCT model FROM pairs) CROSS JOIN h
UNION ALL SELECT model, CAST(i AS BIGINT), line FROM f""")
def report_header(spark, sf):
    """K4: header, configuration and metric block of each written report."""
    models = _reports3(spark, sf)
    lines = XM.tag_union(S.report_text(spark, list(models.values())), models, "report")
    at = F.struct("part", "block", "mid")
    end = lines.where(F.col("line") == REPORT_ROWS_START).groupBy("model").agg(F.min(at).alias("end"))
    head = lines.join(F.broadcast(end), "model").where(at <= F.col("end"))  # a fixed number of lines for each model
    i = F.row_number().over(Window.partitionBy("model").orderBy("part", "block", "mid")) - 1
    return head.select("model", i.cast("long").alias("i"), "line")


@register("report_roundtrip4", f"""WITH {SOURCE_PAIRS}
SELECT model, num, src, pred, "true" FROM spairs""")
def report_roundtrip4(spark, sf):
    """K4 + S6 + X1: four-column reports whose source holds ', ', parsed back."""
    rows = stored(fx.source_pairs(spark, sf), "source-pairs")
    scores = stored(M.compute_metrics(rows, ["model"]), "scores")
    info = {"n_shots": 0, "batch_size": 8, "data_name": "string"}
    of = lambda df, m: df.where(F.col("model") == m)
    lines = lambda m: K.report_lines(spark, of(rows, m).select("num", "src", "pred", "true"), of(scores, m), info, with_src=True)
    models = _write_all(lines, [m for m, _ in fx.SOURCE_MODELS], scratch_path(spark, "reports4"))
    return XM.tag_union(S.read_report(spark, list(models.values()), cols=4), models).select("model", "num", "src", "pred", "true")


LOOSE = f"""{SOURCE_PAIRS},
ll AS (SELECT model, num, CASE WHEN (num - 1) % 11 = 0 THEN split_part(src, ', ', 1) || ',' || split_part(src, ', ', 2) || ',' || pred || ',' || "true"
                   WHEN (num - 1) % 7 = 0 THEN split_part(src, ', ', 1) || ',,' || pred || ',' || "true"
                   ELSE split_part(src, ', ', 1) || ',' || pred || ',' || "true" END AS line
       FROM spairs),
lp AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY num) AS pos, line,
              string_split(replace(line, ',,', ','), ',') AS parts FROM ll)"""


def _write_loose(spark, rows, body, path, two_fields=False):
    head = literal_table(spark, [(0, "Pred, True:" if two_fields else "Src, Pred, True:"), (1, REPORT_ROWS_START)], "o long, value string")
    lines = head.unionByName(rows.select((F.col("num") + 1).alias("o"), body.alias("value")))
    lines.orderBy("o").select("value").write.mode("overwrite").text(path)


@memo
def _loose3(spark, sf):
    """A loose three-field report for each of the five models."""
    base = scratch_path(spark, "loose")
    models = {m: f"{base}/{m}" for m, _ in fx.SOURCE_MODELS}
    name, brand, k = F.substring_index("src", ", ", 1), F.substring_index("src", ", ", -1), F.col("num") - 1
    line = (F.when(k % 11 == 0, F.concat_ws(",", name, brand, "pred", "true"))
            .when(k % 7 == 0, F.concat(name, F.lit(",,"), F.concat_ws(",", "pred", "true")))
            .otherwise(F.concat_ws(",", name, "pred", "true")))
    for m, path in models.items():
        _write_loose(spark, fx.source_pairs(spark, sf).where(F.col("model") == m), line, path)
    return XM.tag_union(S.read_report_loose(spark, list(models.values()), 3), models)


@register("report_loose", f"""WITH {LOOSE}
SELECT model, pos, line, len(parts) = 3 AS ok,
       CASE WHEN len(parts) = 3 THEN trim(parts[1]) END AS src,
       CASE WHEN len(parts) = 3 THEN trim(parts[2]) END AS pred,
       CASE WHEN len(parts) = 3 THEN trim(parts[3]) END AS "true" FROM lp""")
def report_loose(spark, sf):
    """Loose comma reports with ',,' noise; wrong field counts are kept as
    quarantined rows, each with its line number."""
    return _loose3(spark, sf).select("model", "pos", "line", "ok", "src", "pred", "true")


@register("agreement_from_reports", f"""WITH {LOOSE},
ta AS (SELECT pos, len(parts) = 3 AS good, trim(parts[-2]) = trim(parts[-1]) AS ok FROM lp WHERE model = 'm0'),
tb AS (SELECT row_number() OVER (ORDER BY num) AS pos, pred = "true" AS ok FROM spairs WHERE model = 'm1'),
j AS (SELECT ta.ok AS a, tb.ok AS b FROM ta JOIN tb USING (pos) WHERE good)
SELECT 'all' AS rows, CAST(count(*) AS BIGINT) AS n, CAST(sum((a = b)::INT) AS BIGINT) AS agree, round(avg((a = b)::INT), 6) AS rate FROM j
UNION ALL SELECT 'first right', CAST(count(*) AS BIGINT), CAST(sum((a = b)::INT) AS BIGINT), round(avg((a = b)::INT), 6) FROM j WHERE a
UNION ALL SELECT 'unmatched', CAST(count(*) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM ta WHERE NOT good""")
def agreement_from_reports(spark, sf):
    """S7 -> E11 / E12: two tasks' reports (three and two fields) joined on the
    original line, so a quarantined line of one does not shift the other."""
    a = _loose3(spark, sf).where(F.col("model") == "m0")
    path = scratch_path(spark, "loose2")
    _write_loose(spark, fx.source_pairs(spark, sf).where(F.col("model") == "m1"), F.concat_ws(",", "pred", "true"), path, True)
    b = S.read_report_loose(spark, path, 2)
    ok = (F.col("pred") == F.col("true")).alias("ok")
    ta, tb = a.where("ok").select("pos", ok), b.where("ok").select("pos", ok)
    lost = a.where("not ok").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("agree"), F.lit(0.0).alias("rate"))
    parts = [("all", M.agreement(ta, tb, ["pos"])), ("first right", M.conditional_agreement(ta, tb, ["pos"])), ("unmatched", lost)]
    return reduce(DataFrame.unionByName, [x.select(F.lit(n).alias("rows"), "n", "agree", "rate") for n, x in parts])


@register("pairs_files", f"""WITH {GROUPS}
SELECT CASE WHEN pred = "true" THEN 'right' ELSE 'wrong' END AS kind, src || ', ' || pred AS line FROM complete WHERE n_preds = 1""")
def pairs_files(spark, sf):
    """X3 -> K7: the two lists of unanimous answers written and read back."""
    right, wrong = XM.unanimous(fx.source_pairs(spark, sf))
    out = []
    for kind, rows in (("right", right), ("wrong", wrong)):
        path = scratch_path(spark, f"pairs-{kind}")
        K.write_pairs(rows, path)
        out.append(spark.read.text(path).select(F.lit(kind).alias("kind"), F.col("value").alias("line")))
    return out[0].unionByName(out[1])


@register("confusion_files", ORACLE.get("confusion_long"))
def confusion_files(spark, sf):
    """E8 -> K5: confusion tables written (long and wide) and the long one read back."""
    path = scratch_path(spark, "confusion")
    K.write_confusion(confusion_long(spark, sf), CONF_LABELS, path)
    return spark.read.parquet(f"{path}/long")


@register("mentions_file", f"""WITH {MENTIONS}
SELECT id, text, entity, CASE WHEN id % 10 = 3 THEN NULL ELSE label END AS label FROM mentions
WHERE id % 10 = 3 OR label <> '{fx.FIXTURE_NOT_RELEVANT}'""")
def mentions_file(spark, sf):
    """Mention records written as JSON lines (some without a label) and read
    without the not-relevant ones."""
    path = scratch_path(spark, "mentions")
    m = fx.mentions_raw(spark, sf).withColumn("label", F.when(F.col("id") % 10 != 3, F.col("label")))
    m.write.json(path)
    return S.read_mentions(spark, path, exclude=[fx.FIXTURE_NOT_RELEVANT], multiline=False)


@register("mentions_array", f"""WITH {MENTIONS}
SELECT id, text, entity, CASE WHEN id % 10 = 3 THEN NULL ELSE label END AS label FROM mentions
WHERE id % 10 = 3 OR label <> '{fx.FIXTURE_NOT_RELEVANT}'""")
def mentions_array(spark, sf):
    """The records as JSON arrays, each on one line, with quotes and brackets inside
    the texts; read in splits."""
    path = scratch_path(spark, "mentions-array")
    odd = F.concat(F.lit('{"['), F.col("text"), F.lit('\\"]}\n'))
    m = fx.mentions_raw(spark, sf).select("id", odd.alias("text"), "entity", F.when(F.col("id") % 10 != 3, F.col("label")).alias("label"))
    K.write_json_arrays(m, path, line_sep=" ")
    back = S.read_mentions(spark, path, exclude=[fx.FIXTURE_NOT_RELEVANT])
    return back.withColumn("text", F.expr("substring(text, 4, length(text) - 8)"))


@register("corpus_file", f"""WITH {LINES}
SELECT g.title, g.uid, g.uid AS doi, md5(min(g.pred)) AS text_md5, CAST(count(*) AS BIGINT) AS n_annotations,
       md5(string_agg(l.anno_label || ':' || l.anno_entity, '|' ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
           l.line, l.anno_label, l.anno_entity)) AS annotations_md5
FROM gens g JOIN glines l ON l.uid = g.uid GROUP BY g.title, g.uid""")
def corpus_file(spark, sf):
    """Papers with nested annotations written as Parquet and read back."""
    path = scratch_path(spark, "corpus")
    _papers(spark, sf).write.parquet(path)
    return _corpus_digest(S.read_corpus(spark, path))


@register("corpus_array", ORACLE["corpus_file"])
def corpus_array(spark, sf):
    """The papers as JSON arrays, read in splits."""
    path = scratch_path(spark, "corpus-array")
    K.write_json_arrays(_papers(spark, sf), path)
    return _corpus_digest(S.read_corpus(spark, path, "json"))


def _papers(spark, sf):
    return fx.generations(spark, sf).select("title", "uid", F.col("pred").alias("full_text"), "annotations")


def _corpus_digest(p):
    listed = F.array_join(F.transform("annotations", lambda a: F.concat(a["label"], F.lit(":"), a["entity"])), "|")
    return p.select("title", "uid", "doi", F.md5("full_text").alias("text_md5"), F.size("annotations").cast("long").alias("n_annotations"),
                    F.md5(listed).alias("annotations_md5"))


@register("label_vocab_file", f"""WITH {VOCAB}
SELECT label, CAST(id * 10 + 10 AS INTEGER) AS id, id < 2 AS among_first FROM vocab""")
def label_vocab_file(spark, sf):
    """S3: the vocabulary as one JSON object with sparse ids, read whole and cut to
    the first two labels by rank."""
    path = scratch_path(spark, "vocab")
    v = fx.mention_vocab(spark, sf).select("label", (F.col("id") * 10 + 10).alias("id"))
    entry = F.struct("label", F.struct("id").alias("v"))
    v.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.text(path)
    first = S.read_label_vocab(spark, path, 2).select("label", F.lit(True).alias("among_first"))
    return S.read_label_vocab(spark, path).join(first, "label", "left").select("label", "id", F.coalesce("among_first", F.lit(False)).alias("among_first"))


def _review_file(spark, sf):
    """Review rows as CSV; by order number some cells are broken off."""
    n = F.substring_index("uid", "-", -1).cast("long") % 20
    cut = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    r = fx.review_rows(spark, sf)
    r = r.select("title", "uid", F.when(n == 1, cut("annotation")).otherwise(F.col("annotation")).alias("annotation"),
                 F.when(n == 2, cut("prediction")).otherwise(F.col("prediction")).alias("prediction"), "true",
                 F.when(n == 3, F.lit('"x": [')).otherwise(F.col("wrong")).alias("wrong"), "rejected")
    path = scratch_path(spark, "review")
    r.write.option("header", True).option("escape", '"').csv(path)
    return C.parse_review(S.read_review(spark, path))


_BROKEN = """SELECT uid, title, rejected, CASE CAST(split_part(uid, '-', 2) AS BIGINT) % 20
  WHEN 1 THEN 'annotation' WHEN 2 THEN 'prediction' WHEN 3 THEN CASE WHEN rejected THEN 'ok' ELSE 'wrong' END ELSE 'ok' END AS status FROM flags"""


@register("review_quarantine", f"""WITH {CURATION},
b AS ({_BROKEN}) SELECT title, uid, status FROM b WHERE status <> 'ok'""")
def review_quarantine(spark, sf):
    """Review rows with a broken cell, by the cell that is broken."""
    return C.review_quarantine(_review_file(spark, sf))


@register("review_file", f"""WITH {CURATION},
b AS ({_BROKEN})
SELECT c1.uid, side, label, vpos, npos, entity FROM c1 JOIN b ON b.uid = c1.uid WHERE b.status = 'ok'""")
def review_file(spark, sf):
    """S8 + S9 + C1: the review sheet read from CSV; whole rows become entity rows."""
    return C.explode_sides(C.reviewed(_review_file(spark, sf)))


@register("generations_roundtrip", f"""WITH {LINES}
SELECT g.uid, CAST(count(*) AS BIGINT) AS n_annotations, md5(min(g.pred)) AS pred_md5
FROM gens g JOIN glines l ON l.uid = g.uid GROUP BY g.uid""")
def generations_roundtrip(spark, sf):
    """K1 + S4: generations dumped as JSON in two files (by order parity),
    read back as one union."""
    g = fx.generations(spark, sf).withColumnRenamed("uid", "doi").withColumn("text", F.lit(None).cast("string"))
    key = F.substring_index("doi", "-", -1).cast("long") % 2
    p0, p1 = scratch_path(spark, "gen0"), scratch_path(spark, "gen1")
    K.write_generations(g.where(key == 0), p0)
    K.write_generations(g.where(key == 1), p1)
    back = S.read_generations(spark, p0, p1)
    return back.select(F.col("doi").alias("uid"), F.size("annotations").cast("long").alias("n_annotations"),
                       F.md5("pred").alias("pred_md5"))


_sc, _ss = metrics_sql("sp", ["shape"])


@register("stream_scores", f"""WITH {CLEANED},
sp AS (SELECT CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS shape, pred, "true" FROM cpairs),
{_sc}
{_ss}""")
def stream_scores(spark, sf):
    """ST1: a file stream of raw responses, cleaned batch by batch, with a running
    confusion by key; the last scores equal the batch scores."""
    src = scratch_path(spark, "stream-src")
    r = fx.mention_responses(spark, sf).withColumn("shape", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    r.select("shape", "id", "entity", "label", "response").write.parquet(src)
    vocab = [x.label for x in fx.mention_vocab(spark, sf).orderBy("id").collect()]  # a handful of labels
    stream = spark.readStream.schema("shape string, id long, entity string, label string, response string").option("maxBytesPerTrigger", str(64 << 20)).parquet(src)
    return _stream_scores(spark, cleaned_pairs(stream, vocab, ["shape"]), scratch_path(spark, "stream-snap"),
                          scratch_path(spark, "stream-ckpt"), keys=["shape"])


@register("stream_redelivered", ORACLE["stream_scores"])
def stream_redelivered(spark, sf):
    """ST1: the same scores over a source that delivers a tenth of the responses again in
    later files: each id counts once, and epochs write what changed."""
    src = scratch_path(spark, "stream-src")
    r = fx.mention_responses(spark, sf).withColumn("shape", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    r = stored(r.select("shape", "id", "entity", "label", "response"), "responses")
    r.write.parquet(f"{src}/first")
    r.where(F.col("id") % 10 == 7).write.parquet(f"{src}/second")
    vocab = [x.label for x in fx.mention_vocab(spark, sf).orderBy("id").collect()]  # a handful of labels
    stream = (spark.readStream.schema("shape string, id long, entity string, label string, response string")
              .option("recursiveFileLookup", True).option("maxFilesPerTrigger", 4).parquet(src))
    return _stream_scores(spark, cleaned_pairs(stream, vocab, ["shape", "id"]), scratch_path(spark, "stream-snap"),
                          scratch_path(spark, "stream-ckpt"), keys=["shape"], once=["id"])


_ec, _ = metrics_sql("e", ["model", "epoch"])


@register("metric_log", f"""WITH {PAIRS},
e AS (SELECT *, id % 5 AS epoch FROM pairs),
{_ec}
SELECT model, CAST(epoch AS BIGINT) AS epoch, CAST((epoch + 1) * 100 AS BIGINT) AS step,
  round(coalesce(2.0 * sum(tp) / nullif(sum(n_pred) + sum(support), 0), 0), 6) AS micro_f1,
  round(avg(f1), 6) AS macro_f1
FROM cls GROUP BY model, epoch""")
def metric_log(spark, sf):
    """K8: per-epoch validation scores of each model added to a log, two epochs of
    them twice and one half-written before, read back."""
    pairs = fx.model_pairs(spark, sf).withColumn("epoch", F.col("id") % 5)
    m = M.compute_metrics(pairs, keys=["model", "epoch"])
    rows = m.select("model", F.col("epoch").cast("long"), ((F.col("epoch") + 1) * 100).cast("long").alias("step"),
                    F.col("micro_f").alias("micro_f1"), F.col("macro_f").alias("macro_f1"))
    rows, path = stored(rows, "metrics"), scratch_path(spark, "metric-log")
    first = (F.col("epoch") == 3) & (F.col("model") == PAIR_MODELS[0][0])
    for part in (F.col("epoch") < 2, first, F.col("epoch") >= 2, F.col("epoch") == 1):
        K.append_metric_log(rows.where(part), path, commit=["epoch"])
    return K.read_metric_log(spark, path, "model string, epoch long, step long, micro_f1 double, macro_f1 double")


@register("run_layout", f"""WITH {PAIRS}
SELECT model, model || '-chat' AS variant, 'kbase' AS dataset, 'entity_type' AS task, CAST(count(*) AS BIGINT) AS n
FROM pairs GROUP BY model""")
def run_layout(spark, sf):
    """K9: results laid out by model / variant / dataset / task / run, one model's
    written twice, read back."""
    pairs = fx.model_pairs(spark, sf)
    tagged = K.with_run_columns(pairs, F.col("model"), F.concat(F.lit("org/"), F.col("model"), F.lit("-chat")),
                                "kbase", "entity_type", "2024-01-01 00:00:00")
    path = scratch_path(spark, "layout")
    K.write_run_layout(tagged, path)
    K.write_run_layout(tagged.where(F.col("model") == PAIR_MODELS[0][0]), path)
    back = spark.read.parquet(path)
    return back.groupBy("model", "variant", "dataset", "task").agg(F.count(F.lit(1)).alias("n"))


@register("extraction_csv", ORACLE.get("extraction_table"))
def extraction_csv(spark, sf):
    """K2: extraction table written as CSV and read back."""
    path = scratch_path(spark, "extraction-csv")
    K.write_extraction_csv(_extraction_table(spark, sf), path)
    back = read_csv(spark, path, "Title string, UID string, Annotation string, `Model Prediction` string, True string")
    return back.select(F.col("Title").alias("title"), F.col("UID").alias("uid"), F.col("Annotation").alias("annotation"),
                       F.col("Model Prediction").alias("prediction"), F.col("True").alias("true"))


@register("host_index_json", f"SELECT species, type, name, title, uid FROM ({ORACLE['host_index']}) z")
def host_index_json(spark, sf):
    """K3: the host index written as one JSON array, line by line, and read back."""
    path = scratch_path(spark, "host-index")
    K.write_host_index(_host_index_rows(spark, sf).drop("side"), path)
    return S.read_host_index(spark, path)


@register("host_index_hot", f"""SELECT 'all' AS species, type, name, CASE WHEN side = 'gold' THEN title ELSE '"' || title || '"' END AS title, uid
FROM ({ORACLE['host_index']}) z UNION ALL SELECT species, type, name, title, uid FROM ({ORACLE['host_index']}) y""")
def host_index_hot(spark, sf):
    """K3 with one species that holds half the rows."""
    path = scratch_path(spark, "host-index-hot")
    rows = stored(_host_index_rows(spark, sf), "host-rows")
    quoted = F.concat(F.lit('"'), F.col("title"), F.lit('"'))
    hot = rows.withColumns({"species": F.lit("all"), "title": F.when(F.col("side") == "gold", F.col("title")).otherwise(quoted)})
    K.write_host_index(rows.unionByName(hot).drop("side"), path)
    return S.read_host_index(spark, path)
