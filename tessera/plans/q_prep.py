"""Registered data-preparation queries: S1, S3, P1-P7, D1-D4, T1-T4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import MAX_NEW_TOKENS
from ..functions.text import bind, literal_table
from ..operators import prompts as P
from ..operators import sampling as D
from ..operators import tokens as T
from ..operators.inference import generate_batches
from ..operators.subword import decode, subword_tokenizer
from . import fixtures as fx
from .fixtures import memo
from .oracle import MENTIONS, VOCAB, strip_sql, values
from ..session import stored
from ..sources.readers import first_labels
from .registry import register

SHOTS = 1
BATCH = 8
SEQ_LEN = 128
PACK_GROUPS = 16

SPLITS = f"""{MENTIONS},
{VOCAB},
rel AS (SELECT * FROM mentions WHERE label <> '{fx.FIXTURE_NOT_RELEVANT}'),
ranked AS (SELECT rel.*, md5('42:' || id) AS ord,
                  row_number() OVER (ORDER BY md5('42:' || id), id) AS rn, count(*) OVER () AS n FROM rel),
splits AS (SELECT *, CASE WHEN rn > n - ceil(0.1 * n) THEN 'test'
                          WHEN rn > n - 2 * ceil(0.1 * n) THEN 'validation' ELSE 'train' END AS split FROM ranked),
choices AS (SELECT string_agg('"' || label || '"', ', ' ORDER BY id) AS choices FROM vocab),
shots AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY ord, id) AS shot_rank
                         FROM splits s WHERE split = 'train' AND label IN (SELECT label FROM vocab)) x
          WHERE shot_rank <= {SHOTS})"""


def _tmpl_table():
    rows = [(f, P.template(f, "kbase", "entity_type_q"), P.template(f, "kbase", "entity_type_a"))
            for f in P.FAMILIES]
    return values(rows, "family, q_tmpl, a_tmpl")


def _q_sql(prefix: str = "") -> str:
    return (f"replace(replace(replace(t.q_tmpl, '{{entity}}', {prefix}entity), '{{text}}', {prefix}text), "
            f"'{{choices}}', c.choices)")


def _a_sql(prefix: str = "") -> str:
    return f"replace(t.a_tmpl, '{{label}}', {prefix}label)"


@memo
def _mentions(spark, sf):
    m = fx.mentions_raw(spark, sf)
    return m.where(F.col("label") != fx.FIXTURE_NOT_RELEVANT)


@memo
def _split(spark, sf):
    return D.split_dataset(_mentions(spark, sf), "id")


@register("mentions_filtered", f"""WITH {MENTIONS}
SELECT id, entity, label, text FROM mentions WHERE label <> '{fx.FIXTURE_NOT_RELEVANT}'""")
def mentions_filtered(spark, sf):
    """Mention records without the not-relevant label."""
    return _mentions(spark, sf)


@register("label_vocab_topn", f"""WITH {VOCAB},
v AS (SELECT * FROM vocab WHERE id < 3)
SELECT label, id, chr(65 + id) AS letter, (SELECT string_agg('"' || label || '"', ', ' ORDER BY id) FROM v) AS choices
FROM v""")
def label_vocab_topn(spark, sf):
    """S3+P2+P3: first N vocabulary labels, option letters, choices string."""
    v = first_labels(fx.mention_vocab(spark, sf), 3)
    return P.choice_letters(v).crossJoin(P.choices_string(v)).select("label", "id", "letter", "choices")


@register("split_sizes", f"WITH {SPLITS}\nSELECT split, count(*) AS n FROM splits GROUP BY split")
def split_sizes(spark, sf):
    """D1+D2: sizes of the seeded train / validation / test split."""
    return _split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("split_assignment", f"WITH {SPLITS}\nSELECT id, split, rn FROM splits")
def split_assignment(spark, sf):
    """D1+D2: split and global rank of every record."""
    return _split(spark, sf).select("id", "split", "rn")


@register("few_shot_rows", f"WITH {SPLITS}\nSELECT label, id, shot_rank FROM shots")
def few_shot_rows(spark, sf):
    """D3: first n training rows per vocabulary label."""
    s = _split(spark, sf).where(F.col("split") == "train")
    shots = D.few_shot(s, fx.mention_vocab(spark, sf), SHOTS)
    return shots.select("label", "id", F.col("shot_rank").cast("long").alias("shot_rank"))


@memo
def _shots_rendered(spark, sf):
    s = _split(spark, sf).where(F.col("split") == "train")
    shots = D.few_shot(s, fx.mention_vocab(spark, sf), SHOTS)
    choices = P.choices_string(fx.mention_vocab(spark, sf))
    fams = literal_table(spark, [(f,) for f in P.FAMILIES], "family string")  # fixed family list
    x = shots.crossJoin(choices).crossJoin(F.broadcast(fams))
    cat = P.template_catalogue(spark)
    x = P.render_prompt(x, cat, "kbase", "entity_type_q",
                        {"entity": F.col("entity"), "text": F.col("text"), "choices": F.col("choices")}, name="q")
    x = P.render_prompt(x, cat, "kbase", "entity_type_a", {"label": F.col("label")}, name="a")
    return D.shot_prefix(x, F.concat("q", "a"), group=["family"])


_PREFIX_SQL = f"""tmpl AS {_tmpl_table()},
shot_text AS (SELECT t.family, s.id, {_q_sql("s.")} || {_a_sql("s.")} AS txt
              FROM shots s CROSS JOIN choices c CROSS JOIN tmpl t),
prefix AS (SELECT family, string_agg(txt, '' ORDER BY md5('42:shot:' || id), id, txt) AS prefix,
                  count(*) AS n_shots FROM shot_text GROUP BY family)"""


@register("shot_prefix", f"""WITH {SPLITS},
{_PREFIX_SQL}
SELECT family, md5(prefix) AS prefix_md5, CAST(strlen(prefix) AS BIGINT) AS n_bytes, n_shots FROM prefix""")
def shot_prefix(spark, sf):
    """D4+P4: concatenated few-shot prefix per model family."""
    p = _shots_rendered(spark, sf)
    return p.select("family", F.md5("prefix").alias("prefix_md5"),
                    F.octet_length("prefix").cast("long").alias("n_bytes"), F.col("n_shots").cast("long"))


@register("eval_prompts", f"""WITH {SPLITS},
{_PREFIX_SQL},
ev AS (SELECT s.id, s.split, t.family, p.prefix || {_q_sql("s.")} AS prompt
       FROM splits s CROSS JOIN choices c CROSS JOIN tmpl t JOIN prefix p ON p.family = t.family
       WHERE s.split IN ('validation', 'test'))
SELECT id, split, family, md5(prompt) AS prompt_md5, CAST(strlen(prompt) AS BIGINT) AS n_bytes FROM ev""")
def eval_prompts(spark, sf):
    """P4+P5+P7: evaluation prompts (few-shot prefix + question) per family."""
    ev = P.eval_rows(_split(spark, sf), None).where(F.col("split").isin("validation", "test"))
    choices = P.choices_string(fx.mention_vocab(spark, sf))
    fams = literal_table(spark, [(f,) for f in P.FAMILIES], "family string")
    # zero shots (the launcher default) leave no prefix row: empty prefix
    prefix = fams.join(_shots_rendered(spark, sf), "family", "left").select(
        "family", F.coalesce("prefix", F.lit("")).alias("prefix"))
    x = ev.crossJoin(choices).crossJoin(F.broadcast(prefix))  # prefix: one row per family
    x = P.render_prompt(x, P.template_catalogue(spark), "kbase", "entity_type_q",
                        {"entity": F.col("entity"), "text": F.col("text"), "choices": F.col("choices")}, name="q")
    prompt = F.concat("prefix", "q")
    return x.select("id", "split", "family", F.md5(prompt).alias("prompt_md5"),
                    F.octet_length(prompt).cast("long").alias("n_bytes"))


@register("train_prompts", f"""WITH {SPLITS},
tmpl AS {_tmpl_table()}
SELECT t.family, s.id, md5({_q_sql("s.")} || {_a_sql("s.")}) AS text_md5
FROM splits s CROSS JOIN choices c CROSS JOIN tmpl t WHERE s.split = 'train'""")
def train_prompts(spark, sf):
    """P5: training rows (question + answer, no few-shot prefix) of every family."""
    fams = literal_table(spark, [(f,) for f in P.FAMILIES], "family string")
    tr = _split(spark, sf).where(F.col("split") == "train").crossJoin(P.choices_string(fx.mention_vocab(spark, sf)))
    x = P.format_examples(tr.crossJoin(F.broadcast(fams)), P.template_catalogue(spark), "family", "train", F.col("choices"))
    return x.select("family", "id", F.md5("prompt_text").alias("text_md5"))


@register("eval_sample", f"""WITH {SPLITS}
SELECT id, split, rn FROM (SELECT *, row_number() OVER (ORDER BY rn) AS i FROM splits WHERE split = 'test') t WHERE i <= 50""")
def eval_sample(spark, sf):
    """The first fifty test rows in split order (the sample size is the feature)."""
    return P.eval_rows(_split(spark, sf), "test", 50).select("id", "split", "rn")


_SLOT_VALUES = {"entity": "p_name", "text": "p_text", "choices": "'\"a\", \"b\"'", "label": "p_name", "answer": "p_name", "e1": "p_name",
                "e2": "p_text", "pathway": "p_name", "gene": "p_text", "num": "CAST(p_partkey AS VARCHAR)"}


def _slots_sql(x):
    for k, v in _SLOT_VALUES.items():
        x = f"replace({x}, '{{{k}}}', {v})"
    return x


@register("all_slots", f"""WITH cat AS {values(P.catalogue_rows(), "family, dataset, slot, template")},
p AS (SELECT p_partkey, p_name, p_name || ' text' AS p_text FROM part)
SELECT p_partkey, family, dataset, slot, md5({_slots_sql("template")}) AS prompt_md5 FROM cat CROSS JOIN p""")
def all_slots(spark, sf):
    """Every slot of every family and dataset rendered."""
    p = fx.load(spark, sf, "part").select("p_partkey", "p_name", F.concat("p_name", F.lit(" text")).alias("p_text"))
    vals = {k: F.expr(v.replace("VARCHAR", "STRING")) for k, v in _SLOT_VALUES.items()}
    pieces, names = P.cut_template(F.col("template"))
    cat = bind(P.template_catalogue(spark), ["family", "dataset", "slot"], pieces=pieces, names=names)
    x = p.crossJoin(F.broadcast(cat))  # the catalogue is fixed
    return x.select("p_partkey", "family", "dataset", "slot", F.md5(P.fill_cut(F.col("pieces"), F.col("names"), vals)).alias("prompt_md5"))


@register("batches", f"""WITH {SPLITS},
ev AS (SELECT id, row_number() OVER (ORDER BY ord, id) AS r FROM splits WHERE split IN ('validation', 'test'))
SELECT id, CAST((r - 1) // {BATCH} AS BIGINT) AS batch FROM ev""")
def batches(spark, sf):
    """T4: evaluation rows cut into batches of eight in split order."""
    ev = _split(spark, sf).where(F.col("split").isin("validation", "test")).drop("rn")
    return D.assign_batches(ev, ["ord", "id"], BATCH, hashed=True).select("id", "batch")


PAPERS = f"""pp AS (SELECT doc_id, source,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS full_text
  FROM documents),
comp AS (SELECT doc_id, source,
    CASE WHEN length({strip_sql("title")}) > 0
         THEN 'Title: ' || {strip_sql("title")} || '. Full-Text: ' || {strip_sql("full_text")}
         ELSE 'Full-Text: ' || {strip_sql("full_text")} END AS text
  FROM pp)"""


@memo
def _composed(spark, sf):
    p = fx.papers(spark, sf)
    return p.select("doc_id", "source", P.compose_text(p).alias("text"))


@register("compose_text", f"""WITH {PAPERS}
SELECT doc_id, md5(text) AS text_md5, CAST(strlen(text) AS BIGINT) AS n_bytes FROM comp""")
def compose_text(spark, sf):
    """S2+P1: paper input text from title and full text."""
    c = _composed(spark, sf)
    return c.select("doc_id", F.md5("text").alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"))


@register("paper_prompts", f"""WITH {PAPERS},
pv AS (SELECT string_agg('"' || l || '"', ', ' ORDER BY l) AS choices FROM (SELECT DISTINCT lower(p_type) AS l FROM part)),
tmpl AS {values([(f, P.template(f, "kbase", "paper_q")) for f in P.FAMILIES], "family, q_tmpl")}
SELECT t.family, c.doc_id, md5(replace(replace(t.q_tmpl, '{{choices}}', pv.choices), '{{text}}', c.text)) AS prompt_md5
FROM comp c CROSS JOIN pv CROSS JOIN tmpl t""")
def paper_prompts(spark, sf):
    """P1 + P2 + P5: the paper task's prompts of every family."""
    fams = literal_table(spark, [(f,) for f in P.FAMILIES], "family string")
    x = _composed(spark, sf).crossJoin(P.choices_string(fx.paper_vocab(spark, sf))).crossJoin(F.broadcast(fams))
    x = P.format_examples(x, P.template_catalogue(spark), "family", "test", F.col("choices"), task="entity_and_entity_type")
    return x.select("family", "doc_id", F.md5("prompt_text").alias("prompt_md5"))


@register("length_guard", f"""WITH {PAPERS},
lim AS (SELECT source, CASE WHEN k % 5 = 4 THEN NULL ELSE CAST(2048 * pow(2, k % 4) AS INTEGER) END AS "limit"
        FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS k FROM documents) s),
tk AS (SELECT c.doc_id, CAST(len(list_filter(string_split_regex(c.text, '[ \\n]+'), lambda t: t <> '')) AS BIGINT) AS n_tokens,
              l."limit" FROM comp c LEFT JOIN lim l USING (source))
SELECT doc_id, n_tokens, "limit",
  CASE WHEN "limit" IS NULL THEN 'no_limit' WHEN n_tokens + {MAX_NEW_TOKENS["entity_and_entity_type"]} <= "limit" THEN 'ok'
       ELSE 'too_long' END AS status
FROM tk""")
def length_guard(spark, sf):
    """Input tokens + new tokens against the context limit per source."""
    c = _composed(spark, sf)
    g = P.check_length(c, fx.source_limits(spark, sf), "text", "source", MAX_NEW_TOKENS["entity_and_entity_type"])
    return g.select("doc_id", "n_tokens", "limit", "status")


TOKENS = f"""d AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '[ \\n]+'), lambda t: t <> ''),
                   lambda t: ('0x' || substr(md5(t), 1, 15))::BIGINT + 2) AS ids FROM documents),
b AS (SELECT d.*, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS BIGINT) AS batch FROM d),
tp AS (SELECT b.*, max(len(ids)) OVER (PARTITION BY batch) AS m FROM b),
tp2 AS (SELECT doc_id, batch, ids, m,
          list_concat(list_transform(range(m - len(ids)), lambda x: CAST(0 AS BIGINT)), ids) AS padded,
          list_concat(list_transform(range(m - len(ids)), lambda x: 0), list_transform(range(len(ids)), lambda x: 1)) AS attention
        FROM tp),
tp3 AS (SELECT *, list_transform(padded, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS masked FROM tp2)"""


@memo
def _padded(spark, sf):
    docs = fx.load(spark, sf, "documents").select("doc_id", "text")
    # batches and their longest sequence from (id, length), counted without ids; these
    # are made once, where the rows are padded
    b = D.assign_batches(docs.select("doc_id", P.token_count(F.col("text")).alias("n")), ["doc_id"], BATCH)
    b = stored(T.batch_lengths(b, "batch"), "batches")
    p = T.pad(T.tokenize(docs, "text").join(b, "doc_id"), "ids", "longest", side="left")
    return p.withColumn("masked", T.mask_labels(F.col("padded")))


def _md5_ids(c):
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " "))


@register("token_pad", f"""WITH {TOKENS}
SELECT doc_id, batch, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(m AS BIGINT) AS padded_len,
       md5(array_to_string(padded, ' ')) AS ids_md5, CAST(list_sum(attention) AS BIGINT) AS n_attended FROM tp3""")
def token_pad(spark, sf):
    """Tokens padded (left) to the longest sequence of each batch."""
    p = _padded(spark, sf)
    return p.select("doc_id", "batch", F.size("ids").cast("long").alias("n_tokens"),
                    F.size("padded").cast("long").alias("padded_len"), _md5_ids(F.col("padded")).alias("ids_md5"),
                    F.aggregate("attention", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_attended"))


@register("label_mask", f"""WITH {TOKENS}
SELECT doc_id, CAST(len(list_filter(masked, lambda x: x = -100)) AS BIGINT) AS n_masked,
       md5(array_to_string(masked, ' ')) AS labels_md5 FROM tp3""")
def label_mask(spark, sf):
    """Pad positions of the labels replaced by -100."""
    p = _padded(spark, sf)
    return p.select("doc_id", F.size(F.filter("masked", lambda x: x == -100)).cast("long").alias("n_masked"),
                    _md5_ids(F.col("masked")).alias("labels_md5"))


@register("packed_sequences", f"""WITH {TOKENS},
ex AS (SELECT doc_id, doc_id % {PACK_GROUPS} AS grp, list_append(padded, CAST(1 AS BIGINT)) AS i,
              list_append(masked, CAST(1 AS BIGINT)) AS l FROM tp3),
off AS (SELECT *, sum(len(i)) OVER (PARTITION BY grp ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - len(i) AS s FROM ex),
tok AS (SELECT grp, s + generate_subscripts(i, 1) - 1 AS p, unnest(i) AS ti, unnest(l) AS tl FROM off),
seqs AS (SELECT grp, p // {SEQ_LEN} AS seq, list(ti ORDER BY p) AS ids, list(tl ORDER BY p) AS labs, count(*) AS c
         FROM tok GROUP BY ALL)
SELECT grp, CAST(seq AS BIGINT) AS seq, md5(array_to_string(ids, ' ')) AS ids_md5,
       md5(array_to_string(labs, ' ')) AS labels_md5 FROM seqs WHERE c = {SEQ_LEN}""")
def packed_sequences(spark, sf):
    """Padded inputs and masked labels packed into 128-token sequences
    within 16 hash groups (each group drops its own short tail)."""
    p = _padded(spark, sf).withColumn("grp", F.col("doc_id") % PACK_GROUPS)
    packed = T.pack_sequences(p, "padded", ["doc_id"], SEQ_LEN, group=["grp"], labels="masked", length=F.col("longest"))
    return packed.select("grp", "seq", _md5_ids(F.col("input_ids")).alias("ids_md5"),
                         _md5_ids(F.col("labels")).alias("labels_md5"))


#: A public byte-level vocabulary file; any file of the same form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _subword(spark, df, text="text"):
    """``df`` with subword ids, made once and written."""
    return stored(T.tokenize(df, text, subword_tokenizer(spark, VOCABULARY)), "subword-ids")


@register("subword_pad", f"""WITH b AS (SELECT doc_id, text, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS BIGINT) AS batch FROM documents)
SELECT doc_id, batch, md5(text) AS text_md5, CAST(strlen(text) AS BIGINT) AS n_bytes, TRUE AS padded_right FROM b""")
def subword_pad(spark, sf):
    """T1 with a subword tokenizer: ids padded by batch (right), and the text given back
    by the ids that are attended to."""
    t = _subword(spark, fx.load(spark, sf, "documents").select("doc_id", "text"))
    b = D.assign_batches(t.select("doc_id", F.size("ids").alias("n")), ["doc_id"], BATCH)
    p = T.pad(t.join(T.batch_lengths(b, "batch"), "doc_id"), "ids", "longest", side="right")
    ones = F.aggregate("attention", F.lit(0), lambda a, x: a + x)
    right = (F.size("padded") == F.col("longest")) & (ones == F.size("ids")) & (F.slice("padded", F.lit(1), ones) == F.col("ids"))
    p = p.select("doc_id", "batch", decode(spark, VOCABULARY, F.slice("padded", F.lit(1), ones)).alias("back"), right.alias("padded_right"))
    return p.select("doc_id", "batch", F.md5("back").alias("text_md5"), F.octet_length("back").cast("long").alias("n_bytes"), "padded_right")


@register("length_guard_subword")
def length_guard_subword(spark, sf):
    """P6 on subword ids: every paper against the context limit of each model variant."""
    models = literal_table(spark, [("Falcon", "falcon-7b"), ("LLaMA-3", "llama-3-8b"), ("MPT", "mpt-30b-chat"), ("Mistral", "Mixtral-8x7B-Instruct-v0.1"), ("Unknown", "other")],
                           "family string, variant string")
    limits = models.withColumn("limit", P.context_limit(F.col("family"), F.col("variant")))
    counted = _subword(spark, _composed(spark, sf).select("doc_id", "text")).select("doc_id", F.size("ids").alias("n"))
    rows = counted.crossJoin(F.broadcast(models.select("variant")))  # a handful of models
    g = P.check_length(rows, limits, "text", "variant", MAX_NEW_TOKENS["entity_and_entity_type"], F.col("n"))
    return g.select("doc_id", "family", "variant", "n_tokens", "limit", "status")


@register("generated_batches", """SELECT conv_id, turn, CASE WHEN substr(md5(text), 1, 2) = 'ff' THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN substr(md5(text), 1, 2) <> 'ff' THEN 'answer ' || md5(text) END AS response, TRUE AS within_budget
FROM conversations WHERE role = 'user'""")
def generated_batches(spark, sf):
    """M1: user turns answered in batches of similar length under a token budget; prompts
    that the predictor fails on are set apart, the rest of their batch is answered."""
    turns = fx.load(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    out = generate_batches(turns, fx.failing_channel_factory, budget=1024, most_rows=32)
    within = (F.col("batch_tokens") <= 1024) | (F.col("batch_rows") == 1)
    return out.select("conv_id", "turn", "status", "response", within.alias("within_budget"))
