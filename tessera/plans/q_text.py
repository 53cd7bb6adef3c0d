"""Registered response queries: R1, R2 (F4), P9 (F8), M1 (test predictor)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import literal_table
from ..operators import prompts as P
from ..operators import responses as R
from ..operators.inference import generate
from . import fixtures as fx
from .fixtures import memo
from .oracle import RESPONSES, strip_sql
from .q_prep import SPLITS, _split, _tmpl_table
from .registry import register

CLEAN = f"""{RESPONSES},
cr AS (SELECT r.*, list_filter(list_transform(v.vocab, lambda l: lower(l)),
                               lambda l: contains(replace(lower(r.response), lower(r.entity), ''), l)) AS hits
       FROM responses r CROSS JOIN vocab_arr v),
cl AS (SELECT *, CASE WHEN len(hits) = 1 THEN hits[1]
                      WHEN len(hits) > 1 AND list_contains(hits, lower(label)) THEN lower(label)
                      ELSE 'None' END AS cleaned FROM cr)"""


@memo
def _responses(spark, sf):
    return fx.mention_responses(spark, sf).crossJoin(fx.vocab_array(fx.mention_vocab(spark, sf)))


@register("clean_response", f"""WITH {CLEAN}
SELECT id, array_to_string(hits, '|') AS hits, cleaned FROM cl""")
def clean_response(spark, sf):
    """Vocabulary labels found in the raw response; chosen label."""
    r = _responses(spark, sf)
    c = R.clean_response(r, "vocab", tie_break="gold")
    return c.select("id", F.array_join("hits", "|").alias("hits"), "cleaned")


CLEANED = f"""{RESPONSES},
st AS (SELECT r.*, v.vocab, {strip_sql("r.response")} AS resp, {strip_sql("r.label")} AS gold
       FROM responses r CROSS JOIN vocab_arr v),
crs AS (SELECT *, list_filter(list_transform(vocab, lambda l: lower(l)),
                             lambda l: contains(replace(lower(resp), lower(entity), ''), l)) AS hits FROM st),
cpairs AS (SELECT id, lower(CASE WHEN len(hits) = 1 THEN hits[1]
                      WHEN len(hits) > 1 AND list_contains(hits, lower(gold)) THEN lower(gold)
                      ELSE 'None' END) AS pred, lower(gold) AS "true" FROM crs)"""


@register("scored_pairs", f"WITH {CLEANED}\nSELECT id, pred, \"true\" FROM cpairs")
def scored_pairs(spark, sf):
    """R2: stripped, cleaned, lower-cased (pred, true) pairs."""
    r = _responses(spark, sf)
    return R.score_pairs(r, "vocab", response="response", entity="entity", true="label", keys=["id"])


@register("strip_prompt", f"""WITH u AS (SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS completion FROM conversations WHERE role = 'assistant'),
j AS (SELECT u.conv_id, u.turn, prompt, completion, prompt || ' ' || completion AS generated
      FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn),
s AS (SELECT *, {strip_sql("substr(generated, length(prompt) + 1)")} AS stripped FROM j)
SELECT conv_id, turn, md5(stripped) AS response_md5, stripped = {strip_sql("completion")} AS same FROM s""")
def strip_prompt(spark, sf):
    """Echoed prompt cut by length from generated text, then stripped."""
    e = fx.echoed_turns(spark, sf)
    s = R.strip_prompt(F.col("generated"), F.col("prompt"))
    return e.select("conv_id", "turn", F.md5(s).alias("response_md5"),
                    (s == R.strip(F.col("completion"))).alias("same"))


@register("generated_pairs", f"""WITH {SPLITS},
tmpl AS {_tmpl_table()},
ts AS (SELECT s.*, t.family, replace(replace(replace(t.q_tmpl, '{{entity}}', s.entity), '{{text}}', s.text), '{{choices}}', c.choices)
              AS prompt FROM splits s CROSS JOIN choices c CROSS JOIN tmpl t WHERE s.split = 'test'),
g AS (SELECT ts.*, v.vocab AS vocab, v.vocab[(instr('0123456789abcdef', substr(md5(prompt), 1, 1)) - 1) % len(v.vocab) + 1] AS choice
      FROM ts CROSS JOIN vocab_arr v),
h AS (SELECT g.*, list_filter(list_transform(vocab, lambda l: lower(l)),
                              lambda l: contains(replace(lower(choice), lower(entity), ''), l)) AS hits FROM g)
SELECT family, id, lower(CASE WHEN len(hits) = 1 THEN hits[1]
                      WHEN len(hits) > 1 AND list_contains(hits, lower(label)) THEN lower(label)
                      ELSE 'None' END) AS pred, lower(label) AS "true" FROM h""")
def generated_pairs(spark, sf):
    """P5 + M1 + P9 + R2: test prompts of every family through the batch predictor
    (Arrow, mapInPandas), echo removed, response cleaned to a label."""
    test = _split(spark, sf).where(F.col("split") == "test")
    choices = P.choices_string(fx.mention_vocab(spark, sf))
    fams = literal_table(spark, [(f,) for f in P.FAMILIES], "family string")
    x = P.format_examples(test.crossJoin(choices).crossJoin(F.broadcast(fams)), P.template_catalogue(spark), "family", "test", F.col("choices"))
    x = x.select("family", "id", "entity", "label", F.col("prompt_text").alias("prompt"))
    out = generate(x, fx.choice_channel_factory, "prompt", "generated", batch_size=8)
    out = out.withColumn("response", R.strip_prompt(F.col("generated"), F.col("prompt")))
    va = fx.vocab_array(fx.mention_vocab(spark, sf))
    return R.score_pairs(out.crossJoin(va), "vocab", response="response", entity="entity", true="label",
                         keys=["family", "id"])
