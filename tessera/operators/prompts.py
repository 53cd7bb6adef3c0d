"""Prompt catalogue and rendering, text composition, length guard.

The catalogue is a small fixed dimension (family, dataset, slot, template)
in our own wording; placeholders are ``{name}``. Rendering substitutes all
placeholders in one pass (template split on placeholders, pieces
interleaved with values), so a value that itself contains ``{text}`` is
never expanded again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import literal_table, strip
from ..sources.readers import first_labels

FAMILIES = ["llama2", "llama3", "mistral", "solar", "falcon", "mpt"]
PLACEHOLDER = "\\{([a-z0-9_]+)\\}"

# Definitions prepended by the families that use the long mention question.
_DEFINITIONS = (
    "Entity types used below:\n"
    "plasmid - a small circular DNA molecule used as a vector.\n"
    "organism host - the organism that carries and expresses the engineered DNA.\n"
    "promoter - a DNA sequence where transcription of a gene starts.\n"
    "genome engineering - a method that edits an organism's genome.\n"
    "cloning method - a technique that assembles or copies DNA fragments.\n"
    "reporter - a gene whose product gives a measurable signal.\n"
    "regulator - a molecule or element that controls gene expression.\n"
    "antibiotic marker - a gene that lets transformed cells survive an antibiotic.\n"
    "genetic screen - a systematic search for genes behind a trait.\n"
    "RBS - the ribosome binding site in front of a coding sequence.\n"
    "counter selection - a method that removes cells carrying a given trait.\n"
    "terminator - a sequence that ends transcription.\n"
    "DNA transfer - a way to bring foreign DNA into cells.\n"
    "operator - a DNA site bound by a regulatory protein.\n\n"
)

_MENTION_Q = ("Question: Which of these entity types fits {entity} in the text below? "
              "Options: {choices}. Text: {text}\n\nAnswer:")

_BASE: dict[tuple[str, str], str] = {
    ("kbase", "entity_type_q"): _MENTION_Q,
    ("kbase", "entity_type_a"): " {label}\n\n",
    ("kbase", "paper_q"): ("{text}\n\nQuestion: List the biological entities and genetic tools named in "
                           "the text above, one per line as 'type: name'. Types: {choices}.\n\nAnswer:"),
    ("kbase", "paper_a"): " {answer}\n",
    ("string", "entity_q"): "QUESTION: Which proteins bind {entity}?\nANSWER:",
    ("string", "entity_a"): " {answer}\n",
    ("string", "relation_q"): "Question: Do {e1} and {e2} interact? True or False\n\nAnswer:",
    ("string", "relation_a"): " {answer}\n\n",
    ("kegg", "entity_q"): "Question: Which genes take part in the {pathway} pathway?\n\nAnswer:",
    ("kegg", "entity_a"): " {answer}\n",
    ("kegg", "relation_q"): "Question: Is {gene} part of the {pathway} pathway? True or False\n\nAnswer:",
    ("kegg", "relation_a"): " {answer}\n\n",
    ("scierc", "entity_q"): "\n\nQ: Which scientific terms appear in this text?\n\n",
    ("scierc", "entity_a"): "A: {answer}\n\n",
    ("scierc", "entity_type_q"): "\n\nQ: Which type fits the term \"{entity}\"? {choices}\n\n",
    ("scierc", "entity_type_a"): "A: ({num}) {label}\n\n",
    ("scierc", "relation_type_q"): "\n\nQ: Which relation holds between \"{e1}\" and \"{e2}\"? {choices}\n\n",
    ("scierc", "relation_type_a"): "A: ({num}) {label}\n\n",
    ("indra", "relation_type_q"): "\n\nQuestion: Which relation links {e1} to {e2}? Options: {choices}\n\nAnswer:",
    ("indra", "relation_type_a"): " {answer}\n\n",
    ("lll", "relation_type_q"): ("{text}\n\nQuestion: Which relation links {e1} and {e2} in the text above? "
                                 "Options: {choices}\n\nAnswer:"),
    ("lll", "relation_type_a"): " {answer}\n\n",
}

_OVERRIDES: dict[tuple[str, str, str], str] = {
    ("solar", "kbase", "entity_type_q"): _DEFINITIONS + _MENTION_Q,
    ("falcon", "kbase", "entity_type_q"): _DEFINITIONS + _MENTION_Q,
    ("falcon", "string", "entity_q"): ">>QUESTION<< Which proteins bind {entity}?\n>>ANSWER<<",
    ("falcon", "string", "relation_q"): ">>QUESTION<< Do {e1} and {e2} interact? True or False\n>>ANSWER<<",
    ("falcon", "kegg", "entity_q"): ">>QUESTION<< Which genes take part in the {pathway} pathway?\n>>ANSWER<<",
    ("falcon", "kegg", "relation_q"): ">>QUESTION<< Is {gene} part of the {pathway} pathway? True or False\n>>ANSWER<<",
    ("mpt", "kegg", "entity_q"): "Question: Which genes are related to the {pathway} pathway?\n\nAnswer:",
}


def catalogue_rows() -> list[tuple[str, str, str, str]]:
    rows = []
    for fam in FAMILIES:
        for (ds, slot), tmpl in _BASE.items():
            rows.append((fam, ds, slot, _OVERRIDES.get((fam, ds, slot), tmpl)))
    return rows


def template(family: str, dataset: str, slot: str) -> str:
    if family not in FAMILIES:
        raise ValueError(f"unknown model family {family!r}")
    return _OVERRIDES.get((family, dataset, slot), _BASE[(dataset, slot)])


def template_catalogue(spark: SparkSession) -> DataFrame:
    """P4 dimension: (family, dataset, slot, template) - a fixed, small table."""
    return literal_table(spark, catalogue_rows(), "family string, dataset string, slot string, template string")


def cut_template(tmpl: Column) -> tuple[Column, Column]:
    """The texts between a template's placeholders, and the placeholders' names."""
    return F.split(tmpl, PLACEHOLDER), F.regexp_extract_all(tmpl, F.lit(PLACEHOLDER), 1)


def fill(tmpl: Column, values: Mapping[str, Column]) -> Column:
    """Single-pass placeholder substitution; unknown placeholders stay as
    written and a null value renders as empty text."""
    return fill_cut(*cut_template(tmpl), values)


def fill_cut(pieces: Column, names: Column, values: Mapping[str, Column]) -> Column:
    """``fill`` of a template that was cut before it met its rows."""

    def lookup(n: Column) -> Column:
        out = F.concat(F.lit("{"), n, F.lit("}"))
        for k, v in values.items():
            out = F.when(n == F.lit(k), F.coalesce(v.cast("string"), F.lit(""))).otherwise(out)
        return out

    vals = F.concat(F.transform(names, lookup), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, vals, lambda p, v: F.concat(p, v)), "")


def render_prompt(df: DataFrame, templates: DataFrame, dataset: str, slot: str,
                  values: Mapping[str, Column], family: str | Column = "family",
                  name: str = "prompt") -> DataFrame:
    """Join the template of (family, dataset, slot) and fill it. ``family``
    is a column of ``df`` or a literal family name."""
    t = templates.where((F.col("dataset") == dataset) & (F.col("slot") == slot)) \
        .select(F.col("family").alias("_fam"), F.col("template").alias("_tmpl"))
    fam = F.lit(family) if isinstance(family, str) and family in FAMILIES else F.col(family) \
        if isinstance(family, str) else family
    joined = df.join(F.broadcast(t), fam == F.col("_fam"), "inner")  # t: fixed catalogue slice
    return joined.withColumn(name, fill(F.col("_tmpl"), values)).drop("_fam", "_tmpl")


def compose_text(df: DataFrame, title: str = "title", full_text: str = "full_text") -> Column:
    """P1: 'Title: t. Full-Text: f' (stripped values), or 'Full-Text: f' when
    the title is blank."""
    t, f = strip(F.col(title)), strip(F.col(full_text))
    return F.when(F.length(t) > 0, F.concat(F.lit("Title: "), t, F.lit(". Full-Text: "), f)) \
        .otherwise(F.concat(F.lit("Full-Text: "), f))


def choices_string(vocab: DataFrame, n: int | None = None) -> DataFrame:
    """One row with '"a", "b", ...' in vocabulary order (first ``n``)."""
    v = first_labels(vocab, n)
    return v.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "label"))),
                                          lambda s: F.concat(F.lit('"'), s["label"], F.lit('"'))), ", ")
                 .alias("choices"))


def choice_letters(vocab: DataFrame) -> DataFrame:
    """Option letter A..Z by vocabulary id; an id past Z is an error."""
    return vocab.withColumn("letter", F.expr("if(id between 0 and 25, chr(65 + id), raise_error(concat('no option letter for id ', id)))"))


def context_limit(family: Column, variant: Column) -> Column:
    """Context limit (input + output tokens) from the fixed family / variant
    table; a variant entry wins over its family. Null when unknown (Q16)."""
    from ..functions.fixed import CONTEXT_LIMITS
    out = F.lit(None).cast("int")
    for kind, name, limit in CONTEXT_LIMITS:
        if kind == "family":
            out = F.when(family == F.lit(name), F.lit(limit)).otherwise(out)
    for kind, name, limit in CONTEXT_LIMITS:
        if kind == "variant":
            out = F.when(variant == F.lit(name), F.lit(limit)).otherwise(out)
    return out


def format_examples(df: DataFrame, templates: DataFrame, family: str, split: str, choices: Column,
                    prefix: Column | None = None, task: str = "entity_type") -> DataFrame:
    """P5: training rows (text = answer = question + answer) or evaluation
    rows (text = few-shot prefix + question, answer = label). The paper task
    ``entity_and_entity_type`` has whole papers and no gold labels: its rows are
    questions without an answer, and a few-shot prefix is an error (Q11)."""
    if task != "entity_type" and prefix is not None:
        raise ValueError("few-shot prompts need labelled records; the paper task has none")
    if task == "entity_and_entity_type":  # paper task: no gold answer, the prompt is the question
        q = render_prompt(df, templates, "kbase", "paper_q", {"text": F.col("text"), "choices": choices}, family=family, name="_q")
        return q.select("*", F.col("_q").alias("prompt_text")).drop("_q")
    if task != "entity_type":
        raise ValueError(f"unknown task {task!r}")
    q = render_prompt(df, templates, "kbase", "entity_type_q",
                      {"entity": F.col("entity"), "text": F.col("text"), "choices": choices},
                      family=family, name="_q")
    if split == "train":
        qa = render_prompt(q, templates, "kbase", "entity_type_a", {"label": F.col("label")},
                           family=family, name="_a")
        text = F.concat("_q", "_a")
        return qa.select("*", text.alias("prompt_text"), text.alias("answer")).drop("_q", "_a")
    pre = F.coalesce(prefix, F.lit("")) if prefix is not None else F.lit("")
    return q.select("*", F.concat(pre, F.col("_q")).alias("prompt_text"),
                    F.col("label").alias("answer")).drop("_q")


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[ \\n]+"), lambda t: t != ""))


def check_length(df: DataFrame, limits: DataFrame, text: str, on: str, new_tokens: int, count: Column | None = None) -> DataFrame:
    """Flag rows whose input tokens plus new tokens exceed the limit;
    a missing limit is an error row instead of an abort (Q16). ``count`` is the number of
    tokens where it is not that of words (ids of a subword tokenizer, for one)."""
    n = token_count(F.col(text)) if count is None else count
    j = df.withColumn("n_tokens", n.cast("long")).join(limits, on, "left")
    total = F.col("n_tokens") + F.lit(new_tokens)
    status = (F.when(F.col("limit").isNull(), F.lit("no_limit"))
              .when(total <= F.col("limit"), F.lit("ok")).otherwise(F.lit("too_long")))
    return j.withColumn("status", status)


def eval_rows(df: DataFrame, split: str | None, sample_size: int = -1) -> DataFrame:
    """The validation or test rows (``split=None`` = whole corpus), at most
    ``sample_size`` of them in order (-1 = all). The rows of a split have
    consecutive ranks ``rn``, so a filter on the rank takes the first ones."""
    out = df if split is None else df.where(F.col("split") == split)
    if sample_size < 0:
        return out
    first = out.agg(F.min("rn").alias("_first"))
    return out.crossJoin(first).where(F.col("rn") < F.col("_first") + sample_size).drop("_first")
