"""Registered queries of this subpackage: each one applies an operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, language, line_dedup, mixing, packing, pages, phrases, quality, simhash, token_counts, toxicity, turns
from .common import crc_mod, table


def op1_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_classes(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, names=("slot", "place", "block", "shares"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull()))
    found = language.languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    scored = toxicity.scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.lines(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return turns.audits(turns.damaged(given), given)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.frequent(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact": op1_exact,
    "op2_mixing": op2_mixing,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_html": op8_html,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_conversations": op11_conversations,
    "op12_quality": op12_quality,
    "op13_phrases": op13_phrases,
}
ORACLE: dict[str, str] = {
    # translate() lower-cases A-Z alone; equality is that of the texts themselves
    "op1_exact": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        WINDOW w AS (PARTITION BY t)""",
    "op13_phrases": r"""
        WITH words AS (
            SELECT lang, [x FOR x IN string_split_regex(piece, '[ \t]+') IF x <> ''] AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
        grams AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
                  FROM starts, (VALUES (1), (2), (3), (4)) AS lengths(k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
        places AS (SELECT lang, k, a, phrase, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS i FROM f WHERE k >= 2),
        cuts AS (SELECT p.lang, p.phrase, p.a, l.a AS l, r.a AS r, p.i,
                        CAST(2000000 * CAST(p.a AS HUGEINT) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
                 FROM places p JOIN f l ON l.lang = p.lang AND l.phrase = array_to_string(list_slice(p.w, 1, p.i), ' ')
                 JOIN f r ON r.lang = p.lang AND r.phrase = array_to_string(list_slice(p.w, p.i + 1, p.k), ' ')),
        scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
        within AS (SELECT lang, a, k, w, i AS m, unnest(range(1, k - i + 2)) AS s FROM places WHERE k >= 3 AND i >= 2),
        cover AS (SELECT lang, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase, max(a) AS around FROM within GROUP BY 1, 2)
        SELECT s.lang, CAST(row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS BIGINT) AS rank,
               s.phrase, s.a, s.l, s.r, t.n, s.score
        FROM scored s JOIN total t ON t.lang = s.lang LEFT JOIN cover c ON c.lang = s.lang AND c.phrase = s.phrase
        WHERE c.around IS NULL OR 100 * CAST(c.around AS HUGEINT) < 80 * CAST(s.a AS HUGEINT)
        QUALIFY rank <= 2000""",
}
