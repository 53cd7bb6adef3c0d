"""The training-corpus pipeline over ``documents``: toxic documents go, one document
of each group of near copies stays, documents with benchmark passages go, sources
are mixed to their target weights, and the rest becomes packed rows of token ids.

Each stage takes (spark, docs, sf_dir), gets what the stage before it wrote, and
all but the last return the columns of ``documents``. The mixing stage returns its
rows in mixed order, which its files hold; the packing stage packs them shard by
shard in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, packing, simhash, toxicity
from tessera.llm.common import crc_mod, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Viterbi decoding and XXH64 fingerprints have no SQL form; tests/llm/test_pipeline.py
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
