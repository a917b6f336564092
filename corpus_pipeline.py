"""A corpus pipeline: toxicity filter, near-duplicates, repeated passages, source mixing, packing.

Every stage is a job over all rows that its predecessor kept; what it returns is written as Parquet
and read again as the next stage's documents.  All but the last return the columns of ``documents``, others included.

Defined cases: rows without an id pass the filters (they are judged for toxicity) and are packed; null texts count as empty, and of
all empty documents one stays; repeated rows share their fate; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import mixing, packing, simhash, suffix_dedup, toxicity
from quillstack.staging import Stage, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    return toxicity.keep_clean(spark, docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document with the smallest id only."""
    return suffix_dedup.remove_repeats(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that source, language and topic shares meet tempered targets."""
    return mixing.sample(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: The stages learn, link and pack, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stage, docs = Stage(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage.put(name, docs)
    return docs
