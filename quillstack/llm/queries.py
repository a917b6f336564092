"""Registered queries of the language-model operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from corpus_pipeline import run as pipeline
from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import alignment, graph_ann, langid, lexical, licenses, media, mixing, packing, simhash, suffix_dedup, token_files, toxicity, url_filter
from quillstack.staging import read_table


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(spark, read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, read_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.calibrate(spark, read_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(spark, read_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(spark, read_table(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(spark, read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_media_columns": op3_media_columns,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_files": op7_token_files,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_graph_ann": op10_graph_ann,
    "op11_token_alignment": op11_token_alignment,
    "op12_lexical_search": op12_lexical_search,
    "op13_license_scan": op13_license_scan,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": mixing.oracle_sql(),
    "op8_url_filter": url_filter.oracle_sql(),
    "op12_lexical_search": lexical.oracle_sql(),
}
