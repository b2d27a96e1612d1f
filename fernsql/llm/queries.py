"""The registered queries of the training-data operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, fingerprints, katz, licenses, oracles, simhash, suffixes, tokens, toxicity, urls
from .common import read


#: Place and pattern of the byte-level vocabulary.
BYTE_BPE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: The rules of the registered URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(spark, docs))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_table(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark, read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, rule string"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(spark, read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(spark, read(spark, sf_dir, "documents"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.find(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(spark, read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), BYTE_BPE, PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(spark, docs, read(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licenses, op2_token_ids, op3_urls, op4_simhash, op5_suffix_dedup, op6_fingerprints, op7_decontam, op8_katz, op9_bpe, op10_toxicity, pipeline)}


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force, an exact round trip or held-out rows: SQL has no form of them."""
    return {"op3_urls": oracles.url_filter(URL_RULES), "op7_decontam": oracles.decontamination()}
