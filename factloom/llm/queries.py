"""The registered queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import classifier, exact_dedup, licenses, mixing, packing, quality_rules, simhash, token_counts, token_output, url_filters
from .common import load
from .tokens import vocabulary_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.write_tokens(load(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE), end_id=2).documents(spark)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(load(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE)))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(load(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(load(spark, sf_dir, "documents"), width=4, max_bits=4)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(load(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), vocabulary_path(WORD_BPE), end_id=0, capacity=2048)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(load(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, load(spark, sf_dir, "labels")), threshold=0.3)


QUERIES = {f.__name__: f for f in (op1_token_output, op2_quality_rules, op3_token_counts, op4_url_filters, op5_simhash, op6_mixing, op7_packing, op8_exact_dedup, op9_licenses, op10_classifier)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
