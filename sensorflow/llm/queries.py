"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.llm import (
    alignment,
    archives,
    byte_bpe,
    exact_dedup,
    filter_audit,
    ngram_join,
    oracles,
    packing,
    personal_data,
    quality_rules,
    secret_scan,
    token_counts,
    topk_search,
    url_filter,
)
from sensorflow.session import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(personal_data.find(_table(spark, sf_dir, "documents")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(_table(spark, sf_dir, "documents"), vocabulary, capacity=2048)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(_table(spark, sf_dir, "documents"), size=3, percent=90)


# Fixed: the rules that the query judges by.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "archives")
    archives.write(_table(spark, sf_dir, "pages"), folder)
    return archives.read(spark, folder, with_payload=False).drop("payload", "target")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    repository = F.concat_ws("/", "source", "lang")
    return secret_scan.report(secret_scan.find(docs, F.col("source"), repository))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.counted(_table(spark, sf_dir, "documents"), vocabulary, limit=512)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.aligned(_table(spark, sf_dir, "documents"), left, right)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_exact_dedup,
        op3_personal_data,
        op4_byte_bpe,
        op5_packing,
        op6_ngram_join,
        op7_url_filter,
        op8_archives,
        op9_secret_scan,
        op10_token_counts,
        op11_filter_audit,
        op12_topk_search,
        op13_alignment,
    )
}
SQL = oracles.SQL
