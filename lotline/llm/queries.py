"""The operators of this package applied to their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lotline.llm import (
    bpe,
    divergence,
    language,
    mixing,
    ngram_join,
    part_codes,
    periodic,
    quality,
    secret_scan,
    token_files,
    toxicity,
    url_filter,
    vector_forest,
)
from lotline.llm.common import read
from lotline.llm.sql import mixing_sql, part_codes_sql, secret_scan_sql, url_filter_sql, vector_links_sql
from lotline.sources.snapshots import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Blocks per period of a thousand.
MIX_WEIGHTS = {"src0": 120, "src1": 100, "src2": 80} | {f"src{i}": 40 for i in range(3, 20)} | {mixing.REST: 20}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= quality.KEEP).cast("int"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= toxicity.TOXIC).cast("int"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_documents(read(spark, sf_dir, "documents"), scratch_dir(spark, "ledger"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.concat_ws(",", "base_spans").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", "spans").alias("spans"),
    )


@query
def op6_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_rules(read(spark, sf_dir, "documents"))


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), MIX_WEIGHTS)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(
        read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json")
    )
    return token_files.read_token_index(spark, path)


@query
def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.part_codes(read(spark, sf_dir, "embeddings"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(read(spark, sf_dir, "documents"))
    return periodic.digests(periodic.periodic_runs(docs))


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(read(spark, sf_dir, "documents"))


SQL |= {
    "op3_url_filter": url_filter_sql(),
    "op5_secret_scan": secret_scan_sql(),
    "op6_vector_forest": vector_links_sql(),
    "op9_source_mixing": mixing_sql(MIX_WEIGHTS),
    "op11_part_codes": part_codes_sql(),
}
