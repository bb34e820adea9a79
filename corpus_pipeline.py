"""A corpus from raw documents to token ids: five stages, each written as Parquet and read by the next.

Every stage takes ``(spark, docs, sf_dir)`` and, but for the last, returns the columns of
``documents``. NULL texts count as empty in every decision and stay NULL; texts without
words are never near copies; rows without source share one weight. Extra columns of
``docs`` are carried along, an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lotline.llm import bpe, mixing, ngram_join, quality, secret_scan
from lotline.llm.common import read, stored
from lotline.llm.queries import MIX_WEIGHTS
from lotline.sources.snapshots import scratch_dir

PLACE = {"slot": "long", "share": "string", "place": "long"}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among ``docs``."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies, one of the smallest id."""
    return ngram_join.without_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars`` counted anew where one was."""
    masked = secret_scan.redact_documents(docs.withColumn("__before", F.col("text")), scratch_dir(spark, "ledger"))
    changed = ~F.col("text").eqNullSafe(F.col("__before"))
    count = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", count).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each stored file holds its blocks in the order of the mixed stream.

    The schedule goes on to the next stage as metadata of ``source``, since rows of stored tables have no order.
    """
    mixed = mixing.mix(docs, MIX_WEIGHTS, keep=tuple(docs.columns))
    ordered = mixed.sortWithinPartitions("slot", "share", "place").select(*docs.columns)
    return mixing.with_schedule(ordered, MIX_WEIGHTS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a decoding of each and its place in the mixed stream.

    ``ORDER BY slot, place`` is the stream. The schedule is the one that the mixing stage handed on; the places
    follow from it and the set of documents. Documents without a schedule are in no stream: their ``slot``,
    ``share`` and ``place`` are NULL.
    """
    schedule = mixing.schedule_of(docs)
    if schedule is None:
        placed = docs.withColumns({name: F.lit(None).cast(kind) for name, kind in PLACE.items()})
    else:
        placed = mixing.mix(docs, **schedule, keep=tuple(docs.columns))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.tokens(placed, ranks, public_tokenizers.PATTERN, keep=tuple(PLACE))


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

# The classifier and the encoding have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
