"""Scratch tables and worker tasks shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotline.sources.snapshots import scratch_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Python tasks get batches of this many rows, so that long texts stay within a task's memory.
BATCH_ROWS = 1000
# Text that a task works on at once; one text more may pass it.
CHUNK_CHARS = 4 << 20


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder, read back; removed when the session ends.

    The table outlives lost executors and is not computed again by later jobs.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def batch_task(module: str, name: str, *args) -> Callable[[Iterator], Iterator]:
    """``name(batches, *args)`` of ``lotline.llm.<module>`` as a task for ``mapInArrow`` or ``mapInPandas``.

    The worker finds the package beside the driver's copy where it is not installed.
    """
    return _located(ROOT, module, name, args, lambda call: lambda batches: call(batches))


def _located(root: str, module: str, name: str, args: tuple, shape: Callable) -> Callable:
    def call(data):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(f"lotline.llm.{module}"), name)(data, *args)

    return shape(call)


def texts_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Columns ``doc_id`` and ``text`` of a table and ``more``; a NULL text is the empty one.

    Batches of the Python tasks that follow are kept small.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole, *more)


def text_chunks(texts: list, size: int = CHUNK_CHARS) -> Iterator[list]:
    """Neighbouring texts (or bytes) up to ``size`` characters together; whole texts always."""
    start, held = 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text)
        if held >= size:
            yield texts[start:end]
            start, held = end, 0
    if start < len(texts):
        yield texts[start:]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
