"""Whole-range replacement of a published table.

A snapshot is written to a new directory and then named in a small pointer file
that is replaced in one step, so a failed run leaves the previous snapshot in
place and readers never see half of one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from lotline.functions.display import text_export
from lotline.sources.records import read_records
from lotline.sources.sheets import DIALECT

POINTER = "CURRENT"
# A cell without value, as told from an empty text.
NULL_CELL = "\\N"


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """New directory name in the shared folder of the cluster.

    That is ``spark.checkpoint.dir``. Where the session names none, it is a folder in the
    home directory of the default file system, or, when driver and executors are one
    process (master ``local``), in its temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            home = spark._jvm.java.lang.System.getProperty("java.io.tmpdir")
        else:
            hadoop = spark._jvm.org.apache.hadoop.fs
            home = hadoop.FileSystem.get(spark._jsc.hadoopConfiguration()).getHomeDirectory().toString()
        base = f"{home.rstrip('/')}/lotline-scratch"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def scratch_copy(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back; removed when the session ends."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop file context for ``path`` and its path constructor."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    uri = hadoop.Path(path).toUri()
    if uri.getScheme():
        return hadoop.FileContext.getFileContext(uri, conf), hadoop
    return hadoop.FileContext.getFileContext(conf), hadoop


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Published snapshot and the one before it, newest first; empty when nothing was published."""
    context, hadoop = _files(spark, path)
    if not context.util().exists(hadoop.Path(f"{path}/{POINTER}")):
        return []
    return spark.read.text(f"{path}/{POINTER}", wholetext=True).first()[0].split()


def _drop(spark: SparkSession, path: str, version: str) -> None:
    context, hadoop = _files(spark, path)
    context.delete(hadoop.Path(f"{path}/{version}"), True)


def _publish(spark: SparkSession, path: str, versions: list[str]) -> None:
    """Name the versions in the pointer file; the rename replaces the old one at once."""
    context, hadoop = _files(spark, path)
    gateway = spark.sparkContext._gateway
    options = spark._jvm.org.apache.hadoop.fs.Options
    draft = hadoop.Path(f"{path}/.{versions[0]}.pointer")
    create = gateway.new_array(options.CreateOpts, 1)
    create[0] = options.CreateOpts.createParent()
    flags = spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE, hadoop.CreateFlag.OVERWRITE)
    stream = context.create(draft, flags, create)
    stream.write(bytearray("\n".join(versions), "utf-8"))
    stream.close()
    replace = gateway.new_array(options.Rename, 1)
    replace[0] = options.Rename.OVERWRITE
    context.rename(draft, hadoop.Path(f"{path}/{POINTER}"), replace)


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet", header: bool = False) -> int:
    """Replace what ``path`` holds by ``df`` and return the number of rows written.

    CSV is written as text cells as they are, NULL as ``\\N``, with a header row only when asked for. The snapshot
    before stays for readers that have begun; older ones are removed.
    """
    spark = df.sparkSession
    version = f"snapshot-{uuid.uuid4().hex}"
    written = Observation()
    out = text_export(df) if fmt == "csv" else df
    writer = out.observe(written, F.count(F.lit(1)).alias("rows")).write.format(fmt)
    if fmt == "csv":
        writer = writer.options(**DIALECT).option("nullValue", NULL_CELL).option("header", header)
    try:
        writer.save(f"{path}/{version}")
    except Exception:
        _drop(spark, path, version)
        raise
    earlier = _versions(spark, path)
    _publish(spark, path, [version, *earlier[:1]])
    for old in earlier[1:]:
        _drop(spark, path, old)
    return written.get["rows"]


def current_snapshot(spark: SparkSession, path: str) -> str:
    """Directory of the published snapshot; raises when nothing was published."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no snapshot at {path}")
    return f"{path}/{versions[0]}"


def read_snapshot(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    fmt: str = "parquet",
    header: bool = False,
    split: bool = False,
) -> DataFrame:
    """The published snapshot. A CSV file is read in one piece, as its cells may hold line breaks, or by
    many tasks with ``split``."""
    place = current_snapshot(spark, path)
    if fmt == "csv" and split:
        return read_records(spark, place, DIALECT | {"nullValue": NULL_CELL}, header=header, schema=schema)
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(**DIALECT).options(nullValue=NULL_CELL, multiLine=True, header=header)
    return reader.load(place)
