"""Records of CSV files whose cells hold line breaks, found by many tasks.

A line break ends a record unless it stands within quotes, that is after an odd number of them. Lines are
read in byte ranges as any text; each short stretch of lines counts its quotes and, for both cases
of beginning inside or outside a cell, its records. Prefix sums over the stretches of a file tell
which case holds and the number of the first record, so no task reads a file from its start. Lines of one
record that lie apart are joined by its number.

A quote within a cell must be doubled and its cell quoted, as the writers here do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Lines (a power of two) that are put in order at once.
STRETCH_BITS = 14


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, number, text`` of every record that is not empty, numbered from 0 in its file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("odd", quotes % 2).withColumn("stretch", F.shiftright("at", STRETCH_BITS))
    place = ["file", "block", "stretch"]
    so_far = Window.partitionBy(*place).orderBy("at")
    lines = lines.withColumn("inside", (F.sum("odd").over(so_far) - F.col("odd")) % 2)

    stretches = lines.groupBy(*place).agg(
        F.sum("odd").alias("odd"), F.count_if(F.col("inside") == 0).alias("outer"), F.count_if(F.col("inside") == 1).alias("inner")
    )
    before = Window.partitionBy("file").orderBy("block", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    entered = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    stretches = stretches.withColumn("entered", entered)
    begun = F.when(F.col("entered") == 0, F.col("outer")).otherwise(F.col("inner"))
    first = F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("first")
    stretches = stretches.withColumn("begun", begun).select(*place, "entered", first)

    placed = lines.join(stretches, place)
    begins = F.col("inside") == F.col("entered")
    number = F.col("first") + F.count_if(begins).over(so_far) - 1
    closed = (F.col("inside") + F.col("odd") + F.col("entered")) % 2 == 0
    placed = placed.select("file", number.alias("number"), "block", "at", "value", (begins & closed).alias("whole"))

    whole = placed.filter("whole").select("file", "number", F.col("value").alias("text"))
    cut = placed.filter("not whole").groupBy("file", "number")
    cut = cut.agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    joined = cut.select("file", "number", F.array_join(F.col("lines.value"), "\n").alias("text"))
    # A record that ends in both characters is from a file whose line breaks are both.
    plain = F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\r$", "")
    text = F.when(F.endswith("text", F.lit("\r")), plain).otherwise(F.col("text"))
    return whole.unionByName(joined).withColumn("text", text).filter("text <> ''")


def has_large_file(spark: SparkSession, path: str) -> bool:
    """Some file below ``path`` is larger than one task reads of a file that can be split."""
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    return largest > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def read_records(
    spark: SparkSession,
    path: str,
    options: dict[str, object],
    *,
    header: bool,
    schema: str | None = None,
    infer: bool = False,
) -> DataFrame:
    """The cells of ``csv_records``, as text unless ``schema`` or ``infer`` tell types.

    ``header`` takes the names from the first record of a file, which holds no line break, and leaves out that of each.
    """
    records = csv_records(spark, path)

    def parsed(texts: DataFrame, kind: str | None, types: bool = False) -> DataFrame:
        reader = spark._jsparkSession.read().option("inferSchema", types)
        for name, value in options.items():
            reader = reader.option(name, value)
        if kind:
            reader = reader.schema(kind)
        cells = reader.csv(getattr(texts.select("text")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING()))
        return DataFrame(cells, spark)

    if not header:
        return parsed(records, schema, infer)
    rows = records.filter("number > 0")
    if schema:
        return parsed(rows, schema)
    names = spark.read.options(**options).option("header", True).csv(path).columns
    plain = ", ".join(f"`{name}` string" for name in names)
    if infer and (typed := parsed(rows, None, True)).columns:
        return typed.toDF(*names)
    return parsed(rows, plain) if names else spark.createDataFrame([], "")
