"""Relational sources: a parquet directory or a JDBC database."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

SPLIT_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def jdbc_options(name: str, options: Mapping[str, str], env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Options of a JDBC read of a table or of a query in parentheses.

    ``user`` and ``password`` may come from the variables named by ``user_env`` and
    ``password_env``. The four split options go together: without them one task
    would read the whole table, so they must be given, or ``numPartitions`` set to 1
    to say that one task is enough.
    """
    given = {key: str(value) for key, value in options.items()}
    for field in ("user", "password"):
        variable = given.pop(f"{field}_env", None)
        if variable is not None:
            given[field] = env[variable]
    present = [key for key in SPLIT_OPTIONS if key in given]
    if present != list(SPLIT_OPTIONS) and given.get("numPartitions") != "1":
        raise ValueError(f"a JDBC read needs {', '.join(SPLIT_OPTIONS)} (or numPartitions=1)")
    return {"dbtable": name, "fetchsize": "10000", "pushDownPredicate": "true", **given}


def read_table(spark: SparkSession, name: str, source: str | Mapping[str, str]) -> DataFrame:
    """Table ``name`` of a parquet directory (text) or a JDBC source (options)."""
    if isinstance(source, str):
        return spark.read.parquet(f"{source}/{name}.parquet")
    return spark.read.format("jdbc").options(**jdbc_options(name, source)).load()
