import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("4", {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.stop()


@pytest.fixture
def values(spark):
    """Values of one expression over hand-written rows, in row order."""

    def run(expr, rows, schema):
        df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "n int, " + schema)
        return [r[0] for r in df.select("n", expr.alias("v")).orderBy("n").select("v").collect()]

    return run
