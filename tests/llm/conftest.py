import pytest


@pytest.fixture
def frame(spark):
    """Small table from rows and a schema."""

    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build
