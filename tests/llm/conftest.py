import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """rows(schema, *rows) -> DataFrame of a few rows over two partitions."""
    def make(schema, *data):
        return spark.createDataFrame(list(data), schema).repartition(2)
    return make
