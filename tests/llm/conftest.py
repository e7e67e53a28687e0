import pytest

from tests.llm import corpus


@pytest.fixture(scope="session")
def rows():
    return corpus.documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, corpus.SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


@pytest.fixture
def write_tables(spark, scratch):
    """A folder with tables as the driver lays them out."""

    def write(**tables):
        folder = scratch("tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
