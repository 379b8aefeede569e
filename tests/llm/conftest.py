import pytest
from edge_rows import COLUMNS, document_rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (3, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
