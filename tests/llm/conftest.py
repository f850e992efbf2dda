import pytest
from llm_rows import edge_rows, frame


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
