import pytest

from gleanery.session import configure
from tests.compare import oracle, session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = configure(session("4"))
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    return oracle(SF)
