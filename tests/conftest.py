import pytest

from tests.compare import duck, session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def con():
    return duck(FOLDER)


@pytest.fixture
def split_mode(spark):
    """Every group of more than a few rows is split."""
    spark.conf.set("trailmark.blockRows", "7")
    yield
    spark.conf.unset("trailmark.blockRows")
