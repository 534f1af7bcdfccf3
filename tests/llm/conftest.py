import pytest

from inkprint.ship import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)
    return spark
