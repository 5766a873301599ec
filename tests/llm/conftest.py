import pytest

from ledgerlens.llm.common import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)
