import pytest

from basketlens.llm.common import prepare


@pytest.fixture(autouse=True)
def small_batches(spark):
    prepare(spark)
