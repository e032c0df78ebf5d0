import pytest

from tessella.llm.common import release


@pytest.fixture(autouse=True, scope="module")
def staged_tables(spark):
    """Staged tables go when a module's tests are done."""
    yield
    release(spark)
