"""The corpus queries that SQL can express, against DuckDB on whole tables."""

import pytest

from tessella.llm.oracles import oracle_sql
from tessella.llm.queries import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, str(SF))
    want = duck.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(r[n] for n in names) for r in df.collect())
    assert got == sorted(want.fetchall())
