"""Every query with SQL against DuckDB: names, types' kinds and rows."""

import datetime as dt
import decimal
import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

#: The corpus queries have tests of their own.
SQL = {k: v for k, v in entry.oracle_sql().items() if not re.match(r"op\d+_|pipeline", k)}


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        raise AssertionError("decimals do not compare")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(norm(r[k]) for k in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(SF))
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
