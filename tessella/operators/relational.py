"""Scan, filter, derive, aggregate, order and limit, usable through DataFrame.transform.

All of them only extend the logical plan; Catalyst prunes columns, pushes predicates into
the Parquet scan, splits aggregates into partial and final ones and fuses ordering with
limits. Names and types are checked while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.aggregates import Aggregate
from tessella.functions.predicates import Predicate, all_of, field_type
from tessella.functions.scalars import Derived


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A columnar table, with only `columns` read, in this order."""
    df = spark.read.parquet(path)
    return df if columns is None else project(df, columns)


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        field_type(df.schema, c)
    return df.select(*(F.col(f"`{c}`") for c in columns))


def where(df: DataFrame, *predicates: Predicate | Column) -> DataFrame:
    """The rows for which all predicates hold."""
    return df.filter(all_of(predicates, df.schema)) if predicates else df


def derive(df: DataFrame, *derived: Derived) -> DataFrame:
    """df with columns appended in order; a later one may use an earlier one. Existing names are refused."""
    for d in derived:
        if d.name in df.columns:
            raise ValueError(f"column exists: {d.name!r}")
        df = df.withColumn(d.name, d.build(df.schema))
    return df


def summarize(df: DataFrame, aggregates: Sequence[Aggregate], by: Sequence[str] = ()) -> DataFrame:
    """One row for all of df (also if it is empty), or one for each group of `by`."""
    names = [*by, *(a.name for a in aggregates)]
    if len(set(names)) < len(names):
        raise ValueError(f"names repeat: {names}")
    for c in by:
        field_type(df.schema, c)
    built = [a.build(df.schema).alias(a.name) for a in aggregates]
    if not built:
        return project(df, by).distinct()
    return df.groupBy(*(F.col(f"`{c}`") for c in by)).agg(*built) if by else df.agg(*built)


def having(df: DataFrame, *predicates: Predicate) -> DataFrame:
    """A filter on the names of aggregates."""
    return where(df, *predicates)


def order(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sorted by names, each of which may end in ` desc`."""
    keys = []
    for name in by:
        column, _, way = name.partition(" ")
        field_type(df.schema, column)
        if way not in ("", "asc", "desc"):
            raise ValueError(f"unknown order: {name!r}")
        keys.append(F.col(f"`{column}`").desc() if way == "desc" else F.col(f"`{column}`").asc())
    return df.orderBy(*keys)


def top(df: DataFrame, n: int, by: Sequence[str], offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + n in the order of `by`, which should be total."""
    ordered = order(df, by)
    return (ordered.offset(offset) if offset else ordered).limit(n)


def limit(df: DataFrame, n: int) -> DataFrame:
    """Any n rows."""
    return df.limit(n)
