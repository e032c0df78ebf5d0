"""Derived columns. Each builder gives a `Derived` with a default name, checked when it is used."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.predicates import Predicate, all_of, field_type
from tessella.functions.types import INTEGER_BITS, is_integer, is_timestamp, literal, spark_type


@dataclass(frozen=True)
class Derived:
    name: str
    build: Callable[[T.StructType], Column]

    def named(self, name: str) -> Derived:
        return replace(self, name=name)


def _need(schema: T.StructType, column: str, fits: Callable[[T.DataType], bool], what: str) -> Column:
    kind = field_type(schema, column)
    if not fits(kind):
        raise TypeError(f"{what} does not take {column}, a {kind.simpleString()}")
    return F.col(f"`{column}`")


def _is_string(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def minute(column: str) -> Derived:
    return Derived(f"extract(minute FROM {column})", lambda s: F.minute(_need(s, column, is_timestamp, "minute")).cast("bigint"))


def byte_length(column: str) -> Derived:
    """Bytes of the UTF-8 text, not characters."""
    return Derived(f"length({column})", lambda s: F.octet_length(_need(s, column, _is_string, "length")).cast("bigint"))


def regex_replace(column: str, pattern: str, replacement: str) -> Derived:
    """All matches; $1 refers to a group."""
    return Derived(f"regexp_replace({column})", lambda s: F.regexp_replace(_need(s, column, _is_string, "regexp_replace"), F.lit(pattern), F.lit(replacement)))


def add(column: str, k: int, wide: bool = False) -> Derived:
    """Widened to 64 bits first, an error where the result does not fit; `wide`: to int128, which also takes decimals without a fraction."""

    def build(schema: T.StructType) -> Column:
        kind = spark_type("int128" if wide else "int64")
        return _need(schema, column, is_integer if wide else lambda t: type(t) in INTEGER_BITS, "addition").cast(kind) + literal(k, kind)

    return Derived(f"{column} + {k}", build)


def subtract(column: str, k: int, wide: bool = False) -> Derived:
    return add(column, -k, wide).named(f"{column} - {k}")


def constant(value: Any, name: str | None = None) -> Derived:
    """Always a text."""
    return Derived(name or str(value), lambda s: F.lit(str(value)))


def alias(column: str, name: str) -> Derived:
    """A copy under a new name; the column stays."""
    return Derived(name, lambda s: _need(s, column, lambda t: True, "alias"))


def case_when(conditions: Iterable[Predicate], then: str, otherwise: str, name: str) -> Derived:
    """`then` where all conditions hold, else `otherwise`. Each is a column's name or else a text of the other's type."""
    conditions = tuple(conditions)

    def build(schema: T.StructType) -> Column:
        known = {f.name for f in schema.fields}
        if then not in known and otherwise not in known:
            raise ValueError("CASE needs a column in one of its arms")
        kind = field_type(schema, then if then in known else otherwise)
        arms = [F.col(f"`{x}`") if x in known else literal(x, kind) for x in (then, otherwise)]
        return F.when(all_of(conditions, schema), arms[0]).otherwise(arms[1])

    return Derived(name, build)


#: Fixed value: the host of a web address, without a leading www.
HOST = r"^https?://(?:www\.)?([^/]+)/.*$"


def host(column: str) -> Derived:
    return regex_replace(column, HOST, "$1")
