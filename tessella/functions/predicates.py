"""Comparisons of a column with a literal, checked against the schema when they are built."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.types import literal

_ORDERED = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


@dataclass(frozen=True)
class Predicate:
    """column SIGN value; build() needs the schema it is used with."""

    column: str
    sign: str
    value: Any

    def build(self, schema: T.StructType) -> Column:
        kind = field_type(schema, self.column)
        column = F.col(f"`{self.column}`")
        if self.sign in _ORDERED:
            return _ORDERED[self.sign](column, literal(self.value, kind))
        if self.sign in ("LIKE", "NOT LIKE"):
            if not isinstance(kind, T.StringType):
                raise TypeError(f"{self.sign} needs a string column; {self.column} is {kind.simpleString()}")
            found = column.like(str(self.value).replace("\\", "\\\\"))
            return found if self.sign == "LIKE" else ~found
        if self.sign == "IN":
            values = self.value.split(",") if isinstance(self.value, str) else list(self.value)
            if isinstance(kind, T.StringType):
                return column.isin([str(v) for v in values])
            return column.isin([literal(v, kind) for v in values])
        raise ValueError(f"unknown sign: {self.sign!r}")


def field_type(schema: T.StructType, column: str) -> T.DataType:
    """The type of a column; unknown and repeated names are errors."""
    found = [f.dataType for f in schema.fields if f.name == column]
    if len(found) != 1:
        raise ValueError(f"{'unknown' if not found else 'ambiguous'} column: {column!r}")
    return found[0]


def eq(column: str, value: Any) -> Predicate:
    return Predicate(column, "=", value)


def ne(column: str, value: Any) -> Predicate:
    return Predicate(column, "<>", value)


def lt(column: str, value: Any) -> Predicate:
    return Predicate(column, "<", value)


def gt(column: str, value: Any) -> Predicate:
    return Predicate(column, ">", value)


def le(column: str, value: Any) -> Predicate:
    return Predicate(column, "<=", value)


def ge(column: str, value: Any) -> Predicate:
    return Predicate(column, ">=", value)


def like(column: str, pattern: str) -> Predicate:
    """`%` is any run and `_` one character; a backslash is an ordinary character."""
    return Predicate(column, "LIKE", pattern)


def not_like(column: str, pattern: str) -> Predicate:
    return Predicate(column, "NOT LIKE", pattern)


def isin(column: str, values: str | Iterable[Any]) -> Predicate:
    """values: a list, or a text with commas between."""
    return Predicate(column, "IN", values if isinstance(values, str) else tuple(values))


def all_of(predicates: Iterable[Predicate | Column], schema: T.StructType) -> Column:
    out = F.lit(True)
    for n, p in enumerate(predicates):
        built = p.build(schema) if isinstance(p, Predicate) else p
        out = built if not n else out & built
    return out
