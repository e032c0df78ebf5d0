"""Aggregates with exact integer semantics. Each builder gives an `Aggregate` with an SQL-style name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.predicates import field_type
from tessella.functions.types import INTEGER_BITS, is_integer, is_number


@dataclass(frozen=True)
class Aggregate:
    name: str
    build: Callable[[T.StructType], Column]

    def named(self, name: str) -> Aggregate:
        return replace(self, name=name)


def _number(schema: T.StructType, column: str, what: str) -> tuple[Column, T.DataType]:
    kind = field_type(schema, column)
    if not is_number(kind):
        raise TypeError(f"{what} needs numbers; {column} is {kind.simpleString()}")
    return F.col(f"`{column}`"), kind


#: Bits that are summed apart from those above them, lowest first, by the width of an integer:
#: no 64-bit sum of the parts overflows below 2 ** 42 rows of a group.
_LOW_BITS = {T.ByteType: (), T.ShortType: (), T.IntegerType: (16,), T.LongType: (21, 21)}


@dataclass(frozen=True)
class _Total:
    """SQL of a group's exact sum: as 64 bits where `fits` holds, and as a decimal. NULL without values."""

    fits: str
    long: str
    decimal: str


def _total(column: str, kind: T.DataType) -> _Total:
    """The sum of an integer column.

    The column's bits are summed in parts, as 64-bit numbers, so that the hash aggregate
    keeps primitive buffers; what the lower parts carry is added to the upper ones
    afterwards. Decimals are summed as they are.
    """
    c = f"`{column}`"
    if isinstance(kind, T.DecimalType):
        return _Total("false", "0L", f"sum({c})")
    c, below, rest, carry = f"cast({c} as bigint)", 0, "0L", "0L"
    for bits in _LOW_BITS[type(kind)]:
        mask = f"{(1 << bits) - 1}L"
        part = f"(sum(shiftright({c}, {below}) & {mask}) + {carry})"
        rest, carry = f"({rest} + shiftleft({part} & {mask}, {below}))", f"shiftright({part}, {bits})"
        below += bits
    top, most = f"(sum(shiftright({c}, {below})) + {carry})", 1 << 63 - below
    # 0 <= rest < 2 ** below, so the sum fits into 64 bits just if the top does into what is left
    fits = f"{top} between -{most}L and {most - 1}L" if below else f"{top} is not null"
    return _Total(fits, f"({top} * {1 << below}L + {rest})", f"(cast({top} as decimal(20,0)) * {1 << below}BD + cast({rest} as decimal(14,0)))")


def count_all() -> Aggregate:
    return Aggregate("COUNT(*)", lambda s: F.count(F.lit(1)))


def sum_exact(column: str) -> Aggregate:
    """Integers: a decimal of 38 digits; doubles: a double. 0 without rows."""

    def build(schema: T.StructType) -> Column:
        c, kind = _number(schema, column, "SUM")
        return F.expr(f"cast(coalesce({_total(column, kind).decimal}, 0BD) as decimal(38,0))") if is_integer(kind) else F.coalesce(F.sum(c), F.lit(0.0))

    return Aggregate(f"SUM({column})", build)


def sum_long(column: str, plus: int = 0) -> Aggregate:
    """The exact sum of column + plus as 64 bits, an error if it does not fit. 0 without rows.

    The shift is applied after summing, so any number of shifted sums of a column share
    one sum and one count. Columns of at most 32 bits are summed in 64 bits, so a partial sum
    that does not fit is an error too; that takes more than 2 ** 32 rows.
    """

    def build(schema: T.StructType) -> Column:
        _, kind = _number(schema, column, "SUM")
        if not is_integer(kind):
            raise TypeError(f"a 64-bit sum needs integers; {column} is {kind.simpleString()}")
        narrow = INTEGER_BITS.get(type(kind), 64) < 64
        plain = f"sum(cast(`{column}` as bigint))"
        total = _Total("true", plain, plain) if narrow else _total(column, kind)
        if plus:
            shifted = f"cast({total.decimal} as decimal(38,0)) + cast({plus} as decimal(19,0)) * count(`{column}`)"
            return F.expr(f"cast(coalesce({shifted}, 0BD) as bigint)")
        return F.expr(f"coalesce({total.long}, 0L)" if narrow else f"coalesce(if({total.fits}, {total.long}, cast({total.decimal} as bigint)), 0L)")

    return Aggregate(f"SUM({column}{f' + {plus}' if plus else ''})", build)


def avg_int(column: str) -> Aggregate:
    """Integers: the mean truncated toward zero, as 64 bits; 0 without rows."""

    def build(schema: T.StructType) -> Column:
        _, kind = _number(schema, column, "AVG")
        if not is_integer(kind):
            raise TypeError(f"a truncated mean needs integers; {column} is {kind.simpleString()}")
        total, n = _total(column, kind), f"nullif(count(`{column}`), 0)"
        return F.expr(f"coalesce(if({total.fits}, {total.long} div {n}, {total.decimal} div {n}), 0L)")

    return Aggregate(f"AVG({column})", build)


def avg_real(column: str) -> Aggregate:
    """The mean as a double."""
    return Aggregate(f"AVG({column})", lambda s: F.avg(_number(s, column, "AVG")[0].cast("double")))


def avg(column: str) -> Aggregate:
    """avg_int of integers, avg_real of doubles."""
    return Aggregate(f"AVG({column})", lambda s: (avg_int if is_integer(_number(s, column, "AVG")[1]) else avg_real)(column).build(s))


def count_distinct(column: str) -> Aggregate:
    """Exact."""

    def build(schema: T.StructType) -> Column:
        field_type(schema, column)
        return F.countDistinct(F.col(f"`{column}`"))

    return Aggregate(f"COUNT(DISTINCT {column})", build)


def _ordered(name: str, f: Callable[[Column], Column], column: str) -> Aggregate:
    def build(schema: T.StructType) -> Column:
        field_type(schema, column)
        return f(F.col(f"`{column}`"))

    return Aggregate(f"{name}({column})", build)


def min_(column: str) -> Aggregate:
    return _ordered("MIN", F.min, column)


def max_(column: str) -> Aggregate:
    return _ordered("MAX", F.max, column)
