"""Type names of schema files, their Spark types, and literals parsed to them."""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names in schema files.
TYPES: dict[str, T.DataType] = {
    "int128": T.DecimalType(38, 0),
    "int64": T.LongType(),
    "int32": T.IntegerType(),
    "int16": T.ShortType(),
    "int8": T.ByteType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
}
INTEGER_BITS = {T.LongType: 64, T.IntegerType: 32, T.ShortType: 16, T.ByteType: 8}


def spark_type(name: str) -> T.DataType:
    if name not in TYPES:
        raise ValueError(f"unknown type: {name!r}")
    return TYPES[name]


def type_name(kind: T.DataType) -> str:
    """The schema file's name of a Spark type. Zoned timestamps are written as TIMESTAMP."""
    if isinstance(kind, T.TimestampType):
        return "TIMESTAMP"
    for name, known in TYPES.items():
        if known == kind:
            return name
    raise ValueError(f"no type name for {kind.simpleString()}")


def is_integer(kind: T.DataType) -> bool:
    return type(kind) in INTEGER_BITS or isinstance(kind, T.DecimalType) and kind.scale == 0


def is_number(kind: T.DataType) -> bool:
    return is_integer(kind) or isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))


def is_timestamp(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def literal(value: Any, kind: T.DataType) -> Column:
    """`value`, or its text, as a literal of `kind`. Text that does not fit is an error now, not per row."""
    return F.lit(parsed(value, kind)).cast(kind)


def parsed(value: Any, kind: T.DataType) -> Any:
    if isinstance(kind, T.StringType):
        return str(value)
    if isinstance(value, bool):
        raise ValueError(f"a truth value is no {kind.simpleString()}")
    text = value.strip() if isinstance(value, str) else value
    if text == "":
        raise ValueError(f"an empty text is no {kind.simpleString()}")
    if is_integer(kind):
        number = int(text)
        bits = INTEGER_BITS.get(type(kind))
        low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if bits else (-(10**38) + 1, 10**38 - 1)
        if number != decimal.Decimal(str(text)) or not low <= number <= high:
            raise ValueError(f"{value!r} does not fit {kind.simpleString()}")
        return number if bits else decimal.Decimal(number)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(text))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(text)
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(text) if isinstance(text, str) else text
    if is_timestamp(kind):
        return dt.datetime.fromisoformat(text) if isinstance(text, str) else text
    raise ValueError(f"no literals of {kind.simpleString()}")
