"""Schema files: a line `name,type` for each column."""

from __future__ import annotations

import csv
import io

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tessella.functions.types import spark_type, type_name


def parse_schema(text: str) -> T.StructType:
    """A comma at the end of a line is allowed; repeated names and other shapes are errors."""
    fields = []
    for line in csv.reader(io.StringIO(text)):
        if len(line) == 3 and line[2] == "":
            line = line[:2]
        if len(line) != 2:
            raise ValueError(f"a schema line needs a name and a type: {line}")
        fields.append(T.StructField(line[0], spark_type(line[1]), True))
    if not fields:
        raise ValueError("the schema is empty")
    if len({f.name for f in fields}) < len(fields):
        raise ValueError("column names repeat")
    return T.StructType(fields)


def format_schema(schema: T.StructType) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows((f.name, type_name(f.dataType)) for f in schema.fields)
    return out.getvalue()


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    """From any path that Spark can read."""
    return parse_schema("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
