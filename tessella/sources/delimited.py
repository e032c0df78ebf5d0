"""Delimited text with an explicit schema.

Quotes may enclose a field; a doubled quote is a literal one; a backslash is an ordinary
character. There is no header and no NULL: an empty field is an empty text, or an error in
a column of numbers or dates. A quote that is not closed is an error.

Large files are split between tasks, line by line. Quoted fields that hold line breaks need
`multi_line`, for which each file is one task; without it such a field is an error, never
a wrong row. Differences of Spark's reader to a strict one: a quote inside an unquoted field
is an ordinary character, a carriage return before a line feed is dropped, and blank lines
are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIALECT = {"header": "false", "quote": '"', "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "dateFormat": "yyyy-MM-dd"}
_QUOTES = "length(value) - length(replace(value, '\"', ''))"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Rows of the wrong arity and texts that are not of their type are errors.

    multi_line: whether quoted fields may hold line breaks; the quotes of each file are then
    counted beforehand, in a pass of its own.
    """
    options = {**_DIALECT, "sep": sep, "mode": "FAILFAST"}
    if multi_line:
        _refuse_unclosed(spark, path)
        df = spark.read.schema(schema).options(**options, multiLine="true").csv(path)
    else:
        unclosed = F.raise_error(F.concat(F.lit("a quote is not closed in its line: "), F.col("value")))
        lines = spark.read.text(path).where("value <> ''").select(F.when(F.expr(_QUOTES) % 2 == 1, unclosed).otherwise(F.col("value")).alias("value"))
        df = lines.select(F.from_csv("value", _ddl(schema), options).alias("row")).select("row.*")
    columns = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            columns.append(F.coalesce(c, F.lit("")).alias(f.name))
        else:
            columns.append(F.when(c.isNull(), F.raise_error(F.lit(f"empty field in column {f.name}"))).otherwise(c).cast(f.dataType).alias(f.name))
    return df.select(*columns)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _refuse_unclosed(spark: SparkSession, path: str) -> None:
    """An error if a file holds an odd number of quotes."""
    quotes = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.expr(_QUOTES).alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    if odd := quotes.where("n % 2 = 1").select("file").first():
        raise ValueError(f"a quote is not closed in {odd.file}")


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Fields are quoted only where needed; doubles have six decimals."""
    columns = [F.format_string("%.6f", F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    options = {**_DIALECT, "sep": sep, "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.select(*columns).write.mode(mode).options(**options).csv(path)
