"""Conversion between delimited text with a schema file and the columnar store (Parquet)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessella.sources.delimited import read_csv, write_csv
from tessella.sources.schema import format_schema, read_schema


def csv_to_columnar(spark: SparkSession, schema_path: str, csv_path: str, out_path: str, multi_line: bool = False, mode: str = "errorifexists") -> None:
    read_csv(spark, csv_path, read_schema(spark, schema_path), multi_line=multi_line).write.mode(mode).parquet(out_path)


def columnar_to_csv(spark: SparkSession, path: str, csv_path: str, schema_path: str, mode: str = "errorifexists") -> None:
    df = spark.read.parquet(path)
    write_csv(df, csv_path, mode=mode)
    spark.createDataFrame([(format_schema(df.schema).rstrip("\n"),)], "value string").coalesce(1).write.mode(mode).text(schema_path)
