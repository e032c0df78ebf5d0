"""SQL over the same tables: register Parquet tables as views and run text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, directory: str, tables: Iterable[str]) -> None:
    for t in tables:
        spark.read.parquet(f"{directory}/{t}.parquet").createOrReplaceTempView(t)


def run(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)
