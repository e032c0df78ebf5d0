"""The relational operators on a stream.

`where` and `derive` work on a streaming DataFrame as they are. A grouped aggregate needs
its groups to end some time: `windowed` groups by event-time windows behind a watermark,
so the state that a query holds is bounded by the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.aggregates import Aggregate
from tessella.functions.predicates import field_type


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def windowed(df: DataFrame, time: str, width: str, late: str, aggregates: Sequence[Aggregate], by: Sequence[str] = ()) -> DataFrame:
    """start, `by`, aggregates for each window of `width`; rows later than `late` are dropped from a stream."""
    for c in (time, *by):
        field_type(df.schema, c)
    built = [a.build(df.schema).alias(a.name) for a in aggregates]
    stamped = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = stamped.groupBy(F.window(time, width).alias("_w"), *by).agg(*built)
    return grouped.select(F.col("_w.start").alias("start"), *by, *(a.name for a in aggregates))
