"""Queries that write delimited text, schemas and columnar files, and read them back, with SQL of what they hold.

They write below the folder that driver and executors share (spark.checkpoint.dir); only on
one machine is that a folder below /tmp. A query replaces what its last run of the same
application has written.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.relational import scan
from tessella.plans import workload_sql
from tessella.plans.sink import write_results
from tessella.sources.convert import columnar_to_csv, csv_to_columnar
from tessella.sources.delimited import read_csv, write_csv
from tessella.sources.schema import format_schema, parse_schema, read_schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "/tmp/checkpoints/tessella"
    return f"{shared}/tessella-{spark.sparkContext.applicationId}-{name}"


@_query("SELECT c_custkey, c_name, c_nationkey, ROUND(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Typed columns, split between tasks."""
    rows, at = scan(spark, f"{d}/customer.parquet"), _place(spark, "csv")
    write_csv(rows, at, mode="overwrite")
    return read_csv(spark, at, parse_schema(format_schema(rows.schema))).withColumn("c_acctbal", F.round("c_acctbal", 6))


@_query("SELECT doc_id, text, lang FROM documents")
def csv_round_trip_of_quoted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes, separators and line breaks."""
    rows, at = scan(spark, f"{d}/documents.parquet", ["doc_id", "text", "lang"]), _place(spark, "quoted")
    write_csv(rows, at, mode="overwrite")
    return read_csv(spark, at, rows.schema, multi_line=True)


@_query(
    "SELECT CONCAT_WS(';', p_partkey, CASE WHEN contains(p_name || p_type, ';') THEN NULL ELSE p_name END, p_type, printf('%.6f', p_retailprice)) AS line FROM part"
)
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """What is written, line by line: no quotes where none are needed, six decimals."""
    at = _place(spark, "lines")
    write_csv(scan(spark, f"{d}/part.parquet", ["p_partkey", "p_name", "p_type", "p_retailprice"]), at, sep=";", mode="overwrite")
    return spark.read.text(at).select(F.col("value").alias("line"))


@_query("""SELECT event_id || ',"' || replace(props, '"', '""') || '"' AS line FROM events""")
def csv_quoted_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that hold quotes are enclosed, with their quotes doubled."""
    at = _place(spark, "fields")
    write_csv(scan(spark, f"{d}/events.parquet", ["event_id", "props"]), at, mode="overwrite")
    return spark.read.text(at).select(F.col("value").alias("line"))


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, ROUND(o_totalprice, 6) AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def columnar_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Columnar to text with its schema file, and back to columnar."""
    at = _place(spark, "columnar")
    columnar_to_csv(spark, f"{d}/orders.parquet", f"{at}/text", f"{at}/schema", mode="overwrite")
    csv_to_columnar(spark, f"{at}/schema", f"{at}/text", f"{at}/store", mode="overwrite")
    return scan(spark, f"{at}/store").withColumn("o_totalprice", F.round("o_totalprice", 6))


@_query(
    "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE column_type END AS kind "
    "FROM (DESCRIBE SELECT * FROM lineitem)"
)
def schema_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A schema printed, written, read and printed again."""
    at = _place(spark, "schema")
    text = format_schema(scan(spark, f"{d}/lineitem.parquet").schema).rstrip("\n")
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(at)
    again = format_schema(read_schema(spark, at))
    return spark.range(1).select(F.explode(F.split(F.lit(again.rstrip("\n")), "\n")).alias("line")).select(F.split_part("line", F.lit(","), F.lit(1)).alias("name"), F.split_part("line", F.lit(","), F.lit(2)).alias("kind"))


@_query(workload_sql.SQL["q15_top_of_many_keys"])
def workload_result_sink(spark: SparkSession, d: str) -> DataFrame:
    """A query's rows as the workload writes them."""
    (at,) = write_results(spark, d, _place(spark, "results"), ["q15_top_of_many_keys"], mode="overwrite")
    return read_csv(spark, at, parse_schema("o_custkey,int64\nn,int64\n"))
