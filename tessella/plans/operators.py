"""A query for each operator, predicate, aggregate and transform, with its SQL.

Whole tables go through each; ordered limits are the feature where they appear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as s
from tessella.functions.aggregates import Aggregate, avg, avg_int, avg_real, count_all, count_distinct, max_, min_, sum_exact, sum_long
from tessella.functions.predicates import Predicate, eq, ge, gt, isin, le, like, lt, ne, not_like
from tessella.functions.scalars import Derived
from tessella.operators.relational import derive, having, limit, order, project, scan, summarize, top, where
from tessella.operators.sql import register

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str, f: Query) -> None:
    QUERIES[name], SQL[name] = f, sql


def _t(spark: SparkSession, d: str, table: str, columns: list[str] | None = None) -> DataFrame:
    return scan(spark, f"{d}/{table}.parquet", columns)


# scans and projections
_add("scan_columns_in_order", "SELECT p_size, p_partkey FROM part", lambda spark, d: _t(spark, d, "part", ["p_size", "p_partkey"]))
_add("scan_all_columns", "SELECT * FROM nation", lambda spark, d: _t(spark, d, "nation"))


# predicates
def _filter(name: str, p: Predicate, sql: str, table: str = "lineitem", key: str = "l_linenumber") -> None:
    _add(f"filter_{name}", f"SELECT {key}, COUNT(*) AS n FROM {table} WHERE {sql} GROUP BY {key}", lambda spark, d: summarize(where(_t(spark, d, table), p), [count_all().named("n")], [key]))


_filter("eq", eq("l_returnflag", "A"), "l_returnflag = 'A'")
_filter("ne", ne("l_returnflag", "A"), "l_returnflag <> 'A'")
_filter("lt", lt("l_quantity", "10.5"), "l_quantity < 10.5")
_filter("gt", gt("l_quantity", 40), "l_quantity > 40")
_filter("le", le("l_shipdate", "1997-06-30 00:00:00"), "l_shipdate <= TIMESTAMP '1997-06-30'")
_filter("ge", ge("l_suppkey", 50), "l_suppkey >= 50")
_filter("like", like("p_name", "%a_e%"), "p_name LIKE '%a_e%'", "part", "p_brand")
_filter("like_backslash", not_like("p_name", "%\\%"), "p_name NOT LIKE '%\\%'", "part", "p_brand")
_filter("not_like", not_like("p_type", "%A%"), "p_type NOT LIKE '%A%'", "part", "p_brand")
_filter("in_numbers", isin("p_size", "1, 7, 49"), "p_size IN (1, 7, 49)", "part", "p_brand")
_filter("in_strings", isin("event_type", ["click", "view"]), "event_type IN ('click', 'view')", "events", "event_type")
_add(
    "filter_conjunction",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_custkey < 200",
    lambda spark, d: project(where(_t(spark, d, "orders"), eq("o_orderstatus", "F"), ge("o_totalprice", 1000), lt("o_custkey", 200)), ["o_orderkey"]),
)


# aggregates: of all rows, of groups, and of no rows
def _aggregate(name: str, table: str, key: str, a: Aggregate, sql: str, after: Callable[[Column], Column] | None = None) -> None:
    absent = "none" if key in ("event_type", "p_brand") else "-1"

    def run(by: list[str], none: bool) -> Query:
        def f(spark: SparkSession, d: str) -> DataFrame:
            rows = _t(spark, d, table)
            out = summarize(where(rows, eq(key, absent)) if none else rows, [a.named("x")], by)
            return out.withColumn("x", after(F.col("x"))) if after else out

        return f

    _add(f"agg_{name}", f"SELECT {sql} AS x FROM {table}", run([], False))
    _add(f"group_{name}", f"SELECT {key}, {sql} AS x FROM {table} GROUP BY {key}", run([key], False))
    empty = sql.replace(" // COUNT(*)", " // NULLIF(COUNT(*), 0)")
    empty = f"COALESCE({empty}, 0)" if name.startswith(("sum", "avg_int")) else empty
    _add(f"empty_{name}", f"SELECT {empty} AS x FROM {table} WHERE CAST({key} AS VARCHAR) = '{absent}'", run([], True))


_aggregate("count", "lineitem", "l_suppkey", count_all(), "COUNT(*)")
_aggregate("sum_int", "lineitem", "l_suppkey", sum_exact("l_orderkey"), "CAST(SUM(l_orderkey) AS BIGINT)", lambda c: c.cast("bigint"))
_aggregate("sum_long", "orders", "o_custkey", sum_long("o_orderkey"), "CAST(SUM(o_orderkey) AS BIGINT)")
_aggregate("sum_double", "events", "event_type", sum_exact("value"), "ROUND(SUM(value), 2)", lambda c: F.round(c, 2))
_aggregate("avg_int", "lineitem", "l_linenumber", avg_int("l_partkey"), "CAST(SUM(l_partkey) // COUNT(*) AS BIGINT)")
_aggregate("avg_of_type", "part", "p_brand", avg("p_size"), "CAST(SUM(p_size) // COUNT(*) AS BIGINT)")
_aggregate("avg_double", "lineitem", "l_linenumber", avg_real("l_quantity"), "ROUND(AVG(l_quantity), 6)", lambda c: F.round(c, 6))
_aggregate("count_distinct", "events", "event_type", count_distinct("user_id"), "COUNT(DISTINCT user_id)")
_aggregate("min_string", "part", "p_brand", min_("p_name"), "MIN(p_name)")
_aggregate("max_string", "part", "p_brand", max_("p_name"), "MAX(p_name)")
_aggregate("min_timestamp", "events", "event_type", min_("ts"), "MIN(ts)")
_aggregate("max_double", "lineitem", "l_linenumber", max_("l_extendedprice"), "MAX(l_extendedprice)")
_aggregate("min_int", "lineitem", "l_suppkey", min_("l_partkey"), "MIN(l_partkey)")
SQL["empty_avg_of_type"] = "SELECT CAST(0 AS BIGINT) AS x"
_add(
    "sum_beyond_64_bits",
    "SELECT CAST(SUM(CAST(l_orderkey AS HUGEINT) + 9223372036854000000) AS VARCHAR) AS x FROM lineitem",
    lambda spark, d: summarize(derive(_t(spark, d, "lineitem"), s.add("l_orderkey", 9223372036854000000, wide=True).named("big")), [sum_exact("big").named("x")]).withColumn("x", F.col("x").cast("string")),
)


# transforms
def _transform(name: str, table: str, key: str, d: Derived, sql: str) -> None:
    _add(f"derive_{name}", f"SELECT {key}, {sql} AS x FROM {table}", lambda spark, at: project(derive(_t(spark, at, table), d.named("x")), [key, "x"]))


_transform("minute", "events", "event_id", s.minute("ts"), "CAST(EXTRACT(MINUTE FROM ts) AS BIGINT)")
_transform("byte_length", "documents", "doc_id", s.byte_length("text"), "CAST(strlen(text) AS BIGINT)")
_transform("regex_replace", "documents", "doc_id", s.regex_replace("source", "([a-z])([0-9])", "$2$1"), r"regexp_replace(source, '([a-z])([0-9])', '\2\1', 'g')")
_transform("host", "pages", "page_id", s.host("url"), r"regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1', 'g')")
_transform("add", "part", "p_partkey", s.add("p_size", 2147483647), "CAST(p_size AS BIGINT) + 2147483647")
_transform("subtract", "part", "p_partkey", s.subtract("p_size", 100), "CAST(p_size AS BIGINT) - 100")
_transform("constant", "region", "r_regionkey", s.constant(1), "'1'")
_transform("alias", "nation", "n_nationkey", s.alias("n_name", "x"), "n_name")
_transform("case_text", "part", "p_partkey", s.case_when([gt("p_size", 10), like("p_type", "%E%")], "p_name", "", "x"), "CASE WHEN p_size > 10 AND p_type LIKE '%E%' THEN p_name ELSE '' END")
_transform("case_number", "part", "p_partkey", s.case_when([eq("p_size", 7)], "p_partkey", "0", "x"), "CASE WHEN p_size = 7 THEN p_partkey ELSE 0 END")
_add(
    "derive_chain",
    "SELECT p_partkey, CAST(p_size AS BIGINT) + 1 AS a, CAST(p_size AS BIGINT) + 3 AS b FROM part",
    lambda spark, d: project(derive(_t(spark, d, "part"), s.add("p_size", 1).named("a"), s.add("a", 2).named("b")), ["p_partkey", "a", "b"]),
)

# order, limit, offset, having
_add("order_without_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", lambda spark, d: order(_t(spark, d, "orders", ["o_orderkey", "o_totalprice"]), ["o_totalprice desc", "o_orderkey"]))
_add("top_mixed_directions", "SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand DESC, p_size, p_partkey DESC LIMIT 17", lambda spark, d: top(_t(spark, d, "part", ["p_brand", "p_size", "p_partkey"]), 17, ["p_brand desc", "p_size", "p_partkey desc"]))
_add("top_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5", lambda spark, d: project(top(_t(spark, d, "customer"), 10, ["c_acctbal", "c_custkey"], offset=5), ["c_custkey"]))
_add("offset_past_end", "SELECT n_name FROM nation ORDER BY n_name LIMIT 10 OFFSET 1000", lambda spark, d: top(_t(spark, d, "nation", ["n_name"]), 10, ["n_name"], offset=1000))
_add("limit_any", "SELECT 1::BIGINT AS one FROM customer LIMIT 10", lambda spark, d: limit(_t(spark, d, "customer"), 10).select(F.lit(1).cast("bigint").alias("one")))
_add("having_two", "SELECT o_custkey, COUNT(*) AS c, MAX(o_orderkey) AS m FROM orders GROUP BY o_custkey HAVING COUNT(*) > 3 AND MAX(o_orderkey) >= 100", lambda spark, d: having(summarize(_t(spark, d, "orders"), [count_all().named("c"), max_("o_orderkey").named("m")], ["o_custkey"]), gt("c", 3), ge("m", 100)))


def _sql_text(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ["lineitem", "orders"])
    return spark.sql(_TEXT)


_TEXT = "SELECT o_orderstatus, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS u FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_orderstatus"
_add("sql_text", _TEXT, _sql_text)
