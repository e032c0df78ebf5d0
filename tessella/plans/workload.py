"""The 42 analytic queries, on the tables at hand, built from the operators.

The names say what a query exercises; `workload_sql` has the SQL of each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.functions import scalars as s
from tessella.functions.aggregates import avg_int, count_all, count_distinct, max_, min_, sum_long
from tessella.functions.predicates import eq, ge, gt, isin, le, like, ne, not_like
from tessella.operators.relational import derive, having, order, project, scan, summarize, top, where

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{table}.parquet")


@_query
def q00_count(spark: SparkSession, d: str) -> DataFrame:
    return summarize(_t(spark, d, "lineitem"), [count_all().named("n")])


@_query
def q01_count_where_not_equal(spark: SparkSession, d: str) -> DataFrame:
    return summarize(where(_t(spark, d, "lineitem"), ne("l_linenumber", 1)), [count_all().named("n")])


@_query
def q02_sum_count_mean(spark: SparkSession, d: str) -> DataFrame:
    return summarize(_t(spark, d, "part"), [sum_long("p_size").named("s"), count_all().named("n"), avg_int("p_size").named("a")])


@_query
def q03_mean_of_large_keys(spark: SparkSession, d: str) -> DataFrame:
    return summarize(_t(spark, d, "lineitem"), [avg_int("l_orderkey").named("a")])


@_query
def q04_distinct_integers(spark: SparkSession, d: str) -> DataFrame:
    return summarize(_t(spark, d, "lineitem"), [count_distinct("l_partkey").named("u")])


@_query
def q05_distinct_strings(spark: SparkSession, d: str) -> DataFrame:
    return summarize(_t(spark, d, "part"), [count_distinct("p_name").named("u")])


@_query
def q06_min_max_date(spark: SparkSession, d: str) -> DataFrame:
    return summarize(_t(spark, d, "orders"), [min_("o_orderdate").named("lo"), max_("o_orderdate").named("hi")])


@_query
def q07_group_count_ordered(spark: SparkSession, d: str) -> DataFrame:
    groups = summarize(where(_t(spark, d, "events"), ne("event_type", "error")), [count_all().named("n")], ["event_type"])
    return order(groups, ["n desc", "event_type"])


@_query
def q08_top_by_distinct(spark: SparkSession, d: str) -> DataFrame:
    return top(summarize(_t(spark, d, "lineitem"), [count_distinct("l_partkey").named("u")], ["l_suppkey"]), 10, ["u desc", "l_suppkey"])


@_query
def q09_top_with_four_aggregates(spark: SparkSession, d: str) -> DataFrame:
    aggregates = [sum_long("l_linenumber").named("s"), count_all().named("c"), avg_int("l_linenumber").named("a"), count_distinct("l_partkey").named("u")]
    return top(summarize(_t(spark, d, "lineitem"), aggregates, ["l_suppkey"]), 10, ["c desc", "l_suppkey"])


@_query
def q10_top_distinct_of_set_strings(spark: SparkSession, d: str) -> DataFrame:
    return top(summarize(where(_t(spark, d, "part"), ne("p_brand", "")), [count_distinct("p_name").named("u")], ["p_brand"]), 10, ["u desc", "p_brand"])


@_query
def q11_top_distinct_two_keys(spark: SparkSession, d: str) -> DataFrame:
    groups = summarize(where(_t(spark, d, "part"), ne("p_brand", "")), [count_distinct("p_name").named("u")], ["p_brand", "p_type"])
    return top(groups, 10, ["u desc", "p_brand", "p_type"])


@_query
def q12_top_string_counts(spark: SparkSession, d: str) -> DataFrame:
    return top(summarize(where(_t(spark, d, "part"), ne("p_name", "")), [count_all().named("c")], ["p_name"]), 10, ["c desc", "p_name"])


@_query
def q13_top_string_distinct(spark: SparkSession, d: str) -> DataFrame:
    groups = summarize(where(_t(spark, d, "events"), ne("event_type", "")), [count_distinct("user_id").named("u")], ["event_type"])
    return top(groups, 10, ["u desc", "event_type"])


@_query
def q14_top_number_and_string_keys(spark: SparkSession, d: str) -> DataFrame:
    groups = summarize(where(_t(spark, d, "events"), ne("event_type", "")), [count_all().named("c")], ["user_id", "event_type"])
    return top(groups, 10, ["c desc", "user_id", "event_type"])


@_query
def q15_top_of_many_keys(spark: SparkSession, d: str) -> DataFrame:
    return top(summarize(_t(spark, d, "orders"), [count_all().named("n")], ["o_custkey"]), 10, ["n desc", "o_custkey"])


@_query
def q16_top_of_many_key_pairs(spark: SparkSession, d: str) -> DataFrame:
    groups = summarize(_t(spark, d, "orders"), [count_all().named("n")], ["o_custkey", "o_orderstatus"])
    return top(groups, 10, ["n desc", "o_custkey", "o_orderstatus"])


@_query
def q17_first_groups_by_key_text(spark: SparkSession, d: str) -> DataFrame:
    groups = summarize(_t(spark, d, "orders"), [count_all().named("n")], ["o_custkey", "o_orderstatus"])
    groups = groups.withColumn("key_text", groups["o_custkey"].cast("string"))
    return project(top(groups, 10, ["key_text", "o_orderstatus"]), ["o_custkey", "o_orderstatus", "n"])


@_query
def q18_minute_as_key(spark: SparkSession, d: str) -> DataFrame:
    events = derive(_t(spark, d, "events"), s.minute("ts").named("m"))
    return top(summarize(events, [count_all().named("n")], ["user_id", "m", "event_type"]), 10, ["n desc", "user_id", "m", "event_type"])


@_query
def q19_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return project(where(_t(spark, d, "orders"), eq("o_orderkey", 4242)), ["o_orderkey"])


@_query
def q20_like_count(spark: SparkSession, d: str) -> DataFrame:
    return summarize(where(_t(spark, d, "pages"), like("url", "%page=%")), [count_all().named("n")])


@_query
def q21_like_min_by_host(spark: SparkSession, d: str) -> DataFrame:
    pages = derive(where(_t(spark, d, "pages"), like("url", "%ref=%"), ne("html", "")), s.host("url").named("k"))
    return top(summarize(pages, [min_("url").named("u"), count_all().named("c")], ["k"]), 10, ["c desc", "k"])


@_query
def q22_like_and_not_like(spark: SparkSession, d: str) -> DataFrame:
    pages = derive(where(_t(spark, d, "pages"), like("html", "%lang=%"), not_like("url", "%ref=%"), ne("url", "")), s.host("url").named("k"))
    aggregates = [min_("url").named("u"), min_("html").named("h"), count_all().named("c"), count_distinct("page_id").named("d")]
    return top(summarize(pages, aggregates, ["k"]), 10, ["c desc", "k"])


@_query
def q23_all_columns_by_time(spark: SparkSession, d: str) -> DataFrame:
    return top(where(_t(spark, d, "events"), like("props", "%7%")), 10, ["ts", "event_id"])


@_query
def q24_one_column_by_time(spark: SparkSession, d: str) -> DataFrame:
    return project(top(where(_t(spark, d, "events"), ne("event_type", "")), 10, ["ts", "event_id"]), ["event_type"])


@_query
def q25_first_strings(spark: SparkSession, d: str) -> DataFrame:
    return top(project(where(_t(spark, d, "part"), ne("p_name", "")), ["p_name"]), 10, ["p_name"])


@_query
def q26_by_time_and_string(spark: SparkSession, d: str) -> DataFrame:
    return project(top(where(_t(spark, d, "events"), ne("event_type", "")), 10, ["ts", "event_type", "event_id"]), ["event_type"])


@_query
def q27_mean_byte_length_having(spark: SparkSession, d: str) -> DataFrame:
    docs = derive(where(_t(spark, d, "documents"), ne("text", "")), s.byte_length("text").named("n_bytes"))
    groups = summarize(docs, [avg_int("n_bytes").named("l"), count_all().named("c")], ["lang"])
    return top(having(groups, gt("c", 110)), 25, ["l desc", "lang"])


@_query
def q28_hosts_having(spark: SparkSession, d: str) -> DataFrame:
    pages = derive(where(_t(spark, d, "pages"), ne("url", "")), s.host("url").named("k"), s.byte_length("url").named("n_bytes"))
    groups = summarize(pages, [avg_int("n_bytes").named("l"), count_all().named("c"), min_("url").named("u")], ["k"])
    return top(having(groups, gt("c", 1)), 25, ["l desc", "k"])


@_query
def q29_ninety_shifted_sums(spark: SparkSession, d: str) -> DataFrame:
    """All sums come from one sum and one count."""
    return summarize(_t(spark, d, "lineitem"), [sum_long("l_linenumber", plus=k).named(f"s{k}") for k in range(90)])


@_query
def q30_two_keys_three_aggregates(spark: SparkSession, d: str) -> DataFrame:
    rows = where(_t(spark, d, "lineitem"), ne("l_returnflag", ""))
    groups = summarize(rows, [count_all().named("c"), sum_long("l_linenumber").named("s"), avg_int("l_partkey").named("a")], ["l_suppkey", "l_linenumber"])
    return top(groups, 10, ["c desc", "l_suppkey", "l_linenumber"])


def _near_unique(rows: DataFrame) -> DataFrame:
    groups = summarize(rows, [count_all().named("c"), sum_long("l_linenumber").named("s"), avg_int("l_suppkey").named("a")], ["l_orderkey", "l_partkey"])
    return top(groups, 10, ["c desc", "l_orderkey", "l_partkey"])


@_query
def q31_near_unique_keys_where(spark: SparkSession, d: str) -> DataFrame:
    return _near_unique(where(_t(spark, d, "lineitem"), ne("l_returnflag", "A")))


@_query
def q32_near_unique_keys(spark: SparkSession, d: str) -> DataFrame:
    return _near_unique(_t(spark, d, "lineitem"))


@_query
def q33_long_string_key(spark: SparkSession, d: str) -> DataFrame:
    return top(summarize(_t(spark, d, "pages"), [count_all().named("c")], ["url"]), 10, ["c desc", "url"])


@_query
def q34_constant_key(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(_t(spark, d, "part"), s.constant("1", "one"))
    return top(summarize(rows, [count_all().named("c")], ["one", "p_brand"]), 10, ["c desc", "p_brand"])


@_query
def q35_keys_from_one_column(spark: SparkSession, d: str) -> DataFrame:
    """The other keys follow from the first, so they are derived from its groups."""
    groups = top(summarize(_t(spark, d, "lineitem"), [count_all().named("c")], ["l_suppkey"]), 10, ["c desc", "l_suppkey"])
    return project(derive(groups, *(s.subtract("l_suppkey", k).named(f"s{k}") for k in (1, 2, 3))), ["l_suppkey", "s1", "s2", "s3", "c"])


@_query
def q36_five_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = where(_t(spark, d, "lineitem"), eq("l_suppkey", 62), ge("l_shipdate", "1997-01-01"), le("l_shipdate", "1999-12-31"), ne("l_linenumber", 0), ne("l_returnflag", ""))
    return top(summarize(rows, [count_all().named("v")], ["l_partkey"]), 10, ["v desc", "l_partkey"])


@_query
def q37_string_key_in_range(spark: SparkSession, d: str) -> DataFrame:
    rows = where(_t(spark, d, "orders"), ge("o_custkey", 100), ge("o_orderdate", "1997-01-01"), le("o_orderdate", "1999-12-31"), eq("o_orderstatus", "F"), ne("o_orderpriority", ""))
    return top(summarize(rows, [count_all().named("v")], ["o_orderpriority"]), 10, ["v desc", "o_orderpriority"])


@_query
def q38_offset_1000(spark: SparkSession, d: str) -> DataFrame:
    rows = where(_t(spark, d, "lineitem"), ge("l_shipdate", "1995-01-01"), le("l_shipdate", "1999-12-31"), ne("l_linenumber", 1))
    return top(summarize(rows, [count_all().named("v")], ["l_partkey"]), 10, ["v desc", "l_partkey"], offset=1000)


@_query
def q39_case_and_alias_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = where(_t(spark, d, "lineitem"), ge("l_shipdate", "1997-01-01"), le("l_shipdate", "2001-12-31"))
    flagged = s.case_when([eq("l_returnflag", "A"), eq("l_linestatus", "F")], "l_returnflag", "", "src")
    rows = derive(rows, flagged, s.alias("l_linestatus", "dst"))
    groups = summarize(rows, [count_all().named("v")], ["l_linenumber", "l_suppkey", "src", "dst"])
    return top(groups, 10, ["v desc", "l_linenumber", "l_suppkey", "src", "dst"], offset=1000)


@_query
def q40_in_list_offset_100(spark: SparkSession, d: str) -> DataFrame:
    rows = where(_t(spark, d, "lineitem"), isin("l_linenumber", "1, 6"), ge("l_shipdate", "1997-01-01"))
    return top(summarize(rows, [count_all().named("v")], ["l_suppkey", "l_returnflag"]), 10, ["v desc", "l_suppkey", "l_returnflag"], offset=100)


@_query
def q41_two_keys_offset_10000(spark: SparkSession, d: str) -> DataFrame:
    groups = summarize(where(_t(spark, d, "orders"), ge("o_orderdate", "1995-01-01")), [count_all().named("v")], ["o_custkey", "o_orderdate"])
    return top(groups, 10, ["v desc", "o_custkey", "o_orderdate"], offset=10000)
