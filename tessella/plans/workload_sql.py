"""The SQL of the workload's queries, for DuckDB."""

from __future__ import annotations

_HOST = r"regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1', 'g')"


def _mean(c: str) -> str:
    return f"CAST(SUM({c}) // COUNT(*) AS BIGINT)"


_SHIFTED = ", ".join(f"CAST(SUM(CAST(l_linenumber AS BIGINT) + {k}) AS BIGINT) AS s{k}" for k in range(90))
_NEAR_UNIQUE = f"""SELECT l_orderkey, l_partkey, COUNT(*) AS c, CAST(SUM(l_linenumber) AS BIGINT) AS s, {_mean("l_suppkey")} AS a FROM lineitem {{}}
    GROUP BY l_orderkey, l_partkey ORDER BY c DESC, l_orderkey, l_partkey LIMIT 10"""

SQL: dict[str, str] = {
    "q00_count": "SELECT COUNT(*) AS n FROM lineitem",
    "q01_count_where_not_equal": "SELECT COUNT(*) AS n FROM lineitem WHERE l_linenumber <> 1",
    "q02_sum_count_mean": f"SELECT CAST(SUM(p_size) AS BIGINT) AS s, COUNT(*) AS n, {_mean('p_size')} AS a FROM part",
    "q03_mean_of_large_keys": f"SELECT {_mean('l_orderkey')} AS a FROM lineitem",
    "q04_distinct_integers": "SELECT COUNT(DISTINCT l_partkey) AS u FROM lineitem",
    "q05_distinct_strings": "SELECT COUNT(DISTINCT p_name) AS u FROM part",
    "q06_min_max_date": "SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders",
    "q07_group_count_ordered": "SELECT event_type, COUNT(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type ORDER BY n DESC, event_type",
    "q08_top_by_distinct": "SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS u FROM lineitem GROUP BY l_suppkey ORDER BY u DESC, l_suppkey LIMIT 10",
    "q09_top_with_four_aggregates": f"""SELECT l_suppkey, CAST(SUM(l_linenumber) AS BIGINT) AS s, COUNT(*) AS c, {_mean("l_linenumber")} AS a, COUNT(DISTINCT l_partkey) AS u
        FROM lineitem GROUP BY l_suppkey ORDER BY c DESC, l_suppkey LIMIT 10""",
    "q10_top_distinct_of_set_strings": "SELECT p_brand, COUNT(DISTINCT p_name) AS u FROM part WHERE p_brand <> '' GROUP BY p_brand ORDER BY u DESC, p_brand LIMIT 10",
    "q11_top_distinct_two_keys": "SELECT p_brand, p_type, COUNT(DISTINCT p_name) AS u FROM part WHERE p_brand <> '' GROUP BY p_brand, p_type ORDER BY u DESC, p_brand, p_type LIMIT 10",
    "q12_top_string_counts": "SELECT p_name, COUNT(*) AS c FROM part WHERE p_name <> '' GROUP BY p_name ORDER BY c DESC, p_name LIMIT 10",
    "q13_top_string_distinct": "SELECT event_type, COUNT(DISTINCT user_id) AS u FROM events WHERE event_type <> '' GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "q14_top_number_and_string_keys": "SELECT user_id, event_type, COUNT(*) AS c FROM events WHERE event_type <> '' GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10",
    "q15_top_of_many_keys": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "q16_top_of_many_key_pairs": "SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus ORDER BY n DESC, o_custkey, o_orderstatus LIMIT 10",
    "q17_first_groups_by_key_text": "SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus ORDER BY CAST(o_custkey AS VARCHAR), o_orderstatus LIMIT 10",
    "q18_minute_as_key": """SELECT user_id, CAST(EXTRACT(MINUTE FROM ts) AS BIGINT) AS m, event_type, COUNT(*) AS n FROM events
        GROUP BY user_id, m, event_type ORDER BY n DESC, user_id, m, event_type LIMIT 10""",
    "q19_point_lookup": "SELECT o_orderkey FROM orders WHERE o_orderkey = 4242",
    "q20_like_count": "SELECT COUNT(*) AS n FROM pages WHERE url LIKE '%page=%'",
    "q21_like_min_by_host": f"SELECT {_HOST} AS k, MIN(url) AS u, COUNT(*) AS c FROM pages WHERE url LIKE '%ref=%' AND html <> '' GROUP BY k ORDER BY c DESC, k LIMIT 10",
    "q22_like_and_not_like": f"""SELECT {_HOST} AS k, MIN(url) AS u, MIN(html) AS h, COUNT(*) AS c, COUNT(DISTINCT page_id) AS d FROM pages
        WHERE html LIKE '%lang=%' AND url NOT LIKE '%ref=%' AND url <> '' GROUP BY k ORDER BY c DESC, k LIMIT 10""",
    "q23_all_columns_by_time": "SELECT * FROM events WHERE props LIKE '%7%' ORDER BY ts, event_id LIMIT 10",
    "q24_one_column_by_time": "SELECT event_type FROM events WHERE event_type <> '' ORDER BY ts, event_id LIMIT 10",
    "q25_first_strings": "SELECT p_name FROM part WHERE p_name <> '' ORDER BY p_name LIMIT 10",
    "q26_by_time_and_string": "SELECT event_type FROM events WHERE event_type <> '' ORDER BY ts, event_type, event_id LIMIT 10",
    "q27_mean_byte_length_having": f"SELECT lang, {_mean('strlen(text)')} AS l, COUNT(*) AS c FROM documents WHERE text <> '' GROUP BY lang HAVING COUNT(*) > 110 ORDER BY l DESC, lang LIMIT 25",
    "q28_hosts_having": f"SELECT {_HOST} AS k, {_mean('strlen(url)')} AS l, COUNT(*) AS c, MIN(url) AS u FROM pages WHERE url <> '' GROUP BY k HAVING COUNT(*) > 1 ORDER BY l DESC, k LIMIT 25",
    "q29_ninety_shifted_sums": f"SELECT {_SHIFTED} FROM lineitem",
    "q30_two_keys_three_aggregates": f"""SELECT l_suppkey, l_linenumber, COUNT(*) AS c, CAST(SUM(l_linenumber) AS BIGINT) AS s, {_mean("l_partkey")} AS a FROM lineitem
        WHERE l_returnflag <> '' GROUP BY l_suppkey, l_linenumber ORDER BY c DESC, l_suppkey, l_linenumber LIMIT 10""",
    "q31_near_unique_keys_where": _NEAR_UNIQUE.format("WHERE l_returnflag <> 'A'"),
    "q32_near_unique_keys": _NEAR_UNIQUE.format(""),
    "q33_long_string_key": "SELECT url, COUNT(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10",
    "q34_constant_key": "SELECT '1' AS one, p_brand, COUNT(*) AS c FROM part GROUP BY p_brand ORDER BY c DESC, p_brand LIMIT 10",
    "q35_keys_from_one_column": """SELECT l_suppkey, l_suppkey - 1 AS s1, l_suppkey - 2 AS s2, l_suppkey - 3 AS s3, COUNT(*) AS c FROM lineitem
        GROUP BY l_suppkey, s1, s2, s3 ORDER BY c DESC, l_suppkey LIMIT 10""",
    "q36_five_predicates": """SELECT l_partkey, COUNT(*) AS v FROM lineitem WHERE l_suppkey = 62 AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1999-12-31'
        AND l_linenumber <> 0 AND l_returnflag <> '' GROUP BY l_partkey ORDER BY v DESC, l_partkey LIMIT 10""",
    "q37_string_key_in_range": """SELECT o_orderpriority, COUNT(*) AS v FROM orders WHERE o_custkey >= 100 AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31'
        AND o_orderstatus = 'F' AND o_orderpriority <> '' GROUP BY o_orderpriority ORDER BY v DESC, o_orderpriority LIMIT 10""",
    "q38_offset_1000": """SELECT l_partkey, COUNT(*) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate <= TIMESTAMP '1999-12-31' AND l_linenumber <> 1
        GROUP BY l_partkey ORDER BY v DESC, l_partkey LIMIT 10 OFFSET 1000""",
    "q39_case_and_alias_keys": """SELECT l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_returnflag ELSE '' END AS src, l_linestatus AS dst, COUNT(*) AS v
        FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '2001-12-31' GROUP BY ALL ORDER BY v DESC, l_linenumber, l_suppkey, src, dst LIMIT 10 OFFSET 1000""",
    "q40_in_list_offset_100": """SELECT l_suppkey, l_returnflag, COUNT(*) AS v FROM lineitem WHERE l_linenumber IN (1, 6) AND l_shipdate >= TIMESTAMP '1997-01-01'
        GROUP BY l_suppkey, l_returnflag ORDER BY v DESC, l_suppkey, l_returnflag LIMIT 10 OFFSET 100""",
    "q41_two_keys_offset_10000": "SELECT o_custkey, o_orderdate, COUNT(*) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY o_custkey, o_orderdate ORDER BY v DESC, o_custkey, o_orderdate LIMIT 10 OFFSET 10000",
}
