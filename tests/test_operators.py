"""Semantics that the driver tables do not show: empty input, overflow, bytes, ties, errors, plans."""

import datetime as dt
import decimal
import random
import io
import os
from contextlib import redirect_stdout

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as s
from tessella.functions.aggregates import avg, avg_int, avg_real, count_all, count_distinct, max_, min_, sum_exact, sum_long
from tessella.functions.predicates import Predicate, eq, ge, gt, isin, le, like, lt, ne, not_like
from tessella.operators.relational import derive, having, limit, order, project, scan, summarize, top, where
from tessella.plans import operators
from tessella.streaming.continuous import read_stream, windowed
from tests.conftest import SF


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Alice", 10), (2, "Bob", 20)], "id long, name string, score long")


def vals(df):
    return [tuple(r) for r in df.collect()]


def test_scan_order_and_unknown_columns(people):
    assert vals(project(people, ["score", "id"])) == [(10, 1), (20, 2)]
    with pytest.raises(ValueError):
        project(people, ["nope"])


@pytest.mark.parametrize(
    ("p", "ids"),
    [
        (eq("score", 20), [2]), (eq("score", "20"), [2]), (isin("score", "999, 555, 20"), [2]), (isin("name", ["Bob"]), [2]),
        (like("name", "A_i%e"), [1]), (not_like("name", "%o%"), [1]), (ne("name", ""), [1, 2]), (lt("name", "Alicf"), [1]),
        (ge("score", 10), [1, 2]), (gt("score", 10), [2]), (le("score", 10), [1]),
    ],
)
def test_predicates(people, p, ids):
    assert [r.id for r in where(people, p).orderBy("id").collect()] == ids


def test_like_takes_percent_and_backslash_in_data(spark):
    df = spark.createDataFrame([(1, "x/google%2F"), (2, "a\\b"), (3, "a%b"), (4, "Привет")], "id long, url string")
    assert [r.id for r in where(df, like("url", "%google%")).collect()] == [1]
    assert [r.id for r in where(df, like("url", "a\\b")).collect()] == [2]
    assert [r.id for r in where(df, like("url", "a\\%")).collect()] == [2]
    assert [r.id for r in where(df, like("url", "______")).collect()] == [4]


@pytest.mark.parametrize("p", [like("score", "1%"), eq("nope", 1), Predicate("id", "~", 1), eq("id", "x"), eq("id", ""), isin("id", "1,,2"), eq("id", "1.5"), eq("id", True), eq("id", 2**63)])
def test_predicates_refuse(people, p):
    with pytest.raises((TypeError, ValueError, ArithmeticError)):
        where(people, p)


def test_narrow_literals_do_not_wrap(spark):
    df = spark.createDataFrame([(44,)], "a tinyint")
    with pytest.raises(ValueError):
        where(df, eq("a", "300"))
    assert where(df, eq("a", "44")).count() == 1


def test_dates_compare(spark):
    df = spark.createDataFrame([(dt.date(2013, 7, 15),), (dt.date(2013, 7, 16),)], "d date")
    assert where(df, ge("d", "2013-07-16")).count() == 1
    with pytest.raises(ValueError):
        where(df, ge("d", "July"))


def test_transforms(people, spark):
    case = s.case_when([eq("id", 1)], "name", "", "x")
    assert vals(derive(people, case)) == [(1, "Alice", 10, "Alice"), (2, "Bob", 20, "")]
    number = derive(people, s.case_when([eq("id", 1)], "score", "0", "x"))
    assert vals(number) == [(1, "Alice", 10, 10), (2, "Bob", 20, 0)] and dict(number.dtypes)["x"] == "bigint"
    assert vals(derive(people, s.alias("name", "who")))[0] == (1, "Alice", 10, "Alice")
    assert vals(derive(people, s.subtract("score", 3), s.add("score - 3", 1).named("y")))[0] == (1, "Alice", 10, 7, 8)
    assert dict(derive(people, s.constant(1)).dtypes)["1"] == "string"
    times = spark.createDataFrame([(dt.datetime(2013, 7, 15, 9, 28, 29),), (dt.datetime(2013, 7, 15, 13, 51, 9),)], "t timestamp_ntz")
    assert [r[1] for r in vals(derive(where(times, ge("t", "2013-07-15")), s.minute("t")))] == [28, 51]
    words = spark.createDataFrame([("Привет",), ("",)], "w string")
    assert [r[1] for r in vals(derive(words, s.byte_length("w")))] == [12, 0]
    hosts = spark.createDataFrame([("https://www.a.org/x/y",), ("none",)], "u string")
    assert [r[1] for r in vals(derive(hosts, s.host("u")))] == ["a.org", "none"]


def test_narrow_integers_are_widened(spark):
    df = spark.createDataFrame([(127,)], "a tinyint")
    assert vals(derive(df, s.add("a", 1)))[0][1] == 128


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "decimal(19,0)", "decimal(38,0)"])
def test_wide_additions_go_beyond_64_bits(spark, kind):
    df = spark.createDataFrame([(127,), (-128,), (None,)], "a int").select(F.col("a").cast(kind))
    out = derive(df, s.add("a", 2**63 - 1, wide=True).named("x"), s.subtract("a", 2**63, wide=True).named("y"), s.add("x", 10**30, wide=True).named("z"))
    assert {t for c, t in out.dtypes if c != "a"} == {"decimal(38,0)"}
    assert vals(out.select("x", "y", "z")) == [(2**63 + 126, -(2**63) + 127, 2**63 + 126 + 10**30), (2**63 - 129, -(2**63) - 128, 2**63 - 129 + 10**30), (None, None, None)]


def test_additions_that_do_not_fit_are_errors(spark):
    df = spark.createDataFrame([(2**63 - 1,)], "a long").withColumn("b", F.lit(decimal.Decimal(10**38 - 1)))
    assert vals(derive(df, s.add("a", 2**63 - 1, wide=True).named("x")).select("x")) == [(2**64 - 2,)]
    for d in (s.add("a", 1), s.subtract("a", -1), s.add("b", 1, wide=True)):
        with pytest.raises(Exception, match="OVERFLOW|OUT_OF_RANGE"):
            derive(df, d).collect()
    for d in (s.add("a", 2**63), s.add("b", 1), s.add("a", 10**38, wide=True), s.add("name", 1, wide=True), s.add("r", 1, wide=True)):
        with pytest.raises((TypeError, ValueError)):
            derive(df.withColumns({"name": F.lit("x"), "r": F.lit(1.5)}), d)


def test_the_query_of_sums_beyond_64_bits_takes_large_keys(spark, tmp_path):
    """The shift leaves 775,807 below 2 ** 63; larger tables have larger keys."""
    path = tmp_path / "lineitem.parquet"
    duckdb.execute(f"COPY (SELECT CAST(unnest([0, 775807, 775808, 8999999, 9223372036854775807, -9223372036854775808, NULL]) AS BIGINT) AS l_orderkey) TO '{path}' (FORMAT parquet)")
    want = duckdb.execute(operators.SQL["sum_beyond_64_bits"].replace("lineitem", f"'{path}'")).fetchall()
    assert vals(operators.QUERIES["sum_beyond_64_bits"](spark, str(tmp_path))) == want


@pytest.mark.parametrize("d", [s.minute("name"), s.byte_length("id"), s.add("name", 1), s.regex_replace("id", "a", "b"), s.alias("nope", "x"), s.constant(1, "id"), s.case_when([], "a", "b", "x")])
def test_transforms_refuse(people, d):
    with pytest.raises((TypeError, ValueError)):
        derive(people, d)


ALL = [count_all(), sum_exact("v"), avg_int("v"), count_distinct("v"), min_("v"), max_("v")]


def test_aggregates_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v long")
    assert vals(summarize(none, ALL)) == [(0, 0, 0, 0, None, None)]
    assert vals(summarize(none, ALL, ["k"])) == []
    assert vals(summarize(none, [sum_long("v")])) == [(0,)]
    assert vals(summarize(spark.createDataFrame([], "v double"), [avg_real("v"), sum_exact("v")])) == [(None, 0.0)]


def test_sums_beyond_64_bits(spark):
    big = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,), (5,)], "v long")
    total = 2 * (2**63 - 1) + 5
    assert vals(summarize(big, [sum_exact("v"), avg_int("v")])) == [(decimal.Decimal(total), total // 3)]
    with pytest.raises(Exception):
        summarize(big, [sum_long("v")]).collect()


def test_means_truncate_toward_zero(spark):
    df = spark.createDataFrame([(-3,), (-4,)], "v int")
    assert vals(summarize(df, [avg_int("v"), avg("v").named("b"), avg_real("v").named("c")])) == [(-3, -3, -3.5)]
    assert vals(summarize(spark.createDataFrame([(1.0,), (2.0,)], "v double"), [avg("v")])) == [(1.5,)]


def test_min_of_empty_strings_and_default_names(spark):
    df = spark.createDataFrame([("b",), ("",)], "v string")
    out = summarize(df, [min_("v"), max_("v"), count_distinct("v"), count_all()])
    assert out.columns == ["MIN(v)", "MAX(v)", "COUNT(DISTINCT v)", "COUNT(*)"] and vals(out) == [("", "b", 2, 2)]


def test_shifted_sums_share_one_sum(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    out = summarize(df, [sum_long("v", plus=k).named(f"s{k}") for k in range(90)])
    assert vals(out)[0] == tuple(3 + 2 * k for k in range(90))
    assert explained(out).count("partial_sum") == 1


@pytest.mark.parametrize("kind, bits", [("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64), ("decimal(19,0)", 64)])
def test_sums_in_parts_equal_plain_ones(spark, kind, bits):
    """Both signs, the ends of the range, carries between the parts, and NULL."""
    top = 1 << bits - 1
    r = random.Random(bits)
    groups = [[-top, top - 1, -1, 0, 1], [top - 1] * 9, [-top] * 9, [-1] * 70, [None, 3, -8], [None], *([r.randrange(-top, top) for _ in range(40)] for _ in range(20))]
    rows = spark.createDataFrame([(g, str(v) if v is not None else None) for g, vs in enumerate(groups) for v in vs], "g int, v string")
    rows = rows.select("g", rows.v.cast(kind).alias("v"))
    got = {g: (int(s), a) for g, s, a in vals(summarize(rows, [sum_exact("v"), avg_int("v")], ["g"]))}
    for g, vs in enumerate(groups):
        known = [v for v in vs if v is not None]
        total, n = sum(known), max(len(known), 1)
        assert got[g] == (total, abs(total) // n * (1 if total > 0 else -1))
        if -(1 << 63) + 5 * n <= total < 1 << 63:
            some = rows.where(f"g = {g}")
            assert vals(summarize(some, [sum_long("v"), sum_long("v", plus=-5).named("less")])) == [(total, total - 5 * len(known))]


@pytest.mark.parametrize("v", [(1 << 63) - 1, -(1 << 63)])
def test_a_64_bit_sum_that_does_not_fit_is_an_error(spark, v):
    rows = spark.createDataFrame([(v,), (v,)], "v bigint")
    with pytest.raises(Exception, match="OVERFLOW"):
        summarize(rows, [sum_long("v")]).collect()


@pytest.mark.parametrize("a", [sum_exact("name"), avg_int("name"), sum_long("r"), avg_int("r"), min_("nope"), count_distinct("nope")])
def test_aggregates_refuse(people, a):
    with pytest.raises((TypeError, ValueError)):
        summarize(people.withColumn("r", F.lit(1.5)), [a])


def test_offset_past_the_rows_and_ties(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(1, 13)], "i long, t long")
    assert [r.i for r in top(df, 10, ["i"], offset=5).collect()] == list(range(6, 13))
    assert top(df, 10, ["i"], offset=12).collect() == []
    assert [r.i for r in top(df, 4, ["t desc", "i"]).collect()] == [12, 9, 10, 11]
    assert limit(df, 3).count() == 3
    with pytest.raises(ValueError):
        order(df, ["i sideways"])


def test_no_hidden_limit(spark):
    assert order(spark.range(2500), ["id desc"]).count() == 2500


def test_having_filters_groups(people):
    assert vals(having(summarize(people, [sum_long("score").named("t")], ["name"]), gt("t", 10))) == [("Bob", 20)]


def test_group_by_doubles_is_not_rounded(spark):
    df = spark.createDataFrame([(1.0000001,), (1.0000002,)], "v double")
    assert summarize(df, [count_all()], ["v"]).count() == 2


def test_names_may_not_repeat(people):
    with pytest.raises(ValueError):
        summarize(people, [count_all().named("x"), sum_exact("id").named("x")])


def explained(df, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_plan_prunes_and_pushes(spark):
    rows = where(scan(spark, f"{SF}/lineitem.parquet"), eq("l_returnflag", "A"), like("l_linestatus", "%F%"))
    plan = explained(top(summarize(rows, [count_all().named("n")], ["l_suppkey"]), 10, ["n desc", "l_suppkey"]))
    assert "ReadSchema: struct<l_suppkey:bigint,l_returnflag:string,l_linestatus:string>" in plan
    assert "EqualTo(l_returnflag,A)" in plan and "StringContains(l_linestatus,F)" in plan
    assert "TakeOrderedAndProject" in plan and plan.count("Exchange") <= 3


def test_late_rows_are_dropped_from_a_stream(spark, tmp_path):
    day = lambda k, n: [(f"2024-01-{k:02d} 12:00:00", "x")] * n
    schema = "ts string, kind string"
    for k, rows in enumerate([day(1, 3), day(20, 2), day(20, 1), day(1, 50) + day(20, 1), day(28, 1), day(28, 1)]):  # the 50 come 19 days late
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1)
        df.write.parquet(str(tmp_path / "parts" / str(k)))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / "parts" / str(k)).glob("*.parquet"))
        part.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = windowed(read_stream(spark, str(tmp_path / "in"), df.schema, 1), "ts", "1 day", "2 days", [count_all().named("n")], ["kind"])
    q = stream.writeStream.outputMode("append").format("memory").queryName("in_time").start()
    try:
        q.processAllAvailable()
        assert sorted((r.start.day, r.n) for r in spark.table("in_time").collect()) == [(1, 3), (20, 4)]
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").repartition(3).write.parquet(str(tmp_path / "in"))
    aggregates = [count_all().named("n"), count_distinct("x").named("u")][:1]
    batch = vals(windowed(events, "ts", "1 day", "100 days", aggregates, ["event_type"]))
    stream = windowed(where(read_stream(spark, str(tmp_path / "in"), events.schema, 1), ne("event_type", "")), "ts", "1 day", "100 days", aggregates, ["event_type"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    try:
        q.processAllAvailable()
        assert sorted(vals(spark.table("counted"))) == sorted(batch)
    finally:
        q.stop()
