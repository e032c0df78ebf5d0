"""Schema files, delimited text, the columnar store and conversion."""

import re
import subprocess
import sys

import pytest
from pyspark.sql import types as T

from tessella.functions.types import spark_type, type_name
from tessella.operators.relational import scan
from tessella.sources.convert import columnar_to_csv, csv_to_columnar
from tessella.sources.delimited import read_csv, write_csv
from tessella.sources.schema import format_schema, parse_schema, read_schema
from tests.conftest import ROOT, SF

PAIR = "id,int64\nname,string\n"


def load(spark, tmp_path, text, schema=PAIR, **kw):
    p = tmp_path / "in.csv"
    p.write_bytes(text.encode())
    return [tuple(r) for r in read_csv(spark, str(p), parse_schema(schema), **({"multi_line": True} | kw)).collect()]


def dump(spark, tmp_path, rows, schema=PAIR):
    out = tmp_path / "out"
    write_csv(spark.createDataFrame(rows, parse_schema(schema)).coalesce(1), str(out), mode="overwrite")
    return "".join(p.read_bytes().decode() for p in sorted(out.glob("part-*")))


def test_schema_round_trip_has_all_types():
    text = "a,int128\nb,int64\nc,int32\nd,int16\ne,int8\nf,double\ng,string\nh,DATE\ni,TIMESTAMP\n"
    assert format_schema(parse_schema(text)) == text
    assert parse_schema("small,int16,\nratio,double\n").simpleString() == "struct<small:smallint,ratio:double>"
    assert type_name(T.TimestampType()) == "TIMESTAMP"


@pytest.mark.parametrize("bad", ["a\n", "a,int64,x\n", "a,INT64\n", "a,date\n", "", "a,int8\na,int8\n"])
def test_bad_schemas(bad):
    with pytest.raises(ValueError):
        parse_schema(bad)


def test_no_type_for_arrays():
    with pytest.raises(ValueError):
        type_name(T.ArrayType(T.LongType()))
    with pytest.raises(ValueError):
        spark_type("float")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('1,Alice\n2,"Bob, Jr."\n', [(1, "Alice"), (2, "Bob, Jr.")]),
        ('1,"say ""hi"""\n', [(1, 'say "hi"')]),
        ('1,"""Hello"""\n', [(1, '"Hello"')]),
        ('1,"line\nbreak"\n', [(1, "line\nbreak")]),
        ('1,"a\\nb"\n', [(1, "a\\nb")]),
        ('1,""\n2,\n', [(1, ""), (2, "")]),
        ('1,"a"",""b"\n', [(1, 'a","b')]),
        ("1,Ünïcödé\n2,x", [(1, "Ünïcödé"), (2, "x")]),
        ("", []),
        ('1,ab"c"d\n', [(1, 'ab"c"d')]),
        ("1,a\r\n2,b\r\n", [(1, "a"), (2, "b")]),
        ("1,a\n\n2,b\n", [(1, "a"), (2, "b")]),
    ],
)
def test_read(spark, tmp_path, text, want):
    assert load(spark, tmp_path, text) == want


@pytest.mark.parametrize("text", ["x,a\n", "1,a,b\n", "1\n", ",a\n", "99999999999999999999,a\n"])
def test_bad_rows_are_errors(spark, tmp_path, text):
    with pytest.raises(Exception):
        load(spark, tmp_path, text)


def test_narrow_types_do_not_wrap(spark, tmp_path):
    assert load(spark, tmp_path, "127,1.5\n", "a,int8\nb,double\n") == [(127, 1.5)]
    with pytest.raises(Exception):
        load(spark, tmp_path, "300,1.5\n", "a,int8\nb,double\n")


def test_other_separator_and_split_files(spark, tmp_path):
    assert load(spark, tmp_path, '1;"a;b"\n', sep=";", multi_line=False) == [(1, "a;b")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('1,Alice\n2,"Bob, Jr."\n', [(1, "Alice"), (2, "Bob, Jr.")]),
        ('1,"say ""hi"""\n\n2,"a\\nb"\r\n', [(1, 'say "hi"'), (2, "a\\nb")]),
        ('1,""\n2,\n', [(1, ""), (2, "")]),
        ("", []),
    ],
)
def test_read_line_by_line(spark, tmp_path, text, want):
    assert load(spark, tmp_path, text, multi_line=False) == want


@pytest.mark.parametrize("text", ["x,a\n", "1,a,b\n", "1\n", ",a\n", "99999999999999999999,a\n", '1,"line\nbreak"\n', '1,"open\n2,b\n'])
def test_bad_lines_are_errors(spark, tmp_path, text):
    with pytest.raises(Exception):
        load(spark, tmp_path, text, multi_line=False)


def test_unclosed_quotes_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="not closed"):
        load(spark, tmp_path, '1,a\n2,"open\n3,b\n')


def test_lines_are_split_between_tasks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("".join(f"{k},text {k}\n" for k in range(20_000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = read_csv(spark, str(tmp_path / "in.csv"), parse_schema(PAIR))
        assert df.rdd.getNumPartitions() > 2 and df.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize(
    ("value", "want"),
    [("plain", "plain"), ("", ""), ("a,b", '"a,b"'), ('q"q', '"q""q"'), ("l\nl", '"l\nl"'), ("back\\slash", "back\\slash"), (" pad ", " pad ")],
)
def test_write_quotes_only_where_needed(spark, tmp_path, value, want):
    assert dump(spark, tmp_path, [(7, value)]) == f"7,{want}\n"


def test_write_doubles_with_six_decimals(spark, tmp_path):
    assert dump(spark, tmp_path, [(1.5, 3)], "r,double\nn,int64\n") == "1.500000,3\n"


def test_conversion_round_trip(spark, tmp_path):
    text = '1,"Bob, Jr.",2013-07-15 09:28:29\n2,"say ""x""",2013-07-15 13:51:09\n'
    (tmp_path / "s.csv").write_text("id,int64\nname,string\nt,TIMESTAMP\n")
    (tmp_path / "d.csv").write_text(text)
    csv_to_columnar(spark, str(tmp_path / "s.csv"), str(tmp_path / "d.csv"), str(tmp_path / "store"))
    assert [r.name for r in scan(spark, str(tmp_path / "store"), ["name", "id"]).orderBy("id").collect()] == ["Bob, Jr.", 'say "x"']
    columnar_to_csv(spark, str(tmp_path / "store"), str(tmp_path / "back"), str(tmp_path / "schema"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "back").glob("part-*"))) == text
    assert read_schema(spark, str(tmp_path / "schema")).simpleString() == "struct<id:bigint,name:string,t:timestamp_ntz>"


def test_conversion_does_not_replace(spark, tmp_path):
    (tmp_path / "s.csv").write_text(PAIR)
    (tmp_path / "d.csv").write_text("1,a\n")
    paths = [str(tmp_path / x) for x in ("s.csv", "d.csv", "store")]
    csv_to_columnar(spark, *paths)
    with pytest.raises(Exception, match="exists"):
        csv_to_columnar(spark, *paths)
    csv_to_columnar(spark, *paths, mode="overwrite")


def test_command_line_converts_both_ways(spark, tmp_path, monkeypatch, capsys):
    from tessella.__main__ import main

    monkeypatch.chdir(tmp_path)
    paths = {x: str(tmp_path / x) for x in ("schema.csv", "input.csv", "store", "text", "schema")}
    (tmp_path / "schema.csv").write_text(PAIR)
    (tmp_path / "input.csv").write_text('1,"a\nb"\n2,c\n')
    assert main(["0", paths["schema.csv"], paths["input.csv"], paths["store"], "--multi-line"]) == 0
    assert main(["1", paths["store"], paths["text"], paths["schema"]]) == 0
    assert "".join(p.read_text() for p in (tmp_path / "text").glob("part-*")) == '1,"a\nb"\n2,c\n'
    assert re.findall(r"[0-9.]+ s", capsys.readouterr().out)
    with pytest.raises(SystemExit):
        main(["0", "a", "b", "c", "d"])
    with pytest.raises(SystemExit):
        main(["workload", "a"])


def test_workload_results(spark, tmp_path):
    from tessella.__main__ import main

    assert main(["workload", str(SF), str(tmp_path), "q00_count", "q07_group_count_ordered"]) == 0
    lines = lambda i: "".join(p.read_text() for p in sorted((tmp_path / f"result{i}.csv").glob("part-*"))).splitlines()
    assert lines(0) == [str(spark.read.parquet(f"{SF}/lineitem.parquet").count())]
    counts = [int(x.split(",")[1]) for x in lines(7)]
    assert counts == sorted(counts, reverse=True) and len(counts) > 1


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        scan(spark, str(tmp_path / "none"))


def test_command_line_refuses_other_modes():
    done = subprocess.run([sys.executable, "-m", "tessella", "2", "a", "b", "c"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 2 and "mode" in done.stderr
