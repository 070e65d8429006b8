import json

import pytest
from pyspark.errors import AnalysisException

from spanwright.sources import tables


def test_jsonl_round_trip_and_refusal(spark, tmp_path):
    q = spark.createDataFrame([("q1", "Why?", "t", "easy", ["p1", "p2"], "a")], tables.SCHEMAS["questions"])
    tables.write_jsonl(q, f"{tmp_path}/q")
    assert tables.read_jsonl(spark, f"{tmp_path}/q", "questions").collect() == q.collect()
    with pytest.raises(AnalysisException):
        tables.write_jsonl(q, f"{tmp_path}/q")


def test_nested_csv_and_union(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cases": [{"id": "s1", "n": 1}, {"id": "s2", "n": 2}]}))
    assert [tuple(r) for r in tables.read_nested(spark, f"{tmp_path}/a.json", "cases", "id string, n int").collect()] == [("s1", 1), ("s2", 2)]
    (tmp_path / "a.csv").write_text('sheet,row,col,value\nx,1,2,"a, ""b"""\n')
    assert [tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/a.csv", "cells").collect()] == [("x", 1, 2, 'a, "b"')]
    a, b = spark.createDataFrame([(1, "7")], "x int, y string"), spark.createDataFrame([(2, "no")], "x int, z string")
    u = tables.union_of_keys([a, b])
    assert u.columns == ["x", "y", "z"]
    assert [r.y for r in tables.numeric(u, ["y", "absent"]).orderBy("x").collect()] == [7.0, None]


def test_partitioned_folders_prune(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "config_id string, n int")
    tables.write_partitioned(df, f"{tmp_path}/c", "config_id")
    one = spark.read.parquet(f"{tmp_path}/c").filter("config_id = 'a'")
    assert [r.n for r in one.collect()] == [1]
    assert len(one.inputFiles()) <= 2


def test_broken_line_is_an_error(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2\n{"x": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, f"{tmp_path}/b.jsonl", "x int").collect()


def test_csv_with_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("a", 'b, "c"'), ("d", None)], "id string, note string")
    tables.write_csv_with_bom(df.coalesce(1), f"{tmp_path}/e")
    part = next((tmp_path / "e").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,note")
    assert tables.read_csv(spark, f"{tmp_path}/e", "id string, note string").count() == 2
