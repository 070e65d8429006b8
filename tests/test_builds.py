"""De-identification, incremental builds, resumed generation, score columns, CSV under the union of keys."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from spanwright.operators import deidentify, incremental
from spanwright.plans import ledger
from spanwright.sources import tables
from spanwright.streaming import resume

RULES = "id string, needle string, replacement string"


def cleaned(spark, texts, rules, **more):
    docs = spark.createDataFrame(texts, "doc_id string, text string, N_Removed string" if len(texts[0]) == 3 else "doc_id string, text string")
    return {r.doc_id: r for r in deidentify.deidentify(docs, spark.createDataFrame(rules, RULES), **more).collect()}


def test_longest_of_the_first_and_own_rules_first(spark):
    rules = [(None, "Budi", "[nama]"), (None, "Budi Santoso", "[nama lengkap]"), (None, "santo", "x"), ("q1", "Budi", "[B]"), ("q1", "16 th", "[umur]"), ("q2", "Andi", "[nama]")]
    got = cleaned(spark, [("q1", "Budi, 16 th, Andi", "own"), ("q2", "Budi Santoso dan Andi, Budi", "own"), ("q3", None, "own"), (None, "Budi", "own"), ("q4", "", "own")], rules)
    assert {k: (r.text, r.n_removed) for k, r in got.items()} == {"q1": ("[B], [umur], Andi", 2), "q2": ("[nama lengkap] dan [nama], [nama]", 3), "q3": (None, 0), None: ("[nama]", 1), "q4": ("", 0)}


def test_against_an_alternation(spark):
    rng = random.Random(2)
    needles = sorted({"".join(rng.choice("abé ") for _ in range(rng.randint(1, 4))) for _ in range(25)})
    texts = [(str(i), "".join(rng.choice("abcé ") for _ in range(60))) for i in range(40)]
    got = cleaned(spark, texts, [(None, n, "#") for n in needles])
    pattern = re.compile("|".join(map(re.escape, sorted(needles, key=lambda n: (-len(n), n)))))
    assert {k: (r.text, r.n_removed) for k, r in got.items()} == {i: pattern.subn("#", t) for i, t in texts}


def test_refusals_of_deidentify(spark):
    with pytest.raises(deidentify.TableMissing):
        cleaned(spark, [("q", "x")], [])
    for bad in [(None, "", "x")], [(None, None, "x")], [(None, "a", None)], [("q", "a", "x"), ("q", "a", "y")]:
        with pytest.raises(ValueError, match="rules without"):
            cleaned(spark, [("q", "x")], bad)
    for text, rules in (("aXb", [(None, "X", ""), (None, "ab", "-")]), ("n", [(None, "n", "[n]")])):
        with pytest.raises(Exception, match="an identifier survives in doc_id q"):
            cleaned(spark, [("q", text)], rules)
        assert cleaned(spark, [("q", text)], rules, strict=False)["q"].survives


def test_sealed_tables_in_both_layouts(spark):
    df = spark.createDataFrame([('{"_note": "x", "q1": [["Andi", "[nama]"], ["16 th", ""]], "q2": []}',), ('{"version": 2, "rules": {"_n": [["z", "z"]], "q3": [["Budi", "[nama]"]]}}',), (None,)], "sealed string")
    assert sorted(tuple(r) for r in deidentify.sealed_rules(df).collect()) == [("q1", "16 th", ""), ("q1", "Andi", "[nama]"), ("q3", "Budi", "[nama]")]


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names}


def test_a_second_run_writes_no_file(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    want = lambda *rows: spark.createDataFrame(rows, "variant string, inputs string")
    build = lambda todo: todo.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).select("variant", F.concat("inputs", "x").alias("v"))
    assert incremental.build_missing(spark, at, want(("a", "1"), ("b", "1")), build, "one") == ["a", "b"]
    before = files(tmp_path)
    assert incremental.build_missing(spark, at, want(("a", "1"), ("b", "1")), build, "two") == [] and files(tmp_path) == before
    assert incremental.build_missing(spark, at, want(("a", "1"), ("b", "2"), ("c", "1")), build, "three") == ["b", "c"]
    kept = {k: v for k, v in before.items() if "variant=a" in k}
    assert kept and kept.items() <= files(tmp_path).items()  # what was there is not touched
    held = incremental.rows(spark, at, build(want(("a", "1"))))
    assert sorted((r.variant, r.v) for r in held.collect()) == [("a", "11"), ("a", "12"), ("b", "21"), ("b", "22"), ("c", "11"), ("c", "12")]
    assert {r.variant: (r.inputs, r.run, r.n_rows) for r in incremental.manifest(spark, at).collect()} == {"a": ("1", "one", 2), "b": ("2", "three", 2), "c": ("1", "three", 2)}
    assert incremental.build_missing(spark, at, want(("d", "1")), lambda t: build(t).filter("false"), "four") == ["d"]
    assert incremental.missing(spark, at, want(("d", "1"), ("e", "1"))).count() == 1
    with pytest.raises(ValueError, match="wanted once"):
        incremental.build_missing(spark, at, want(("e", "1"), ("e", "2")), build, "five")


def test_two_runs_equal_one(spark, tmp_path):
    rng = random.Random(3)
    asked = [(f"q{i}", 1, f"text {i}", i % 3 == 0, None) for i in range(30)] + [("q1", 2, "again", True, None), (None, 1, "no key", True, None)]
    pins = [(f"q{i}", 0, None, None, i % 2 == 0) for i in range(0, 30, 4)]
    write = lambda rows, at: spark.createDataFrame(rows, resume.EVENTS).write.mode("append").parquet(at)

    def run(parts, name):
        at = f"file://{tmp_path}/{name}"
        for part in parts:
            write(part, f"{at}/in")
            resume.generate(spark.readStream.schema(resume.EVENTS).parquet(f"{at}/in"), lambda d: d, f"{at}/out", f"{at}/state").awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(resume.DECIDED).parquet(f"{at}/out").collect())

    once = run([pins + asked], "one")
    assert once == sorted((f"q{i}", f"text {i}", i % 2 == 0 if i % 4 == 0 else i % 3 == 0, i % 4 == 0) for i in range(30))
    half = rng.sample(asked[:30], 15)
    assert run([pins + half, asked, [("q2", 9, None, None, True)]], "two") == once


def test_score_columns(spark):
    rows = [("q1", "a", "0.5"), ("q1", "b", "x"), ("q2", "b", "1"), ("q3", None, "1")]
    df = spark.createDataFrame(rows, "question_id string, index_id string, ndcg string")
    got = {r.question_id: (r.a, r.b) for r in tables.score_columns(df, "ndcg").collect()}
    assert got == {"q1": (0.5, None), "q2": (None, 1.0), "q3": (None, None)}
    with pytest.raises(ValueError, match="more than 1 different"):
        tables.score_columns(df, "ndcg", most=1)
    with pytest.raises(Exception, match="two rows of one"):
        tables.score_columns(df.unionAll(df), "ndcg").collect()


def test_union_csv(spark, tmp_path):
    rows = [(1, {"b": 'x,"y"'}), (2, {"a": "line\nend", "c": None}), (3, {}), (4, None)]
    df = spark.createDataFrame(rows, "n int, f map<string,string>")
    assert tables.write_union_csv(df, "f", "n", f"file://{tmp_path}/u") == ["b", "a", "c"]
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/u").fillna("")
    assert sorted(tuple(r) for r in back.collect())[-2:] == [("", "line\nend", ""), ('x,"y"', "", "")]
    assert tables.write_union_csv(df.filter("n > 9"), "f", "n", f"file://{tmp_path}/none") == []
    assert all(not v for v in [open(p).read() for p in files(f"{tmp_path}/none") if "part-" in p and not p.endswith(".crc")])
    with pytest.raises(ValueError, match="too many"):
        tables.keys_in_order(df, "f", "n", most=2)


def test_discovery_and_lookups(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c d", 4)], "k string, v int").write.partitionBy("k").parquet(f"file://{tmp_path}/t")
    found = tables.discover(spark, f"file://{tmp_path}/t", "*.parquet").collect()
    assert {r.folder.split("=")[1] for r in found} == {"a", "b", "c d"} and all(r.n_bytes > 0 and r.file.startswith(r.stem) for r in found)
    records = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4)], "id string, v int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "i string")
    assert sorted(tuple(r) for r in tables.by_id(records, "id", ids("a", "b", "a")).collect()) == [("a", 1), ("b", 2)]
    for bad, words in (("z", "no record of z"), ("c", "several records of c")):
        with pytest.raises(Exception, match=words):
            tables.by_id(records, "id", ids("a", bad)).collect()


def test_discovery_counts_every_row(spark, tmp_path):
    rows = [("A/x", "F", 1), ("A/x", "F", 2), ("a+b %", "O", 3), (None, "O", 4), ("", "O", 5), ("R", "", 6), ("R", "", 6)]
    spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = ledger.a12_discovery(spark, str(tmp_path)).collect()
    assert {r.config_id: r.n for r in found} == {"A/x-F": 2, "a+b %-O": 1, None: 1, "-O": 1, "R-": 2} and all(r.filled for r in found)
