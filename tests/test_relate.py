"""Tables beside each other: pairing, roles, blinding, pages, probes, packets."""

import pytest
from pyspark.sql import functions as F

from spanwright.operators import relate, study


def frame(spark, schema, *rows):
    return spark.createDataFrame([*rows], schema)


def test_alignment(spark):
    kind = "k string, v double"
    a, b = frame(spark, kind, ("x", 1.0), ("y", 2.0), ("z", None)), frame(spark, kind, ("x", 0.5), ("z", 3.0), ("w", 1.0))
    assert [tuple(r) for r in relate.aligned(a, b, "k", "v").collect()] == [("x", 1.0, 0.5, 0.5)]
    with pytest.raises(Exception, match="only one side has k"):
        relate.aligned(a, b, "k", "v", strict=True).collect()
    with pytest.raises(Exception, match="a k twice"):
        relate.aligned(a.unionAll(a), b, "k", "v").collect()
    assert relate.aligned(a, b.filter("false"), "k", "v").count() == 0


def test_fields_roles_and_blinding(spark):
    df = frame(spark, "role string, text string, n int, char_start int", ("a", "x", 1, 5), ("b", " ", 1, 6), (None, "y", None, 7))
    assert [r.text for r in relate.required(df, ["text", "n"]).collect()] == ["x"]
    assert sorted((r.text, r.retained, r.char_start) for r in relate.by_role(df, "role", ["a"]).collect()) == [(" ", False, -1), ("x", True, 5), ("y", False, -1)]
    assert relate.blinded(df, ["role"]).columns == ["text", "n", "char_start"]
    with pytest.raises(ValueError, match="label"):
        relate.blinded(df, ["role", "label"])


def test_order_and_pages(spark):
    df = frame(spark, "k string, at int", ("b", 3), ("a", 5), ("b", 1), (None, 2), ("a", 9))
    assert sorted((r.place, r.k) for r in relate.first_seen(df, ["k"], ["at"]).collect()) == [(1, "b"), (2, None), (3, "a")]
    assert sorted((r.place, r["at"]) for r in relate.page(df, ["at"], 1, 2).collect()) == [(1, 2), (2, 3)]
    assert relate.page(df, ["at"], 9, 2).count() == 0
    with pytest.raises(ValueError, match="offset"):
        relate.page(df, ["at"], -1, 2)


def test_windows_metrics_and_probes(spark):
    one = frame(spark, "n int", (0,), (5,), (6,), (None,)).select("n", relate.passage_windows(F.col("n"), 10, 3, 2).alias("w")).collect()
    assert {r.n: r.w and [tuple(x) for x in r.w] for r in one} == {0: [], 5: [(0, 5)], 6: [(0, 5), (5, 6)], None: []}
    with pytest.raises(ValueError, match="no room"):
        relate.passage_windows(F.col("n"), 5, 3, 2)
    df = frame(spark, "s boolean, j boolean, f boolean", (True, None, True), (False, True, False), (None, None, True), (False, False, True))
    assert tuple(relate.two_metrics(df, F.col("s"), F.col("j"), F.col("f")).first()) == (4, 1, 2, 1, 0.5)
    assert relate.two_metrics(df.filter("false"), F.col("s"), F.col("j"), F.col("f")).first().rate is None
    hits = frame(spark, "q int, r int, h boolean", (1, 1, False), (1, 3, True), (2, 1, None))
    assert sorted(tuple(x) for x in relate.probe(hits, "q", "r", F.col("h"), (2, 3), ["h"]).collect()) == [(1, False, True, False), (2, False, False, None)]


def test_packets(spark, tmp_path):
    df = frame(spark, "c string, t int, x string", *[(f"c{i % 3}", i, f"é{i}") for i in range(30)])
    relate.write_packets(df, "c", ["t"], f"file://{tmp_path}/p")
    for case in ("c0", "c1", "c2"):
        (part,) = (tmp_path / f"p/c={case}").glob("part-*.json")
        assert part.read_text().splitlines() == [f'{{"t":{i},"x":"é{i}"}}' for i in range(int(case[1]), 30, 3)]


def test_study_drivers(spark):
    rows = [(f"s{i}", c, d, float(v)) for i in range(8) for d, k in (("main", 1), ("more", 2), ("same", 0)) for c, v in (("with", i + k * (i % 3)), ("without", i))]
    got = {r.dimension: r for r in study.primary_analysis(frame(spark, "case string, c string, d string, v double", *rows), "case", "c", "d", "v", "with", "without", "main").collect()}
    assert set(got) == {"main", "more"} and got["main"].p_holm is None and got["more"].p_holm == got["more"].p
    rated = [(i, r, d, float(v)) for d, shift in (("same", 0), ("off", 5)) for i in range(6) for r, v in (("a", i), ("b", i + shift))] + [(9, "a", "lone", 1.0)]
    icc = {r.dimension: r.icc for r in study.inter_rater(frame(spark, "i int, r string, d string, v double", *rated), "i", "r", "d", "v", ("a", "b")).collect()}
    assert icc["same"] == pytest.approx(1) and 0 < icc["off"] < 0.5 and "lone" not in icc
    dealt = study.assign_raters(spark.range(11).withColumn("s", F.col("id") % 2), ["s"], F.lit(2), ["p", "q"], F.col("id"), "id", F.col("s")).collect()
    assert [r.rater for r in sorted(dealt, key=lambda r: (r.s, r.id))] == ["both", "both", "p", "q", "p", "q", "both", "both", "q", "p", "q"]
