"""Reports over rating and segment tables on small ones: nulls, ties, groups that lack a side."""

from pyspark.sql import functions as F

from spanwright.operators import reports


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_units_and_figures(spark):
    pages = spark.createDataFrame([("b", 3), ("a", 1), ("b", 2), (None, 0)], "unit string, page int")
    assert rows(reports.units_in_order(pages, "unit", "page"), "place") == [(None, 1, 1), ("a", 2, 1), ("b", 3, 2)]
    segments = spark.createDataFrame([("u", 0, "x"), ("u", 1, "c"), ("u", 2, "x"), ("v", 0, "x"), ("w", 0, "c")], "unit string, n int, role string")
    got = reports.with_figures(segments, spark.createDataFrame([("u",), ("u",), ("v",)], "unit string"), "unit", "n", "role", "c", "figure")
    assert rows(got, "unit", "place") == [("u", 1, "x"), ("u", 2, "c"), ("u", 3, "figure"), ("u", 4, "x"), ("v", 1, "x"), ("w", 1, "c")]


RATED = "rater string, case string, c string, v double"


def test_rates_means_and_gaps(spark):
    df = spark.createDataFrame([("r", "1", "F", 0.0), ("r", "1", "O", 1.0), ("s", "1", "F", 2.5), ("s", "2", "F", 0.5), ("s", "2", "F", None)], RATED)
    assert rows(reports.fail_rate(df, "c", "case", F.col("v"), 1.0), "c") == [("F", 2, 0.5), ("O", 1, 0.0)]
    assert rows(reports.rater_benefit(df, "rater", "c", "v", "F", "O"), "rater") == [("r", 0.5, -1.0), ("s", 1.5, None)]
    assert rows(reports.means_in_order(df, "case", "v"), "place") == [("1", 1.166667, 1), ("2", 0.5, 2)]
    four = spark.createDataFrame([("r", str(i), c, float(i * (c == "F"))) for i in range(5) for c in "FO"], RATED)
    assert rows(reports.gap_correlation(four, "case", "c", F.col("v"), -F.col("v"), "F", "O")) == [(5, -1.0)]
    assert rows(reports.agreement(four, F.col("v"), F.col("v")))[0][0] == 10
    got = reports.process(df, "rater", "c", "v", "F", "O", F.col("v") > 1, F.floor("v").cast("long"))
    assert rows(got, "rater") == [("r", 2, 0, [0, 1], 0.0, 1.0), ("s", 3, 1, [0, 2], 1.5, None)]


def test_lists_and_forms(spark):
    ids = spark.createDataFrame([("a10", "x"), ("a9", "x"), ("b", "y"), ("a9", "y")], "id string, g string")
    assert [r.id for r in reports.by_numeric_suffix(ids.select("id").distinct(), "id").collect()] == ["b", "a9", "a10"]
    assert rows(reports.coverage(ids, ids.filter("id = 'a9'"), "id", "g"), "g") == [("x", 2, 1, 1), ("y", 2, 1, 1)]
    assert rows(reports.held_out(ids.select("id").distinct(), ids.filter("id = 'b'"), "id", F.length("id"), 5)) == [("a9",), ("a10",)]
    v = reports.verdict_counts(spark.createDataFrame([("accept",), (None,), ("todo",)], "v string"), F.col("v"), ["accept"])
    assert rows(v, "verdict") == [("accept", 1, False), ("todo", 1, True), ("unknown", 1, True)]
    turns = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a"), ("c", 3, None)], "c string, t int, x string")
    assert rows(reports.joined_in_order(turns, "c", "t", F.col("x"), "|", "all")) == [("c", "a|b")]
    form = spark.createDataFrame([("r", 1, 50.0, "s"), ("r", 2, 7.0, "t"), ("r", 3, 8.0, "t"), ("q", 1, 99.0, "s")], "rater string, n int, v double, kind string")
    got = reports.exit_form(form, "rater", "n", "v", F.col("kind") == "t", 0, 10, F.col("kind") == "s")
    assert rows(got, "rater") == [("q", None, None, 1), ("r", 7.5, 7.0, 1)]
