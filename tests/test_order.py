"""Exact order statistics and numbering by ranges."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from spanwright.operators import order, study


def test_quantiles_against_sorting(spark):
    rng = random.Random(6)
    groups = {k: [rng.choice([rng.random(), 1.5, 1.5, -2.0, None]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 101), (None, 40))} | {"nulls": [None, None], "same": [3.0] * 50}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    got = {r.k: r for r in order.quantiles(df, ["k"], "v", {"q1": 0.25, "median": 0.5}, more={"upper": F.floor(F.col("n") / 2), "none": F.col("n")}).collect()}
    for k, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        if not vs:
            assert k not in got
            continue
        at = (len(vs) - 1) * 0.25
        lo = int(at)
        assert got[k].q1 == pytest.approx(vs[lo] + (vs[min(lo + 1, len(vs) - 1)] - vs[lo]) * (at - lo))
        assert got[k].median == pytest.approx(statistics.median(vs)) and got[k].upper == vs[len(vs) // 2]
        assert got[k].none is None and got[k].n == len(vs)
    assert order.quantiles(df, [], "v", {"m": 0.5}).count() == 1 and order.quantiles(df.filter("false"), [], "v", {"m": 0.5}).count() == 0


def test_median_of_ten_million_rows_of_one_key(spark):
    n = 10_000_000
    df = spark.range(n).select(F.lit("one").alias("k"), ((F.col("id") * 7919) % n).alias("v"))
    row = order.quantiles(df, ["k"], "v", {"median": 0.5, "p99": 0.99}).first()
    assert (row.n, row.median, row.p99) == (n, (n - 1) / 2, pytest.approx(0.99 * (n - 1)))
    plan = order.quantiles(df, ["k"], "v", {"median": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan


def test_numbering_within_groups(spark):
    rows = [(k, i) for k, n in ((None, 5), ("a", 300), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "k string, i int")
    got = order.numbered_within(df, ["k"], ["i"], "n").collect()
    assert sorted((r.k or "", r.i, r.n) for r in got) == sorted((k or "", i, i + 1) for k, i in rows)


def test_blocks_and_worklists(spark):
    df = spark.createDataFrame([("x", "F", 5.0), ("x", "F", 7.0), ("x", "O", 1.0), ("y", "F", 2.0), ("y", "O", 4.0), ("z", "P", 9.0), ("w", "F", 1.0)], "b string, c string, v double")
    got = {r.b: (r.gap, r.beyond_baseline) for r in study.block_decomposition(df, "b", "c", "v", "F", "O").collect()}
    assert got == {"x": (5.0, 4.0), "y": (-2.0, -3.0), "w": (None, None)}  # all blocks: 3.5 - 2.5
    lists = study.worklists(spark.range(10), F.col("id") % 3, ["id"], F.col("id") < 2).collect()
    assert sorted((r.rater, r.position, r.id) for r in lists) == [(i % 3, i // 3 + 1, i) for i in sorted(range(10), key=lambda i: (i % 3, i))]
