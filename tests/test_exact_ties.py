"""What the order of sums must not decide: signs of zero, ranks of cases, differences of equal means."""

import random
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from compare import TABLES, compare
from spanwright import registry
from spanwright.operators import reports, study, vector


def test_rounded_keeps_the_sign_of_zero(spark):
    values = [-1e-8, 1e-8, -0.0, 0.0, 0.0078125, -0.0078125, -4.9e-7, -5.1e-7, 1.23456749, float("nan"), None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", vector.rounded(F.col("x"), 6).alias("r"))
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in values]
    assert repr([r.r for r in sorted(got.collect())]) == repr(want)


def test_stored_vectors_keep_the_sign_of_zero(spark, tmp_path):
    for table in TABLES:
        if table != "embeddings":
            (tmp_path / f"{table}.parquet").symlink_to(f"/root/testdata/sf0.001/{table}.parquet")
    small = F.transform("embedding", lambda x, i: F.when(i == 0, F.lit(-1e-8).cast("float")).otherwise(x))
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn("embedding", small).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = registry.QUERIES["b6_index_store"](spark, str(tmp_path)).select("vec").collect()
    assert rows and {repr(r.vec[0]) for r in rows} == {"-0.0"}


def test_correlation_is_rounded_once(spark, tmp_path):
    draw = random.Random(2112)  # a correlation of 0.14487649956: to nine places and then to six it would be 0.144877
    rows = []
    for i in range(60):
        rows += [(2 * i, i, "F", 1000.0 * (i + 1), datetime(1995, draw.randint(1, 12), 1)), (2 * i + 1, i, "O", 500.0, datetime(1995, 1, 1))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    for table in set(TABLES) - {"orders"}:
        (tmp_path / f"{table}.parquet").symlink_to(f"/root/testdata/sf0.001/{table}.parquet")
    assert registry.QUERIES["k22_confidence_gap"](spark, str(tmp_path)).collect()[0].rho == 0.144876
    assert not compare(spark, str(tmp_path), registry.QUERIES["k22_confidence_gap"], registry.ORACLES["k22_confidence_gap"])


def test_cases_meet_their_ranks_when_sums_vary(spark):
    noisy = F.udf(lambda v: v + random.random(), "double").asNondeterministic()
    rows = [(c, s, float(c * 7 % 40 + k)) for c in range(40) for k, s in enumerate("FO")]
    df = spark.createDataFrame(rows, "c int, s string, v double").repartition(3).withColumn("v", noisy("v"))
    r = reports.gap_correlation(df, "c", "s", F.col("v"), F.col("v") * 2, "F", "O").collect()
    assert [x.n for x in r] == [40]


def test_equal_means_are_no_difference(spark):
    rows = [("a", 1, 0.1 + 0.2), ("b", 1, 0.3), ("a", 2, 0.3), ("b", 2, 0.1 + 0.2), ("a", 3, 0.5), ("b", 3, 0.25), ("a", 4, 0.5), ("b", 4, 0.5 + 1e-9)]
    got = study.against_winner(spark.createDataFrame(rows, "s string, i int, v double"), "s", "i", "v").collect()
    assert [(r.s, r.n, r.up, r.down) for r in got] == [("b", 4, 1, 1)]
