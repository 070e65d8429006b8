"""Resamples against their definition, top-k over tiles of equal vectors, and the work that both leave out."""

import hashlib

import numpy as np
import pytest

from spanwright.operators import stats, vector


def plain_draw(seed, b, j):
    return int(hashlib.md5(f"{seed}/{b}/{j}".encode()).hexdigest()[:8], 16)


def test_draws_are_md5():
    for start, stop, n in ((0, 12, 105), (95, 103, 11), (9998, 10003, 3)):
        assert stats._draws(20260628, start, stop, n).tolist() == [[plain_draw(20260628, b, j) for j in range(n)] for b in range(start, stop)]


@pytest.mark.parametrize("held", [1 << 22, 30])
def test_resamples_against_plain(spark, monkeypatch, held):
    monkeypatch.setattr(stats, "HELD_DRAWS", held)
    values = {"a": [0.5, None, 0.25, 1.0], "b": [float(i) for i in range(23)], "none": [None], None: [1.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, item int, value double")
    got = {(r.k, r.b): r.m for r in stats._resampled(df, ["k"], 130, 7).collect()}
    want = {}
    for k in ("a", "b", "none"):
        for b in range(130):
            picked = [values[k][plain_draw(7, b, j) % len(values[k])] for j in range(len(values[k]))]
            picked = [x for x in picked if x is not None]
            want[k, b] = pytest.approx(sum(picked) / len(picked)) if picked else None
    assert got == want


def test_no_draw_travels(spark):
    """Ten thousand rounds of 300 draws are three million; what is exchanged are the values, once for each block of rounds."""
    df = spark.createDataFrame([(1, i, i / 7) for i in range(300)], "k int, item int, value double")
    plan = stats._resampled(df, ["k"], 10_000, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "draw" not in plan and "MapInArrow" in plan


def test_topk_over_tiles_with_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILE", 3)
    monkeypatch.setattr(vector, "ROWS", 11)
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(9, 6)).round(3)
    rows = [(int(i), kinds[i % 9].tolist()) for i in rng.permutation(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame(rows[:10], "query_id long, vec array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in vector.topk_inner_product(df, asked, 17, skip_self=True).collect()}
    want = {}
    for qid, q in rows[:10]:
        order = sorted((-float((np.array(q) * np.array(v)).sum()), i) for i, v in rows if i != qid)
        want |= {(qid, n): i for n, (_, i) in enumerate(order[:17], 1)}
    assert got == want
