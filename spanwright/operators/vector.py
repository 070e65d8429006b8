"""Vectors: normalise, pool, and exact top-k by inner product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are compared in one pass; a larger set takes several passes. Queries and vectors of one matrix product.
BLOCK_QUERIES, TILE, ROWS = 1 << 14, 512, 4096


def as_double(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def rounded(x: Column, decimals: int) -> Column:
    """``x`` rounded, with its sign: Spark's ``round`` makes plain zeros of small negative numbers, SQL's keeps them negative."""
    near = F.round(x, decimals)
    return F.when(near == 0, F.signum(x) * F.lit(0.0)).otherwise(near)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(vec: Column) -> Column:
    """Unit vector; a zero vector becomes null."""
    norm = F.sqrt(dot(vec, vec))
    return F.when(norm > 0, F.transform(as_double(vec), lambda x: x / norm))


def mean_pool(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, at, value): component means of each group, from one shuffle of partial sums."""
    return df.select(key, F.posexplode(as_double(F.col(vec))).alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("value"))


def topk_inner_product(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", skip_self: bool = False, group_col: str | None = None) -> DataFrame:
    """(query_id, rank, id, score): exact top ``k``, score descending, ties to the smaller id.

    ``queries`` (query_id, vec) is a stated set, taken in blocks; every task multiplies its
    vectors with the block and passes on ``k`` rows a query. With ``group_col`` several
    vectors stand for one id, whose best score counts.
    """
    kind = vectors.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col) if kind in ("array<float>", "array<double>") else as_double(F.col(vec_col))
    rows = vectors.select(F.col(group_col or id_col).cast("long").alias("id"), vec.alias("vec")).filter("id is not null and vec is not null")
    found = None
    for ids, matrix in _blocks(queries):
        block = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
        part = rows.mapInArrow(_scan(block, k, skip_self), "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    if group_col:
        found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list = []
    for row in queries.select("query_id", as_double(F.col("vec")).alias("vec")).toLocalIterator():
        held.append(row)
        if len(held) == BLOCK_QUERIES:
            yield np.array([r[0] for r in held]), np.array([r[1] for r in held], dtype=np.float64)
            held = []
    if held:
        yield np.array([r[0] for r in held]), np.array([r[1] for r in held], dtype=np.float64)


def best_of(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each ``of``, in order: by score, then by id; of several with one id the best counts."""
    order = np.lexsort((-scores, ids, of))
    order = order[np.append(True, (of[order][1:] != of[order][:-1]) | (ids[order][1:] != ids[order][:-1]))[: len(order)]]
    order = order[np.lexsort((ids[order], -scores[order], of[order]))]
    return order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < k]


def _scan(block, k: int, skip_self: bool):
    """Vectors of a task -> its ``k`` best of each query. What is below the ``k`` best so far is left out at once; the others' scores are taken
    one by one, so that equal vectors have equal scores wherever they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = block.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(qids), TILE)]
        least, span = np.full(len(qids), -np.inf), np.sqrt((q * q).sum(axis=1)).max(initial=0.0)
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                part = batch.slice(low, ROWS)
                ids = part.column(0).to_numpy()
                v = part.column(1).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
                # what a matrix product may be off
                slack = 1e-14 * v.shape[1] * span * np.sqrt((v * v).sum(axis=1)).max()
                own = np.flatnonzero(np.isin(ids, qids)) if skip_self else ids[:0]
                by_id = np.argsort(ids, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(ids[by_id]) != 0))
                for t, a in enumerate(range(0, len(qids), TILE)):
                    scores = q[a : a + TILE] @ v.T
                    if len(own):
                        scores[:, own] = np.where(qids[a : a + TILE, None] == ids[own], -np.inf, scores[:, own])
                    floor = least[a : a + TILE].copy()
                    new = np.flatnonzero(floor == -np.inf)
                    if len(new) and len(starts) > k:  # an id may own several vectors: its best one counts
                        each = np.maximum.reduceat(scores[new][:, by_id], starts, axis=1)
                        floor[new] = np.partition(each, -k, axis=1)[:, -k]
                    of, at = np.nonzero((scores >= floor[:, None] - slack) & (scores > -np.inf))
                    if not len(of):
                        continue
                    found = (q[a + of] * v[at]).sum(axis=1)
                    of, at, found = of[np.isfinite(found)], at[np.isfinite(found)], found[np.isfinite(found)]
                    of, at, found = (np.concatenate(x) for x in zip(best[t], (of, ids[at], found)))
                    kept = best_of(of, at, found, k)
                    of, at, found = best[t] = of[kept], at[kept], found[kept]
                    last = np.flatnonzero(np.arange(len(of)) - np.searchsorted(of, of) == k - 1)
                    least[a + of[last]] = found[last]
        for t, (of, at, found) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(qids[t * TILE + of]), pa.array(at), pa.array(found)], names=["query_id", "id", "score"])

    return run
