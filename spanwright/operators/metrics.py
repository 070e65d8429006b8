"""Ranking metrics over (query, rank, gain): hit-rate recall, precision, MRR, nDCG, multihop coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _within(k: int) -> Column:
    return F.when(F.col("rank") <= k, F.col("gain")).otherwise(0)


def ideal_dcg(n_relevant: Column, k: int) -> Column:
    """The first min(n, k) terms of 1 / log2(i + 1)."""
    out = F.lit(0.0)
    for i in range(1, k + 1):
        out = out + F.when(n_relevant >= i, F.lit(1.0) / F.log2(F.lit(float(i + 1)))).otherwise(0.0)
    return out


def per_query(ranked: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row a query with every metric at every k, in one aggregation.

    ``ranked`` holds keys, ``rank`` from 1, ``gain`` 0/1 and ``n_relevant``. Recall is 1 if any
    relevant item is in reach; precision divides by k; nDCG is 0 where nothing is relevant.
    """
    aggs = []
    for k in ks:
        first = F.min(F.when((F.col("gain") == 1) & (F.col("rank") <= k), F.col("rank")))
        dcg = F.sum(_within(k) / F.log2(F.col("rank") + F.lit(1.0)))
        ideal = ideal_dcg(F.max("n_relevant"), k)
        aggs += [
            F.max(_within(k)).cast("double").alias(f"recall_at_{k}"),
            (F.sum(_within(k)) / F.lit(float(k))).alias(f"precision_at_{k}"),
            F.coalesce(F.lit(1.0) / first, F.lit(0.0)).alias(f"mrr_at_{k}"),
            F.when(ideal > 0, dcg / ideal).otherwise(0.0).alias(f"ndcg_at_{k}"),
        ]
    return ranked.groupBy(*keys).agg(*aggs)


def multihop_coverage(ranked: DataFrame, required: DataFrame, keys: list[str], k: int) -> DataFrame:
    """1 where every required passage of a query has a hit in the first ``k``, else 0.

    ``required`` holds keys, ``passage`` and ``id``: the items that satisfy the passage.
    """
    top = ranked.filter(F.col("rank") <= k).select(*keys, "id", F.lit(1).alias("hit"))
    met = required.join(top, [*keys, "id"], "left").groupBy(*keys, "passage").agg(F.max(F.coalesce("hit", F.lit(0))).alias("met"))
    return met.groupBy(*keys).agg(F.min("met").alias("coverage"), F.count(F.lit(1)).alias("n_passages"))


def grouped_means(scores: DataFrame, sets: list[list[str]], metrics: list[str]) -> DataFrame:
    """Means of each metric for several groupings in one pass (GROUPING SETS)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return scores.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in metrics])
