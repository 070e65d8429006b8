"""Exact order statistics and numbering without a group in one task.

Equal values are counted first. The counts are dealt by ranges of (keys, value) and stored with their range's number, so a key of
any size spreads over many ranges; what is put in order in one place is a row for each range of a key. A rank is then looked up in
the one range whose running counts cover it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.session import materialised


def _key(keys: list[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, one column for each of ``ranks``): the values at ranks of the sorted non-null values of each group.

    A rank is a column over ``n``, counted from 0; one outside the group gives null. Null keys are a group of their own, a group of nulls only
    has none.
    """
    kept = df.filter(F.col(value).isNotNull()).select(_key(keys).alias("_k"), F.col(value).alias("_v"))
    counts = kept.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    dealt = materialised(counts.repartitionByRange("_k", "_v").withColumn("_part", F.spark_partition_id()), "ranked")
    parts = dealt.groupBy("_k", "_part").agg(F.sum("_c").alias("_c"))
    before = Window.partitionBy("_k").orderBy("_part")  # a row for each range that a key reaches
    whole = Window.partitionBy("_k")
    parts = parts.select("_k", "_part", F.sum("_c").over(whole).alias("n"), (F.sum("_c").over(before) - F.col("_c")).alias("_first"))
    asked = parts.select("*", *[r.cast("long").alias(f"_r{i}") for i, r in enumerate(ranks.values())])
    run = F.sum("_c").over(Window.partitionBy("_part", "_k").orderBy("_v"))
    placed = dealt.withColumn("_to", run).alias("d").join(asked.alias("p"), (F.col("d._part") == F.col("p._part")) & F.col("d._k").eqNullSafe(F.col("p._k")))
    stop = F.col("_first") + F.col("_to")
    found = [F.max(F.when((F.col(f"_r{i}") >= stop - F.col("_c")) & (F.col(f"_r{i}") < stop), F.col("_v"))).alias(name) for i, name in enumerate(ranks)]
    out = placed.groupBy(F.col("d._k").alias("_k")).agg(F.max("n").alias("n"), *found)
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "n", *ranks)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *, more: dict[str, Column] | None = None) -> DataFrame:
    """(keys, n, one column for each of ``probs``): exact quantiles, between two values by their distance; ``more`` are ranks as in ``at_ranks``."""
    ranks = {}
    for i, p in enumerate(probs.values()):
        at = (F.col("n") - 1) * F.lit(float(p))
        ranks |= {f"_lo{i}": F.floor(at), f"_hi{i}": F.ceil(at)}
    found = at_ranks(df, keys, value, ranks | (more or {}))
    share = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    between = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share(p)).alias(name) for i, (name, p) in enumerate(probs.items())]
    return found.select(*keys, "n", *between, *(more or {}))


def numbered_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` = 1, 2, ... along ``order`` within each group; (keys, order) has to be unique. Rows are dealt by ranges, no group is gathered."""
    ordered = df.select("*", _key(keys).alias("_k"))
    dealt = materialised(ordered.repartitionByRange("_k", *order).withColumn("_part", F.spark_partition_id()), "numbered")
    parts = dealt.groupBy("_k", "_part").agg(F.count(F.lit(1)).alias("_c"))
    first = parts.select("_k", "_part", (F.sum("_c").over(Window.partitionBy("_k").orderBy("_part")) - F.col("_c")).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_part", "_k").orderBy(*order))
    placed = dealt.withColumn("_n", within).alias("d").join(first.alias("f"), (F.col("d._part") == F.col("f._part")) & F.col("d._k").eqNullSafe(F.col("f._k")))
    return placed.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("_n") + F.col("_first")).alias(name))
