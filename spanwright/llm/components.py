"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node, for edges (a, b) of longs.

    A round links every node's larger neighbours to its smallest neighbour, then its smaller
    ones; the edges of a component end as a star around its smallest node. Rounds are written
    to the shared folder, so a lost executor costs one round at most. Self-loops, repeats and
    both directions are allowed; nodes without an edge do not appear.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        now = stored(small, "edges")
        if (after := _mark(now)) == mark:
            break
        mark = after
    return now.groupBy("a").agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct()).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))
