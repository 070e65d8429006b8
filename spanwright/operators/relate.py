"""Tables beside each other: strict pairing, required fields, roles, blinding, ordered distinct rows, probes and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.operators.order import numbered_within
from spanwright.operators.study import numbered_in_order


def aligned(a: DataFrame, b: DataFrame, key: str, value: str, *, strict: bool = False) -> DataFrame:
    """(key, a, b, d): two series side by side by key, pairs with a missing value left out.

    With ``strict`` a key that only one side has is an error when it is read. A key has one row on each side; several are an error.
    """
    one = lambda df, name: df.groupBy(key).agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"a {key} twice"))).otherwise(F.max(value)).alias(name), F.lit(True).alias(f"_{name}"))
    both = one(a, "a").join(one(b, "b"), key, "full")
    lone = F.col("_a").isNull() | F.col("_b").isNull()
    if strict:
        both = both.withColumn("a", F.when(lone, F.raise_error(F.concat(F.lit(f"only one side has {key} "), F.col(key).cast("string")))).otherwise(F.col("a")))
    return both.select(key, "a", "b", (F.col("a") - F.col("b")).alias("d")).dropna(subset=["a", "b"])


def required(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in which all fields are there; a text of blanks is not."""
    ok = F.lit(True)
    for f in fields:
        text = df.schema[f].dataType.simpleString() == "string"
        ok = ok & F.col(f).isNotNull() & ((F.trim(f) != "") if text else F.lit(True))
    return df.filter(ok)


def by_role(df: DataFrame, role: str, retained: list[str]) -> DataFrame:
    """``df`` with ``retained``; rows that are not have their offsets, if any, set to -1. A null role is not retained."""
    keep = F.coalesce(F.col(role).isin(*retained), F.lit(False))
    out = df.withColumn("retained", keep)
    return out.withColumns({c: F.when(F.col("retained"), F.col(c)).otherwise(-1) for c in ("char_start", "char_end") if c in df.columns})


def blinded(df: DataFrame, withheld: list[str]) -> DataFrame:
    """``df`` without the columns that would tell; one that is not there is an error, so that no rename lets a label through."""
    missing = [c for c in withheld if c not in df.columns]
    if missing:
        raise ValueError(f"columns to withhold are not there: {', '.join(missing)}")
    return df.drop(*withheld)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each ``keys``, the first along ``order`` (unique), in the order of first sight: ``place`` is 1, 2, ..."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_seen"))
    return numbered_in_order(first, ["_seen"], "_n").select(*keys, (F.col("_n") + 1).alias("place"))


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` along ``order`` (unique), with ``place`` from 0. Only so many rows of a task go on."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit are 0 or more")
    return df.orderBy(*order).limit(offset + limit).transform(lambda top: numbered_in_order(top, order, "place")).filter(F.col("place") >= offset)


def probe(ranked: DataFrame, query: str, rank: str, hit: Column, ks: tuple[int, int], top: list[str]) -> DataFrame:
    """(query, hit_at_a, hit_at_b, top_...): whether a hit is among the first a and b results of a query, and columns of its first result."""
    first = [F.max(F.when(F.col(rank) == 1, F.col(c))).alias(f"top_{c}") for c in top]
    return ranked.groupBy(query).agg(*[F.coalesce(F.max((F.col(rank) <= k) & hit), F.lit(False)).alias(f"hit_at_{k}") for k in ks], *first)


def truncation_class(stats: DataFrame, tokens_max: str, cap: str) -> DataFrame:
    """``stats`` with ``truncation``: ``cap exceeded``, ``no-op`` (the cap is never reached) or ``unknown`` where a figure is missing."""
    over = F.when(F.col(tokens_max).isNull() | F.col(cap).isNull(), "unknown").when(F.col(tokens_max) > F.col(cap), "cap exceeded").otherwise("no-op")
    return stats.withColumn("truncation", over)


def passage_windows(n_tokens: Column, max_len: int, prefix: int, special: int) -> Column:
    """(start, stop) token windows of a passage under a model's limit: what prefix and special tokens leave is the budget of each."""
    budget = max_len - prefix - special
    if budget < 1:
        raise ValueError("prefix and special tokens leave no room for text")
    starts = F.when(n_tokens > 0, F.sequence(F.lit(0).cast("long"), n_tokens.cast("long") - 1, F.lit(budget).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + budget, n_tokens.cast("long")).alias("stop")))


def two_metrics(df: DataFrame, screen: Column, judge: Column, surfaced: Column) -> DataFrame:
    """(n, judged_risky, in_union, surfaced, rate): the first metric on all rows, the second on rows that screen or judge calls risky."""
    union = F.coalesce(screen, F.lit(False)) | F.coalesce(judge, F.lit(False))
    n = F.count_if(union)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(judge).alias("judged_risky"),
        n.alias("in_union"),
        F.count_if(union & surfaced).alias("surfaced"),
        (F.count_if(union & surfaced) / F.nullif(n, F.lit(0))).alias("rate")
    )


def sealed_key(df: DataFrame, order: Column, key: str, columns: list[str]) -> DataFrame:
    """(response_id, *columns): the key behind blind codes R001, R002, ... in the codes' order; codes follow a seeded order of the rows."""
    placed = numbered_within(df.withColumn("_o", order), [], ["_o", key], "_n")
    return placed.select(F.format_string("R%03d", F.col("_n")).alias("response_id"), *columns)


def write_packets(df: DataFrame, case: str, order: list[str], path: str, *, overwrite: bool = False) -> None:
    """One folder of JSON lines for each case, its rows in order in one file. Cases are dealt by their key, so a case is written by one task in a sorted pass."""
    dealt = df.repartition(case).sortWithinPartitions(case, *order)
    dealt.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(case).json(path)
