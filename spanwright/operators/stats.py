"""Statistics as windows and grouped aggregates; exact or approximate p-values in small Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DoubleType


def _with_midrank(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counts`` (keys, value, n) plus ``midrank``, the average rank of the rows of a value.

    The running total is over different values, not over rows.
    """
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("midrank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2.0)


def midranks(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, n, midrank): one row a value; ties share their average rank."""
    return _with_midrank(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), keys, value)


def holm(df: DataFrame, p: str, order: str, family: list[str]) -> DataFrame:
    """``df`` plus ``p_holm``: step-down, monotone, at most 1; ties in the order given."""
    w = Window.partitionBy(*family).orderBy(p, order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


#: Groups of so many differences at most, none of them zero or tied, get the exact p; above it the normal approximation is as good.
EXACT_UP_TO = 50


@lru_cache(maxsize=4096)
def _null_sums(ranks: tuple[int, ...]) -> np.ndarray:
    """How many of the 2^n sign patterns give a sum of positive ranks of s or less, for all s: one rank after the other."""
    ways = np.zeros(sum(ranks) + 1, np.int64)
    ways[0] = 1
    for r in ranks:
        ways[r:] += ways[: len(ways) - r].copy()
    return np.cumsum(ways)


@F.pandas_udf(DoubleType())
def exact_signed_rank_p(doubled: pd.Series, least: pd.Series) -> pd.Series:
    """Two-sided p of the smaller rank sum under all sign patterns; ranks and sum are doubled, so that midranks are whole."""

    def p(ranks, w) -> float | None:
        if ranks is None or w is None or math.isnan(w):
            return None
        below = _null_sums(tuple(sorted(int(r) for r in ranks)))
        return min(1.0, 2.0 * int(below[int(w)]) / 2.0 ** len(ranks))

    return pd.Series([p(r, w) for r, w in zip(doubled, least)], dtype="float64")


def signed_rank(df: DataFrame, diff: str, keys: list[str], *, exact_up_to: int = EXACT_UP_TO, exact_ties: bool = False) -> DataFrame:
    """(keys, n, w_plus, w_minus, rank_biserial, p, method): Wilcoxon's signed ranks of differences; zeros and nulls are dropped.

    ``p`` is two-sided. ``exact``: from the distribution over all sign patterns, for ``exact_up_to`` differences or less without ties
    (with ``exact_ties`` also with them: the distribution given the midranks). ``normal``: the approximation with tie correction.
    A group of zeros only is ``identical``: n 0, p 1 and rank-biserial 0; a group of nulls only is left out.
    """
    if exact_up_to > 60:
        raise ValueError("exact counts of more than 60 differences do not fit 64 bits")
    kept = df.filter(F.col(diff).isNotNull())
    counts = kept.groupBy(*keys, F.abs(diff).alias("_abs")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(diff) > 0).alias("_up"))
    groups = counts.groupBy(*keys).agg(F.lit(1).alias("_one"))
    r = _with_midrank(counts.filter("_abs <> 0"), keys, "_abs")
    plus, minus = F.sum(F.col("_up") * F.col("midrank")), F.sum((F.col("n") - F.col("_up")) * F.col("midrank"))
    ties = F.sum(F.col("n") * (F.col("n") * F.col("n") - 1))
    # as many values as a group with an exact p can have; larger groups hold an empty list
    few = r.groupBy(*keys).agg(F.sum("n").alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), ties.alias("_ties"))
    exact = (F.col("n") <= exact_up_to) & ((F.col("_ties") == 0) | F.lit(exact_ties))
    small = r.withColumnRenamed("n", "_times").join(few.filter(exact).select(*keys), keys, "left_semi")
    ranks = small.select(*keys, F.explode(F.array_repeat((2 * F.col("midrank")).cast("long"), F.col("_times").cast("int"))).alias("_rank")).groupBy(*keys).agg(F.collect_list("_rank").alias("_ranks"))
    out = groups.join(few, keys, "left").join(ranks, keys, "left").drop("_one")
    n, low = F.coalesce("n", F.lit(0)), F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    z = (low - n * (n + 1) / 4.0) / F.sqrt(var)
    p = F.when(n == 0, 1.0).when(F.col("_ranks").isNotNull(), exact_signed_rank_p("_ranks", (2 * low).cast("double"))).otherwise(two_sided(z))
    method = F.when(n == 0, "identical").when(F.col("_ranks").isNotNull(), "exact").otherwise("normal")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    side = (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus"))
    return out.select(*keys, n.alias("n"), zero("w_plus").alias("w_plus"), zero("w_minus").alias("w_minus"), zero(side).alias("rank_biserial"), p.alias("p"), method.alias("method"))


def mann_whitney(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """U of the first group, group sizes and rank-biserial 2U/(n1 n2) - 1."""
    both = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
    counts = both.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(group) == first).alias("_first"))
    a = _with_midrank(counts, [], value).agg(F.sum("_first").alias("n1"), F.sum(F.col("n") - F.col("_first")).alias("n2"), F.sum(F.col("_first") * F.col("midrank")).alias("rank_sum"))
    u = a.withColumn("u", F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    return u.select("n1", "n2", "u", (2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1).alias("rank_biserial"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], *, decimals: int = 9) -> DataFrame:
    """n and the correlation of midranks, for groups of four rows or more; null where one side has one value only."""
    rx = midranks(df, x, keys).select(*keys, x, F.col("midrank").alias("_x"))
    ry = midranks(df, y, keys).select(*keys, y, F.col("midrank").alias("_y"))
    both = df.select(*keys, x, y).join(rx, [*keys, x]).join(ry, [*keys, y])
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.covar_pop("_x", "_y") / F.nullif(F.stddev_pop("_x") * F.stddev_pop("_y"), F.lit(0.0)), decimals).alias("rho")).filter("n >= 4")


@F.pandas_udf(DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return z.map(lambda x: None if x is None or math.isnan(x) else min(1.0, math.erfc(abs(x) / math.sqrt(2))))


#: Rounds of a resampling that a task draws at a time, and hashes that it holds.
ROUNDS, HELD_DRAWS = 100, 1 << 22
#: Hashes of one step of MD5: what stays in a core's cache.
_HASHES = 1 << 14
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)


def _first_word(w: list[np.ndarray]) -> np.ndarray:
    """The first 32 bits of the MD5 of messages of one block, as the number that their hex digits spell; ``w`` are the block's 16 words."""
    a, b, c, d = first = [np.array([x], np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + (a + (w[g] + _SINES[i : i + 1]))
        a, d, c, b = d, c, b, b + ((f << np.uint32(_TURNS[i])) | (f >> np.uint32(32 - _TURNS[i])))
    return (first[0] + a).byteswap()


def _by_digits(start: int, stop: int) -> list[tuple[int, int]]:
    """The numbers from ``start`` to ``stop`` as ranges of one number of digits."""
    cuts = [start, *(10**d for d in range(1, 20) if start < 10**d < stop), stop]
    return list(zip(cuts, cuts[1:])) if start < stop else []


def _draws(seed: int, start: int, stop: int, n: int) -> np.ndarray:
    """(rounds, n): the first 32 bits of the MD5 of ``seed/round/draw`` for the rounds from ``start`` to ``stop`` and ``n`` draws each."""
    out, head = np.empty((stop - start, n), np.uint32), f"{seed}/".encode()
    for b0, b1 in _by_digits(start, stop):
        for j0, j1 in _by_digits(0, n):
            b_len, j_len = len(str(b0)), len(str(j0))
            length = len(head) + b_len + 1 + j_len
            if length > 55:
                raise ValueError("a draw's name does not fit one block of MD5")
            step = max(1, _HASHES // (b1 - b0))
            for low in range(j0, j1, step):
                b, j = np.arange(b0, b1)[:, None], np.arange(low, min(j1, low + step))[None, :]
                text = np.zeros((b.size, j.size, 64), np.uint8)
                text[..., : len(head)] = np.frombuffer(head, np.uint8)
                for at, number, digits in ((len(head), b, b_len), (len(head) + b_len + 1, j, j_len)):
                    for p in range(digits):
                        text[..., at + p] = number // 10 ** (digits - 1 - p) % 10 + 48
                text[..., len(head) + b_len], text[..., length] = ord("/"), 0x80
                text[..., 56:58] = np.array([length * 8], "<u2").view(np.uint8)
                words = text.reshape(-1, 64).view("<u4")
                # words before the numbers and behind the end are the same in all messages
                w = [np.ascontiguousarray(words[:, i]) if len(head) // 4 <= i <= length // 4 else words[:1, i].copy() for i in range(16)]
                out[b0 - start : b1 - start, low : low + j.size] = _first_word(w).reshape(b.size, j.size)
    return out


def _resampled(df: DataFrame, keys: list[str], n_boot: int, seed: int) -> DataFrame:
    """(keys, b, m): means of resamples; the pick of draw j in round b is a hash, so reruns and engines agree.

    ``df`` holds one small group of scores a key, which fits one row: its values in the order of ``item`` go to every block of rounds. No
    draw travels; a block's hashes are the same for all keys and are taken once for the largest group.
    """
    known = df.filter(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
    lists = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("item", F.col("value").cast("double").alias("value")))).alias("_s"))
    each = lists.select(*keys, F.col("_s.value").alias("_values"), F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // ROUNDS))).alias("_block"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = each.repartition(parts, "_block").sortWithinPartitions("_block", F.desc(F.size("_values")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty((0, 0), np.uint32)
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1)
                values = row.column("_values").flatten()
                ok, x, n = np.asarray(values.is_valid()), values.fill_null(0.0).to_numpy(), len(values)
                start = row.column("_block")[0].as_py() * ROUNDS
                stop, step = min(n_boot, start + ROUNDS), max(1, HELD_DRAWS // n)
                for low in range(start, stop, step):
                    high = min(stop, low + step)
                    if at != (low, high) or held.shape[1] < n:
                        at, held = (low, high), _draws(seed, low, high, n)
                    pick = held[:, :n] % np.uint32(n)
                    of = np.full(high - low, n) if ok.all() else ok[pick].sum(axis=1)
                    m = pa.array(x[pick].sum(axis=1) / np.maximum(of, 1), mask=of == 0)
                    same = pa.array(np.zeros(high - low, np.int32))
                    yield pa.RecordBatch.from_arrays([*(row.column(k).take(same) for k in keys), pa.array(np.arange(low, high, dtype=np.int32)), m], names=[*keys, "b", "m"])

    schema = T.StructType([*(lists.schema[k] for k in keys), T.StructField("b", T.IntegerType()), T.StructField("m", T.DoubleType())])
    return each.mapInArrow(run, schema)


def bootstrap_ci(df: DataFrame, keys: list[str], *, n_boot: int = 10_000, seed: int = 20260628, alpha: float = 0.05) -> DataFrame:
    """(keys, ci_low, ci_high, n_boot): percentile interval of the mean of ``value`` (keys, item, value)."""
    m = _resampled(df, keys, n_boot, seed)
    return m.groupBy(*keys).agg(
        F.round(F.percentile("m", F.lit(alpha / 2)), 9).alias("ci_low"),
        F.round(F.percentile("m", F.lit(1 - alpha / 2)), 9).alias("ci_high"),
        F.count(F.lit(1)).alias("n_boot")
    )


def paired_bootstrap(df: DataFrame, keys: list[str], *, n_boot: int = 10_000, seed: int = 20260628) -> DataFrame:
    """Mean difference, its interval and a two-sided p that is 2 / n_boot at least and 1 at most."""
    m = _resampled(df, keys, n_boot, seed)
    obs = df.groupBy(*keys).agg(F.avg("value").alias("diff"))
    tail = F.avg(F.when(F.col("diff") > 0, (F.col("m") <= 0).cast("int")).otherwise((F.col("m") >= 0).cast("int")))
    both = m.join(obs, keys)
    return both.groupBy(*keys).agg(
        F.round(F.max("diff"), 9).alias("diff"),
        F.round(F.percentile("m", F.lit(0.025)), 9).alias("ci_low"),
        F.round(F.percentile("m", F.lit(0.975)), 9).alias("ci_high"),
        F.least(F.lit(1.0), 2 * F.greatest(tail, F.lit(1.0 / n_boot))).alias("p"),
    )


def select_winner(df: DataFrame) -> DataFrame:
    """(index_id, score, ..., ci_low, ci_high) plus ``place`` and ``tied``: the interval reaches the winner's lower bound."""
    placed = df.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "index_id")))
    low = F.first(F.col("ci_low")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return placed.withColumn("tied", F.col("ci_high") >= low).drop("n_boot")


def rank_sensitivity(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Two orders of the same rows: Spearman's rho of the places, same winner, same first three, mean shift."""
    r = df.withColumn("ra", F.row_number().over(Window.orderBy(F.desc(a), key))).withColumn("rb", F.row_number().over(Window.orderBy(F.desc(b), key)))
    n = F.count(F.lit(1))
    d2 = F.sum((F.col("ra") - F.col("rb")) * (F.col("ra") - F.col("rb")))
    return r.agg(
        n.alias("n"),
        (1 - 6 * d2 / (n * (n * n - 1))).alias("rho"),
        F.max((F.col("ra") == 1) & (F.col("rb") == 1)).alias("winner_stable"),
        (F.count_if((F.col("ra") <= 3) & (F.col("rb") <= 3)) == 3).alias("top3_same"),
        F.round(F.avg(F.abs(F.col(a) - F.col(b))), 9).alias("mean_shift")
    )


def icc21(df: DataFrame, target: str, rater: str, value: str) -> DataFrame:
    """Two-way random, absolute agreement, single rater; complete tables only. Sums of rows, columns and squares."""
    x = df.select(target, rater, F.col(value).cast("double").alias("x"))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    rows = x.groupBy(target).agg(F.sum("x").alias("s")).agg(F.count(F.lit(1)).alias("n"), square("s").alias("rr"), F.sum("s").alias("g"))
    cols = x.groupBy(rater).agg(F.sum("x").alias("s"), square("x").alias("q")).agg(F.count(F.lit(1)).alias("k"), square("s").alias("cc"), F.sum("q").alias("xx"))
    s = rows.join(cols, F.lit(True))  # one row by one row
    n, k = F.col("n"), F.col("k")
    mean2 = F.col("g") * F.col("g") / (n * k)
    ssr, ssc = F.col("rr") / k - mean2, F.col("cc") / n - mean2
    msr, msc, mse = ssr / (n - 1), ssc / (k - 1), (F.col("xx") - mean2 - ssr - ssc) / ((n - 1) * (k - 1))
    return s.select("n", "k", F.round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 9).alias("icc"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unweighted kappa; 1 where chance agreement is complete."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    t = cells.withColumn("rows", F.sum("n").over(Window.partitionBy("a"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    cols = cells.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("cols"))
    marg = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("rows")).join(cols, "c", "left")
    pe = marg.agg(F.sum(F.col("rows") * F.coalesce("cols", F.lit(0))).alias("e"))
    po = t.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("o"), F.max("total").alias("n"))
    both = po.join(pe, F.lit(True))  # one row by one row
    o, e = F.col("o") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return both.select("n", o.alias("agreement"), F.when(e == 1, F.lit(1.0)).otherwise((o - e) / (1 - e)).alias("kappa"))


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Quadratic weights over the places of the observed categories."""
    cats = df.select(F.explode(F.array(a, b)).alias("c")).distinct().withColumn("place", F.row_number().over(Window.orderBy("c")) - 1)
    k = df.join(cats.select(F.col("c").alias(a), F.col("place").alias("i")), a).join(cats.select(F.col("c").alias(b), F.col("place").alias("j")), b)
    cells = k.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    seen = cells.agg(F.sum((F.col("i") - F.col("j")) ** 2 * F.col("n")).alias("seen"), F.sum("n").alias("n"))
    side = lambda c: cells.groupBy(F.col(c).alias(f"{c}_")).agg(F.sum("n").alias(f"n_{c}"))
    chance = side("i").join(side("j"), F.lit(True)).agg(F.sum((F.col("i_") - F.col("j_")) ** 2 * F.col("n_i") * F.col("n_j")).alias("chance"))  # categories by categories
    both = seen.join(chance, F.lit(True))
    return both.select("n", (1 - F.col("seen") * F.col("n") / F.nullif(F.col("chance"), F.lit(0.0))).alias("kappa"))
