"""Reports over rating and segment tables, each with its columns as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.operators import stats
from spanwright.operators.order import numbered_within
from spanwright.operators.study import numbered_in_order
from spanwright.session import materialised


def units_in_order(df: DataFrame, unit: str, order: str) -> DataFrame:
    """(unit, place, n): units in the order in which they are first seen along ``order``, and their rows."""
    u = df.groupBy(unit).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("n"))
    return numbered_in_order(u, ["_first", unit], "_n").select(unit, (F.col("_n") + 1).alias("place"), "n")


def with_figures(segments: DataFrame, figures: DataFrame, unit: str, order: str, role: str, behind: str, kind: str) -> DataFrame:
    """``segments`` (unit, order, role) with a row of role ``kind`` for each unit of ``figures``, behind the unit's last row of role ``behind``; ``place`` numbers them anew.

    A unit without such a row gets no figure: there is nothing to put it behind.
    """
    last = segments.filter(F.col(role) == behind).groupBy(unit).agg((F.max(order).cast("double") + 0.5).alias(order))
    new = last.join(figures.select(unit).distinct(), unit, "left_semi").withColumn(role, F.lit(kind))
    both = segments.select(unit, F.col(order).cast("double").alias(order), role).unionByName(new.select(unit, order, role))
    return numbered_within(both, [unit], [order], "place").select(unit, "place", role)


def fail_rate(df: DataFrame, group: str, case: str, value: Column, below: float, *, decimals: int = 6) -> DataFrame:
    """(group, n, fail_rate): the share of cases whose mean over raters is below a bound: the case is the unit."""
    c = df.groupBy(group, case).agg(F.round(F.avg(value), decimals).alias("_m"))
    return c.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_m") < below).cast("int")).alias("fail_rate"))


def coverage(expected: DataFrame, scored: DataFrame, key: str, group: str) -> DataFrame:
    """(group, expected, scored, missing): how many of the expected ids have a score; an id scored twice counts once."""
    s = scored.select(key).distinct().withColumn("_one", F.lit(1))
    d = expected.join(s, key, "left").groupBy(group).agg(F.count(F.lit(1)).alias("expected"), F.count("_one").alias("scored"))
    return d.withColumn("missing", F.col("expected") - F.col("scored"))


def means_in_order(df: DataFrame, kind: str, value: str, *, decimals: int = 6) -> DataFrame:
    """(kind, score, place): means by kind, best first, ties by name."""
    m = df.groupBy(kind).agg(F.round(F.avg(value), decimals).alias("score")).withColumn("_down", -F.col("score"))
    return numbered_in_order(m, ["_down", kind], "_n").select(kind, "score", (F.col("_n") + 1).alias("place"))


def condition_gap(value: Column, condition: str, first: str, second: str) -> Column:
    """The mean under the first condition less that under the second; null without one of them."""
    side = lambda c: F.avg(F.when(F.col(condition) == c, value))
    return side(first) - side(second)


def rater_benefit(df: DataFrame, rater: str, condition: str, value: str, first: str, second: str) -> DataFrame:
    """(rater, mean, benefit): each rater's mean, and the difference between the conditions that the rater saw."""
    return df.groupBy(rater).agg(F.avg(value).alias("mean"), condition_gap(F.col(value), condition, first, second).alias("benefit"))


def gap_correlation(df: DataFrame, case: str, condition: str, a: Column, b: Column, first: str, second: str, *, decimals: int = 6) -> DataFrame:
    """(n, rho): rank correlation over cases of two differences between conditions. Differences are rounded, so that equal ones tie.

    Cases meet their ranks by the differences, which are sums of doubles: they are stored first, as a sum that is taken again in another order
    may round to another value, and the case would meet no rank.
    """
    gap = lambda v, n: F.round(condition_gap(v, condition, first, second), n)
    c = df.groupBy(case).agg(gap(a, 4).alias("_a"), gap(b, 6).alias("_b")).filter("_a is not null and _b is not null")
    return stats.spearman(materialised(c.select("_a", "_b"), "gaps"), "_a", "_b", [], decimals=decimals)


def exit_form(df: DataFrame, rater: str, order: str, value: str, rated: Column, low: float, high: float, section: Column) -> DataFrame:
    """(rater, likert, first_in_range, section_rows): the mean of the rated items, the first answer within bounds, the rows of one section."""
    inside = F.col(value).between(low, high)
    first = F.when(F.count_if(inside) > 0, F.min_by(value, F.when(inside, F.col(order))))
    return df.groupBy(rater).agg(F.avg(F.when(rated, F.col(value))).alias("likert"), first.alias("first_in_range"), F.count_if(section).alias("section_rows"))


def held_out(pool: DataFrame, used: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """``n`` rows of the pool in a seeded order that share no key with those in use (fewer, if there are no more)."""
    return pool.join(used.select(key), key, "left_anti").orderBy(order, key).limit(n)


def by_numeric_suffix(df: DataFrame, column: str, name: str = "number") -> DataFrame:
    """``df`` in the order of the number that ``column`` ends with; ids without one come first, with a null."""
    number = F.nullif(F.regexp_extract(column, r"(\d+)$", 1), F.lit("")).cast("decimal(38,0)")
    return df.withColumn(name, number.cast("long")).orderBy(name, column)


def verdict_counts(df: DataFrame, verdict: Column, known: list[str]) -> DataFrame:
    """(verdict, n, fatal): counts of verdicts; null is ``unknown``, and what is not among the known ones is fatal."""
    v = F.coalesce(verdict, F.lit("unknown"))
    return df.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n")).withColumn("fatal", ~F.col("verdict").isin(*known))


def joined_in_order(df: DataFrame, unit: str, order: str, line: Column, between: str, name: str) -> DataFrame:
    """(unit, name): the lines of each unit in order, as one text. A unit is one text, so it has to fit one row."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), line.alias("_line"))))
    return df.groupBy(unit).agg(F.array_join(F.transform(parts, lambda x: x["_line"]), between).alias(name))


def agreement(df: DataFrame, a: Column, b: Column, *, decimals: int = 6) -> DataFrame:
    """(n, mean_a, mean_b, rho): two scores of one table, their means and rank correlation; rows without one of them are left out."""
    j = df.select(a.alias("_a"), b.alias("_b")).dropna()
    means = j.agg(F.round(F.avg("_a"), decimals).alias("mean_a"), F.round(F.avg("_b"), decimals).alias("mean_b"))
    return stats.spearman(j, "_a", "_b", []).join(means, F.lit(True)).select("n", "mean_a", "mean_b", F.round("rho", decimals).alias("rho"))  # one row by one row


def process(df: DataFrame, rater: str, condition: str, value: str, first: str, second: str, influenced: Column, level: Column) -> DataFrame:
    """(rater, n, influenced, levels, mean_first, mean_second): a rater's levels in order, counts of influence, means by condition.

    ``level`` has few different values (a scale), so a rater's list of them is short.
    """
    m = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    return df.groupBy(rater).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(influenced).alias("influenced"),
        F.sort_array(F.collect_set(level)).alias("levels"),
        m(first).alias("mean_first"),
        m(second).alias("mean_second")
    )
