"""Study data: parsing, pivots, confusion, votes, draws and validation of long rating tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.operators import stats
from spanwright.operators.order import numbered_within, quantiles
from spanwright.session import materialised, shared_dir
from spanwright.sources.tables import new_folder


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd (null below two values), median, upper median, least and most; nulls are ignored.

    Both medians are exact and come from counts dealt by ranges, so no group is gathered in one task.
    """
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    middle = quantiles(df, keys, value, {"median": 0.5}, more={"upper_median": F.floor(F.col("n") / 2)}).drop("n")
    return null_safe(out, middle, keys).select(*keys, "n", "mean", "sd", "median", "upper_median", "least", "most")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which null keys meet."""
    met = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] or [F.lit(True)]  # without keys: one row by one row
    return left.alias("l").join(right.alias("r"), met, "left").select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def block_decomposition(df: DataFrame, block: str, condition: str, value: str, first: str, second: str) -> DataFrame:
    """(block, gap, beyond_baseline): each block's difference of medians of two conditions, and what it has beyond that of all blocks.

    Medians are exact; the whole table's, too, come from counts dealt by ranges. A block without one of the conditions has no gap.
    """
    two = df.filter(F.col(condition).isin(first, second))
    side = F.when(F.col("condition") == first, F.col("median"))
    gap = F.max(side) - F.max(F.when(F.col("condition") == second, F.col("median")))
    named = two.select(F.col(block).alias("block"), F.col(condition).alias("condition"), F.col(value).alias("v"))
    each = quantiles(named, ["block", "condition"], "v", {"median": 0.5}).groupBy("block").agg(gap.alias("gap"))
    base = quantiles(named, ["condition"], "v", {"median": 0.5}).agg(gap.alias("base"))
    return each.join(F.broadcast(base), F.lit(True)).select(F.col("block").alias(block), "gap", (F.col("gap") - F.col("base")).alias("beyond_baseline"))  # one row


def pivot_pairs(df: DataFrame, case: str, condition: str, value: str, first: str, second: str) -> DataFrame:
    """One row a case that has both conditions: their means and the difference."""
    wide = df.groupBy(case).pivot(condition, [first, second]).agg(F.avg(value))
    return wide.select(case, F.col(f"`{first}`").alias("a"), F.col(f"`{second}`").alias("b")).dropna().withColumn("d", F.col("a") - F.col("b"))


def sign_tally(df: DataFrame, d: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col(d) > 0).alias("up"), F.count_if(F.col(d) < 0).alias("down"), F.count_if(F.col(d) == 0).alias("tie"))


def strata_ci(df: DataFrame, case: str, stratum: str, value: str) -> DataFrame:
    """Case means first, then per stratum n, mean and mean +- 1.96 sd / sqrt(n): the case is the unit."""
    cases = df.groupBy(case, stratum).agg(F.avg(value).alias("m"))
    half = 1.96 * F.stddev_samp("m") / F.sqrt(F.count("m"))
    return cases.groupBy(stratum).agg(F.count("m").alias("n"), F.avg("m").alias("mean"), (F.avg("m") - half).alias("ci_low"), (F.avg("m") + half).alias("ci_high"))


def confusion(df: DataFrame, rater: str, system: Column, truth: Column) -> DataFrame:
    """tp, fp, fn, tn, agreement, sensitivity and specificity a rater and for all (null rater), in one pass."""
    c = lambda s, t: F.count_if((system == s) & (truth == t))
    out = df.rollup(rater).agg(c(1, 1).alias("tp"), c(1, 0).alias("fp"), c(0, 1).alias("fn"), c(0, 0).alias("tn"))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.withColumns({"agreement": (F.col("tp") + F.col("tn")) / F.nullif(n, F.lit(0)), "sensitivity": ratio("tp", "fn"), "specificity": ratio("tn", "fp")})


def majority(df: DataFrame, case: str, flag: Column) -> DataFrame:
    """Votes of repeated verdicts: the majority, and whether they disagree."""
    v = df.groupBy(case).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("yes"))
    return v.withColumns({"majority": F.col("yes") * 2 > F.col("n"), "unstable": (F.col("yes") > 0) & (F.col("yes") < F.col("n"))})


def stratified_draw(df: DataFrame, strata: list[str], n: int, order: Column, key: str) -> DataFrame:
    """The first ``n`` rows of each stratum in a seeded order, and their place."""
    w = Window.partitionBy(*strata).orderBy(order, key)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def snake_blocks(df: DataFrame, n: int, order: Column, length: str, key: str) -> DataFrame:
    """A sample of ``n`` dealt to two blocks of like length: sorted by length, blocks 1-2-2-1."""
    drawn = df.withColumn("_o", order).orderBy("_o", key).limit(n)
    rn = F.row_number().over(Window.orderBy(F.desc(length), key))
    return drawn.withColumn("block", F.when(F.pmod(rn - 1, F.lit(4)).isin(0, 3), 1).otherwise(2)).drop("_o")


def numbered_in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` = 0, 1, ... along ``order``, which has to be unique.

    Rows are dealt by ranges and written to the shared folder; a partition's first number is the
    count of those before it, so only a row a partition is ordered in one task.
    """
    spark = df.sparkSession
    at = new_folder(shared_dir(spark), spark.sparkContext.applicationId, "numbered")
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(at)
    dealt = spark.read.parquet(at)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_rows_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(first), "_part").withColumn(name, F.col("_rows_before") + within).select(*df.columns, name)


def blind_codes(df: DataFrame, order: Column, key: str) -> DataFrame:
    """Rows in a seeded order with ``response_id`` = R001, R002, ..."""
    placed = numbered_in_order(df.withColumn("_o", order), ["_o", key], "_nth")
    return placed.withColumn("response_id", F.format_string("R%03d", F.col("_nth") + 1)).drop("_o", "_nth")


def diff_tables(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status): unchanged, edited, dropped or added."""
    a = old.select(F.col(key).alias("ka"), F.struct(*fields).alias("a"))
    b = new.select(F.col(key).alias("kb"), F.struct(*fields).alias("b"))
    status = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "dropped").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("edited")
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias(key), status.alias("status"))


def problems(df: DataFrame, key: str, checks: list[tuple[Column, str]]) -> DataFrame:
    """(key, problem): one row for each check that a row fails."""
    found = F.filter(F.array(*[F.when(bad, F.lit(message)) for bad, message in checks]), lambda x: x.isNotNull())
    return df.select(key, F.explode(found).alias("problem"))


def anchored_spans(df: DataFrame, key: str, text: str, anchors: list[str]) -> DataFrame:
    """(key, part, char_start, char_end): the text cut at the first place of each anchor, white space trimmed off.

    Anchors that are missing or out of order do not cut.
    """
    cuts = F.array_sort(F.array_distinct(F.filter(F.array(F.lit(0), *[F.instr(F.col(text), a) - 1 for a in anchors], F.length(text)), lambda x: x >= 0)))
    pairs = F.arrays_zip(F.slice(cuts, F.lit(1), F.size(cuts) - 1).alias("s"), F.slice(cuts, F.lit(2), F.size(cuts) - 1).alias("e"))
    rows = df.select(key, F.col(text).alias("_t"), F.posexplode(pairs).alias("_n", "x")).select(key, "_t", "_n", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    part = F.expr("substring(_t, s + 1, e - s)")
    lead, trail = F.length(F.regexp_extract(part, r"^\s*", 0)), F.length(F.regexp_extract(part, r"\s*$", 0))
    out = rows.select(key, F.chr(F.col("_n") + 97).alias("part"), (F.col("s") + lead).alias("char_start"), (F.col("e") - trail).alias("char_end"))
    return out.filter("char_end > char_start")


def mixed_model(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """Random-intercept model y ~ 1 + x + (1 | group) by maximum likelihood.

    One aggregation brings each group down to n and its sums; groups with equal statistics
    are one row, and the profile likelihood of the variance ratio is evaluated as an
    aggregation over a grid of ratios, so the driver sees one row a ratio.
    """
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"),
        F.sum(F.col(y) * F.col(y)).alias("syy")
    )
    grid = [0.0, *np.geomspace(1e-4, 1e2, 121).tolist()]
    each = g.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    c = F.col("t") / (1 + F.col("n") * F.col("t"))
    s = lambda a, b, ab: F.sum(F.col(ab) - c * F.col(a) * F.col(b))
    row = each.groupBy("t").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        s("n", "n", "n").alias("a11"),
        s("n", "sx", "sx").alias("a12"),
        s("sx", "sx", "sxx").alias("a22"),
        s("n", "sy", "sy").alias("b1"),
        s("sx", "sy", "sxy").alias("b2"),
        s("sy", "sy", "syy").alias("yy"),
        F.sum(F.log(1 + F.col("n") * F.col("t"))).alias("logdet")
    )
    det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
    fit = row.withColumn("intercept", (F.col("a22") * F.col("b1") - F.col("a12") * F.col("b2")) / det).withColumn("slope", (F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1")) / det)
    fit = fit.withColumn("sigma2", (F.col("yy") - F.col("intercept") * F.col("b1") - F.col("slope") * F.col("b2")) / F.col("n"))
    fit = fit.withColumn("loglik", -(F.col("n") * (F.log(2 * np.pi * F.col("sigma2")) + 1) + F.col("logdet")) / 2).withColumn("slope_se", F.sqrt(F.col("sigma2") * F.col("a11") / det))
    best = fit.agg(F.max(F.struct("loglik", "t", "intercept", "slope", "slope_se", "sigma2", "n", "groups")).alias("m")).select("m.*")
    return best.select("n", "groups", "intercept", "slope", "slope_se", "sigma2", (F.col("t") * F.col("sigma2")).alias("tau2"), "loglik")


def paired_report(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """n, mean, median, sd, t and dz of differences, for groups of five or more that are not all zero."""
    out = df.filter(F.col(d).isNotNull()).groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count_if(F.col(d) != 0).alias("_other"))
    out = out.filter((F.col("n") >= 5) & (F.col("_other") > 0)).drop("_other")
    out = null_safe(out, quantiles(df, keys, d, {"median": 0.5}).drop("n"), keys)
    return out.withColumns({"t": F.col("mean") / (F.nullif("sd", F.lit(0.0)) / F.sqrt("n")), "dz": F.col("mean") / F.nullif("sd", F.lit(0.0))})


def deal(df: DataFrame, strata: list[str], raters: list[str], order: Column, key: str, start: Column) -> DataFrame:
    """Items of each stratum in a seeded order, dealt to raters in turn from an offset of the stratum."""
    placed = numbered_within(df.withColumn("_o", order), strata, ["_o", key], "_place")
    turn = F.pmod(F.col("_place") - 1 + start, F.lit(len(raters))) + 1
    return placed.withColumn("rater", F.element_at(F.array(*map(F.lit, raters)), turn.cast("int"))).drop("_o", "_place")


def workload(df: DataFrame, rater: str, raters: list[str], heavy: Column) -> DataFrame:
    """Items and heavy items a rater; ``both`` counts for each."""
    who = F.when(F.col(rater) == "both", F.array(*map(F.lit, raters))).otherwise(F.array(rater))
    return df.withColumn("_heavy", heavy).select(F.explode(who).alias("rater"), "_heavy").groupBy("rater").agg(F.count(F.lit(1)).alias("items"), F.count_if("_heavy").alias("heavy"))


def jitter(df: DataFrame, value: str, key: str, step: float) -> DataFrame:
    """``df`` plus ``offset``: equal values are spread evenly around zero."""
    w = Window.partitionBy(value)
    return df.withColumn("offset", (F.row_number().over(w.orderBy(key)) - 1 - (F.count(F.lit(1)).over(w) - 1) / 2.0) * step)


def cell_answers(cells: DataFrame, headers: list[str]) -> DataFrame:
    """(sheet, header, answer): for each header text the cell to the right of its first place.

    ``cells`` holds sheet, row, col, value; sheets without a header have no row for it.
    """
    first = Window.partitionBy("sheet", "value").orderBy("row", "col")
    heads = cells.filter(F.col("value").isin(*headers)).withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(
        "sheet",
        "row",
        (F.col("col") + 1).alias("col"),
        F.col("value").alias("header")
    )
    return heads.join(cells.select("sheet", "row", "col", F.col("value").alias("answer")), ["sheet", "row", "col"], "left").select("sheet", "header", "answer")


def worksheet(lines: DataFrame, key: str, head: str, field: str) -> DataFrame:
    """(key, entry, field, value): a line matching ``head`` opens an entry, one matching ``field``
    (name, value) a field, other non-blank lines continue the field, a blank line ends it."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head, is_field = F.col("text").rlike(head), F.col("text").rlike(field)
    e = lines.withColumn("entry", F.sum(is_head.cast("int")).over(w)).filter("entry > 0").withColumn("_h", is_head).withColumn("_f", is_field & ~is_head)
    e = e.withColumn("_span", F.sum((F.col("_f") | F.col("_h") | (F.trim("text") == "")).cast("int")).over(w))
    part = Window.partitionBy(key, "_span").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("field", F.first(F.when(F.col("_f"), F.regexp_extract("text", field, 1)), ignorenulls=True).over(part)).filter("field is not null")
    value = F.when(F.col("_f"), F.regexp_extract("text", field, 2)).otherwise(F.trim("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", value.alias("v")))), lambda x: x["v"]), " ")
    return e.groupBy(key, "entry", "field").agg(joined.alias("value"))


def by_header(cells: DataFrame, names: dict[str, str], *, fuzzy: bool = False) -> DataFrame:
    """Cells (sheet, row, col, value) -> a row a row below row 0, with a column for each of ``names`` by its header.

    ``fuzzy`` takes the header that holds the name, in any case; of several the leftmost.
    """
    heads = cells.filter("row = 0")
    hit = lambda name: F.contains(F.lower("value"), F.lit(name.lower())) if fuzzy else F.trim("value") == name
    at = heads.groupBy("sheet").agg(*[F.min(F.when(hit(name), F.col("col"))).alias(f"_{field}") for field, name in names.items()])
    body = cells.filter("row > 0").join(at, "sheet")
    return body.groupBy("sheet", "row").agg(*[F.max(F.when(F.col("col") == F.col(f"_{field}"), F.col("value"))).alias(field) for field in names])


def answers_below(cells: DataFrame, number_col: int, answer_col: int) -> DataFrame:
    """(sheet, item, answer): the cell one row below each whole number of ``number_col``, in ``answer_col``."""
    number = F.expr("try_cast(value as double)")
    items = cells.filter(F.col("col") == number_col).select("sheet", (F.col("row") + 1).alias("row"), number.alias("x")).filter("x = floor(x)")
    answers = cells.filter(F.col("col") == answer_col).select("sheet", "row", F.col("value").alias("answer"))
    return items.join(answers, ["sheet", "row"], "left").select("sheet", F.col("x").cast("long").alias("item"), "answer")


def sealed_entries(df: DataFrame, key: str, sealed: str) -> DataFrame:
    """(key, needle, replacement) of JSON maps; needles that begin with an underscore are notes."""
    entries = F.explode(F.map_filter(F.from_json(sealed, "map<string,string>"), lambda k, v: ~F.startswith(k, F.lit("_"))))
    return df.select(key, entries.alias("needle", "replacement"))


def index_record(df: DataFrame, keys: list[str], id_col: str, vec_col: str) -> DataFrame:
    """What an index holds and whether it can be built: one dimension, and as many ids as vectors."""
    n, ids, dim = F.count(F.lit(1)), F.countDistinct(id_col), F.max(F.size(vec_col))
    return df.groupBy(*keys).agg(
        n.alias("n_vectors"),
        ids.alias("n_ids"),
        dim.alias("dim"),
        (F.min(F.size(vec_col)) == dim).alias("one_dim"),
        (n == ids).alias("unique_ids"),
        (n * dim * 4).alias("flat_bytes")
    )


def restricted(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(name, n, unknown) of the names asked for; the filter reaches the scan."""
    found = df.filter(F.col(column).isin(names)).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("k"))
    asked = df.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return asked.join(found, "name", "left").select("name", F.coalesce("k", F.lit(0)).alias("n"), F.col("k").isNull().alias("unknown"))


def rederived(recorded: DataFrame, derived: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem) of what was derived anew and is not recorded, or not so; of several fields the first."""
    both = derived.alias("d").join(recorded.alias("r"), key, "left")
    problem = F.when(F.col(f"r.{fields[0]}").isNull(), "not recorded")
    for f in fields:
        problem = problem.when(F.abs(F.col(f"d.{f}") - F.col(f"r.{f}")) > 1e-9, f"{f} differs")
    return both.select(key, problem.alias("problem")).filter("problem is not null")


def freeze(df: DataFrame, strata: list[str], n: int, risk: Column, order: Column, key: str) -> DataFrame:
    """A draw of ``n`` a stratum with all risk cases beside it, dealt in turn to two raters and both orders of conditions.

    Risk cases beyond the draw are marked ``by_risk``. The numbering runs within a stratum, over ranges of it.
    """
    placed = numbered_within(df.withColumn("_o", order), strata, ["_o", key], "_k").withColumn("_risk", risk)
    odd = F.col("_k") % 2 == 1
    kept = placed.filter((F.col("_k") <= n) | F.col("_risk"))
    return kept.select(
        *df.columns,
        (F.col("_risk") & (F.col("_k") > n)).alias("by_risk"),
        F.when(odd, "r1").otherwise("r2").alias("rater"),
        F.when(odd, "with-without").otherwise("without-with").alias("crossover")
    )


def against_winner(df: DataFrame, system: str, item: str, value: str, *, decimals: int = 12) -> DataFrame:
    """Mean difference and signs of every system to the one of largest mean, over the items that both have.

    A sign counts to ``decimals`` places of the difference: values are means of doubles, and what is left of two equal ones depends on the order of their sums.
    """
    means = df.groupBy(system).agg(F.round(F.avg(value), 9).alias("m"))
    best = means.agg(F.max_by(system, F.struct("m", system)).alias("_best"))
    marked = df.crossJoin(F.broadcast(best))  # one row
    own = marked.filter(F.col(system) == F.col("_best")).select(item, F.col(value).alias("_v"))
    d = marked.filter(F.col(system) != F.col("_best")).join(own, item).withColumn("_d", F.col(value) - F.col("_v"))
    side = F.round("_d", decimals)
    return d.groupBy(system).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_diff"), F.count_if(side > 0).alias("up"), F.count_if(side < 0).alias("down"))


def worklists(df: DataFrame, rater: Column, order: list[str], shared: Column) -> DataFrame:
    """``df`` with ``rater``, ``position`` (1, 2, ... along ``order`` in the rater's list) and ``shared``. ``order`` is unique within a rater."""
    marked = df.withColumns({"rater": rater, "shared": shared})
    return numbered_within(marked, ["rater"], order, "position")


def primary_analysis(df: DataFrame, case: str, condition: str, dimension: str, value: str, first: str, second: str, primary: str) -> DataFrame:
    """(dimension, n, mean, median, sd, t, dz, w_plus, w_minus, rank_biserial, p, method, p_holm): every dimension's paired analysis in one plan.

    A case's ratings under a condition are averaged first; cases with both conditions are pairs. ``primary`` is reported as it is, ``p_holm`` adjusts
    the p of all other dimensions as one family. Dimensions of fewer than five pairs, or of equal pairs only, have no report.
    """
    side = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    pairs = df.groupBy(F.col(dimension).alias("dimension"), case).agg((side(first) - side(second)).alias("d")).filter("d is not null")
    pairs = materialised(pairs.select("dimension", "d"), "pairs")  # read by each of the three reports
    report = paired_report(pairs, ["dimension"], "d")
    signed = stats.signed_rank(pairs, "d", ["dimension"]).drop("n")
    both = report.join(signed, "dimension")
    holm = stats.holm(both.filter(F.col("dimension") != primary).select("dimension", "p", F.lit(0).alias("_family")), "p", "dimension", ["_family"])
    return both.join(holm.select("dimension", "p_holm"), "dimension", "left")


def inter_rater(df: DataFrame, item: str, rater: str, dimension: str, value: str, raters: tuple[str, str]) -> DataFrame:
    """(dimension, n, icc): ICC(2,1) of two raters on the items that both rated, by dimension; null below two items or without any variance.

    Only sums of pairs are gathered; several ratings of one rater are averaged.
    """
    one = lambda r: F.avg(F.when(F.col(rater) == r, F.col(value)))
    w = df.groupBy(F.col(dimension).alias("dimension"), item).agg(one(raters[0]).alias("a"), one(raters[1]).alias("b")).dropna(subset=["a", "b"])
    # around the first rater's mean, so that large values do not cancel
    mid = w.groupBy("dimension").agg(F.avg("a").alias("_m"))
    c = w.join(F.broadcast(mid), "dimension").select("dimension", (F.col("a") - F.col("_m")).alias("a"), (F.col("b") - F.col("_m")).alias("b"))
    s = c.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("a").alias("sa"),
        F.sum("b").alias("sb"),
        F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("q"),
        F.sum((F.col("a") + F.col("b")) * (F.col("a") + F.col("b"))).alias("r")
    )
    n = F.col("n")
    grand = (F.col("sa") + F.col("sb")) * (F.col("sa") + F.col("sb")) / (2 * n)
    rows, columns = F.col("r") / 2 - grand, (F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / n - grand
    msr, mse = rows / (n - 1), (F.col("q") - grand - rows - columns) / (n - 1)
    icc = (msr - mse) / F.nullif(msr + mse + 2 * (columns - mse) / n, F.lit(0.0))
    return s.select("dimension", "n", F.when(n >= 2, icc).alias("icc"))


def assign_raters(df: DataFrame, strata: list[str], shared: Column, raters: list[str], order: Column, key: str, start: Column) -> DataFrame:
    """``df`` with ``rater``: of each stratum the first ``shared`` in a seeded order go to ``both``, the others are dealt in turn from ``start``."""
    placed = numbered_within(df.withColumn("_o", order), strata, ["_o", key], "_place")
    turn = F.pmod(F.col("_place") - shared - 1 + start, F.lit(len(raters))) + 1
    who = F.when(F.col("_place") <= shared, "both").otherwise(F.element_at(F.array(*map(F.lit, raters)), turn.cast("int")))
    return placed.withColumn("rater", who).drop("_o", "_place")
