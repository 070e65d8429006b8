"""Mixing sources to target weights by pivotal dependent rounding.

Every document has a fractional number of copies, its source's target over its source's
size. The whole part is taken; the fractions are rounded together: a pair of documents
moves mass between its fractions, weighed by size, until one is 0 or 1, which keeps the
source's expected words exactly. Pairs are formed inside small groups of one source and one
size class, what stays open moves up a reduction tree, and the last few open documents of
a source are settled from the largest to the smallest, each pushing its rounding error
onto smaller ones.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import WORD_CLASS, stored

#: Rows of a group in which pairs are formed, and rows that a group leaves open.
GROUP_ROWS = 512
OPEN_ROWS = 32
#: Equal rows (same id, source and size) that one task numbers at a time.
TWIN_ROWS = 1 << 16
#: Groups that meet in one node of the tree, and in its root.
FAN_IN = 8
ROOT_GROUPS = 4
EPS = 1e-12


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """(source, source_size) -> the same plus ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share all words.
    A target stops at ``max_copies`` times its source's size; the excess goes to the others by
    weight until none is above. One row a source: the ordering runs on that small table.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", (F.col("source_size") * max_copies).alias("top"), turn.alias("weight"))
    by_ratio = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole))
    s = s.withColumn("capped", (F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0))) / F.sum("weight").over(rest) > F.col("top") / F.col("weight"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("top"))).over(whole), F.lit(0))
    s = s.withColumn("left", left).withColumn("left_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("top").cast("double")).otherwise(F.col("left") * F.col("weight") / F.col("left_weight")).alias("target"))


def _move(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """One pivotal step between fractions p, q of documents sized a, b: p*a + q*b stays."""
    up, down = min(1 - p, q * b / a), min(p, (1 - q) * b / a)
    if u * (up + down) < down:
        p, q = p + up, q - up * a / b
    else:
        p, q = p - down, q + down * a / b
    return tuple(0.0 if x < EPS else 1.0 if x > 1 - EPS else x for x in (p, q))


def pair_up(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int) -> np.ndarray:
    """Settles fractions in order until ``leave`` at most are open; the sum of p * size stays.

    One open row is carried along and meets the next ones in turn; where both rows of a pair
    end at once, the row after them is carried on.
    """
    p = p.copy()
    todo = np.flatnonzero((p > 0) & (p < 1))
    still, carried = len(todo), -1
    for j, u in zip(todo, rng.random(len(todo))):
        if carried < 0:
            carried = j
            continue
        if still <= leave:
            break
        i = carried
        p[i], p[j] = _move(p[i], size[i], p[j], size[j], u)
        open_ = [x for x in (i, j) if 0 < p[x] < 1]
        still -= 2 - len(open_)
        carried = open_[0] if open_ else -1
    return p


def settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds what is open from the largest to the smallest document; each error moves to smaller ones.

    Where the smaller ones cannot take an error whole, the one or two settled documents whose turning
    brings the sum nearest to where it was are turned.
    """
    aim, settled = float((p * size).sum()), np.flatnonzero((p > 0) & (p < 1))
    p = p.copy()
    todo = [i for i in np.lexsort((np.arange(len(p)), -size)) if 0 < p[i] < 1]
    for k, (i, u) in enumerate(zip(todo, rng.random(len(todo)))):
        rest = np.array(todo[k + 1 :], dtype=np.int64)
        a, mass, room = size[i], float((size[rest] * p[rest]).sum()), float((size[rest] * (1 - p[rest])).sum())
        give, take = (1 - p[i]) * a, p[i] * a  # what the rest gives if i is taken, takes if it is not
        if give <= mass and take <= room:
            one = u < p[i]
        elif give > mass and take > room:
            one = give - mass < take - room
        else:
            one = give <= mass
        p[i] = float(one)
        if len(rest):
            p[rest] = p[rest] * (1 - min(give, mass) / mass if mass else 0.0) if one else 1 - (1 - p[rest]) * (1 - min(take, room) / room if room else 0.0)
    want = aim - float((p * size).sum())
    step = np.append(np.where(p[settled] > 0.5, -1, 1) * size[settled], 0.0)  # the last one turns nothing
    order = np.argsort(step, kind="stable")
    at = np.searchsorted(step[order], want - step)
    turns = [(abs(want - step[i] - step[j]), i, int(j)) for i in range(len(step)) for j in order[max(0, at[i] - 2) : at[i] + 2] if i != j]
    left, *pair = min(turns, default=(abs(want),))
    if left < abs(want) - EPS:
        turned = settled[[k for k in pair if k < len(settled)]]
        p[turned] = 1 - p[turned]
    return p


def numbered(counted: DataFrame) -> DataFrame:
    """Rows with a count ``n`` -> each ``n`` times with ``nth`` = 0, 1, ...: equal rows are told apart
    without a window over them, and a row of a large count is dealt to many tasks first."""
    step = F.lit(TWIN_ROWS).cast("long")
    few, many = counted.filter(F.col("n") <= step), counted.filter(F.col("n") > step)
    many = many.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)))
    many = many.repartition(*[c for c in counted.columns if c != "n"], "low")
    runs = few.withColumn("low", F.lit(0).cast("long")).unionByName(many)
    return runs.withColumn("nth", F.explode(F.sequence("low", F.least(F.col("low") + step, "n") - 1))).drop("n", "low")


def _seed(*parts) -> np.random.Generator:
    return np.random.default_rng(xxhash.xxh64_intdigest(repr(parts).encode()))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), max_copies: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies`` for every row of ``docs``.

    ``size`` is the number of words (null text: 0), ``copies`` how often the mix takes the
    document (0 to ``max_copies``), ``taken`` = size * copies. A source's taken words differ from
    its target by about the size of its smallest documents. Null sources are one source;
    documents without words are never taken; repeated rows are numbered and rounded one by one,
    so rows without an id spread over the groups like others; reruns on the same rows agree
    whatever their order. An empty table gives an empty result; only the three columns named
    are read, whatever others are called.
    """
    spark = docs.sparkSession
    size = word_count(F.col(text_col))
    each = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = stored(numbered(each.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))), "mix-sizes")
    rows = rows.withColumn("cls", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    cells = rows.groupBy("source", "cls").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    goals = targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    plan = stored(
        cells.alias("c").join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "cls", "source_size", "target", F.ceil(F.col("n") / GROUP_ROWS).alias("salts")), "mix-plan"
    )
    levels, most = [], plan.agg(F.max("salts")).first()[0] or 1
    while most > ROOT_GROUPS:
        most = -(-most // FAN_IN)
        levels.append(len(levels) + 1)
    copies = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    dealt = (
        rows.alias("r")
        .join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.cls") == F.col("p.cls")))
        .select("id", "nth", "r.source", "size", "r.cls", "source_size", "target", F.pmod(F.xxhash64("id", "size", "nth", F.lit(seed)), F.col("salts")).alias("salt"), copies.alias("c"))
        .withColumns({"base": F.floor("c"), "p": F.col("c") - F.floor("c")})
        .drop("c")
    )
    schema = dealt.schema

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        h = [xxhash.xxh64_intdigest(f"{seed}/{i}/{s}/{n}") for i, s, n in zip(pdf["id"], pdf["size"], pdf["nth"])]
        return pdf.assign(h=h).sort_values(["h", "size"], kind="stable").drop(columns="h")

    def stage(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = in_order(pdf)
            first = pdf.iloc[0]
            rng = _seed(seed, level, first["source"], int(first["cls"]), int(first["salt"]))
            return pdf.assign(p=pair_up(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), rng, OPEN_ROWS))

        return run

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        return pdf.assign(p=settle(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), _seed(seed, "root", pdf.iloc[0]["source"])))

    done, open_ = [], dealt
    for level in chain([0], levels):
        if level:
            open_ = open_.withColumn("salt", F.floor(F.col("salt") / FAN_IN))
        now = stored(open_.groupBy("source", "cls", "salt").applyInPandas(stage(level), schema), f"mix-level{level}")
        done.append(now.filter("p in (0, 1)"))
        open_ = now.filter("p not in (0, 1)")
    done.append(open_.groupBy("source").applyInPandas(root, schema))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.col("p")).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.col("source").alias(source_col))
