"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a unit
vector; its part of a bucket number is the signed axis it is nearest to. As many rotations make a
bucket as the number of vectors asks for, the last one over fewer axes, so that buckets can be
twice as many at every step. How fine the buckets are and how many of them a query probes in each table is
measured on a bounded sample of queries against their exact neighbours: of the layouts that reach
the target recall the one with the fewest candidates. Coarse layouts can be probed whole, so the
target is in reach for any vectors.

Neighbouring buckets are one group for a task; a query travels once to each group with the buckets that it
probes there. Candidates are ranked by the exact inner product of the original vectors, so only the
best of each group travel on. Equal vectors are one class, large groups are cut into shards on both sides,
and queries that found too little are compared with all vectors in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import stored

#: Vectors, and queries, of one group that one task compares; more are dealt to shards.
SHARD_ROWS = 16384
#: Scored pairs that a task holds before it cuts them to the best of each query.
HELD_PAIRS = 1 << 18
#: Query classes and other classes that calibrate the layout.
SAMPLE_QUERIES, SAMPLE_ROWS = 64, 4096
#: Largest number of probes tried; layouts of up to as many buckets can be probed whole.
MOST_PROBES = 4096
#: Average rows of a bucket in the finest layout tried, and the rows that a probe costs as much as.
BUCKET_ROWS, PROBE_ROWS = 8, 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    x, h = x.copy(), 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _best_sums(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest sums of each row, largest first, of two descending score lists, with their joint numbers.

    The sum of the i-th and the j-th best has at least (i + 1)(j + 1) - 1 others before it, so only pairs with
    (i + 1)(j + 1) <= most are looked at.
    """
    right_at = np.argsort(-right, axis=1, kind="stable")[:, :most]
    right = np.take_along_axis(right, right_at, axis=1)
    depth = np.minimum(right.shape[1], most // np.arange(1, min(left.shape[1], most) + 1))
    i = np.repeat(np.arange(len(depth)), depth)
    j = np.arange(len(i)) - np.repeat(np.cumsum(depth) - depth, depth)
    sums = left[:, i] + right[:, j]
    top = np.argsort(-sums, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(sums, top, axis=1), np.take_along_axis((left_at[:, i] << bits) | right_at[:, j], top, axis=1)


class CrossPolytope:
    """``tables`` hash tables of 2 ** ``bits`` buckets, for vectors of ``dim`` components.

    ``top`` is the largest norm; where norms differ, vectors get one more component that brings
    them to norm one, which keeps the order of inner products for any query.
    """

    def __init__(self, dim: int, top: float, lift: bool, tables: int, bits: int, seed: int):
        self.dim, self.top, self.lift, self.tables, self.bits = dim, top, lift, tables, bits
        self.width = 1 << (dim + lift - 1).bit_length()
        full = self.width.bit_length()  # a rotation over all axes gives log2(2 * width) bits
        self.parts = [full] * (bits // full) + ([bits % full] if bits % full else [])
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (len(self.parts), tables, 3, self.width))

    def _wide(self, x: np.ndarray, query: bool) -> np.ndarray:
        wide = np.zeros((len(x), self.width))
        wide[:, : self.dim] = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else self.top)
        if self.lift and not query:
            wide[:, self.dim] = np.sqrt(np.maximum(0.0, 1 - (wide[:, : self.dim] ** 2).sum(axis=1)))
        return wide

    def _axes(self, wide: np.ndarray, table: int) -> Iterator[np.ndarray]:
        """For each rotation of a table, how near each vector is to its signed axes."""
        for part, bits in enumerate(self.parts):
            y = wide
            for s in self.signs[part, table]:
                y = hadamard(y * s)
            y = y[:, : 1 << (bits - 1)]
            yield np.concatenate([y, -y], axis=1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket numbers."""
        wide = self._wide(x, False)
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for bits, near in zip(self.parts, self._axes(wide, t)):
                out[:, t] = (out[:, t] << bits) | near.argmax(axis=1)
        return out

    def order(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` buckets of a table that each query probes first (all, where there are no more)."""
        out = []
        for i in range(0, len(x), 32):
            wide = self._wide(x[i : i + 32], True)
            score, at = np.zeros((len(wide), 1)), np.zeros((len(wide), 1), np.int64)
            for bits, near in zip(self.parts, self._axes(wide, table)):
                score, at = _best_sums(score, at, near, bits, most)
            out.append(at)
        return np.concatenate(out) if out else np.zeros((0, most), np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


FOUND = "q long, cids array<long>, scores array<double>"


def _top(q: np.ndarray, cids: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """FOUND rows of flat (q, cid, score): for each q the k largest scores, ties to smaller cids, a cid once."""
    order = np.lexsort((-scores, cids, q))
    if len(order):
        q, cids, scores = q[order], cids[order], scores[order]
        once = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(cids) != 0)])
        q, cids, scores = q[once], cids[once], scores[once]
        order = np.lexsort((cids, -scores, q))
        q, cids, scores = q[order], cids[order], scores[order]
        start = np.flatnonzero(np.concatenate([[True], np.diff(q) != 0]))
        keep = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k
        q, cids, scores = q[keep], cids[keep], scores[keep]
    start = np.flatnonzero(np.concatenate([[True], np.diff(q) != 0])) if len(q) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(start, len(q)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(q[start].astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(cids.astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(scores.astype(np.float64)))], names=["q", "cids", "scores"])


def _pairs(q: np.ndarray, qids: np.ndarray, v: np.ndarray, cids: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Flat (q, cid, score) of the k best and all ties with the k-th, some queries at a time.

    ``least`` holds for every number of ``qids`` a score that k rows reach already: smaller ones are left out,
    and the k-th best of these rows raises it.
    """
    step = max(1, (1 << 21) // max(1, len(v)))
    for i in range(0, len(q), step):
        scores = q[i : i + step] @ v.T
        if len(v) > k:
            kth = np.partition(scores, len(v) - k, axis=1)[:, len(v) - k]
            if least is not None:
                kth = least[qids[i : i + step]] = np.maximum(least[qids[i : i + step]], kth)
        else:
            kth = np.full(len(scores), -np.inf) if least is None else least[qids[i : i + step]]
        row, col = np.nonzero(scores >= kth[:, None])
        yield qids[i : i + step][row], cids[col], scores[row, col]


def _joined(parts: list[tuple], k: int) -> pa.RecordBatch:
    if not parts:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    return _top(*(np.concatenate(c) for c in zip(*parts)), k)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (q, cid, score) of FOUND rows."""
    q = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
    return q, batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()


def _merged(found: DataFrame, k: int) -> DataFrame:
    """One FOUND row a query: the rows of a query follow each other, those cut by a batch are carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            rows = [held, _flat(batch)] if held else [_flat(batch)]
            merged = _joined(rows, k)
            if len(merged):
                held = _flat(merged.slice(len(merged) - 1))
                yield merged.slice(0, len(merged) - 1)
        if held:
            yield _joined([held], k)

    return found.repartition("q").sortWithinPartitions("q").mapInArrow(run, FOUND)


def _exact(classes: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """FOUND rows of a bounded sample of queries (cid, vec) against all classes: the best of each task."""
    block = classes.sparkSession.sparkContext.broadcast((np.array([r[0] for r in queries]), np.array([r[1] for r in queries], dtype=np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = block.value
        for batch in batches:
            yield _joined(list(_pairs(q, qids, _matrix(batch.column(1), dim), batch.column(0).to_numpy(), k)), k)

    return classes.select("cid", "vec").mapInArrow(run, FOUND)


def _all_rows(classes: DataFrame, asked: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    """FOUND rows of queries (cid, vec) of any number against all classes, block by block."""

    def salt(blocks: int) -> Column:
        return F.pmod(F.xxhash64("cid"), F.lit(blocks))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    row_blocks, ask_blocks = -(-n // SHARD_ROWS), -(-asked.count() // SHARD_ROWS)
    left = classes.select("cid", "vec", salt(row_blocks).alias("i"), every(ask_blocks).alias("j"))
    right = asked.select("cid", "vec", salt(ask_blocks).alias("j"), every(row_blocks).alias("i"))

    def compare(rows: pa.Table, asks: pa.Table) -> pa.Table:
        v, q = _matrix(rows.column("vec"), dim), _matrix(asks.column("vec"), dim)
        return pa.Table.from_batches([_joined(list(_pairs(q, asks.column("cid").to_numpy(), v, rows.column("cid").to_numpy(), k)), k)])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(compare, FOUND)


def _cut(parts: list[tuple], least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat (q, cid, score) cut to the k best of each query, whose ``least`` rises to its k-th."""
    q, cids, scores = (np.concatenate(c) for c in zip(*parts))
    near = scores >= least[q]
    best = _top(q[near], cids[near], scores[near], k)
    q, cids, scores = _flat(best)
    size = best.column(1).value_lengths().to_numpy()
    full = size == k
    least[best.column(0).to_numpy()[full]] = scores[np.cumsum(size) - 1][full]
    return q, cids, scores


def _candidates(classes: DataFrame, asked: DataFrame, index: CrossPolytope, probes: int, n: int, dim: int, k: int) -> DataFrame:
    """FOUND rows of the queries against the buckets that they probe: the best of each group and shard."""
    shared = classes.sparkSession.sparkContext.broadcast(index)
    tables = index.tables
    low = index.bits - min(index.bits, max(0, (n // SHARD_ROWS).bit_length()))  # bits of a bucket number within its group

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = shared.value.buckets(_matrix(batch.column(1), dim)).ravel()
            at = pa.array(np.repeat(np.arange(len(batch)), tables))
            t = pa.array(np.tile(np.arange(tables, dtype=np.int32), len(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), t, pa.array(b >> low), pa.array(b)], names=["cid", "vec", "t", "g", "b"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                x = _matrix(batch.column(1), dim)
                for t in range(tables):
                    b = np.sort(shared.value.order(x, t, probes), axis=1)
                    row, g = np.repeat(np.arange(len(b)), b.shape[1]), (b >> low).ravel()
                    start = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(g) != 0)]))
                    at, lists = pa.array(row[start]), pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(b.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(start), t, np.int32)), pa.array(g[start]), lists], names=["cid", "vec", "t", "g", "bs"])

    vec = classes.schema["vec"].dataType.simpleString()
    placed = classes.select("cid", "vec").mapInArrow(place, f"cid long, vec {vec}, t int, g long, b long")
    asking = asked.mapInArrow(probe, f"cid long, vec {vec}, t int, g long, bs array<long>")
    sizes = stored(
        placed.groupBy("t", "g").agg(F.count(F.lit(1)).alias("n")).join(asking.groupBy("t", "g").agg(F.count(F.lit(1)).alias("m")), ["t", "g"]).select("t", "g", F.ceil(F.col("n") / SHARD_ROWS).alias("row_shards"), F.ceil(F.col("m") / SHARD_ROWS).alias("ask_shards")),
        "ann-groups",
    )

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows in one shard of their own side, and in every shard of the other."""
        each = df.join(sizes, ["t", "g"]).withColumn(own, F.pmod(F.xxhash64("cid"), F.col(f"{own}_shards")))
        return each.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_shards") - 1))).drop("row_shards", "ask_shards")

    def compare(rows: pa.Table, asks: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        size, limit = 0, HELD_PAIRS
        if len(rows) and len(asks):
            b, v, cids = rows.column("b").to_numpy(), _matrix(rows.column("vec"), dim), rows.column("cid").to_numpy()
            by = np.argsort(b, kind="stable")
            b, v, cids = b[by], v[by], cids[by]
            q, qids, bs = _matrix(asks.column("vec"), dim), asks.column("cid").to_numpy(), asks.column("bs").combine_chunks()
            who, what = np.repeat(np.arange(len(q)), bs.value_lengths().to_numpy()), bs.flatten().to_numpy()
            by = np.argsort(what, kind="stable")
            who, what = who[by], what[by]
            least = np.full(len(q), -np.inf)  # by query, a score that k rows of the group reach already
            for one in np.intersect1d(b, what):
                (i, j), (m, n) = np.searchsorted(b, [one, one + 1]), np.searchsorted(what, [one, one + 1])
                for at, cid, score in _pairs(q[who[m:n]], who[m:n], v[i:j], cids[i:j], k, least):
                    parts.append((at, cid, score))
                    size += len(at)
                    if size > limit:
                        parts = [_cut(parts, least, k)]
                        size = len(parts[0][0])
                        limit = max(HELD_PAIRS, 2 * size)
            if parts:
                at, cid, score = _cut(parts, least, k)
                parts = [(qids[at], cid, score)]
        return pa.Table.from_batches([_joined(parts, k)])

    keys = ["t", "g", "row", "ask"]
    return dealt(placed, "row", "ask").groupBy(*keys).cogroup(dealt(asking, "ask", "row").groupBy(*keys)).applyInArrow(compare, FOUND)


def nearest(vectors: DataFrame, queries, *, k: int = 20, tables: int = 8, target_recall: float = 0.94, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` largest inner products found for each query row.

    ``queries`` is a condition on ``vectors``; every other row is a candidate. Scores are
    double-precision inner products of the original vectors, nearest first, ties to the
    smaller id. Rows with a null id, a null, empty or zero vector, null or non-finite
    components, or a length other than the table's largest take no part. A query gets all
    candidates where there are ``k`` or fewer. Repeated rows of one id count once. Recall is
    calibrated to ``target_recall`` on ``SAMPLE_QUERIES`` queries.
    """
    spark, keep = vectors.sparkSession, k + 1
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    vec = F.transform(F.col(vec_col), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), queries.alias("ask"), vec.alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") > 0))
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    schema = f"query_id long, rank int, {id_col} long, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vec") == dim)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    classes = stored(rows.groupBy("vec").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n")).withColumn("norm", norm), "ann-classes")
    n, top, low = classes.agg(F.count(F.lit(1)), F.max("norm"), F.min("norm")).first()
    asks = stored(rows.filter(F.coalesce("ask", F.lit(False))).select("id", "vec").join(classes.select("vec", "cid"), "vec").select(F.col("id").alias("query_id"), F.col("cid").alias("q")).distinct(), "ann-queries")
    asked = classes.join(asks.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi").select("cid", "vec")
    index, probes = calibrated(classes, asked, n, dim, keep, target_recall, lambda bits: CrossPolytope(dim, top, low < 0.999 * top, tables, bits, seed))
    best = stored(_merged(_candidates(classes, asked, index, probes, n, dim, keep), keep), "ann-found")
    # a class stands for its ids; the smallest k + 1 are enough for any query
    twins = rows.select("id", "vec").distinct().join(classes.filter("n > 1").select("vec", "cid"), "vec").select("cid", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    first = Window.partitionBy("cid", "salt").orderBy("id")
    members = twins.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= keep).groupBy("cid").agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"))
    members = stored(members, "ann-members")
    total = rows.select("id").distinct().count()

    def listed(found: DataFrame) -> DataFrame:
        """(q, near): the nearest ids of each query class."""
        pairs = found.select("q", F.explode(F.arrays_zip("cids", "scores")).alias("x")).select("q", F.col("x.cids").alias("cid"), F.col("x.scores").alias("score"))
        each = pairs.join(members, "cid", "left").select("q", "score", F.explode(F.coalesce("ids", F.array("cid"))).alias("id"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        return each.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= keep).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("near"))

    lists = asks.select("q").distinct().join(listed(best), "q", "left")
    lists = stored(lists.withColumn("short", F.coalesce(F.size("near"), F.lit(0)) < min(keep, total)), "ann-lists")
    done, short = lists.filter("not short").select("q", "near"), lists.filter("short").select(F.col("q").alias("cid"))
    if not short.isEmpty():
        short = stored(classes.join(short, "cid", "left_semi").select("cid", "vec"), "ann-short")
        done = done.unionByName(listed(_merged(_all_rows(classes, short, n, dim, keep), keep)))
    own = asks.join(done, "q").select("query_id", F.filter("near", lambda x: x["id"] != F.col("query_id")).alias("near"))
    ranked = own.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def calibrated(classes: DataFrame, asked: DataFrame, n: int, dim: int, k: int, target: float, layout) -> tuple[CrossPolytope, int]:
    """The layout and the probes a table with which sampled queries find ``target`` of their exact neighbours cheapest."""
    drawn = F.xxhash64("cid"), "cid"
    sample = asked.orderBy(*drawn).limit(SAMPLE_QUERIES).collect()
    near = []
    if sample:
        found = _merged(_exact(classes, sample, dim, k), k)
        near = found.select("q", F.explode("cids").alias("cid")).filter("q <> cid").join(classes.select("cid", "vec"), "cid").select("q", "vec").collect()
    if not near:
        return layout(1), 2
    others = np.array([r["vec"] for r in classes.orderBy(*drawn).limit(SAMPLE_ROWS).select("vec").collect()], dtype=np.float64)
    at = {r[0]: i for i, r in enumerate(sample)}
    x, v, which = np.array([r[1] for r in sample], dtype=np.float64), np.array([r["vec"] for r in near], dtype=np.float64), np.array([at[r["q"]] for r in near])
    tried = []
    finest = max(3, (n // BUCKET_ROWS).bit_length())
    for bits in range(2 + finest % 2, finest + 1, 2):
        index = layout(bits)
        probes, share = _measured(index, x, v, which, others, target)
        if probes:
            tried.append((share * n + probes * index.tables * PROBE_ROWS, bits, probes))
    _, bits, probes = min(tried)
    return layout(bits), probes


def _measured(index: CrossPolytope, x: np.ndarray, v: np.ndarray, which: np.ndarray, others: np.ndarray, target: float) -> tuple[int, float]:
    """Probes a table that a layout needs (0: not in reach), and the share of all rows that are compared then."""
    most = min(MOST_PROBES, 1 << index.bits)
    b, c, need = index.buckets(v), index.buckets(others), np.full(len(v), most)
    orders = [index.order(x, t, most) for t in range(index.tables)]
    for t, order in enumerate(orders):
        for i in range(len(x)):
            mine = np.flatnonzero(which == i)
            hit = order[i][None, :] == b[mine, t][:, None]
            need[mine] = np.minimum(need[mine], np.where(hit.any(axis=1), hit.argmax(axis=1), most))
    probes = int(np.sort(need)[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]) + 1
    if probes > most:
        return 0, 1.0
    return probes, sum(np.isin(c[:, t], orders[t][i, :probes]).mean() for t in range(index.tables) for i in range(len(x))) / len(x)
