"""Near copies by word shingles: SimHash fingerprints, pigeonhole blocks, Hamming distance, exact Jaccard, components.

Texts with equal shingle sets form one class first. A class has a SimHash fingerprint of its shingles, a majority bit for each bit of
their hashes, which is cut into ``blocks`` of ``bits`` bits (see ``layout``). Two that differ in fewer bits than there are blocks
agree on one block for certain; sets of Jaccard 0.8 have about 85 % of their bits in common, so they agree on one of the blocks with
a probability of 0.998 or more, closer ones with more. Sets of at most ``TINY`` shingles, whose bits say less, also meet by their
sums without one shingle, which misses none of them. Classes that share a block meet if their fingerprints are within
``FAR`` of 128 bits (a pair of Jaccard 0.8 is beyond with a probability below 0.0001); groups of them are compared up
to ``MEET`` at a time in a task, which counts the shingles of all their pairs as a matrix product and hands on a spanning forest of the
links, never the pairs. Of a group with more classes, most are then in one component; only those
outside of it meet the others, block by block, so no link of the group is lost. The first blocks link most; the others are
searched for what is not yet in one component.

A class is called by the number of one of its rows. Texts stay where they are: Bloom filters of row numbers say which ones are cut
into shingles for a meeting and which may have to go at the end, and only the latter travel.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.llm.components import components
from spanwright.llm.simhash import first_of_roots, first_rows
from spanwright.llm.suffix_dedup import Packed, stored
from spanwright.llm.twice_filter import bits_for, may_hold, seen

#: Share of bits that fingerprints of sets of Jaccard 0.8 have in common, at least; bits of 128 that may differ.
AGREE, FAR = 0.8385, 37
#: Shingles of a set up to which sums without one of them are keys: two such sets of Jaccard 0.8 have a key in common.
TINY = 9
#: Blocks that travel at a time, rows of one part of a block, and classes of one block that are compared pair by pair.
AT_ONCE, PART_ROWS, PAIRED = 16, 1 << 17, 128
#: Classes that meet in one task, and shingles of one matrix product.
MEET, COLUMNS = 512, 8192
#: Bits of a filter of row numbers, at most.
FILTER_BITS = 1 << 27
BLOCKS = Packed(key="<u4", cls="<i8", w0="<u8", w1="<u8", root="<i8")


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The different XXH64 of the word shingles of a text, in order; words as in ``simhash64``."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.array([xxhash.xxh64_intdigest(s) for s in shingles], np.uint64))


def layout(n: int) -> tuple[int, int]:
    """(blocks, bits of a block) for ``n`` classes: about 16 classes to a value of a block, and as many blocks as find a
    pair of Jaccard 0.8 with a probability of 0.998."""
    bits = min(24, max(8, n.bit_length() - 4))
    return max(math.ceil(6.2 / AGREE**bits), math.ceil(128 / bits)), bits


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int) -> bytes:
    """The majority of each bit over the hashes ``h`` and ``words - 1`` hashes derived from each."""
    ones, more = np.zeros(64 * words, np.int64), np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(h), 255):  # what a byte can count
        part = np.ascontiguousarray(_mix(h[i : i + 255, None] + more))
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h)).tobytes()


def signature(text: str | None, width: int, words: int) -> tuple[int, bytes | None, list[int]]:
    """(digest of the shingle set, signed; fingerprint; keys): zero, none and none without a word."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0, None, []
    keys = []
    if len(h) <= TINY:
        total = h.sum(dtype=np.uint64)
        keys = np.unique(_mix(np.append(total - h, total))).view(np.int64).tolist()
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64).view(np.int64)[0]), fingerprint(h, words), keys


def _groups(key: np.ndarray, w0: np.ndarray, w1: np.ndarray, far: int) -> np.ndarray:
    """For each row, in order of ``key``, the first row that links of ``far`` bits or fewer between rows of one key lead to."""
    near = lambda i, j: np.bitwise_count(w0[i] ^ w0[j]).astype(np.int64) + np.bitwise_count(w1[i] ^ w1[j]) <= far
    label = np.arange(len(key))
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(begins, len(key)))
    i, left, right = np.flatnonzero(np.repeat(size <= PAIRED, size)), [], []
    for d in range(1, PAIRED):
        i = i[i + d < len(key)]
        i = i[key[i + d] == key[i]]
        if not len(i):
            break
        hit = i[near(i, i + d)]
        left.append(hit)
        right.append(hit + d)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while (label[a] != label[b]).any():
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            label = label[label]
    for begin, n in zip(begins[size > PAIRED].tolist(), size[size > PAIRED].tolist()):
        rest = np.arange(begin, begin + n)  # what is found leaves the rest, so that many alike are few steps
        while len(rest):
            first, rest, todo = rest[0], rest[1:], [rest[0]]
            while todo and len(rest):
                hit = near(todo.pop(), rest)
                label[rest[hit]] = first
                todo += rest[hit].tolist()
                rest = rest[~hit]
    return label


def _keyed(classes: DataFrame, n: int, first: int, stop: int) -> DataFrame:
    """(cls, key): for each block from ``first`` to ``stop`` the groups of classes with one value of it and near fingerprints.

    A key stands for the members of a group. Groups whose classes all have one ``root`` are left out; a class without a link has none (-1).
    """
    _, bits = layout(n)
    parts, far = -(-n // PART_ROWS), FAR

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_by("cls")  # numbers that rise, and one root for most, take little room
            cls, root = (batch.column(c).to_numpy() for c in (0, 2))
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), -1)
            w0, w1 = (np.ascontiguousarray(fps[:, a : a + 8]).view(np.uint64).ravel() for a in (0, 8))
            flat = np.unpackbits(fps, axis=1)[:, first * bits : stop * bits].reshape(len(batch), stop - first, bits)
            value = flat.astype(np.float32) @ (2.0 ** np.arange(bits)).astype(np.float32)
            for t in range(stop - first):
                v = value[:, t].astype(np.uint32)
                yield BLOCKS.rows(t * parts + v % parts, v, cls, w0, w1, root)

    def meet(table: pa.Table) -> pa.Table:
        key, cls, w0, w1, root = BLOCKS.columns(table)
        order = np.argsort(key, kind="stable")
        key, cls, w0, w1, root = key[order], cls[order], w0[order], w1[order], root[order]
        label = _groups(key, w0, w1, far)
        order = np.argsort(label, kind="stable")
        begins = np.flatnonzero(np.append(True, np.diff(label[order]) != 0)[: len(label)])
        size = np.diff(np.append(begins, len(label)))
        cls, root = cls[order], root[order]
        root = np.where(root < 0, -2 - cls, root)
        several = np.minimum.reduceat(root, begins) < np.maximum.reduceat(root, begins)
        names = _mix(np.add.reduceat(_mix(cls.view(np.uint64)), begins)).view(np.int64)
        keep = np.repeat(several, size)
        return pa.table({"cls": pa.array(cls[keep]), "key": pa.array(np.repeat(names, size)[keep])})

    rows = classes.filter("fp is not null").select("cls", "fp", "root")
    return rows.mapInArrow(deal, BLOCKS.schema).groupBy("part").applyInArrow(meet, "cls long, key long")


def _linked(left: list[np.ndarray], right: list[np.ndarray], least: float) -> np.ndarray:
    """Matrix of which sets of ``left`` and ``right`` have a Jaccard of ``least`` or more."""
    sets = left + right
    sizes = np.array([len(x) for x in sets], np.float32)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = owner[seen[column] > 1], column[seen[column] > 1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[owner[part], column[part] - low] = 1
        both += table[: len(left)] @ table[len(left) :].T
    return both >= least * (sizes[: len(left), None] + sizes[None, len(left) :] - both) - 1e-3


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the symmetric matrix ``near`` connects, one less than there are members at most."""
    out, left = [], np.ones(len(near), np.bool_)
    for i in range(len(near)):
        todo = [i] if left[i] else []
        left[i] = False
        while todo:
            at = todo.pop()
            found = np.flatnonzero(near[at] & left)
            left[found] = False
            out += [(at, int(x)) for x in found]
            todo += found.tolist()
    return out


def _met(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links between the rows (meeting, side, cls, root, shingles) of each meeting.

    A meeting with one side links all its rows; one with two links those of side 1 to those of side 0 of
    another root, one for each root.
    """

    def links(cls: np.ndarray, side: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        if not side.any():
            return [(int(cls[i]), int(cls[j])) for i, j in _forest(_linked(sets, sets, least))]
        one, other = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        near = _linked([sets[i] for i in one], [sets[i] for i in other], least) & (root[one][:, None] != root[other][None, :])
        out = []
        for i, row in zip(one, near):
            at = other[row]
            out += [(int(cls[i]), int(cls[j])) for j in at[np.unique(root[at], return_index=True)[1]]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                cls, side, root = (table.column(c).to_numpy() for c in ("cls", "side", "root"))
                found = links(cls, side, root, [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")])
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:  # sorted by meeting, which may go on in the next batch
            meeting = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(meeting[1:] != meeting[:-1]) + 1).tolist(), len(meeting)]
            for a, b in zip(cuts, cuts[1:]):
                if held and b > a and held[-1].column(0)[0].as_py() != meeting[a]:
                    yield from flush()
                if b > a:
                    held.append(batch.slice(a, b - a))
        yield from flush()

    rows = rows.select("meeting", "side", "cls", "root", "shingles")
    return rows.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(run, "a long, b long")


def _held(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose ``cls`` is in ``numbers`` (cls), and some more."""
    n = numbers.count()
    bits = bits_for(n, FILTER_BITS)
    found = rows.filter(may_hold(seen(numbers, bits), F.col("cls")))
    return found if 8 * n <= 2 * bits else found.join(numbers, "cls", "left_semi")


def _with_sets(meeting: DataFrame, sets: DataFrame) -> DataFrame:
    """``meeting`` with the shingles of its classes. Its rows come from arrays and sequences, whose length the planner does not see: both sides are
    exchanged, or it would send a table of any size through the driver as a small one."""
    return meeting.hint("merge").join(sets, "cls")


def _links(keyed: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b): links between classes that give the components of all similar pairs sharing a key of ``keyed`` (cls, key)."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(keyed.join(sizes, "key").withColumn("shard", F.pmod(F.xxhash64("cls", "key"), F.ceil(F.col("n") / MEET))), "near-keys")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    sets = stored(_held(rows, stored(shared.select("cls").distinct(), "near-asked")).select("cls", "text").mapInArrow(cut, "cls long, shingles binary"), "near-sets")
    # keys with the same classes are one meeting
    groups = shared.groupBy("key", "shard").agg(F.sort_array(F.collect_list("cls")).alias("members")).filter(F.size("members") > 1).select("members").distinct()
    members = groups.select(F.xxhash64("members").alias("meeting"), F.explode("members").alias("cls"))
    first = stored(_met(_with_sets(members, sets).withColumns({"side": F.lit(0), "root": F.lit(0).cast("long")}), least), "near-links")
    large = shared.filter(F.col("n") > MEET).select("key", "cls", "n")
    if large.isEmpty():
        return first
    roots = components(first)
    rooted = stored(large.join(roots, large["cls"] == roots["node"], "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("root")), "near-rooted")
    main = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key", F.lit(0).alias("side")).agg(F.max_by("root", F.struct("m", "root")).alias("main"), (F.sum("m") - F.max("m")).alias("strays"))
    # the strays of a key, in blocks, meet all its classes, in blocks
    main = main.filter("strays > 0").select("key", "main", F.ceil(F.col("strays") / MEET).alias("rows"))
    at = rooted.join(main, "key").withColumns({"i": F.pmod(F.xxhash64("cls", F.lit(1)), "rows"), "j": F.pmod(F.xxhash64("cls", F.lit(2)), F.ceil(F.col("n") / MEET))})
    below = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    strays = at.filter("root <> main").withColumn("j", below(F.ceil(F.col("n") / MEET))).withColumn("side", F.lit(1))
    others = at.withColumn("i", below(F.col("rows"))).withColumn("side", F.lit(0))
    meeting = strays.unionByName(others).select(F.xxhash64("key", "i", "j").alias("meeting"), "side", "cls", "root")
    return first.unionByName(_met(_with_sets(meeting, sets), least))


def keep_one_similar(docs: DataFrame, *, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of smallest id.

    Texts link if the Jaccard of their sets of ``width``-word shingles is ``least`` or more.
    Fewer words than ``width`` make one shingle; texts without a word are copies of each other.
    A row with an id goes before rows without; of rows that share id and set the smallest text
    stays.
    """

    n = docs.count()
    blocks, bits = layout(n)
    words = -(-blocks * bits // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = [signature(t.as_py(), width, words) for t in batch.column(2)]
            digest, fp, keys = (pa.array([x[i] for x in signed], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digest, fp, keys], names=["row", "number", "digest", "fp", "keys"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([packed.schema["row"], *(T.StructField(c, T.LongType()) for c in ("number", "digest")), T.StructField("fp", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    rows = stored(packed.mapInArrow(run, schema), "near-signed")
    classes = stored(rows.groupBy("digest").agg(F.min("number").alias("cls"), F.min(f"row.{id_col}").alias("first_id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-classes")
    texts = rows.select(F.col("number").alias("cls"), F.col(f"row.{text_col}").cast("string").alias("text"))
    begin = min(AT_ONCE, blocks)
    keyed = _keyed(classes.withColumn("root", F.lit(-1).cast("long")), n, 0, begin).unionByName(classes.select("cls", F.explode("keys").alias("key")))
    links = _links(stored(keyed.distinct(), "near-keyed"), texts, width, least)
    if begin < blocks:
        roots = components(links)
        rooted = stored(classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "fp", F.coalesce("root", F.lit(-1)).alias("root")), "near-rooted")
        rest = [stored(_keyed(rooted, n, at, min(at + AT_ONCE, blocks)), "near-keyed") for at in range(begin, blocks, AT_ONCE)]
        links = links.unionByName(_links(stored(functools.reduce(DataFrame.unionByName, rest).distinct(), "near-keyed"), texts, width, least))
    roots = components(links)
    rooted = stored(classes.join(roots, classes["cls"] == roots["node"], "left").select(F.col("digest").alias("fp"), "first_id", F.coalesce("root", "cls").alias("root")), "near-rooted")
    rows = rows.select("row", "number", F.col("digest").alias("fp"))
    # most rows stay for certain, as the only ones of their id and set; only the others go where their copies are
    named = rows.select("number", "fp", F.col(f"row.{id_col}").alias("first_id"))
    meant = named.join(first_of_roots(rooted).withColumnRenamed("first_id", "id"), "fp").filter(F.col("first_id").eqNullSafe(F.col("id")))
    alone = meant.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("number")).filter("n = 1")
    doubtful = stored(named.join(alone, "number", "left_anti").select("number"), "near-doubtful")
    asked = may_hold(seen(doubtful, bits_for(doubtful.count(), FILTER_BITS)), F.col("number"))
    marked = rows.withColumn("asked", asked)
    return marked.filter(~F.col("asked")).select("row.*").unionByName(first_rows(marked.filter("asked").select("row", "fp"), rooted, id_col, text_col))
