"""Phrase collocations: multikey three-way quicksort of suffix pointers, to the depth of the longest phrase.

Every word of every piece of text starts a suffix; what is compared are its first words only.

1. A map packs the words of its texts as numbers, a chunk for each group and about a million words, with the chunk's own
   list of words. A few suffixes of each chunk are noted for the routing.
2. Suffixes are routed by their leading words: ranges of (group, first word, second word, ...), in the order of the words' hashes.
   Equal suffixes of a chunk travel as one with a count. Limits of the ranges come from the noted suffixes and decide nothing but
   balance; they may fall inside a word or a pair, so that no frequent word makes a large range.
3. Each range is sorted by multikey three-way quicksort. The rows equal to a pivot are one phrase, their counts add up to its
   frequency; partitions below the least frequency are abandoned unless a limit of the range runs through their phrase.
4. Phrases that a limit cuts come in parts, which are added up. Scores are joins among the frequent phrases: the
   parts of a frequent phrase are frequent themselves.

A word is compared as itself, never as its hash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import dropped, stored

#: Words of a packed chunk, and suffixes of a range (about 40 bytes each in the task that sorts it).
CHUNK_WORDS, RANGE_SUFFIXES = 1 << 20, 1 << 21
#: Suffixes noted for each range: limits are off by a few percent of a range.
NOTED = 64
#: Bytes of text that are split into words at a time; partitions of so few rows are sorted directly.
SLICE, SMALL = 1 << 20, 1024

#: A piece ends at . , ; : ! ? and \x0A-\x0D, a word at a blank or a tab; A-Z are lower-cased.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(_BREAKS) + b" ")
_EDGE = re.compile(rb"[ \n]")


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a folded text in order, with b"\\n" between pieces, a bounded list at a time."""
    data, at = text.translate(_FOLD), 0
    while at < len(data):
        found = _EDGE.search(data, at + SLICE)
        end = found.start() if found else len(data)
        yield [w for w in data[at:end].replace(b"\n", b" \n ").split(b" ") if w]
        at = end


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _opened(data: bytes, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _suffixes(ids: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """Columns of the first ``depth`` words of the suffixes at ``at``; 0 stands behind the end of a piece."""
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    columns = [padded[at]]
    for k in range(1, depth):
        columns.append(np.where(columns[-1] == 0, 0, padded[at + k]))
    return columns


def _keys(group: str, hashes: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Routing keys as byte strings: 8 bytes for group and first word, 4 for each next word."""
    n, depth = len(columns[0]), len(columns)
    key = np.empty((n, 4 + 4 * depth), np.uint8)
    lead = np.uint64(xxhash.xxh64_intdigest(group.encode("utf-8"))) ^ hashes
    key[:, :8] = lead[columns[0]].astype(">u8").view(np.uint8).reshape(n, 8)
    tail = (hashes >> np.uint64(32)).astype(">u4")
    for k in range(1, depth):
        key[:, 4 + 4 * k : 8 + 4 * k] = tail[columns[k]].view(np.uint8).reshape(n, 4)
    return key


def _strings(key: np.ndarray) -> np.ndarray:
    return key.view(f"S{key.shape[1]}").ravel()


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hashes by word number; number 0 is no word."""
    return np.array([0, *(xxhash.xxh64_intdigest(w) for w in words)], np.uint64)


def _pack_chunks(depth: int):
    """mapInArrow: (grp, text) -> packed chunks of one group each."""

    class Held:
        def __init__(self):
            self.numbers = defaultdict(count(1).__next__, {b"\n": 0})
            self.ids: list[np.ndarray] = []
            self.size = 0

        def put(self, text: bytes) -> None:
            for words in word_slices(text):
                self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
                self.size += len(words)
            self.ids.append(np.zeros(1, np.int32))
            self.size += 1

        def chunk(self, group: str) -> dict:
            ids = np.concatenate(self.ids)
            vocab = [w for w in self.numbers if w != b"\n"]
            at = np.flatnonzero(ids)
            some = at[np.linspace(0, len(at) - 1, min(NOTED, len(at))).astype(np.int64)]
            noted = _strings(_keys(group, _hashes(vocab), _suffixes(ids, some, depth))) if len(at) else []
            return {"grp": group, "n": len(at), "size": len(ids), "ids": _packed(ids), "vocab": b" ".join(vocab), "noted": [bytes(x) for x in noted]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Held] = defaultdict(Held)
        total = 0

        def out(group: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([held.pop(group).chunk(group)], schema=_CHUNK)

        for batch in batches:
            for group, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                own = held[group.as_py()]
                before = own.size
                own.put(text.as_buffer().to_pybytes())
                total += own.size - before
                while total > 2 * CHUNK_WORDS:  # the largest group goes, so that chunks stay large
                    most = max(held, key=lambda g: held[g].size)
                    total -= held[most].size
                    yield out(most)
        for group in [*held]:
            yield out(group)

    return run


_CHUNK = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("vocab", pa.binary()), ("noted", pa.list_(pa.binary()))])
_PART = "range long, grp string, size long, rows binary, kind string, weights binary, vocab binary"


def _route(depth: int, limits):
    """mapInArrow: chunks -> their suffixes, a part for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = limits.value
        for batch in batches:
            for row in range(batch.num_rows):
                group, size, ids, vocab = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("grp", "size", "ids", "vocab"))
                words, ids = vocab.split(b" "), _opened(ids, size, "int32")
                columns = _suffixes(ids, np.flatnonzero(ids), depth)
                if not len(columns[0]):
                    continue
                columns, weights = _equal_as_one(columns)
                hashes = _hashes(words)
                to = np.searchsorted(cuts, _strings(_keys(group, hashes, columns)), side="right")
                order = np.argsort(to, kind="stable")
                columns, weights, to = [c[order] for c in columns], weights[order], to[order]
                starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                for a, b in zip(starts, np.r_[starts[1:], len(to)]):
                    used, rows = np.unique(np.stack([c[a:b] for c in columns]), return_inverse=True)
                    if used[0] != 0:  # number 0 stays the end of a piece
                        used, rows = np.r_[0, used], rows + 1
                    kind = "uint16" if len(used) < 1 << 16 else "int32"
                    part = {
                        "range": int(to[a]), "grp": group, "size": int(b - a), "rows": _packed(rows.reshape(depth, -1).astype(kind)), "kind": kind,
                        "weights": _packed(weights[a:b]), "vocab": b" ".join([words[i - 1] for i in used[1:]]),
                    }
                    yield pa.RecordBatch.from_pylist([part], schema=pa.schema([("range", pa.int64()), ("grp", pa.string()), ("size", pa.int64()), ("rows", pa.binary()), ("kind", pa.string()), ("weights", pa.binary()), ("vocab", pa.binary())]))

    return run


def _equal_as_one(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of equal words together, with their number. A clash of the sorting hash leaves two rows, which are added up later."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed = (mixed ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    columns = [c[order] for c in columns]
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], np.diff(np.r_[starts, len(new)]).astype(np.int64)


def frequent(columns: list[np.ndarray], weights: np.ndarray, least: int, edge: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Multikey three-way quicksort: (rows, depth, counts) of phrases found ``least`` times or cut by a limit.

    ``columns[d]`` has the suffixes' word numbers at depth d, 0 behind the end; ``edge`` to what depth a suffix shares its words
    with a limit. A row stands for its phrase of ``depth`` words; a phrase is reported once.
    """
    deepest = len(columns)
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        rows, d = stack.pop()
        total = int(weights[rows].sum())
        if total < least and not (edge[rows] > d).any():
            continue
        if len(rows) <= SMALL:
            yield from _finish(columns, weights, least, edge, rows, d)
            continue
        words = columns[d][rows]
        pivot = np.sort(words[:: len(words) // 9])[4]
        stack += [(rows[words < pivot], d), (rows[words > pivot], d)]
        same = rows[words == pivot]
        if pivot:
            total = int(weights[same].sum())
            if total >= least or (edge[same] > d).any():
                yield same[:1], d + 1, np.array([total])
                if d + 1 < deepest:
                    stack.append((same, d + 1))


def _finish(columns: list[np.ndarray], weights: np.ndarray, least: int, edge: np.ndarray, rows: np.ndarray, d: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """A small partition whose suffixes share ``d`` words: sorted at once, groups counted depth by depth."""
    rows = rows[np.lexsort([c[rows] for c in columns[:d:-1]] + [columns[d][rows]])]
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in range(d, len(columns)):
        words = columns[k][rows]
        new[1:] |= words[1:] != words[:-1]
        starts = np.flatnonzero(new)
        totals = np.add.reduceat(weights[rows], starts)
        hit = (words[starts] != 0) & ((totals >= least) | (np.maximum.reduceat(edge[rows], starts) > k))
        if hit.any():
            yield rows[starts[hit]], k + 1, totals[hit]


def _sort_range(depth: int, least: int, limits):
    """applyInArrow: the parts of a range -> its phrases with their counts."""

    def run(parts: pa.Table) -> pa.Table:
        out: dict[str, list] = {"grp": [], "phrase": [], "words": [], "a": []}
        cuts = limits.value
        groups = parts.column("grp").to_pylist()
        number = parts.column("range")[0].as_py()
        sides = [np.frombuffer(cuts[i : i + 1].tobytes(), np.uint8) for i in (number - 1, number) if 0 <= i < len(cuts)]
        for group in sorted(set(groups)):
            numbers = defaultdict(count(1).__next__)
            held, weights = [], []
            for i in (i for i, g in enumerate(groups) if g == group):
                size, rows, kind, w, vocab = (parts.column(c)[i].as_py() for c in ("size", "rows", "kind", "weights", "vocab"))
                own = np.array([0, *map(numbers.__getitem__, vocab.split(b" "))], np.int32)
                held.append(own[_opened(rows, size * depth, kind).reshape(depth, size)])
                weights.append(_opened(w, size, "int64"))
            columns, weights = [*np.concatenate(held, axis=1)], np.concatenate(weights)
            del held
            words = [*numbers]
            edge = _shared(group, words, columns, sides)
            for rows, k, totals in frequent(columns, weights, least, edge):
                for row, total in zip(rows, totals):
                    out["grp"].append(group)
                    out["phrase"].append(b" ".join([words[c[row] - 1] for c in columns[:k]]).decode("utf-8"))
                    out["words"].append(k)
                    out["a"].append(int(total))
        return pa.table(out, schema=pa.schema([("grp", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())]))

    return run


def _shared(group: str, words: list[bytes], columns: list[np.ndarray], sides: list[np.ndarray]) -> np.ndarray:
    """To what depth each suffix has the words of one of the limits beside its range (by hash: more are kept than need be)."""
    edge = np.zeros(len(columns[0]), np.int8)
    hashes = _hashes(words)
    lead = (np.uint64(xxhash.xxh64_intdigest(group.encode("utf-8"))) ^ hashes).astype(">u8").view(np.uint8).reshape(-1, 8)
    tail = (hashes >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
    for side in sides:
        alike = np.flatnonzero((lead == side[:8]).all(axis=1)[columns[0]])
        for k in range(1, len(columns) + 1):
            edge[alike] = np.maximum(edge[alike], k)
            if k < len(columns):
                same = (tail == side[4 + 4 * k : 8 + 4 * k]).all(axis=1)
                alike = alike[same[columns[k][alike]]]
    return edge


def frequent_phrases(docs: DataFrame, *, longest: int = 4, least: int = 30, group_col: str = "lang", text_col: str = "text", no_group: str = "und") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words found ``least`` times or more in a group, and the groups' word counts.

    (grp, phrase, words, a) and (grp, n). A text is lower-cased (A-Z), split at ``. , ; : ! ?`` and ``\\x0A-\\x0D`` into pieces and those
    at blanks and tabs into words; phrases stay within a piece, overlaps count. Null texts hold nothing, null groups are
    ``no_group``; repeated rows count each. Both tables are stored.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit(no_group)).alias("grp"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = "grp string, n long, size long, ids binary, vocab binary, noted array<binary>"
    chunks = stored(source.mapInArrow(_pack_chunks(longest), schema), "phrase-chunks")
    counts = stored(chunks.groupBy("grp").agg(F.sum("n").alias("n")).filter("n > 0"), "phrase-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranges = total // RANGE_SUFFIXES + 1
    noted = chunks.select(F.explode("noted").alias("key"))
    share = min(1.0, NOTED * ranges / max(1, noted.count()))  # the sample has so many keys for each range, whatever the input
    keys = np.sort(np.array([bytes(r.key) for r in noted.sample(share, seed=7).toLocalIterator()], f"S{4 + 4 * longest}"))
    picks = np.unique(keys[(np.arange(1, ranges) * len(keys)) // ranges]) if len(keys) else keys
    limits = spark.sparkContext.broadcast(picks)
    parts = chunks.select("grp", "size", "ids", "vocab").mapInArrow(_route(longest, limits), _PART)
    found = parts.groupBy("range").applyInArrow(_sort_range(longest, least, limits), "grp string, phrase string, words int, a long")
    phrases = found.groupBy("grp", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    phrases = stored(phrases, "phrases")
    dropped(chunks)
    return phrases, counts


def collocations(
    docs: DataFrame, *, longest: int = 4, least: int = 30, top: int = 2000, cover: tuple[int, int] = (80, 100), scale: int = 1_000_000,
    group_col: str = "lang", text_col: str = "text", no_group: str = "und",
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each group: group, rank, phrase, a, l, r, n, score.

    A phrase found a times whose first part is found l and whose rest is found r times scores ``floor(2 * scale * a / (l + r))`` (the
    Dice coefficient of its two parts); the cut that scores least counts, of equal ones the first. A phrase whose words
    stand side by side in a longer frequent phrase is left out where that one is found at least ``cover[0] / cover[1]`` times as often. Order:
    score, then a, both falling, then the phrase by its UTF-8 bytes; so no two rows tie. No frequent phrase: no row.
    All numbers are exact: products are decimals of 38 digits.
    """
    phrases, counts = frequent_phrases(docs, longest=longest, least=least, group_col=group_col, text_col=text_col, no_group=no_group)
    exact = lambda c: c.cast("decimal(20,0)")
    words = F.split("phrase", " ")
    long = phrases.filter("words > 1").withColumn("w", words)
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = long.select("grp", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("grp", "phrase", "words", "a", "cut", joined(F.lit(1), F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("rest"))
    part = lambda name, n: phrases.select("grp", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = cuts.join(part("first", "l"), ["grp", "first"]).join(part("rest", "r"), ["grp", "rest"])
    score = F.expr(f"cast({2 * scale} as decimal(12,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    scored = cuts.groupBy("grp", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    spans = F.expr(f"explode(flatten(transform(sequence(2, {max(2, longest - 1)}), k -> transform(sequence(1, greatest(words - k + 1, 1)), i -> if(k < words, array_join(slice(w, i, k), ' '), null)))))")
    inner = long.filter("words > 2").select("grp", F.col("a").alias("over"), spans.alias("phrase")).filter("phrase is not null")
    inner = inner.groupBy("grp", "phrase").agg(F.max("over").alias("over"))
    left = scored.join(inner, ["grp", "phrase"], "left")
    left = left.filter(F.col("over").isNull() | (exact(F.col("over")) * cover[1] < exact(F.col("a")) * cover[0])).select("grp", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of many shares of a group first: one task then ranks a bounded number of rows
    some = left.withColumn("part", F.abs(F.xxhash64("phrase")) % 64).withColumn("rank", F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)))
    some = some.filter(F.col("rank") <= top).drop("part")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(counts, "grp").select(F.col("grp").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
