"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit check.

Texts are character sequences. A CGK walk over a window of n characters takes 3 n steps; at every step
it reads the character under its cursor and moves on by one or by nothing, as a random function of step and
character says. Two windows a few edits apart soon walk in step again, so their edit distance
becomes a Hamming distance of the walks, and a hash of sampled coordinates is often equal. The
benchmark's items are hashed at all their offsets, documents at every few characters, so an
occurrence is tried many times and none is missed for its alignment. Window and stride follow
the item's size (see ``window_of``): whole items would differ in too many coordinates at the error
rates that count. How many walks are needed is measured: sampled items are edited as much as is allowed
until ``target_recall`` of them are found. What is found is verified by the edit distance
between the whole item and the place in the document, first part by part for all candidates at once.
"""

from __future__ import annotations

import functools
import random
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.llm.common import stored, without

#: Bytes of item texts in one pass over the documents; a larger benchmark takes several passes.
BLOCK_BYTES = 2 << 20
#: Items of a size that are edited to measure recall, and walks of a size at most. Where these do not reach the target, pieces of
#: the items are looked up instead, which miss nothing.
TRIAL_ITEMS, MOST_REPEATS = 64, 64
#: Characters that one step of the vectorised search holds, if no single text is longer.
STEP_CHARS = 1 << 20
#: Candidates of one item that start within so many characters are verified at once.
NEAR = 32
#: Sampled coordinates of a walk; parts of items that are compared at once.
SAMPLES, PARTS_AT_ONCE = 10, 1 << 13
BLANK = 32


@functools.cache
def _symbols() -> np.ndarray:
    """Code point -> a symbol of one byte, 0 where no word character is (``str.isalnum`` or an underscore)."""
    points = np.arange(0x110000, dtype=np.uint32)
    word = np.frombuffer(bytes(chr(i).isalnum() or i == 95 for i in range(0x110000)), np.bool_)
    mixed = np.where(points < 128, points, 128 + (points * np.uint32(0x9E3779B1) >> np.uint32(25)))
    return np.where(word, mixed, 0).astype(np.uint8)


def normal_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, begin of each text and the end): lower-case words, one blank behind each."""
    raw = [(t or "").lower().encode("utf-32-le", "replace") for t in texts]
    codes = np.frombuffer(b"".join(raw), np.uint32)
    ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
    word = _symbols()[codes] != 0
    last = np.zeros(len(codes), np.bool_)
    last[ends[1:][np.diff(ends) > 0] - 1] = True
    # the first character behind a word stands for its blank; a word that ends its text gets one more
    keep = word.copy()
    keep[1:] |= word[:-1] & ~last[:-1]
    times = keep.astype(np.int8) + (word & last)
    out = np.repeat(np.where(word, codes, np.uint32(BLANK)), times)
    begins = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])[ends]
    out[begins[1:][np.diff(begins) > 0] - 1] = BLANK
    return out, begins


def normal_text(text: str | None) -> str:
    """Lower-case words between single blanks."""
    return normal_codes([text])[0].tobytes().decode("utf-32-le").rstrip(" ")


class Item:
    """A normalised item, prepared for comparisons."""

    def __init__(self, text: str):
        self.text, self.masks = text, {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        """Smallest edit distance between the item and any substring of ``text`` (bit-parallel)."""
        n = len(self.text)
        if self.text in text:
            return 0
        full, top = (1 << n) - 1, 1 << (n - 1)
        pv, mv, score, best = full, 0, n, n
        for c in text:
            eq = self.masks.get(c, 0)
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (full & ~(xh | pv)), pv & xh
            score += bool(ph & top) - bool(mh & top)
            best = min(best, score)
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | (full & ~(eq | mv | ph)), ph & (eq | mv)
        return best


def edit_distance_within(item: str, text: str) -> int:
    return Item(item).distance(text)


def window_of(n: int) -> tuple[int, int]:
    """(window, stride) for an item of ``n`` characters: several windows lie within any occurrence."""
    if n >= 64:
        return 16, 8
    if n >= 32:
        return 12, 3
    return max(1, n // 2), max(1, n // 8)


class Walks:
    """``repeats`` random walks over windows of ``length`` characters with the coordinates that are sampled."""

    def __init__(self, length: int, repeats: int, seed: int):
        self.length, steps = length, 3 * length
        self.moves, self.coords = [], []
        for r in range(repeats):
            rng = np.random.default_rng([seed, length, r])
            self.moves.append(rng.integers(0, 2, (steps, 256), dtype=np.uint8))
            cuts = np.linspace(0, steps, min(steps, SAMPLES) + 1).astype(int)  # one coordinate of each part of the walk
            self.coords.append({int(rng.integers(a, b)) for a, b in zip(cuts, cuts[1:])})

    def embed(self, symbols: np.ndarray, starts: np.ndarray, table: int) -> np.ndarray:
        """A hash of the sampled coordinates for each start; the cursor stops at the window's last character."""
        at, last, out = starts.astype(np.int32), (starts + (self.length - 1)).astype(np.int32), np.full(len(starts), table + 1, np.uint64)
        moves, coords = self.moves[table], self.coords[table]
        for t in range(max(coords) + 1):
            symbol = symbols.take(at, mode="clip")
            if t in coords:
                out = (out ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
            at += moves[t].take(symbol)
            if t + 1 >= self.length:  # no cursor is beyond the window before
                np.minimum(at, last, out=at)
        return out


class Plain:
    """A hash of ``length`` characters as they are."""

    def __init__(self, length: int):
        self.length = length

    def embed(self, symbols: np.ndarray, starts: np.ndarray, table: int) -> np.ndarray:
        out = np.full(len(starts), self.length, np.uint64)
        for t in range(self.length):
            out = (out ^ symbols[np.minimum(starts + t, len(symbols) - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out


def _least_distances(symbols: np.ndarray, low: np.ndarray, high: np.ndarray, masks: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row the smallest edit distance of a pattern of up to 64 symbols to any stretch of ``symbols[low:high]``, by Myers' bit vectors.

    Rows are in order of ``high - low``, so that those which end first leave the front. A pattern stands at the top of its word, so that its
    last symbol is the sign; what is below it (see ``_masks``) always fits.
    """
    one, left = np.uint64(1), np.int64(63)
    masks, place, at = masks.ravel(), own.astype(np.int64) * 256, low.astype(np.int64)
    pv, mv = ~np.uint64(0) << (64 - size).astype(np.uint64), np.zeros(len(low), np.uint64)
    score, best, lengths = size.astype(np.int64), size.astype(np.int64), high - low
    x, ph, mh, eq = (np.empty(len(low), np.uint64) for _ in range(4))
    step, begin = np.empty(len(low), np.int64), 0
    for t in range(int(lengths.max(initial=0))):
        if lengths[begin] <= t:
            done = int(np.searchsorted(lengths, t, "right")) - begin
            begin += done
            place, at, pv, mv, score, x, ph, mh, eq, step = (v[done:] for v in (place, at, pv, mv, score, x, ph, mh, eq, step))
        np.add(place, symbols.take(at), out=step)
        masks.take(step, out=eq, mode="clip")
        at += 1
        np.bitwise_and(eq, pv, out=x)
        x += pv
        x ^= pv
        x |= eq
        np.bitwise_or(x, pv, out=ph)
        np.invert(ph, out=ph)
        ph |= mv
        np.bitwise_and(pv, x, out=mh)
        score -= np.right_shift(ph.view(np.int64), left, out=step)
        score += np.right_shift(mh.view(np.int64), left, out=step)
        np.minimum(best[begin:], score, out=best[begin:])
        np.left_shift(ph, one, out=ph)
        np.left_shift(mh, one, out=mh)
        eq |= mv
        np.bitwise_and(ph, eq, out=mv)
        np.bitwise_or(eq, ph, out=pv)
        np.invert(pv, out=pv)
        pv |= mh
    return best


def _padded(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([_symbols()[codes], np.zeros(64, np.uint8)])


def _edited(text: str, rate: float, rng: random.Random) -> str:
    """``text`` with a share of its characters replaced, left out or doubled by others."""
    out = list(text)
    for i in rng.sample(range(len(text)), int(rate * len(text))):
        kind = rng.random()
        out[i] = rng.choice(string.ascii_lowercase) if kind < 0.6 else "" if kind < 0.8 else out[i] + rng.choice(string.ascii_lowercase)
    return "".join(out)


def repeats_for(items: list[str], window: int, stride: int, rate: float, target: float, seed: int) -> int:
    """Walks with which ``target`` of a sample of items, edited at ``rate``, share a hash with themselves; 0 where ``MOST_REPEATS`` are too few."""
    rng = random.Random(seed)
    trial = [(x, _edited(x, rate, rng)) for x in rng.sample(items, min(len(items), TRIAL_ITEMS)) for _ in range(max(1, TRIAL_ITEMS // len(items)))]
    plain, other = ([_padded(normal_codes([x])[0]) for x in side] for side in zip(*trial))
    found = np.zeros(len(trial), np.bool_)
    walks = Walks(window, MOST_REPEATS, seed)
    for r in range(MOST_REPEATS):
        for i in np.flatnonzero(~found):
            own = walks.embed(plain[i], np.arange(max(1, len(plain[i]) - 64 - window)), r)
            found[i] = np.isin(walks.embed(other[i], np.arange(i % stride, max(i % stride + 1, len(other[i]) - 64 - window), stride), r), own).any()
        if found.mean() >= target:
            return r + 1
    return 0


@dataclass
class Block:
    """Items (different normalised texts, each with its ids) and what is needed to search for them.

    A block travels to the executors as texts and numbers; the hash tables are built there, once a worker.
    """

    items: list[tuple[str, list]]
    repeats: dict[tuple[int, int], int]
    max_error: float
    seed: int
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Tables:
    """The hash tables of a block: for each window size and walk the sorted hashes of all windows of all items."""

    held: tuple[str, Tables] | None = None

    @classmethod
    def of(cls, block: Block) -> Tables:
        if cls.held is None or cls.held[0] != block.key:
            cls.held = block.key, cls(block)
        return cls.held[1]

    def __init__(self, block: Block):
        self.block = block
        self.lengths = np.array([len(t) for t, _ in block.items])
        self.prepared = functools.lru_cache(maxsize=10_000)(lambda i: Item(block.items[i][0]))
        self.masks = functools.lru_cache(maxsize=10_000)(self._masks)
        self.sizes = []
        for (window, stride), repeats in block.repeats.items():
            own = [i for i, (t, _) in enumerate(block.items) if window_of(len(t)) == (window, stride)]
            if not repeats:
                self._exact_pieces(own)
                continue
            codes = [normal_codes([block.items[i][0]])[0][:-1] for i in own]
            begins = np.cumsum([0, *map(len, codes)])
            symbols = _padded(np.concatenate(codes))
            at = np.concatenate([np.arange(b, b + len(c) - window + 1) for b, c in zip(begins, codes)])
            part = np.searchsorted(begins, at, "right") - 1
            item, offset = np.array(own)[part], at - begins[part]
            walks, tables = Walks(window, repeats, block.seed), []
            for r in range(repeats):
                keys = walks.embed(symbols, at, r)
                order = np.argsort(keys, kind="stable")
                seen = np.zeros(1 << 20, np.bool_)
                seen[keys & np.uint64((1 << 20) - 1)] = True
                tables.append((seen, keys[order], item[order].astype(np.int32), offset[order].astype(np.int32)))
            self.sizes.append((walks, stride, tables))

    def _exact_pieces(self, own: list[int]) -> None:
        """Tables without chance, for items that the walks find too rarely: of d + 1 pieces of an item one has none of d edits."""
        pieces: dict[int, list[tuple[int, int]]] = {}
        for i in own:
            n = int(self.lengths[i])
            most = int(self.block.max_error * n)
            size = n // (most + 1)
            pieces.setdefault(size, []).extend((i, k * size) for k in range(most + 1))
        for size, at in sorted(pieces.items()):
            symbols = {i: _padded(normal_codes([self.block.items[i][0]])[0]) for i, _ in at}
            plain = Plain(size)
            keys = np.concatenate([plain.embed(symbols[i], np.array([o]), 0) for i, o in at])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, np.bool_)
            seen[keys & np.uint64((1 << 20) - 1)] = True
            item, offset = (np.array([a[k] for a in at], np.int32)[order] for k in (0, 1))
            self.sizes.append((plain, 1, [(seen, keys[order], item, offset)]))

    def near_enough(self, codes: np.ndarray, begins: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Which candidates can be within their item's distance at all. None that is gets lost.

        An item is cut into parts of at most 64 characters. Where the item is within its distance, one part is within its own share of it,
        near its place. All parts of all candidates are compared side by side, a character a step (bit-parallel, one word a part).
        """
        if not len(found):
            return np.zeros(0, np.bool_)
        n = self.lengths[found[:, 1]]
        most = (self.block.max_error * n).astype(np.int64)
        count = -(-n // 64)
        which = np.repeat(np.arange(len(found)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        first, stop = nth * n[which] // count[which], (nth + 1) * n[which] // count[which]
        size = stop - first
        begin, end = begins[found[which, 0]], begins[found[which, 0] + 1]
        place = begin + found[which, 2] * NEAR + first
        low, high = np.maximum(begin, place - most[which] - 1), np.minimum(end, place + NEAR + size + most[which] + 1)
        share = most[which] * size // n[which]
        part, own = np.unique(found[which, 1] << 24 | nth, return_inverse=True)
        masks = np.zeros((len(part), 256), np.uint64)
        for k, key in enumerate(part.tolist()):
            masks[k] = self.masks(key)
        symbols, ok = _padded(codes), np.zeros(len(found), np.bool_)
        order = np.argsort(high - low, kind="stable")
        for job in np.split(order, range(PARTS_AT_ONCE, len(order), PARTS_AT_ONCE)):
            ok[which[job[_least_distances(symbols, low[job], high[job], masks, own[job], size[job]) <= share[job]]]] = True
        return ok

    def _masks(self, key: int) -> np.ndarray:
        """For each symbol the places it has in a part of an item, which stands at the top of 64 bits; below it all fits."""
        item, nth = key >> 24, key & 0xFFFFFF
        n = int(self.lengths[item])
        count = -(-n // 64)
        codes = normal_codes([self.block.items[item][0]])[0][nth * n // count : (nth + 1) * n // count]
        free = 64 - len(codes)
        out = np.full(256, (1 << free) - 1, np.uint64)
        np.bitwise_or.at(out, _symbols()[codes], np.uint64(1) << np.arange(free, 64, dtype=np.uint64))
        return out

    def candidates(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Rows (text, item, start of the item in the text) in order, one for starts that are ``NEAR`` each other."""
        symbols, lens = _padded(codes), np.diff(begins)
        parts = [np.zeros((0, 3), np.int64)]
        for walks, stride, tables in self.sizes:
            per = -(-lens // stride)
            text = np.repeat(np.arange(len(lens)), per)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
            starts = begins[text] + nth * stride
            for r, (seen, keys, item, offset) in enumerate(tables):
                h = walks.embed(symbols, starts, r)
                hit = np.flatnonzero(seen[h & np.uint64((1 << 20) - 1)])
                low, high = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
                hit, low, many = hit[high > low], low[high > low], (high - low)[high > low]
                which = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                place = np.repeat(nth[hit] * stride, many) - offset[which]
                parts.append(np.unique(np.stack([np.repeat(text[hit], many), item[which], place // NEAR], axis=1), axis=0))
        return np.unique(np.concatenate(parts), axis=0)

    def leaks(self, texts: list[str | None]) -> dict[int, list[dict]]:
        """Number of a text -> the verified items in it, each at its best place."""
        codes, begins = normal_codes(texts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        found = self.candidates(codes, begins)
        for text, i, place in found[self.near_enough(codes, begins, found)].tolist():
            n = int(self.lengths[i])
            most = int(self.block.max_error * n)
            if best.get((text, i), (most + 1,))[0] == 0:
                continue
            begin, end = int(begins[text]), int(begins[text + 1]) - 1
            low = max(begin, begin + place * NEAR - most - 1)
            near = codes[low : max(low, min(end, begin + (place + 1) * NEAR + n + most + 1))].tobytes().decode("utf-32-le")
            d = self.prepared(i).distance(near)
            if d <= most and d < best.get((text, i), (most + 1,))[0]:
                exact = near.find(self.block.items[i][0])
                start = low + exact if exact >= 0 else max(begin, begin + place * NEAR)
                best[text, i] = d, int(np.count_nonzero(codes[begin:start] == BLANK))
        out: dict[int, list[dict]] = {}
        for (text, i), (d, word) in sorted(best.items()):
            out.setdefault(text, []).extend({"item_id": k, "distance": d, "similarity": 1 - d / int(self.lengths[i]), "word": word} for k in self.block.items[i][1])
        return out


def blocks_of(benchmark: DataFrame, max_error: float, target_recall: float, seed: int, item_id: str, item_text: str) -> Iterator[Block]:
    """The benchmark in blocks of ``BLOCK_BYTES``; texts that are equal when normalised are one item."""
    held: dict[str, list] = {}

    def block() -> Block:
        sizes: dict[tuple[int, int], list[str]] = {}
        for text in held:
            sizes.setdefault(window_of(len(text)), []).append(text)
        return Block(list(held.items()), {k: repeats_for(v, *k, max_error, target_recall, seed) for k, v in sorted(sizes.items())}, max_error, seed)

    rows, size = benchmark.select(F.col(item_id).alias("k"), F.col(item_text).cast("string").alias("t")).filter("t is not null"), 0
    for row in rows.toLocalIterator():
        if text := normal_text(row.t):
            size += 0 if text in held else len(text)
            held.setdefault(text, []).append(row.k)
        if size > BLOCK_BYTES:
            yield block()
            held, size = {}, 0
    if held:
        yield block()


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, max_error: float = 0.2, target_recall: float = 0.95, seed: int = 11, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` plus ``leaks``, an array of (item_id, distance, similarity, word).

    An item is in a document if some place of the normalised text (lower-case words, single
    blanks) is within an edit distance of ``max_error`` times the item's length, that is, a
    similarity of ``1 - max_error`` or more; ``word`` is the number of the word at or near which it
    starts. Each item is reported once a document, at its best place. All exact occurrences are
    found, and ``target_recall`` of those in which ``max_error`` of the characters are edited, more of closer ones; the
    distance is exact. Null, empty and word-less texts and items match nothing; no row is
    lost; repeated rows are judged one by one, repeated items all reported; a column named
    ``leaks`` is replaced. The benchmark is the query set: it is broadcast in blocks of
    ``BLOCK_BYTES``, one pass over the documents and one stored table for each.
    """
    docs = without(docs, ["leaks"])
    spark, id_type = docs.sparkSession, benchmark.schema[item_id].dataType
    kind = T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("distance", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("word", T.IntegerType())]))
    out = docs.withColumn("leaks", F.array().cast(kind))
    schema, at = out.schema, docs.columns.index(text_col)

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = Tables.of(shared.value)
            for batch in batches:
                texts, old = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1)
                leaks, low, size = old.to_pylist(), 0, 0
                for i, text in enumerate([*texts, None]):
                    if i == len(texts) or size + len(text or "") > STEP_CHARS:
                        for k, more in tables.leaks(texts[low:i]).items():
                            leaks[low + k] = [*(leaks[low + k] or []), *more]
                        low, size = i, 0
                    size += len(text or "")
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(leaks, old.type)], schema=batch.schema)

        return run

    first = True
    for block in blocks_of(benchmark, max_error, target_recall, seed, item_id, item_text):
        out = (out if first else stored(out, "leaks")).mapInArrow(scan(spark.sparkContext.broadcast(block)), schema)
        first = False
    return out
