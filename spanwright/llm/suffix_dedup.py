"""Suffix-array dedup by a distributed difference cover, to the depth that the match length asks for.

What is sorted are the suffixes that can be repeats. Fingerprints of all strings of the match length are
compared first, and starts whose string one document alone has are left out. What is left are
stretches of text; they are cut where a local hash minimum stands, which the bytes nearby decide, and
equal pieces enter the sort as one string that knows its smallest and its largest document.

The sort is a difference cover modulo 3 over those strings:

1. Sampled positions (1 and 2 modulo 3) have a triple of words. Triples are dealt by ranges, sorted, and named in order.
2. Names recurse: three names in a row make a triple of their own, sorted and named again, until a name stands
   for the match length but for the bytes that a shift needs. Then names are ranks of sampled suffixes.
3. The remaining suffixes are merged in: those that start at 0 modulo 3 are sorted by their first byte and the rank
   behind it, and their place among the sampled ones follows from comparing one byte and the next rank,
   or two bytes and the rank after them.
4. Adjacent prefixes of the merged order are compared; neighbours that agree on the match length are one class,
   whose smallest document keeps the string.

All but the first step ships positions and ranks; arrays travel packed, a blob for each source chunk and
target range. Range limits come from a bounded sample and decide nothing but balance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.llm.common import dropped, without
from spanwright.llm.common import stored as stored_as
from spanwright.llm.twice_filter import bits_for, contains, filter_of, may_hold, seen

#: Half the least distance of two cuts, level by level.
CUTS = (64, 32)
#: Bytes of a word that the cuts of a text are hashed from.
CUT_WORD = 12
#: A list of copies or of removed stretches up to so many bytes is broadcast to the texts; to a larger one go the texts that a filter
#: of so many bits at most says it may have.
MAX_BROADCAST, OWNER_BITS = 32 << 20, 1 << 27
#: Bytes of rows that a task works on at a time, and that it hashes at a time (a number for each byte, to be had in the cache); a longer row
#: is one piece of work.
CHUNK, HASHED = 1 << 20, 1 << 16
#: Suffixes of one range of the sort; pieces that range limits are drawn from (one for each range at least), and bytes of each.
RANGE_ROWS, SAMPLE_PIECES, SAMPLE_BYTES = 1 << 19, 4000, 2048
#: Bits that a name has within its range.
NAME_BITS = 40
#: Bits of a fingerprint, and fingerprints that a task holds before it hands them on.
MARK_BITS, HELD_MARKS = 40, 1 << 22


#: Spark deletes the exchange files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Stored with the codec that keeps pieces of text smallest. The exchange files of a written round go at once: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stored_as(df, name, "zstd")
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` bytes (4 at least): its words, the last two overlapping, mixed and each times an odd number of its place."""
    n, size = len(data) - width + 1, 8 if width >= 8 else 4
    if n <= 0:
        return np.array([], np.uint64)
    words = np.ndarray(len(data) - size + 1, f"<u{size}", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    words *= np.uint64(0xBF58476D1CE4E5B9)
    words ^= words >> np.uint64(32)
    out, term = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for k, at in enumerate([*range(0, width - size, size), width - size]):
        np.multiply(words[at : at + n], np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)), out=term)
        out += term
    return out


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of ``width`` values."""
    n, size = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= width:
        x, size = np.minimum(x[: len(x) - size], x[size:]), size * 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def _marks(data: np.ndarray, length: int, sparse: bool) -> np.ndarray:
    """A fingerprint for each start of a string of ``length`` bytes, decided by the string alone: of its hash or, if
    ``sparse``, of the least hash of the words of three quarters of its length in it, which neighbours often share."""
    if len(data) < length:
        return np.array([], np.uint64)
    if not sparse:
        return _hashes(data, length) >> np.uint64(64 - MARK_BITS)
    word = length * 3 // 4
    with np.errstate(over="ignore"):
        least = _lowest(_hashes(data, word), length - word + 1) * np.uint64(0xD6E8FEB86659FD93)
    return (least ^ (least >> np.uint64(32))) >> np.uint64(64 - MARK_BITS)


def _chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of its first row, bytes, offsets) of runs of rows of about ``size`` bytes, so that array work spans many short rows."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if offs[-1] == offs[0]:
        return
    data, lo = np.frombuffer(column.buffers()[2], np.uint8), 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _inside(offs: np.ndarray, length: int) -> np.ndarray:
    """For each byte that ``length`` bytes begin at, whether they end in its row."""
    size = np.diff(offs)
    good = np.maximum(size - length + 1, 0)
    return np.repeat(np.tile([True, False], len(size)), np.stack([good, size - good], 1).ravel())[: max(0, int(offs[-1]) - length + 1)]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """For each row, whether it is the first or differs from the one before."""
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))[: len(columns[0])]


def _marks_by_row(column: pa.Array, length: int, sparse: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints of a run of rows, the row of each); neighbours that are equal are one."""
    for lo, data, offs in _chunks(column, HASHED):
        marks = _marks(data, length, sparse)
        if len(marks):
            row = np.repeat(np.arange(lo, lo + len(offs) - 1), np.diff(offs))[: len(marks)]
            new = np.flatnonzero(_changes(marks, row) & _inside(offs, length))
            yield marks[new], row[new]


def pack(values: np.ndarray) -> bytes:
    """Integers byte by byte, lowest bytes first, compressed: bytes that hardly change take no room."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(blobs: pa.ChunkedArray, counts: np.ndarray, kind: str) -> np.ndarray:
    """The integers of all ``blobs``, ``counts`` in each, one after the other."""
    width = np.dtype(kind).itemsize
    out = []
    for blob, n in zip(blobs, counts.tolist()):
        raw = np.frombuffer(pa.decompress(blob.as_buffer(), n * width, codec="zstd"), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel())
    return np.concatenate(out) if out else np.zeros(0, kind)


class Packed:
    """Columns of integers that travel as blobs: a row (part, n, a blob a column) for each source and target part."""

    def __init__(self, **kinds: str):
        self.kinds = kinds
        self.schema = "part int, n int, " + ", ".join(f"{c} binary" for c in kinds)

    def rows(self, part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        """One row for each value of ``part``; within it the order stays."""
        few = part.min(initial=0) >= 0 and part.max(initial=0) < 1 << 16
        order = np.argsort(part.astype(np.uint16) if few else part, kind="stable")  # 16 bits are sorted by radix
        starts = np.flatnonzero(_changes(part[order]))
        parts, ends = part[order[starts]], np.append(starts[1:], len(order))
        blobs = [[pack(c[order[a:b]].astype(k, copy=False)) for a, b in zip(starts, ends)] for c, k in zip(columns, self.kinds.values())]
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array((ends - starts).astype(np.int32)), *(pa.array(b, pa.binary()) for b in blobs)], names=["part", "n", *self.kinds])

    def columns(self, table: pa.Table) -> list[np.ndarray]:
        n = table.column("n").to_numpy()
        return [unpack(table.column(c), n, k) for c, k in self.kinds.items()]


MARKS = Packed(mark="<u8", again="|u1")
NAMES = Packed(number="<i8", pos="<i4", name="<u8")
NAMED = Packed(number="<i8", pos="<i4", n0="<u8", n1="<u8", n2="<u8")
SUFFIXES = Packed(number="<i8", pos="<i4", kind="|u1", head="<u2", tail="<u4", ra="<u8", rb="<u8", first="<i8", more="<i8")
CLASSES = Packed(number="<i8", pos="<i4", least="<i8")


def _repeated_marks(pieces: DataFrame, length: int, sparse: bool, max_filter_bits: int):
    """A broadcast filter of the fingerprints that two rows of ``pieces`` have.

    Every task hands on its different fingerprints, sorted and as differences; a range of them meets in one
    place. Missing none is certain; fingerprints that only look repeated cost work, not results.
    """
    spark = pieces.sparkSession
    n_bytes = pieces.select(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = min(10, max(2, int(n_bytes // (1 << 24)).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_before, size = [], 0, 0

        def flush() -> pa.RecordBatch:
            marks, row = (np.concatenate(x) for x in zip(*held))
            row = np.cumsum(_changes(row)).astype(np.uint64)  # there are fewer rows than fingerprints held, so both fit one number
            both = np.sort(marks << np.uint64(64 - MARK_BITS) | row)
            marks = both >> np.uint64(64 - MARK_BITS)
            begins = np.flatnonzero(_changes(marks))
            again = both[begins] != both[np.append(begins[1:], len(both)) - 1]
            marks = marks[begins]
            part = (marks >> np.uint64(MARK_BITS - bits)).astype(np.int32)
            step = np.diff(marks, prepend=np.uint64(0))
            firsts = np.flatnonzero(np.diff(part, prepend=-1))
            step[firsts] = marks[firsts]
            return MARKS.rows(part, step, again.astype(np.uint8))

        for batch in batches:
            for marks, row in _marks_by_row(batch.column(0), length, sparse):
                if len(marks):
                    held.append((marks, row + rows_before))
                    size += len(marks)
                if size > HELD_MARKS:
                    yield flush()
                    held, size = [], 0
            rows_before += len(batch)
        if size:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        step, again = MARKS.columns(table)
        n = table.column("n").to_numpy()
        begins = np.concatenate([[0], np.cumsum(n)[:-1]])
        total = np.cumsum(step, dtype=np.uint64)
        marks = total - np.repeat(total[begins] - step[begins], n)
        both = np.sort(marks << np.uint64(1) | again)
        marks = both >> np.uint64(1)
        marks = marks[(both & np.uint64(1) > 0) | np.append(~_changes(marks)[1:], False)]
        return pa.table({"marks": pa.array([marks[_changes(marks)].tobytes()], pa.binary())})

    found = pieces.select("data").mapInArrow(fill, MARKS.schema).groupBy("part").applyInArrow(meet, "marks binary")
    found = stored(found, "marks")
    total = found.select(F.sum(F.octet_length("marks"))).first()[0] or 0
    words = filter_of((_mixed(np.frombuffer(r.marks, np.uint64)) for r in found.toLocalIterator()), bits_for(2 * (total // 8), max_filter_bits))
    dropped(found)
    return spark.sparkContext.broadcast(words)


def _mixed(marks: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = marks * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _suspects(data: np.ndarray, inside: np.ndarray, length: int, sparse: bool, words: np.ndarray) -> np.ndarray:
    """For each start, whether another row may have its string."""
    marks = _marks(data, length, sparse)
    if not inside.any():
        return inside
    new = np.flatnonzero(_changes(marks))
    return np.repeat(contains(words, _mixed(marks[new])), np.diff(np.append(new, len(marks)))) & inside


def _row_of(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, at, "right") - 1


def _cuts(data: np.ndarray, offs: np.ndarray, reach: int) -> np.ndarray:
    """Positions whose hash is below those of ``reach`` positions before and not above those of as many behind, all in one row."""
    x = _hashes(data, CUT_WORD)
    if len(x) < 2 * reach + 1:
        return np.array([], np.int64)
    low, own = _lowest(x, reach), x[reach : len(x) - reach]
    at = np.flatnonzero((own < low[: len(own)]) & (own <= low[reach + 1 : reach + 1 + len(own)])) + reach
    row = _row_of(offs, at)
    return at[(at - reach >= offs[row]) & (at + reach + CUT_WORD <= offs[row + 1])]


def _split(length: int, reach: int, sparse: bool, shared):
    """mapInArrow: (owner, first, last, data) -> pieces (owner, first, last, start, n starts, digest, data) of the starts that can be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch in batches:
            several = batch.column(1).to_numpy() < batch.column(2).to_numpy()
            for lo, data, offs in _chunks(batch.column(3), HASHED):
                inside, own = _inside(offs, length), several[lo : lo + len(offs) - 1]
                ok = _suspects(data, inside, length, sparse, shared.value)
                if own.any():
                    ok = ok | (inside & np.repeat(own, np.diff(offs))[: len(inside)])
                if not ok.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
                cuts = _cuts(data, offs, reach)
                cuts = cuts[cuts < len(ok)]
                starts = np.union1d(edge[::2], cuts[ok[cuts]])
                ends = np.minimum(np.append(starts[1:], len(data)), edge[1::2][np.searchsorted(edge[1::2], starts, "right")])
                raw, own = data.tobytes(), _row_of(offs, starts)
                pieces = [raw[a:b] for a, b in zip(starts.tolist(), (ends + length - 1).tolist())]
                keys = [hashlib.md5(x).digest() for x in pieces]
                from_ = pa.array(own + lo)
                places = (pa.array(x.astype(np.int32)) for x in (starts - offs[own], ends - starts))
                columns = [*(batch.column(i).take(from_) for i in range(3)), *places, pa.array(keys, pa.binary()), pa.array(pieces, pa.binary())]
                made.append(pa.RecordBatch.from_arrays(columns, names=["owner", "first", "last", "start", "n", "key", "data"]))
                size += len(data)
                if size >= CHUNK:
                    yield pa.concat_batches(made)
                    made, size = [], 0
        if made:
            yield pa.concat_batches(made)

    return run


class Cover:
    """Widths of the sort for a match length: a word, a triple of them, and the names that recursion puts side by side."""

    def __init__(self, length: int):
        self.length, self.word = length, min(8, (length - 2) // 3)
        self.triple = self.reach = 3 * self.word
        self.rounds: list[tuple[int, int]] = []  # distances of the second and the third name; multiples of 3 stay in the cover
        while (more := min(2 * self.reach, (length - 2 - self.reach) // 3 * 3)) > 0:
            self.rounds.append((min(self.reach, more), more))
            self.reach += more
        self.tail = length - self.reach  # bytes that complete the match behind a ranked prefix


def _prefixes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)
    return np.ascontiguousarray(view[at]).view(f"S{width}").ravel()


def _words(strings: np.ndarray) -> np.ndarray:
    """Strings of one width as rows of numbers of eight bytes, in the same order."""
    width = strings.dtype.itemsize
    wide = np.zeros((len(strings), -(-width // 8) * 8), np.uint8)
    wide[:, :width] = strings.view(np.uint8).reshape(len(strings), width)
    return np.ascontiguousarray(wide.view(">u8").T).astype(np.uint64)


def _ordered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the first key, then the next, whether each row of it differs from the one before). One number is sorted at a time,
    of rows that are still equal: that is faster than strings or all columns."""
    order = np.argsort(keys[0])
    begins = _changes(keys[0][order])
    for key in keys[1:]:
        tied = np.flatnonzero(~(begins & np.append(begins[1:], True)[: len(begins)]))
        group, rows = np.cumsum(begins)[tied], order[tied]
        by_key = np.argsort(key[rows])
        both = group[by_key] << 32 | np.cumsum(_changes(key[rows[by_key]]))
        then = np.argsort(both)
        order[tied], begins[tied] = rows[by_key[then]], _changes(both[then])
    return order, begins


def _positions(offs: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, position in its row) of every byte that ``width`` bytes of its row begin at."""
    at = np.arange(len(row))
    at = at[at + width <= offs[1:][row]]
    return at, at - offs[row[at]]


def _limits(pieces: DataFrame, ranges: int, cover: Cover) -> np.ndarray:
    """Triples that cut the order into ``ranges`` of about one size, from slices of a sample of pieces: it has a few kilobytes for each range."""
    at = F.pmod(F.xxhash64(F.col("number") + 1), F.greatest(F.lit(1), F.octet_length("data") - SAMPLE_BYTES)).cast("int") + 1
    sample = pieces.orderBy(F.xxhash64("number")).limit(max(SAMPLE_PIECES, ranges)).select(F.substring("data", at, F.lit(SAMPLE_BYTES)).alias("data")).collect()
    some = [_prefixes(np.frombuffer(r.data, np.uint8), np.arange(0, max(1, len(r.data) - cover.triple), 3), cover.triple) for r in sample]
    some = np.sort(np.concatenate(some)) if some else np.zeros(0, f"S{cover.triple}")
    return np.unique(some[np.linspace(0, len(some) - 1, ranges + 1).astype(int)[1:-1]]) if len(some) else some


def _triples(cover: Cover, limits: np.ndarray, kinds: Packed):
    """mapInArrow: (number, data) -> the triples of sampled positions, dealt by ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for lo, data, offs in _chunks(batch.column(1)):
                row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                at, pos = _positions(offs, row, cover.triple)
                at, pos = at[pos % 3 > 0], pos[pos % 3 > 0]
                triple = _prefixes(data, at, cover.triple)
                order = _ordered(*_words(triple), at)[0]
                at, pos, triple = at[order], pos[order], triple[order]
                yield kinds.rows(np.searchsorted(limits, triple, "right"), numbers[row[at] + lo], pos, triple)

    return run


def _in_order(part: int, begins: np.ndarray) -> np.ndarray:
    """Names along an order in which ``begins`` marks rows that differ from the one before: the range, then a running number."""
    return (np.uint64(part) << np.uint64(NAME_BITS)) + np.cumsum(begins).astype(np.uint64)


def _bucket(number: np.ndarray, buckets: int) -> np.ndarray:
    return (number % buckets).astype(np.int32)


def _by_place(number: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The order by number and position, no two of which are the same. Numbers are a task's and its row's
    (``monotonically_increasing_id``); without the bits between, they and the position are one number, unless that is too long."""
    row = number & ((1 << 33) - 1)
    bits, low = (int(x.max(initial=0)).bit_length() for x in (pos, row))
    if bits + low + (int(number.max(initial=0)) >> 33).bit_length() > 63:
        return np.lexsort((pos, number))
    return np.argsort(((number >> 33 << low) | row) << bits | pos)


def _by_position(number: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by number and position, keys in that order): a key plus a distance is the key of the position behind."""
    order = _by_place(number, pos)
    return order, (np.cumsum(_changes(number[order])).astype(np.int64) << 32) + pos[order]


def _name_triples(ranges: int, kinds: Packed):
    def run(table: pa.Table) -> pa.Table:
        number, pos, triple = kinds.columns(table)
        order, begins = _ordered(*_words(triple))
        name = _in_order(table.column("part")[0].as_py(), begins)
        number, pos = number[order], pos[order]
        back = _by_position(number, pos)[0]
        return pa.Table.from_batches([NAMES.rows(_bucket(number[back], ranges), number[back], pos[back], name[back])])

    return run


def _triples_of_names(distances: tuple[int, int]):
    """Names of one bucket of pieces -> three names side by side, dealt by the range of the first."""

    def run(table: pa.Table) -> pa.Table:
        number, pos, name = NAMES.columns(table)
        order, key = _by_position(number, pos)
        number, pos, name = number[order], pos[order], name[order]
        behind = [np.arange(len(key)) + 2 * d // 3 for d in distances]  # positions 1 and 2 modulo 3 of a piece are there without gaps
        ok = np.logical_and.reduce([(b < len(key)) & (key[np.minimum(b, len(key) - 1)] == key + d) for b, d in zip(behind, distances)])
        n0, (n1, n2) = name[ok], (name[b[ok]] for b in behind)
        n2 = n2 if distances[0] != distances[1] else np.zeros_like(n2)
        return pa.Table.from_batches([NAMED.rows((n0 >> np.uint64(NAME_BITS)).astype(np.int32), number[ok], pos[ok], n0, n1, n2)])

    return run


def _name_names(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        number, pos, n0, n1, n2 = NAMED.columns(table)
        order, begins = _ordered(n0, n1, n2)
        name, number, pos = _in_order(table.column("part")[0].as_py(), begins), number[order], pos[order]
        back = _by_position(number, pos)[0]
        return pa.Table.from_batches([NAMES.rows(_bucket(number[back], ranges), number[back], pos[back], name[back])])

    return run


def _suffixes(cover: Cover, limits: np.ndarray):
    """Pieces and ranks of a bucket -> every start with what places it in the order, dealt by the ranges of triples."""

    def run(ranks: pa.Table, pieces: pa.Table) -> pa.Table:
        number, pos, rank = NAMES.columns(ranks)
        order, out = _by_place(number, pos), []
        number, pos, rank = number[order], pos[order], rank[order]
        pieces = pieces.sort_by("number").combine_chunks()
        for lo, data, offs in _chunks(pieces.column("data").combine_chunks() if isinstance(pieces.column("data"), pa.ChunkedArray) else pieces.column("data")):
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            own, first, last = (pieces.column(c).to_numpy()[lo : lo + len(offs) - 1] for c in ("number", "first", "last"))
            part = slice(*np.searchsorted(number, [own[0], own[-1] + 1]))
            held = np.zeros(len(data) + 4, np.uint64)
            held[offs[np.searchsorted(own, number[part])] + pos[part]] = rank[part]
            at, p = _positions(offs, row, cover.length)
            kind = (p % 3).astype(np.uint8)
            ra = np.where(kind == 0, held[at + 1], held[at])
            rb = np.where(kind == 1, held[at + 1], held[at + 2])
            wide = np.concatenate([data, np.zeros(8, np.uint8)])
            head = wide[at].astype(np.uint16) << 8 | wide[at + 1]
            tail = np.zeros(len(at), np.uint32)
            for k in range(cover.tail):
                tail = tail << np.uint32(8) | wide[at + cover.reach + k]
            range_ = (ra >> np.uint64(NAME_BITS)).astype(np.int32)
            zero = np.flatnonzero(kind == 0)
            range_[zero] = np.searchsorted(limits, _prefixes(data, at[zero], cover.triple), "right")
            out.append(SUFFIXES.rows(range_, own[row[at]], p, kind, head, tail, ra, rb, first[row[at]], (last - first)[row[at]]))
        return pa.Table.from_batches(out, schema=SUFFIXES.rows(*[np.zeros(0, np.int64)] * 10).schema)

    return run


def _in_32_bits(ra: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks as numbers of 32 bits in the same order: range and running number side by side, or renumbered where these are too long."""
    low = np.uint64((1 << NAME_BITS) - 1)
    bits = int(max((x & low).max(initial=0) for x in (ra, rb))).bit_length()
    if bits + int(max((x >> np.uint64(NAME_BITS)).max(initial=0) for x in (ra, rb))).bit_length() <= 32:
        return tuple((x >> np.uint64(NAME_BITS) << np.uint64(bits)) | (x & low) for x in (ra, rb))
    ranks = np.unique(np.concatenate([ra, rb]))
    return tuple(np.searchsorted(ranks, x).astype(np.uint64) for x in (ra, rb))


def merged_order(cover: Cover, kind: np.ndarray, head: np.ndarray, tail: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes by their first ``length`` bytes, whether each agrees with the one before on all of them).

    Sampled suffixes (``kind`` 1 and 2) are in order by their rank and what completes it. The others are sorted by one
    byte and the next rank, and merged: against kind 1 by that, against kind 2 by two bytes and the rank after them.
    """
    tail = tail.astype(np.uint64)
    sampled, zero, one, two = kind > 0, kind == 0, kind == 1, kind == 2
    a, b = _in_32_bits(ra, rb)
    cut = lambda d: tail & np.uint64((1 << 8 * (cover.tail - d)) - 1)
    own = a << np.uint64(32) | tail
    by_one = head.astype(np.uint64) >> np.uint64(8) << np.uint64(56) | np.where(one, b, a) << np.uint64(24) | cut(1)
    by_two = head.astype(np.uint64) << np.uint64(48) | b << np.uint64(16) | cut(2)
    first = np.flatnonzero(sampled)[np.argsort(own[sampled])]
    rest = np.flatnonzero(zero)[np.argsort(by_one[zero])]
    before = np.searchsorted(by_one[first[one[first]]], by_one[rest]) + np.searchsorted(by_two[first[two[first]]], by_two[rest])
    order = np.empty(len(kind), np.int64)
    at = np.arange(len(rest)) + before
    free = np.ones(len(kind), np.bool_)
    free[at] = False
    order[at], order[free] = rest, first
    x, y = order[:-1], order[1:]
    same = np.where(sampled[x] & sampled[y], own[x] == own[y], np.where(two[x] | two[y], by_two[x] == by_two[y], by_one[x] == by_one[y]))
    return order, np.append(False, same)[: len(order)]


def _classes(cover: Cover, ranges: int):
    """Suffixes of a range -> (number, pos, smallest document of its class), where the class has a larger one too."""

    def run(table: pa.Table) -> pa.Table:
        number, pos, kind, head, tail, ra, rb, first, more = SUFFIXES.columns(table)
        order, same = merged_order(cover, kind, head, tail, ra, rb)
        begins = np.flatnonzero(~same)
        least, most = np.minimum.reduceat(first[order], begins), np.maximum.reduceat((first + more)[order], begins)
        at, which = order, np.cumsum(~same) - 1
        keep = least[which] < most[which]
        number, pos, least = number[at[keep]], pos[at[keep]], least[which[keep]]
        back = _by_position(number, pos)[0]
        return pa.Table.from_batches([CLASSES.rows(_bucket(number[back], ranges), number[back], pos[back], least[back])])

    return run


RUNS, SPANS = "array<struct<a:int,b:int,least:long>>", "array<struct<a:int,b:int>>"


def _runs(table: pa.Table) -> pa.Table:
    """(number, runs): stretches of starts of a piece with one smallest document."""
    number, pos, least = CLASSES.columns(table)
    order = _by_place(number, pos)
    number, pos, least = number[order], pos[order], least[order]
    begins = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (pos[1:] != pos[:-1] + 1) | (least[1:] != least[:-1]))[: len(pos)])
    ends = np.append(begins[1:], len(pos))
    runs = pa.StructArray.from_arrays([pa.array(pos[begins]), pa.array(pos[ends - 1] + np.int32(1)), pa.array(least[begins])], names=["a", "b", "least"])
    of, at = np.unique(number[begins], return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(begins)).astype(np.int32)), runs)
    return pa.table({"number": pa.array(of), "runs": lists})


def _by_cover(pieces: DataFrame, length: int) -> DataFrame:
    """(number, runs) of ``pieces`` (number, first, last, data) by the difference cover; see the module's text."""
    cover = Cover(length)
    n = pieces.select(F.sum(F.octet_length("data") - length + 1)).first()[0] or 0
    ranges = int(max(4, n // RANGE_ROWS))
    limits = pieces.sparkSession.sparkContext.broadcast(_limits(pieces, ranges, cover)).value
    kinds = Packed(number="<i8", pos="<i4", triple=f"S{cover.triple}")
    dealt = pieces.select("number", "data").mapInArrow(_triples(cover, limits, kinds), kinds.schema)
    # a round is written before the next begins, so that the exchanges of only one are on disk
    names = stored(dealt.groupBy("part").applyInArrow(_name_triples(ranges, kinds), NAMES.schema), "names")
    for distances in cover.rounds:
        beside = names.groupBy("part").applyInArrow(_triples_of_names(distances), NAMED.schema)
        longer = stored(beside.groupBy("part").applyInArrow(_name_names(ranges), NAMES.schema), "names")
        dropped(names)
        names = longer
    dealt = pieces.select((F.col("number") % ranges).cast("int").alias("part"), "number", "first", "last", "data")
    suffixes = names.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(_suffixes(cover, limits), SUFFIXES.schema)
    classes = suffixes.groupBy("part").applyInArrow(_classes(cover, ranges), CLASSES.schema)
    return classes.groupBy("part").applyInArrow(_runs, f"number long, runs {RUNS}")


def repeated_runs(pieces: DataFrame, length: int, *, cuts: tuple[int, ...] = CUTS, sparse: bool = True, max_filter_bits: int = 1 << 29, spent: bool = False) -> DataFrame:
    """(owner, runs) of ``pieces`` (owner, first, last, data), strings that the documents ``first`` to ``last`` have:
    stretches [a, b) of byte positions at which a string of ``length`` bytes starts that documents of several
    ids have, with the ``least`` of those ids. Documents of larger ids lose them.

    ``owner`` tells rows apart. ``cuts`` are the levels at which strings that can be repeats are cut out and equal
    ones become one; with none the sort has all suffixes, and the result is the same. ``spent`` pieces are stored
    ones that nothing else reads: their files go as soon as they are cut.
    """
    if length < 8:
        raise ValueError("length is 8 at least")
    if not cuts:
        numbered = pieces if isinstance(pieces.schema["owner"].dataType, T.LongType) else stored(pieces.withColumn("number", F.monotonically_increasing_id()), "cover-pieces")
        if numbered is pieces:
            return stored(_by_cover(pieces.withColumnRenamed("owner", "number"), length), "cover-runs").withColumnRenamed("number", "owner")
        found = stored(_by_cover(numbered.select("number", "first", "last", "data"), length), "cover-runs")
        return numbered.select("owner", "number", "last").join(found, "number").select("owner", F.filter("runs", lambda r: r["least"] < F.col("last")).alias("runs"))
    shared = _repeated_marks(pieces, length, sparse, max_filter_bits)
    fields = [("owner", pieces.schema["owner"].dataType), ("first", T.LongType()), ("last", T.LongType()), ("start", T.IntegerType()), ("n", T.IntegerType()), ("key", T.BinaryType()), ("data", T.BinaryType())]
    parts = stored(pieces.select("owner", "first", "last", "data").mapInArrow(_split(length, cuts[0], sparse, shared), T.StructType([T.StructField(*f) for f in fields])), f"pieces-{cuts[0]}")
    shared.destroy()  # the executors keep it as files
    if spent:
        dropped(pieces)
    groups = parts.groupBy("key", "data").agg(F.min("first").alias("first"), F.max("last").alias("last")).sortWithinPartitions("first")  # what is in order packs better
    groups = stored(groups.withColumn("owner", F.monotonically_increasing_id()), f"groups-{cuts[0]}")
    places, keys = stored(parts.drop("data"), f"places-{cuts[0]}"), groups.select("owner", "key")
    dropped(parts)
    if len(cuts) > 1:  # else the sort reads the groups to its end
        keys = stored(keys, f"keys-{cuts[0]}")
    inner = repeated_runs(groups.select("owner", "first", "last", "data"), length, cuts=cuts[1:], sparse=False, max_filter_bits=max_filter_bits, spent=True)
    known = stored(keys.join(inner, "owner").drop("owner"), f"repeated-{cuts[0]}")
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b"), r["least"].alias("least")))
    found = places.join(known, "key").select("owner", F.filter(moved, lambda r: r["least"] < F.col("last")).alias("runs"))
    result = stored(found.filter(F.size("runs") > 0).groupBy("owner").agg(F.flatten(F.collect_list("runs")).alias("runs")), f"runs-{cuts[0]}")
    dropped(places, keys, groups, inner, known)
    return result


def _brought(rows: DataFrame, found: DataFrame, n_bytes: int) -> DataFrame:
    """The left join of ``rows`` with ``found``, of ``n_bytes``, by ``owner``. Rows that are not in it stay where they are."""
    if n_bytes <= MAX_BROADCAST:
        return rows.join(F.broadcast(found), "owner", "left")
    key = F.xxhash64("owner")
    marked = rows.withColumn("asked", F.col("owner").isNotNull() & may_hold(seen(found.select(key.alias("key")), bits_for(found.count(), OWNER_BITS)), key))
    return marked.filter(~F.col("asked")).drop("asked").unionByName(marked.filter("asked").drop("asked").join(found, "owner", "left"), allowMissingColumns=True)


def _spans(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Beginnings and ends of the union of the stretches [a, b); those that touch are one."""
    begins, ends = [], []
    for x, y in sorted(zip(a, b)):
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            begins.append(x)
            ends.append(y)
    return begins, ends


def drop_repeats(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text", cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """``docs`` plus ``kept`` (bytes), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Removed is every byte covered by a string of ``length`` bytes that also starts in a document
    of smaller id; strings are judged on the input and never cross documents. ``kept`` is what
    stays (a cut may fall inside a character). Null texts are empty; rows without an id
    neither lose nor cause anything; rows that share an id do not remove each other. Ids are whole
    numbers. Columns named as the new ones are replaced.
    """
    docs = without(docs, ["kept", "n_bytes", "n_removed", "n_spans"])
    text, id_ = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    long = id_.isNotNull() & (F.octet_length(text) >= length)
    owner = F.unhex(F.md5(text))
    # whole copies lose everything to the document of smallest id, which alone goes on
    whole = docs.filter(long).select(owner.alias("owner"), id_.alias("id")).groupBy("owner").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    copies = stored(whole.filter("n > 1").drop("n"), "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), id_.alias("id"), F.when(long, owner).alias("owner"))
    keyed = _brought(rows, copies, 64 * copies.count())
    alone = F.col("owner").isNotNull() & (F.col("least").isNull() | (F.col("id") == F.col("least")))
    texts = keyed.filter(alone).select("owner", F.col("id").alias("first"), F.col("id").alias("last"), F.col("text").cast("binary").alias("data"))
    found = repeated_runs(texts, length, cuts=cuts)
    spans = F.transform("runs", lambda r: F.struct(r["a"], r["b"]))
    runs = stored(found.groupBy("owner").agg(F.flatten(F.collect_list(spans)).cast(SPANS).alias("runs")), "removed-runs")
    dropped(found)
    n_bytes = runs.select(F.sum(F.lit(48) + 8 * F.size("runs"))).first()[0] or 0
    all_ = F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("text") - length + 1).alias("b")))
    left = keyed.select("owner", "row", F.when(F.col("id") > F.col("least"), all_.cast(SPANS)).alias("whole"))
    joined = _brought(left, runs, n_bytes).select("row", F.coalesce("whole", "runs").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            out: list[tuple] = []
            for text, own in zip(row.field(text_col), batch.column(1)):
                data, begins, ends = (text.as_py() or "").encode("utf-8"), [], []
                if own.is_valid:
                    begins, ends = _spans(own.values.field("a").to_numpy().tolist(), (own.values.field("b").to_numpy() + length - 1).tolist())
                kept = b"".join(data[x:y] for x, y in zip([0, *ends], [*begins, len(data)]))
                out.append((kept, len(data), sum(ends) - sum(begins), len(begins)))
            made = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(row.field(i) for i in range(row.type.num_fields)), *made], names=[*(f.name for f in row.type), "kept", "n_bytes", "n_removed", "n_spans"])

    extra = [T.StructField("kept", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans"))]
    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, *extra]))
