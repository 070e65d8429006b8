"""Bloom filters: over the keys of documents, seen in one and seen in two or more; over a column of longs.

Every task folds the key hashes of its documents into a *once* and a *twice* filter; the
filters of all tasks are merged segment by segment (``twice |= once & other_once``), so no key
that two documents share can be missing from the merged *twice* filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter segment (8 KB); segments are the unit in which filters are merged.
SEGMENT_BITS = 1 << 16


def bits_for(keys: int, most: int) -> int:
    """About eight bits a key, a power of two, ``most`` at most."""
    return max(SEGMENT_BITS, min(most, 1 << (8 * keys).bit_length()))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions for each 64-bit hash; ``bits`` is a power of two."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask])


def _get(words: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (words[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _set(words: np.ndarray, pos: np.ndarray) -> None:
    np.bitwise_or.at(words, (pos >> np.uint64(3)).astype(np.int64), np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8))


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a filter; false answers are certain."""
    pos = _positions(hashes, len(words) * 8)
    return _get(words, pos[0]) & _get(words, pos[1])


def _fill(bits: int, keys_of: Callable[[pa.Array], Iterable[np.ndarray]]):
    """mapInArrow: texts of a task -> the non-empty segments of its two filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

        def put(hashes: np.ndarray) -> None:
            keys, n = np.unique(hashes, return_counts=True)
            pos = _positions(keys, bits)
            again = (_get(once, pos[0]) & _get(once, pos[1])) | (n > 1)
            _set(twice, pos[:, again].ravel())
            _set(once, pos.ravel())

        for batch in batches:
            held, size = [], 0
            for keys in keys_of(batch.column(0)):
                held.append(keys)
                size += len(held[-1])
                if size > 1 << 20:
                    put(np.concatenate(held))
                    held, size = [], 0
            if size:
                put(np.concatenate(held))
        step = SEGMENT_BITS // 8
        segs = [s for s in range(bits // SEGMENT_BITS) if once[s * step : (s + 1) * step].any()]
        packed = [[zlib.compress(w[s * step : (s + 1) * step].tobytes(), 1) for s in segs] for w in (once, twice)]
        yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], names=["seg", "once", "twice"])

    return run


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas over segments dealt by their number: a task holds its own segments only."""
    kept: dict[int, list[np.ndarray]] = {}
    for frame in frames:
        for seg, a, b in zip(frame["seg"], frame["once"], frame["twice"]):
            once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if seg in kept:
                kept[seg][1] |= twice | (kept[seg][0] & once)
                kept[seg][0] |= once
            else:
                kept[seg] = [once.copy(), twice.copy()]
    yield pd.DataFrame({"seg": pd.Series([*kept], dtype="int32"), "twice": [zlib.compress(x[1].tobytes(), 1) for x in kept.values()]})


def seen_twice(texts: DataFrame, keys_of: Callable[[pa.Array], Iterable[np.ndarray]], bits: int):
    """A broadcast of the merged *twice* filter (``bits`` / 8 bytes) of the one text column of ``texts``.

    ``keys_of`` gives arrays of key hashes for a column; a document's keys are different and in one array.
    """
    spark = texts.sparkSession
    parts = texts.mapInArrow(_fill(bits, keys_of), "seg int, once binary, twice binary")
    merged = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seg").mapInPandas(_merge, "seg int, twice binary")
    step = SEGMENT_BITS // 8
    twice = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        twice[row.seg * step : (row.seg + 1) * step] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return spark.sparkContext.broadcast(twice)


def filter_of(keys: Iterable[np.ndarray], bits: int) -> np.ndarray:
    """A filter of ``bits`` bits of all key hashes."""
    words = np.zeros(bits // 8, np.uint8)
    for k in keys:
        _set(words, _positions(k, bits).ravel())
    return words


def _bits_of(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def seen(keys: DataFrame, bits: int):
    """A broadcast filter of ``bits`` bits (a multiple of 65,536) of the one long column of ``keys``; what ``may_hold`` asks.

    The tasks' bitmaps are put together on the executors, the driver gets the filter alone.
    """
    at = keys.select(F.explode(F.array(*_bits_of(F.col(keys.columns[0]), bits))).alias("at")).select((F.col("at") + 1).alias("at"))  # buckets begin at 1
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("seg")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    words = np.zeros(bits // 8, np.uint8)
    for row in maps.toLocalIterator():
        words[(row.seg - 1) * len(row.map) : row.seg * len(row.map)] = np.frombuffer(row.map, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(words)


def may_hold(filter_, key: Column) -> Column:
    """Whether ``key`` may be in a filter of ``seen``; false answers are certain."""

    def ask(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.logical_and(*(_get(filter_.value, x.to_numpy().astype(np.uint64)) for x in (a, b))))

    return F.pandas_udf(ask, "boolean")(*_bits_of(key, len(filter_.value) * 8))
