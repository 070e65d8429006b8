"""Line dedup: two Bloom filters pick suspects, an exact count confirms them.

Every task folds the line keys of its documents into a *once* and a *twice* filter:
a key that may already be in *once* goes into *twice*. The filters of all tasks are
merged segment by segment (``twice |= once & other_once``), so no key that two
documents share can be missing from the merged *twice* filter. Only keys found there
(true repeats and a few false positives) are shuffled, as 16-byte digests, for an
exact document count and the choice of the first occurrence.

The filters have a fixed upper size. Beyond it more keys become suspects, up to a plain
group-by over digests; results never change, because suspects are always counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.llm.common import stored, without
from spanwright.llm.twice_filter import bits_for, contains, seen_twice

BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """A line without the ASCII blanks at both ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _doc_keys(text: str | None, min_chars: int) -> set[bytes]:
    keys = {line_key(x) for x in (text or "").encode("utf-8").split(b"\n")}
    return {k for k in keys if _chars(k) >= min_chars}


def repeated_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 27) -> DataFrame:
    """(id, key, first_id): the lines of each document whose key is in ``min_docs`` documents or more.

    ``key`` is the 16-byte digest of the line key, ``first_id`` the smallest id that has it.
    """
    if min_docs < 2:
        raise ValueError("min_docs is 2 at least; a line of one document is no repeat")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = texts.select(F.sum(F.coalesce(newlines, F.lit(0)) + 1)).first()[0] or 0
    hashes = lambda column: (np.array([xxhash.xxh64_intdigest(k) for k in _doc_keys(text.as_py(), min_chars)], np.uint64) for text in column)
    shared = seen_twice(texts, hashes, bits_for(lines, max_filter_bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in enumerate(batch.column(1)):
                own = list(_doc_keys(text.as_py(), min_chars))
                keys += own
                ids += [i] * len(own)
            hit = np.flatnonzero(contains(shared.value, np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)))
            digests = [xxhash.xxh3_128_digest(keys[i]) for i in hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([ids[i] for i in hit], pa.int64())), pa.array(digests, pa.binary())], names=["id", "key"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("key", T.BinaryType())])
    found = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(suspects, schema), "line-suspects")
    common = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter(F.col("n") >= min_docs)
    # written first: the join then shuffles both sides itself, and a key of very many lines can be split
    return found.join(stored(common.select("key", "first_id"), "line-repeats"), "key")


def drop_repeated_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 27) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, plus ``n_lines`` and ``n_dropped``.

    A text is split at ``\\n``; a null or empty text is one empty line. A line's key is the
    line without ASCII blanks at both ends and with A-Z lower-cased; keys of ``min_chars``
    code points or more found in ``min_docs`` rows or more lose all their lines, or with
    ``keep_first`` all but the first line in the document of smallest id. What stays is
    joined by ``\\n``; a text without any line left, and a null text, become empty. Rows that
    share an id, or have none, count as documents of their own; none is lost. Other
    columns pass through; columns named as the new ones are replaced.
    """
    docs = without(docs, ["n_lines", "n_dropped"])
    bad = (
        repeated_lines(docs, min_docs=min_docs, min_chars=min_chars, id_col=id_col, text_col=text_col, max_filter_bits=max_filter_bits)
        .groupBy("id")
        .agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("id").eqNullSafe(F.col("first_id")), F.col("key"))).alias("firsts"))
    )
    left = docs.select(F.col(id_col).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("l")
    joined = left.join(bad.alias("r"), F.col("l.id").eqNullSafe(F.col("r.id")), "left").select("l.row", "r.keys", "r.firsts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts, totals, drops = [], [], []
            for text, keys, firsts in zip(row.field(text_col), batch.column(1), batch.column(2)):
                lines = (text.as_py() or "").encode("utf-8").split(b"\n")
                kept = lines
                if keys.is_valid:
                    gone, once = set(keys.as_py()), set(firsts.as_py()) if keep_first else set()
                    kept = []
                    for line in lines:
                        key = line_key(line)
                        digest = xxhash.xxh3_128_digest(key)
                        if digest not in gone or _chars(key) < min_chars:
                            kept.append(line)
                        elif digest in once:
                            once.discard(digest)
                            kept.append(line)
                texts.append(b"\n".join(kept).decode("utf-8"))
                totals.append(len(lines))
                drops.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if f.name == text_col else row.field(i) for i, f in enumerate(row.type)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(drops, pa.int64())], names=[*(f.name for f in row.type), "n_lines", "n_dropped"])

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(cut, schema)
