"""Similar sets of words: prefix, position, size-by-parts and parity filters before any two sets are compared.

Sets are ordered by how rare their words are. Two sets of a Jaccard of t or more share a word among their first
``n - ceil(t n) + 1``, and where they do, the words behind that place bound how many they can share at all. A pair that
passes is checked against two sketches of both sets, which bound their symmetric difference from below: the parities of
512 buckets of words, and the sizes of 16 parts. Only what is left is compared word by word.

Rarity comes from counts of 2^20 buckets of word hashes, a broadcast of fixed size: any order common to all sets is right,
and this one needs no join of words with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import fold
from spanwright.session import materialised

#: Buckets of the word counts (four bytes each), parity bits and parts of a sketch.
COUNTED, PARITIES, PARTS = 1 << 20, 512, 16


def word_set(text: Column) -> Column:
    """The different folded words of a text, in order."""
    return F.sort_array(F.array_distinct(F.filter(F.split(fold(text), " "), lambda w: w != "")))


def set_digest(words: Column) -> Column:
    return F.sha2(F.concat_ws(" ", words), 256)


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many words of all sets fall into each bucket."""
    bucket = (F.col("h").bitwiseAND(F.lit(COUNTED - 1))).cast("int")
    counted = sets.select(F.explode("h").alias("h")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    out = np.zeros(COUNTED, np.int32)
    for batch in counted.toArrow().to_batches():  # a row a bucket
        out[batch.column(0).to_numpy()] = np.minimum(batch.column(1).to_numpy(), np.iinfo(np.int32).max)
    return out


def _sketches(rarity, least: float):
    """mapInArrow: (id, class digest, word hashes) -> (id, set, n, prefix, parity, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            rows, h = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64)
            seen = counts[h & (COUNTED - 1)]
            order = np.lexsort((h, seen, rows))
            h, seen = h[order], seen[order]
            begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            place = np.arange(len(h)) - begins[rows]
            reach = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
            kept = (place < reach[rows]) & (seen > 1)  # a word that no other set has meets none
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows[kept], minlength=len(sizes)))]).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(h[kept]), pa.array(place[kept].astype(np.int32))], names=["h", "at"])
            bits = np.bincount(rows * PARITIES + ((h >> 20) & (PARITIES - 1)), minlength=len(sizes) * PARITIES).reshape(-1, PARITIES) & 1
            words = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64).ravel()
            parts = np.bincount(rows * PARTS + ((h >> 40) & (PARTS - 1)), minlength=len(sizes) * PARTS)
            lists_of = lambda values, width: pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * width), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), entries),
                    lists_of(words, PARITIES // 64),
                    lists_of(parts.astype(np.int32), PARTS)
                ],
                names=["id", "set", "n", "prefix", "parity", "parts"],
            )

    return run


def candidates(classes: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of classes (id, n, prefix, parity, parts) that the filters cannot tell from similar ones, a < b."""
    part = lambda name, width: [F.col(name)[i].alias(f"{name}{i}") for i in range(width)]
    flat = classes.select("id", "n", F.explode("prefix").alias("p"), *part("parity", PARITIES // 64), *part("parts", PARTS)).select("*", "p.h", "p.at").drop("p")
    x, y = flat.alias("x"), flat.alias("y")
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c("x", "n") + c("y", "n")
    need = total * (least / (1 + least)) - 1e-6  # words that they have to share
    may = F.least(c("x", "n") - c("x", "at"), c("y", "n") - c("y", "at"))
    spare = total - 2 * need  # words that only one of them has, at most
    odd = sum((F.bit_count(c("x", f"parity{i}").bitwiseXOR(c("y", f"parity{i}"))) for i in range(1, PARITIES // 64)), F.bit_count(c("x", "parity0").bitwiseXOR(c("y", "parity0"))))
    uneven = sum((F.abs(c("x", f"parts{i}") - c("y", f"parts{i}")) for i in range(1, PARTS)), F.abs(c("x", "parts0") - c("y", "parts0")))
    met = x.join(y, (c("x", "h") == c("y", "h")) & (c("x", "id") < c("y", "id")) & (may >= need) & (uneven <= spare) & (odd <= spare))
    return met.select(c("x", "id").alias("a"), c("y", "id").alias("b")).distinct()


def _classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(set, id, n, prefix, parity, parts) of each class of equal sets, and (id, set) of all documents with a word."""
    sets = docs.select(F.col("doc_id").alias("id"), word_set(F.col("text")).alias("words")).filter(F.size("words") > 0)
    # texts are folded once; the hashes are read twice
    hashed = materialised(sets.select("id", set_digest(F.col("words")).alias("set"), F.transform("words", lambda w: F.xxhash64(w)).alias("h")), "set-hashes")
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(hashed))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"id {kind}, set string, n int, prefix array<struct<h: bigint, at: int>>, parity array<bigint>, parts array<int>"
    sketched = materialised(hashed.mapInArrow(_sketches(rarity, least), schema), "set-sketches")
    first = sketched.groupBy("set").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "prefix", "parity", "parts")])
    return first, sketched.select("id", "set")


def jaccard_classes(docs: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) over classes of equal folded word sets of ``docs`` (doc_id, text), each named by its smallest id.

    A class gives one row of jaccard 1 for each other member ``b``; classes pair by their names where their sets have a
    Jaccard of ``least`` or more. Members of two paired classes have the jaccard of the names, so no pair is lost.
    Texts without a word belong to no class; rows without an id are not compared.
    """
    if not 0 < least <= 1:
        raise ValueError("a similarity is above 0 and 1 at most")
    docs = docs.filter(F.col("doc_id").isNotNull())
    classes, members = _classes(docs, least)
    pairs = materialised(candidates(classes, least), "set-candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.select("doc_id", "text").join(asked, "doc_id", "left_semi").select("doc_id", word_set(F.col("text")).alias("s"))
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("s").alias(f"s_{c}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    scored = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (both / (F.size("s_a") + F.size("s_b") - both)).alias("jaccard"))
    names = classes.select("set", F.col("id").alias("a"))
    same = members.join(names, "set").filter("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= least).unionByName(same)


def set_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_members): classes of equal folded word sets, named by the smallest id; texts without a word have none."""
    words = word_set(F.col("text"))
    keyed = docs.select("doc_id", words.alias("s")).filter(F.size("s") > 0).select("doc_id", set_digest(F.col("s")).alias("set"))
    names = keyed.groupBy("set").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_members"))
    return keyed.join(names, "set").select("doc_id", "class_id", "n_members")
