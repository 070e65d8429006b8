"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Documents with equal fingerprints form one class first, so groups of copies cost one row.
A fingerprint of 64 bits is cut into ``max_bits + 2`` blocks; two that differ in
``max_bits`` bits or fewer agree on two blocks at least, so the pairs of blocks are the join
keys. Small buckets are joined and verified. A bucket with many different fingerprints is
not paired: its members are linked through the points one bit away from them (two
fingerprints within two bits share such a point, and a point has 65 neighbours at most),
which gives the same components from a number of rows in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.llm.common import stored
from spanwright.llm.components import components

#: Buckets with more different fingerprints than this are linked through shared points.
PAIRED_BUCKET = 64


def simhash64(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority bits over the XXH64 of word shingles, as a signed 64-bit integer.

    A-Z are lower-cased; words are runs without ASCII blanks; fewer than ``width`` words
    make one shingle; no word at all gives zero.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash64(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _masks(max_bits: int) -> list[int]:
    """Signed masks of all pairs of ``max_bits + 2`` blocks."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links between different fingerprints that give the components of all pairs in reach.

    ``fps`` holds distinct fingerprints in column ``fp``. Every link is verified.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2: large buckets are linked through points one bit away")
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(max_bits))])).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(keyed.join(sizes, ["block", "key"]), "simhash-blocks")
    few = shared.filter(F.col("n") <= PAIRED_BUCKET)
    pairs = few.select("block", "key", F.col("fp").alias("a")).join(few.select("block", "key", F.col("fp").alias("b")), ["block", "key"]).filter("a < b").select("a", "b")
    many = shared.filter(F.col("n") > PAIRED_BUCKET).select("fp").distinct()
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(64)] if max_bits == 2 else []
    near = many.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("point"))
    if max_bits == 1:
        near = many.select("fp", F.explode(F.array(*[F.array(F.lit(i).cast("long"), F.col("fp").bitwiseAND(F.lit(~(1 << i) if i < 63 else (1 << 63) - 1))) for i in range(64)])).alias("point"))
    met = near.groupBy("point").agg(F.collect_set("fp").alias("met")).filter(F.size("met") > 1)  # 65 at most
    through = met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).filter("a <> b")
    return pairs.unionByName(through).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def _classes(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first_id, root): one row for each fingerprint of ``fps`` (id, fp)."""
    classes = fps.groupBy("fp").agg(F.min("id").alias("first_id"))
    roots = components(links(classes.select("fp"), max_bits))
    return classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, max_bits: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at ``max_bits`` differing bits or fewer; ``component_id`` is the smallest
    id reachable, the row's own included. Null, empty and blank texts have fingerprint zero and
    link like any other. Rows without an id keep their place in a component but never name it
    (null if no row of the component has an id). Repeated rows each get a row.
    """
    fps = stored(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    rooted = _classes(fps, max_bits)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_roots(rooted: DataFrame) -> DataFrame:
    """(fp, first_id) of smallest id for each ``root`` in ``rooted`` (fp, first_id, root)."""
    return rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp")).alias("k")).select("k.fp", "k.first_id")


def first_rows(rows: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each ``root`` in ``rooted`` (fp, first_id, root) the row of smallest id in ``rows`` (row, fp)."""
    chosen = rows.join(first_of_roots(rooted), "fp").filter(F.col(f"row.{id_col}").eqNullSafe(F.col("first_id")))
    first = Window.partitionBy("fp").orderBy(F.col(f"row.{text_col}"))
    return chosen.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*")


def keep_one(docs: DataFrame, *, max_bits: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of smallest id.

    A row with an id goes before rows without; of rows that share id and fingerprint the
    smallest text stays. The texts are shuffled once, for the final choice.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash64(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["row", "fp"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("fp", T.LongType())])
    rows = stored(packed.mapInArrow(run, schema), "fingerprinted")
    rooted = _classes(rows.select(F.col(f"row.{id_col}").alias("id"), "fp"), max_bits)
    return first_rows(rows, rooted, id_col, text_col)
