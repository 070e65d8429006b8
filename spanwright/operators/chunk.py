"""Tokens, chunks and windows, all addressed by half-open character spans."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\S+")
#: Separators of recursive splitting, from paragraphs to characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Characters of texts that are cut into tokens at a time.
BLOCK_CHARS = 1 << 22
#: White space by code point; no code point above the last entry is any.
_BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


def _token_blocks(texts: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, texts, tokens before each text and in all, starts, ends) of blocks of rows; positions are within the text."""
    first, held, size = 0, [], 0
    for row, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size > BLOCK_CHARS or row == len(texts) - 1:
            codes = np.frombuffer("\n".join(held).encode("utf-32-le"), np.uint32)
            edges = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[np.minimum(codes, len(_BLANK) - 1)], [True]])))
            bases = np.concatenate([[0], np.cumsum([len(t) + 1 for t in held])])
            starts, ends = edges[::2], edges[1::2]
            before = np.searchsorted(starts, bases)
            shift = np.repeat(bases[:-1], np.diff(before))
            yield first, held, before, (starts - shift).astype(np.int32), (ends - shift).astype(np.int32)
            first, held, size = row + 1, [], 0


def with_token_offsets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``tokens``, the (s, e) spans of the runs without white space of the text. Narrow: no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held, before, starts, ends in _token_blocks(batch.column(at)):
                spans = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], names=["s", "e"]))
                part = batch.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([*part.columns, spans], names=[*batch.schema.names, "tokens"])

    schema = T.StructType([*docs.schema.fields, T.StructField("tokens", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))])
    return docs.mapInArrow(run, schema)


def chunk_sweep(docs: DataFrame, configs: list[tuple[str, int, int]], *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(config_id, id, seq, char_start, char_end, n_tokens, text): windows of tokens under each (config_id, size, overlap).

    ``with_text=False`` leaves the texts null where only the spans are asked for.

    Texts are cut into tokens once for all configurations. The last window is the first that reaches the last token; texts
    without a token have none.
    """
    for _, size, overlap in configs:
        if not 0 <= overlap < size:
            raise ValueError("overlap is 0 or more and less than size")
    if len({c for c, _, _ in configs}) < len(configs):
        raise ValueError("configurations of one name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held, before, starts, ends in _token_blocks(batch.column(1)):
                n = np.diff(before)
                ids = batch.column(0).slice(first, len(held))
                for name, size, overlap in configs:
                    step = size - overlap
                    windows = np.where(n > 0, np.maximum(n - overlap - 1, 0) // step + 1, 0)
                    row = np.repeat(np.arange(len(held)), windows)
                    seq = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                    at = before[row] + seq * step
                    stop = np.minimum(at + size, before[row + 1])
                    s, e = starts[at], ends[stop - 1]
                    texts = [held[r][i:j] for r, i, j in zip(row.tolist(), s.tolist(), e.tolist())] if with_text else [None] * len(row)
                    columns = [pa.array([name] * len(row), pa.string()), ids.take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (seq, s, e, stop - at)), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["config_id", id_col, "seq", "char_start", "char_end", "n_tokens", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"config_id string, `{id_col}` {kind}, seq int, char_start int, char_end int, n_tokens int, text string")


def fixed_chunks(docs: DataFrame, size: int, overlap: int, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id, seq, char_start, char_end, n_tokens, text): windows of ``size`` tokens, ``overlap`` shared."""
    return chunk_sweep(docs, [("", size, overlap)], id_col=id_col, text_col=text_col, with_text=with_text).drop("config_id")


def config_sweep(spark, strategies: dict[str, tuple[list[int], list[int], list[bool]]]) -> DataFrame:
    """One row a chunking configuration; an overlap as large as the size is left out, ids are unique."""
    rows = [(s, size, over, ctx) for s, (sizes, overs, ctxs) in strategies.items() for size in sizes for over in overs for ctx in ctxs]
    df = spark.createDataFrame(rows, "strategy string, size int, overlap int, ctx boolean").filter("overlap < size")
    return df.withColumn("config_id", F.concat_ws("-", "strategy", "size", "overlap", F.when(F.col("ctx"), "ctx"))).dropDuplicates(["config_id"])


def windows_of(grid: DataFrame, lengths: DataFrame) -> DataFrame:
    """``grid`` plus ``windows``: how many sliding windows each configuration makes of texts with (n, docs) tokens."""
    step = F.col("size") - F.col("overlap")
    each = F.when(F.col("n") == 0, 0).otherwise(F.floor(F.greatest(F.col("n") - F.col("overlap") - 1, F.lit(0)) / step) + 1)
    return F.broadcast(grid).crossJoin(lengths).groupBy(*grid.columns).agg(F.sum(each * F.col("docs")).cast("long").alias("windows"))


class Tokens:
    """The tokens of a text; how many of them a span touches, without looking at the text again."""

    def __init__(self, text: str):
        _, _, _, starts, ends = next(_token_blocks(pa.array([text])))
        self.starts, self.ends = starts.tolist(), ends.tolist()

    def range(self, s: int, e: int) -> tuple[int, int]:
        return bisect_right(self.ends, s), bisect_left(self.starts, e)

    def count(self, s: int, e: int) -> int:
        a, b = self.range(s, e)
        return max(0, b - a)


def split_spans(text: str, s: int, e: int, sep: str) -> list[tuple[int, int]]:
    """Pieces of ``text[s:e]`` that end behind each separator; together they cover the span."""
    cuts = [s, *(m.end() for m in re.compile(re.escape(sep)).finditer(text, s, e)), e]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def leaves(text: str, tokens: Tokens, s: int, e: int, size: int, seps: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Spans of at most ``size`` tokens where some separator allows it: every piece that is too large is split at the next separator."""
    done, work = [], [(s, e, 0)]
    while work:
        a, b, level = work.pop()
        if tokens.count(a, b) <= size or level == len(seps):
            done.append((a, b))
        elif seps[level]:
            work += [(x, y, level + 1) for x, y in reversed(split_spans(text, a, b, seps[level]))]
        else:  # every ``size`` tokens begin a piece
            first, last = tokens.range(a, b)
            cuts = [a, *(tokens.starts[i] for i in range(first + size, last, size)), b]
            done += list(zip(cuts, cuts[1:]))
    return done


def pack(parts: list[tuple[int, int]], counts: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of neighbouring leaves, as many as have ``size`` tokens together, one at least. The next chunk begins at the last
    leaf that leaves ``overlap`` tokens or more to both, and behind the first leaf of the chunk before.

    Both places are searches in the running totals of the counts.
    """
    total = [0, *accumulate(counts)]
    out, begin, n = [], 0, len(parts)
    while begin < n:
        end = max(begin + 1, bisect_right(total, total[begin] + size) - 1)
        out.append((parts[begin][0], parts[end - 1][1]))
        if end == n:
            break
        begin = max(begin + 1, bisect_right(total, total[end] - overlap, 0, end) - 1) if overlap else end
    return out


def recursive_chunks(docs: DataFrame, size: int, overlap: int, *, id_col: str = "doc_id", text_col: str = "text", by_line: bool = False, atomic: str | None = None) -> DataFrame:
    """(id, seq, char_start, char_end): recursive splits, packed; blank chunks are skipped.

    With ``by_line`` chunks never cross a line (structure-aware); a line that fits, or whose
    text matches ``atomic``, stays whole.
    """
    whole = re.compile(atomic) if atomic else None

    def spans(text: str) -> list[tuple[int, int]]:
        out, tokens = [], Tokens(text)
        for s, e in split_spans(text, 0, len(text), "\n") if by_line else [(0, len(text))]:
            if by_line and (tokens.count(s, e) <= size or (whole and whole.search(text[s:e]))):
                out.append((s, e))
            else:
                parts = leaves(text, tokens, s, e, size)
                out += pack(parts, [tokens.count(a, b) for a, b in parts], size, overlap)
        return [(a, b) for a, b in out if text[a:b].strip()]

    kind = pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"char_start": a, "char_end": b} for a, b in spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())])))
    ])
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return made.select(F.col("id").alias(id_col), F.posexplode("spans").alias("seq", "x")).select(id_col, "seq", "x.char_start", "x.char_end")


def line_segments(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, char_start, char_end, text): lines with running offsets into the text; a null text is one empty line. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                lines = [(t.as_py() or "").split("\n") for t in part.column(1)]
                row = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
                flat = [x for own in lines for x in own]
                size = np.fromiter(map(len, flat), np.int64, len(flat))
                stop = np.cumsum(size + 1) - 1
                begins = np.flatnonzero(np.diff(row, prepend=-1))
                shift = np.repeat(np.append(0, stop[begins[1:] - 1] + 1), np.diff(np.append(begins, len(row))))
                no = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
                columns = [part.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (no, stop - size - shift, stop - shift)), pa.array(flat, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "line_no", "char_start", "char_end", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, line_no int, char_start int, char_end int, text string")


#: Widths of the offset bins, as powers of two: a span lies in one or two bins of the first width that is not below its length.
BIN_BITS = (10, 14, 18, 22, 26, 31)


def _placed(spans: DataFrame, name: str, id_col: str) -> DataFrame:
    """``spans`` (struct ``name``) under the bins of their own width."""
    start, last = F.col(f"{name}.char_start"), F.greatest(F.col(f"{name}.char_start"), F.col(f"{name}.char_end") - 1)
    bits = F.lit(BIN_BITS[-1])
    for b in reversed(BIN_BITS[:-1]):
        bits = F.when(last - start < (1 << b), b).otherwise(bits)
    binned = spans.withColumn("_bits", bits)
    bins = F.expr(f"sequence(shiftright({name}.char_start, _bits), shiftright(greatest({name}.char_start, {name}.char_end - 1), _bits))")
    return binned.select(F.col(f"{name}.{id_col}").alias("_doc"), "_bits", F.explode(bins).alias("_bin"), name)


def _asked(spans: DataFrame, name: str, id_col: str) -> DataFrame:
    """``spans`` under every bin of every width that they touch: a few each, as the widths grow by sixteen."""
    of = lambda b: F.expr(f"transform(sequence(shiftright({name}.char_start, {b}), shiftright(greatest({name}.char_start, {name}.char_end - 1), {b})), x -> struct({b} as bits, x as bin))")
    return spans.select(
        F.col(f"{name}.{id_col}").alias("_doc"),
        name,
        F.explode(F.concat(*[of(b) for b in BIN_BITS])).alias("_b")
    ).select("_doc", F.col("_b.bits").alias("_bits"), F.col("_b.bin").alias("_bin"), name)


def interval_join(left: DataFrame, right: DataFrame, *, id_col: str = "doc_id", how: str = "inner") -> DataFrame:
    """(l, r): structs of the rows of ``left`` and ``right`` whose spans [char_start, char_end) in one document overlap.

    An interval index: right spans lie in bins of a width that fits them, left spans ask the bins they touch, and both join on
    (document, width, bin), so a document of any number of spans spreads over the tasks. A pair is reported in the bin of
    the larger start only, hence once. With ``how="left"`` a left row may come with a null ``r`` besides its pairs: callers group by it.
    An empty span overlaps what it lies strictly inside of.
    """
    a = _asked(left.select(F.struct("*").alias("l")), "l", id_col).alias("a")
    b = _placed(right.select(F.struct("*").alias("r")), "r", id_col).alias("b")
    once = F.expr("shiftright(greatest(a.l.char_start, b.r.char_start), a._bits) = a._bin")
    met = (F.col("a._doc") == F.col("b._doc")) & (F.col("a._bits") == F.col("b._bits")) & (F.col("a._bin") == F.col("b._bin"))
    over = (F.col("a.l.char_start") < F.col("b.r.char_end")) & (F.col("b.r.char_start") < F.col("a.l.char_end"))
    return a.join(b, met & over & once, how).select("l", "r")


def dominant_segment(chunks: DataFrame, segments: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """For each chunk the segment of largest overlap (first wins ties) and how many it touches; null and 0 where it touches none."""
    spans = [id_col, "char_start", "char_end"]
    hit = interval_join(chunks.select(*spans, "seq"), segments.select(*spans, "line_no"), id_col=id_col, how="left")
    overlap = F.least("l.char_end", "r.char_end") - F.greatest("l.char_start", "r.char_start")
    best = F.struct(overlap.alias("overlap"), (-F.col("r.char_start")).alias("early"), F.col("r.line_no").alias("line_no"))
    found = hit.groupBy(F.col(f"l.{id_col}").alias(id_col), F.col("l.seq").alias("seq")).agg(F.max(F.when(F.col("r").isNotNull(), best)).alias("best"), F.count("r").alias("n_segments"))
    return found.select(id_col, "seq", F.col("best.line_no").alias("line_no"), F.col("best.overlap").alias("overlap"), "n_segments")


def token_windows(tokenised: DataFrame, width: int, min_tail: int, *, id_col: str = "doc_id") -> DataFrame:
    """(id, window, char_start, char_end): consecutive windows; a tail shorter than ``min_tail`` goes unless it is the first."""
    n = F.size("tokens")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    rows = tokenised.select(id_col, "tokens", F.posexplode(starts).alias("window", "at")).withColumn("last", F.least(F.col("at") + width, n))
    kept = rows.filter((F.col("window") == 0) | (F.col("last") - F.col("at") >= min_tail))
    return kept.select(id_col, "window", F.col("tokens")[F.col("at")]["s"].alias("char_start"), F.col("tokens")[F.col("last") - 1]["e"].alias("char_end"))


def span_overlap(chunks: DataFrame, gold: DataFrame, threshold: float, denominator: str, *, id_col: str = "doc_id") -> DataFrame:
    """(gold_id, id, seq, fraction): chunks that overlap a gold span by ``threshold`` or more of the denominator."""
    spans = [id_col, "char_start", "char_end"]
    hit = interval_join(chunks.select(*spans, "seq"), gold.select(*spans, "gold_id"), id_col=id_col)
    clen, glen = F.col("l.char_end") - F.col("l.char_start"), F.col("r.char_end") - F.col("r.char_start")
    base = {"shorter": F.least(clen, glen), "gold": glen, "chunk": clen}[denominator]
    fraction = (F.least("l.char_end", "r.char_end") - F.greatest("l.char_start", "r.char_start")) / base
    return hit.withColumn("fraction", fraction).filter(F.col("fraction") >= threshold).select("r.gold_id", F.col(f"l.{id_col}").alias(id_col), "l.seq", "fraction")


#: Tokenizers that SQL can state: words and single marks, and runs without white space.
TOKENIZERS = {"words": r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", "blanks": r"\S+"}


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text under one of ``TOKENIZERS``, without special ones; an empty or null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def compare_tokenizers(docs: DataFrame, group: str, tokenizers: list[str], size: int, *, text_col: str = "text") -> DataFrame:
    """(group, and for each tokenizer its corpus tokens, characters a token with 3 places, and chunks of ``size`` tokens)."""
    each = docs.select(group, F.length(F.coalesce(text_col, F.lit(""))).alias("_chars"), *[token_count(F.col(text_col), t).alias(t) for t in tokenizers])
    made = []
    for t in tokenizers:
        tokens = F.sum(t)
        per = F.round(F.sum("_chars") / F.nullif(tokens, F.lit(0)), 3)
        made += [tokens.alias(f"{t}_tokens"), per.alias(f"chars_per_{t}_token"), F.sum(F.ceil(F.col(t) / size)).cast("long").alias(f"{t}_chunks")]
    return each.groupBy(group).agg(*made)


def query_tokens(df: DataFrame, prefix: str, special: int, cap: int, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` of the text, ``n_input`` with prefix and special tokens, and ``over_cap``; a null text counts as none."""
    with_prefix = token_count(F.concat(F.lit(prefix), F.coalesce(text_col, F.lit(""))), tokenizer) + special
    return df.withColumns({"n_tokens": token_count(F.col(text_col), tokenizer), "n_input": with_prefix, "over_cap": with_prefix > cap})


def offset_violations(chunks: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``chunks`` with ``violates``: their text is not what stands at their offsets in the document, or the document is not there."""
    whole = docs.select(id_col, F.col(text_col).alias("_whole"))
    there = F.expr("substring(_whole, char_start + 1, char_end - char_start)")
    return chunks.join(whole, id_col, "left").withColumn("violates", ~F.coalesce(there == F.col("text"), F.lit(False))).drop("_whole")


def chunk_stats(chunks: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Number, least, mean and most tokens, and the share of chunks over ``size``."""
    over = F.count_if(F.col("n_tokens") > size)
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("n_tokens").alias("tokens_min"), F.avg("n_tokens").alias("tokens_mean"), F.max("n_tokens").alias("tokens_max"), over.alias("truncated"), (over / F.count(F.lit(1))).alias("truncation_rate")
    )


def boundary_agreement(a: DataFrame, b: DataFrame, tolerance: int, *, id_col: str = "doc_id") -> DataFrame:
    """Per document the share of ``a``'s inner chunk ends that ``b`` reproduces within ``tolerance``.

    The band join is keyed by document and by buckets of the tolerance.
    """
    width = max(1, tolerance)
    ends = lambda df: df.select(id_col, F.col("char_end").alias("at"))
    last = Window.partitionBy(id_col)
    inner = ends(a).withColumn("top", F.max("at").over(last)).filter("at < top").drop("top")
    left = inner.withColumn("bucket", F.floor(F.col("at") / width)).alias("l")
    right = ends(b).select(id_col, F.col("at").alias("other"), F.explode(F.array(*[F.floor(F.col("at") / width) + d for d in (-1, 0, 1)])).alias("bucket")).alias("r")
    met = left.join(right, (F.col(f"l.{id_col}") == F.col(f"r.{id_col}")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.abs(F.col("l.at") - F.col("r.other")) <= tolerance), "left_semi")
    per = inner.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_inner"))
    hits = met.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_met"))
    return per.join(hits, id_col, "left").select(id_col, "n_inner", F.coalesce("n_met", F.lit(0)).alias("n_met"), (F.coalesce("n_met", F.lit(0)) / F.col("n_inner")).alias("agreement"))
