"""Segments: regions, headings, labels, ordered merges; pages to text; containment and set similarity."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.text import fold


def regions(lines: DataFrame, marker: Column, reference: Column, *, id_col: str = "doc_id") -> DataFrame:
    """(id, section_role, first_line, last_line, digest): scaffolding up to the first marker line,
    references from the first later reference line, clinical between; all clinical without a marker."""
    w = Window.partitionBy(id_col)
    a = lines.withColumn("_a", F.min(F.when(marker, F.col("line_no"))).over(w))
    b = a.withColumn("_b", F.min(F.when((F.col("line_no") > F.col("_a")) & reference, F.col("line_no"))).over(w))
    role = F.when(F.col("_a").isNull(), "clinical").when(F.col("line_no") <= F.col("_a"), "scaffolding").when(F.col("line_no") >= F.col("_b"), "references").otherwise("clinical")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return b.groupBy(id_col, role.alias("section_role")).agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.md5(joined).alias("digest"))


def is_heading(c: Column, *, longest: int = 80, upper_share: float = 0.75) -> Column:
    """A roman-numeral title, or a short line with enough letters, enough of them upper case."""
    letters, upper = F.length(F.regexp_replace(c, "[^A-Za-z]", "")), F.length(F.regexp_replace(c, "[^A-Z]", ""))
    return c.rlike(r"^[IVXLC]+\. .{1,56}$") | (F.length(c).between(3, longest) & (letters >= 3) & (upper >= upper_share * letters))


def classify(lines: DataFrame, rules: list[tuple[str, Column]], default: str, atomic: tuple[str, ...], max_chars: int) -> DataFrame:
    """``lines`` plus ``content_type`` (the first rule that holds) and ``atomic``."""
    kind = F.lit(default)
    for name, rule in reversed(rules):
        kind = F.when(rule, name).otherwise(kind)
    return lines.withColumn("content_type", kind).withColumn("atomic", F.col("content_type").isin(*atomic) & (F.length("text") <= max_chars))


def override_types(lines: DataFrame, rules: DataFrame, keys: list[str], atomic: tuple[str, ...], max_chars: int) -> DataFrame:
    """Labels replaced by ``new_type`` where ``rules`` has the keys; ``atomic`` is computed anew."""
    out = lines.join(rules.select(*keys, "new_type"), keys, "left").withColumn("content_type", F.coalesce("new_type", "content_type")).drop("new_type")
    return out.withColumn("atomic", F.col("content_type").isin(*atomic) & (F.length("text") <= max_chars))


WALKED = "seg_no int, topic string, title string, sub string, heading_path string, first_line int, last_line int, n_chars int"


def _collapsed(text: str) -> str:
    return " ".join(text.split())


def _outline(lines: list[str], unit: str, is_topic: re.Pattern, is_marker: re.Pattern, is_heading: re.Pattern) -> list[tuple]:
    """The segments of the lines of one text; see ``walk``."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    topics = {i: is_topic.match(lines[i]) for i in at}
    kind = {i: "T" if topics[i] else "M" if is_marker.match(lines[i]) else "H" if is_heading.match(lines[i]) else "B" for i in at}
    # what opens a segment shows in the line itself and the one before it
    opens = [n for n, i in enumerate(at) if n == 0 or kind[i] in "TM" or (kind[i] == "H" and kind[at[n - 1]] in "BM")]
    out, topic, title = [], None, None
    for number, (a, b) in enumerate(zip(opens, [*opens[1:], len(at)])):
        own = at[a:b]
        heads = own[: next((n for n, i in enumerate(own) if kind[i] == "B"), len(own))]  # the opener and the headings behind it
        subs = [_collapsed(lines[i]) for i in heads if kind[i] == "H"]
        if kind[own[0]] == "T":
            topic, title = topics[own[0]].group(1).upper(), _collapsed(topics[own[0]].group(2) or "") or None
            if title is None and subs:
                title, *subs = subs
        sub = _collapsed(lines[own[0]])[:80] if kind[own[0]] == "M" else " ".join(subs) or None
        node = None if topic is None else topic if title is None else f"{topic}: {title}"
        n_chars = sum(len(lines[i]) for i in own) + 2 * (len(own) - 1)
        out.append((number, topic, title, sub, " > ".join(x for x in (unit, node, sub) if x), own[0], own[-1], n_chars))
    return out


def walk(docs: DataFrame, *, heading: str, topic: str, marker: str, unit_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, seg_no, topic, title, sub, heading_path, first_line, last_line, n_chars): the outline of each text, line by line.

    A topic line (group 1 its name, group 2 a title on the same line or nothing), a marker line and the first of a row of headings behind
    other text open a segment; headings side by side are one heading. A topic holds until the next one; without a title of its own the
    heading right behind it is its title. The heading below (``sub``) is that of the segment's own opener: a marker line, cut to 80
    characters, or its headings. Blank lines count for nothing; a text without others has no segment. ``n_chars`` joins lines by two
    characters. One pass over each text, no shuffle: which lines open a segment depends on neighbours only.
    """
    patterns = re.compile(topic), re.compile(marker), re.compile(heading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_outline((t.as_py() or "").split("\n"), u.as_py() or "", *patterns) for t, u in zip(batch.column(1), batch.column(2))]
            yield _exploded(batch.column(0), id_col, found, schema)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([(name, pa.string() if type_ == "string" else pa.int32()) for name, type_ in (f.split(" ") for f in WALKED.split(", "))])
    return docs.select(id_col, F.col(text_col).cast("string"), F.col(unit_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {WALKED}")


def _exploded(ids: pa.Array, id_col: str, found: list[list[tuple]], schema: pa.Schema) -> pa.RecordBatch:
    rows = [r for own in found for r in own]
    at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
    return pa.RecordBatch.from_arrays([ids.take(at), *columns], names=[id_col, *schema.names])


MERGED = "seg_no int, first_line int, last_line int, n_chars int"


def _folded(docs: DataFrame, segs: str, id_col: str, fold_: Callable[[pa.StructArray], list[tuple[int, int]]]) -> DataFrame:
    """(id, seg_no, first_line, last_line, n_chars) of the groups [a, b) into which ``fold_`` puts the segments of each row."""
    schema = pa.schema([(n, pa.int32()) for n in ("seg_no", "first_line", "last_line", "n_chars")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own in batch.column(1):
                groups = fold_(own.values) if own.is_valid and len(own.values) else []
                total = np.concatenate([[0], np.cumsum(own.values.field("n").to_numpy(zero_copy_only=False) + 2)]) if groups else []
                found.append([(k, a, b - 1, int(total[b] - total[a]) - 2) for k, (a, b) in enumerate(groups)])
            yield _exploded(batch.column(0), id_col, found, schema)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, segs).mapInArrow(run, f"`{id_col}` {kind}, {MERGED}")


def merge_atomic(docs: DataFrame, max_chars: int, *, segs: str = "segs", id_col: str = "doc_id") -> DataFrame:
    """Neighbouring atomic segments of one kind and unit joined while they stay within ``max_chars`` together (two characters between them).

    ``segs`` is an array of structs (n, kind, unit, atomic) in order. Greedy from the left: a group is as long as it may be. Groups are found by a
    search in the running lengths of a run of like segments, so the work is linear; no row leaves its task.
    """

    def fold_(own: pa.StructArray) -> list[tuple[int, int]]:
        n = own.field("n").to_numpy(zero_copy_only=False)
        atomic = own.field("atomic").to_numpy(zero_copy_only=False).astype(bool)
        like = list(zip(own.field("kind").to_pylist(), own.field("unit").to_pylist(), atomic.tolist()))
        total = np.concatenate([[0], np.cumsum(n + 2)])
        runs = [0, *(i for i in range(1, len(n)) if not atomic[i] or like[i] != like[i - 1]), len(n)]
        out = []
        for a, b in zip(runs, runs[1:]):
            while a < b:
                end = max(a + 1, min(b, int(np.searchsorted(total, total[a] + max_chars + 2, side="right")) - 1))
                out.append((a, end))
                a = end
        return out

    return _folded(docs, segs, id_col, fold_)


def merge_tiny(docs: DataFrame, smallest: int, *, segs: str = "segs", id_col: str = "doc_id") -> DataFrame:
    """Segments of less than ``smallest`` characters (``bare``, without blanks at the ends) joined to the one before, whatever its unit.

    ``segs`` is an array of structs (n, bare). Where the first group stays below ``smallest`` it joins the second.
    """

    def fold_(own: pa.StructArray) -> list[tuple[int, int]]:
        n, bare = (own.field(c).to_numpy(zero_copy_only=False) for c in ("n", "bare"))
        cuts = [0, *(np.flatnonzero(bare[1:] >= smallest) + 1).tolist(), len(n)]
        groups = list(zip(cuts, cuts[1:]))
        first = groups[0]
        size = bare[0] if first[1] == 1 else int((n[: first[1]] + 2).sum()) - 2
        if len(groups) > 1 and size < smallest:
            groups = [(0, groups[1][1]), *groups[2:]]
        return groups

    return _folded(docs, segs, id_col, fold_)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.title, self.links, self.text, self.open = "", [], [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "meta", "link", "img", "hr", "input"):
            self.open.append(tag)
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.open:
            self.title += data
        elif "article" in self.open and not {"script", "style"} & set(self.open):
            self.text.append(data)


def parse_html(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, n_links, article): the article text with single blanks."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, html in zip(pdf[id_col], pdf[html_col]):
                page = _Page()
                page.feed(html or "")
                rows.append((key, page.title.strip(), len(page.links), " ".join(" ".join(page.text).split())))
            yield pd.DataFrame(rows, columns=[id_col, "title", "n_links", "article"])

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, title string, n_links int, article string")


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): folded items that stand in a folded document between word boundaries.

    An item is looked up by the word that fewest documents have; texts are joined to the
    candidates only. Items are the query set.
    """
    asked = items.select("item_id", fold(F.col("text")).alias("item")).filter("item <> ''")
    words = asked.select("item_id", F.explode(F.array_distinct(F.split("item", " "))).alias("w"))
    folded = docs.select("doc_id", fold(F.col("text")).alias("doc"))
    met = folded.select("doc_id", F.explode(F.array_distinct(F.split("doc", " "))).alias("w")).join(words.select("w").distinct(), "w", "left_semi")
    seen = met.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = words.join(seen, "w", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w")).alias("x")).select("item_id", "x.w")
    pairs = met.join(rarest, "w").select("doc_id", "item_id")
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return pairs.join(asked, "item_id").join(folded, "doc_id").filter(F.contains(padded("doc"), padded("item"))).select("doc_id", "item_id").distinct()
