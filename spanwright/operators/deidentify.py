"""Removal of direct identifiers by a sealed table of substitutions, checked after the fact.

A table row is (id, needle, replacement, ord); a null id holds for every text. Needles are looked for all at once by an automaton, and of those that begin
first the longest is replaced, so the order of the table never matters. The automaton of the rules for all texts is
built once in each worker from two broadcast lists of at most ``MOST_BYTES``; rules of single texts travel with their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of needles and replacements that hold for all texts.
MOST_BYTES = 8 << 20


class TableMissing(ValueError):
    """There is no substitution table, so nothing may be rendered."""


def checked_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (id, needle, replacement), or an error: no rule at all, a null or empty needle, one needle of one id with two replacements.

    That no replacement brings a needle back is checked text by text, after the substitution.
    """
    if rules.limit(1).count() == 0:
        raise TableMissing("no substitution table: texts stay sealed")
    bad = rules.filter(F.col("needle").isNull() | (F.col("needle") == "") | F.col("replacement").isNull())
    twice = rules.groupBy("id", "needle").agg(F.count_distinct("replacement").alias("n")).filter("n > 1").select("needle")
    found = bad.select("needle").unionByName(twice).limit(5).collect()
    if found:
        raise ValueError(f"rules without a needle, without a replacement or with two: {len(found)} or more")
    return rules.dropDuplicates(["id", "needle"])


def _automaton(pairs: list[tuple[str, str]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for needle, replacement in pairs:
        a.add_word(needle, (len(needle), replacement))
    a.make_automaton()
    return a


def _substituted(text: str, a: ahocorasick.Automaton) -> tuple[str, int]:
    """Of all occurrences the first to begin counts, the longest of those, and none that overlaps it."""
    found = sorted((end + 1 - size, -size, value) for end, (size, value) in a.iter(text))
    out, at, n = [], 0, 0
    for start, size, value in found:
        if start >= at:
            out += [text[at:start], value]
            at, n = start - size, n + 1
    return "".join([*out, text[at:]]), n


def deidentify(docs: DataFrame, rules: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", strict: bool = True) -> DataFrame:
    """``docs`` with the identifiers taken out of the text, ``n_removed`` and ``survives`` (a needle is left).

    With ``strict`` a surviving needle is an error that names the row: a replacement together with its neighbours, or a
    replacement itself, may spell one. Where none survives, another run changes nothing. Null texts stay null.
    """
    if {"n_removed", "survives"} & {c.lower() for c in docs.columns}:
        docs = docs.drop("n_removed", "survives")
    rules = checked_rules(rules)
    everywhere = rules.filter("id is null").select("needle", "replacement")
    size = everywhere.agg(F.sum(F.octet_length("needle") + F.octet_length("replacement"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"rules for all texts take {size} bytes, more than {MOST_BYTES}: give them ids")
    shared = docs.sparkSession.sparkContext.broadcast(sorted((r.needle, r.replacement) for r in everywhere.collect()))
    own = rules.filter("id is not null").groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("needle", "replacement"))).alias("_rules"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    met = docs.select(row, F.col(f"`{id_col}`").alias("_key")).join(own, F.col("_key") == F.col("_id"), "left").select("row", F.col("_key").cast("string"), "_rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = _automaton(shared.value) if shared.value else None
        for batch in batches:
            rows = batch.column(0)
            texts, counts, left = [], [], []
            for text, key, more in zip(rows.field(text_col), batch.column(1), batch.column(2)):
                text, n, survives = text.as_py(), 0, False
                pairs = [(r["needle"], r["replacement"]) for r in more.as_py() or []]
                # a rule of the text's own id goes before one for all texts
                a = _automaton(list((dict(shared.value) | dict(pairs)).items())) if pairs else common
                if text is not None and a is not None:
                    text, n = _substituted(text, a)
                    survives = next(a.iter(text), None) is not None
                    if survives and strict:
                        raise ValueError(f"an identifier survives in {id_col} {key.as_py()}")
                texts.append(text)
                counts.append(n)
                left.append(survives)
            columns = [pa.array(texts, pa.string()) if f.name == text_col else rows.field(i) for i, f in enumerate(rows.type)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(left, pa.bool_())], names=[*(f.name for f in rows.type), "n_removed", "survives"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType()), T.StructField("survives", T.BooleanType())])
    return met.mapInArrow(run, schema)


def sealed_rules(table: DataFrame, sealed: str = "sealed") -> DataFrame:
    """(id, needle, replacement) of JSON documents in a column: ``{id: [[needle, replacement], ...]}``, or that under ``rules``.

    Keys that begin with an underscore are notes. A null document holds nothing.
    """
    # a note beside the rules may be of any kind, so every value is read as text first
    top = F.from_json(sealed, "map<string, string>")
    rules = F.coalesce(F.from_json(top["rules"], "map<string, string>"), top)
    each = table.select(F.explode(rules).alias("id", "subs")).filter(~F.col("id").startswith("_"))
    return each.select("id", F.explode(F.from_json("subs", "array<array<string>>")).alias("s")).select("id", F.col("s")[0].alias("needle"), F.col("s")[1].alias("replacement"))
