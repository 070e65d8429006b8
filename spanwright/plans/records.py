"""Queries over record files: JSON lines with declared schemas, lookups by id, span maps, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.operators import chunk
from spanwright.plans.retrieval import _t
from spanwright.plans.texts import _LINES, _TOK, _fixed_sql
from spanwright.session import shared_dir
from spanwright.sources import tables

Q, O = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


def _written(spark, df, name, *, blank: bool = False):
    """A JSON-lines file of ``df``; with ``blank`` an empty line and one of blanks follow every record."""
    at = tables.new_folder(shared_dir(spark), spark.sparkContext.applicationId, name)
    if blank:
        df.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit(""), F.lit("  "))).alias("value")).write.text(at)
    else:
        tables.write_jsonl(df, at)
    return at


def _segments(spark, sf):
    lines = chunk.line_segments(_t(spark, sf, "documents").select("doc_id", "text")).join(_t(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    kind = F.when(F.length("text") < 60, "short").otherwise("long")
    return lines.select(
        F.concat_ws(
            "-",
            "doc_id",
            "line_no"
        ).alias("segment_id"), F.col("source").alias("source_unit"), F.concat_ws(" > ", "source", "lang").alias("heading_path"), F.col("line_no").alias("page_start"), F.col("line_no").alias("page_end"),
        kind.alias("content_type"), F.lit("clinical").alias("section_role"), (F.length("text") < 60).alias("atomic"), "lang", "char_start", "char_end", F.length("text").alias("n_chars"), "text",
    )


_SEGMENT_ROWS = f"""{_LINES}, sg AS (SELECT doc_id || '-' || line_no AS segment_id, source AS source_unit, concat_ws(' > ', source, lang) AS heading_path, line_no AS page_start, line_no AS page_end, CASE WHEN length(text) < 60 THEN 'short' ELSE 'long' END AS content_type,
'clinical' AS section_role, length(text) < 60 AS atomic, lang, char_start, char_end, length(text) AS n_chars, md5(text) AS digest, line_no FROM seg JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id))"""


@query(f"WITH {_SEGMENT_ROWS} SELECT * EXCLUDE (line_no) FROM sg")
def a4_jsonl_records(spark, sf):
    """Segment records (T23) written as JSON lines with blank lines between them and read with their schema."""
    back = tables.read_jsonl(spark, _written(spark, _segments(spark, sf), "segments", blank=True), "segments")
    return back.filter("segment_id is not null").withColumn("digest", F.md5("text")).drop("text")


@query(f"WITH {_SEGMENT_ROWS} SELECT segment_id, char_start, char_end, content_type, digest FROM sg WHERE line_no = 1")
def a5_segments_by_id(spark, sf):
    """The segments of the ids asked for, from the file."""
    segments = tables.read_jsonl(spark, _written(spark, _segments(spark, sf), "segments"), "segments")
    asked = segments.filter("page_start = 1").select("segment_id")
    return tables.by_id(segments, "segment_id", asked).select("segment_id", "char_start", "char_end", "content_type", F.md5("text").alias("digest"))


@query("""SELECT 'q' || item_id AS question_id, CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, md5(text) AS digest, p AS passage_id FROM benchmark, range(0, item_id % 3 + 1) AS r(i), LATERAL (SELECT 'p' || (item_id + i) AS p)""")
def a6_questions(spark, sf):
    """Questions with lists of passages, from the file; a row for each passage."""
    b = _t(spark, sf, "benchmark")
    q = b.select(
        F.concat(F.lit("q"), "item_id").alias("question_id"),
        F.col("text").alias("question"),
        F.when(F.col("item_id") % 3 == 0, "easy").when(F.col("item_id") % 3 == 1, "medium").otherwise("hard").alias("difficulty"),
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("item_id") % 3),
            lambda i: F.concat(F.lit("p"), (F.col("item_id") + i).cast("string"))
        ).alias("passage_ids")
    )
    back = tables.read_jsonl(spark, _written(spark, q, "questions"), "questions")
    return back.select("question_id", "difficulty", F.md5("question").alias("digest"), F.explode("passage_ids").alias("passage_id"))


_CHUNK_ROWS = f"{_TOK}, c AS ({_fixed_sql(64, 16)})"


def _chunk_file(spark, sf):
    c = chunk.chunk_sweep(_t(spark, sf, "documents").select("doc_id", "text"), [("fixed-64-16", 64, 16)])
    rows = c.select("config_id", F.concat_ws("-", "doc_id", "seq").alias("chunk_id"), F.lit("fixed").alias("strategy"), "text", "char_start", "char_end", F.length("text").alias("n_chars"), "n_tokens")
    return tables.read_jsonl(spark, _written(spark, rows, "chunks"), "chunks")


@query(f"WITH {_CHUNK_ROWS} SELECT doc_id || '-' || seq AS chunk_id, char_start, char_end FROM c")
def a7_chunk_spans(spark, sf):
    """The spans of a chunk file by chunk: three fields of it are read."""
    return _chunk_file(spark, sf).select("chunk_id", "char_start", "char_end")


@query(f"WITH {_CHUNK_ROWS} SELECT doc_id || '-' || seq AS chunk_id, 'fixed-64-16' AS config_id, 'fixed' AS strategy, char_start, char_end, n_tokens, char_end - char_start AS n_chars, md5(substring(d.text, char_start::INT + 1, (char_end - char_start)::INT)) AS digest FROM c JOIN documents d USING (doc_id) WHERE seq = 2")
def a8_chunk_records(spark, sf):
    """Full chunk records of the ids asked for, from the file."""
    chunks = _chunk_file(spark, sf)
    asked = chunks.select("chunk_id").filter("chunk_id like '%-2'")
    return tables.by_id(chunks, "chunk_id", asked).withColumn("digest", F.md5("text")).drop("text")


QUERIES, ORACLES = Q, O
