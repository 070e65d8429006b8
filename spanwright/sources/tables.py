"""Readers and writers at the engine's edges: JSONL, CSV, nested JSON, with declared schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the tables that other tools exchange with the engine.
SCHEMAS = {
    "segments": "segment_id string, source_unit string, heading_path string, page_start int, page_end int, content_type string, section_role string, atomic boolean, lang string, char_start int, char_end int, n_chars int, text string",
    "gold_passages": "passage_id string, concept string, source_unit string, source_segment_id string, heading_path string, page_start int, page_end int, char_start int, char_end int, n_chars int, text string",
    "questions": "question_id string, question string, question_type string, difficulty string, passage_ids array<string>, reference_answer string",
    "retrieval": "index_id string, question_id string, rank int, chunk_id string, score double",
    "chunks": "config_id string, chunk_id string, strategy string, text string, char_start int, char_end int, n_chars int, n_tokens int",
    "cells": "sheet string, row int, col int, value string",
}


def new_folder(*parts: str) -> str:
    """A path that nothing has used yet."""
    return "/".join([*parts[:-1], f"{parts[-1]}-{uuid.uuid4().hex}"])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; ``schema`` is DDL or a name of ``SCHEMAS``. Blank lines are skipped, a broken line is an error."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_nested(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """The records of the array ``field`` of one JSON document; ``element`` is their DDL."""
    doc = spark.read.schema(f"{field} array<struct<{element}>>").option("multiLine", True).json(path)
    return doc.select(F.inline(field))


def discover(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, stem, folder, n_bytes) of the files below ``path`` whose names match ``glob``: a listing, no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("length").alias("n_bytes"))


def by_id(records: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` (one column of that name), each once; an id without a record, and one with several, are an error when it is read."""
    asked = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    found = records.groupBy(key).agg(F.first(F.struct("*")).alias("_row"), F.count(F.lit(1)).alias("_n"))
    met = asked.join(found, F.col("_id") == F.col(key), "left")
    wrong = F.when(F.col("_n").isNull(), F.concat(F.lit("no record of "), F.col("_id").cast("string"))).when(F.col("_n") > 1, F.concat(F.lit("several records of "), F.col("_id").cast("string")))
    return met.select(F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("_row")).alias("_row")).select("_row.*")


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that exist as doubles; what is no number becomes null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns if c in df.columns})


def union_of_keys(frames: list[DataFrame]) -> DataFrame:
    """All rows under all columns, those of the first frames first."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Refuses to replace what is there unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_partitioned(df: DataFrame, path: str, by: str, *, overwrite: bool = False) -> None:
    """Parquet, one folder a configuration, so that a reader's filter on it prunes files."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(by).parquet(path)


def write_csv_with_bom(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """CSV files with a header whose first name begins with a byte order mark, for spreadsheets."""
    first, *rest = df.columns
    marked = df.withColumnRenamed(first, "\ufeff" + first)
    marked.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def distinct_names(df: DataFrame, column: str, most: int) -> list[str]:
    """The different non-null values of ``column`` in order, for use as column names; more than ``most`` are an error."""
    found = [str(r[0]) for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} different values: too many for columns")
    return sorted(found)


def score_columns(scores: DataFrame, metric: str, *, item: str = "question_id", system: str = "index_id", most: int = 1000) -> DataFrame:
    """(item, one double column a system): the chosen metric of every item, null where a system has none or no number.

    Two passes: the systems first, as a bounded list, then one aggregation by item. An item scored twice by one system is an error.
    """
    systems = distinct_names(scores, system, most)
    value = F.expr(f"try_cast(`{metric}` as double)")
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"an item has two rows of one {system}"))).otherwise(F.max("_v"))
    return scores.select(item, system, value.alias("_v")).groupBy(item).pivot(system, systems).agg(once)


def keys_in_order(rows: DataFrame, fields: str, order: str, *, most: int = 1000) -> list[str]:
    """The keys of the map column ``fields`` in the order in which rows first have them (by ``order``, then by place in the map)."""
    each = rows.select(F.col(order).alias("_o"), F.posexplode(F.map_keys(fields)).alias("_at", "_key"))
    first = each.groupBy("_key").agg(F.min(F.struct("_o", "_at")).alias("_first")).orderBy("_first").limit(most + 1)
    found = [r["_key"] for r in first.collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} different keys: too many for columns")
    return found


def write_union_csv(rows: DataFrame, fields: str, order: str, path: str, *, most: int = 1000, overwrite: bool = False) -> list[str]:
    """Rows of a map column as CSV under the union of their keys, first-seen order, blank where a row has none; returns the header.

    Without rows the result is one empty file. Rows are written in ``order`` within ranges of it.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    header = keys_in_order(rows, fields, order, most=most)
    if not header:
        rows.sparkSession.createDataFrame([("",)], "value string").coalesce(1).filter("false").write.mode(mode).text(path)
        return []
    wide = rows.repartitionByRange(order).sortWithinPartitions(order)
    wide.select(*[F.coalesce(F.col(fields)[k].cast("string"), F.lit("")).alias(k) for k in header]).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return header
