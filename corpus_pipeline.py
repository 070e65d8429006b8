"""The corpus pipeline: five stages from raw documents to a weighted mix.

``STAGES`` holds (name, function) in order; each function takes (spark, docs, sf_dir) and
returns the documents that it keeps, which are written as Parquet and read again as the
next one's ``docs``. ``run`` applies them to the ``documents`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.common import stored, table
from spanwright.llm.decontaminate import find_leaks
from spanwright.llm.language_id import fit, held_out, identify
from spanwright.llm.line_dedup import drop_repeated_lines
from spanwright.llm.mixing import mix, numbered
from spanwright.llm.near_copies import keep_one_similar

#: A language that makes up a smaller share of a document says nothing about it; a document of which such languages make up
#: more than half is of no language.
MIN_SHARE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those more than half of which is spread over languages of less than a tenth each.

    A document of several languages stays, whichever of them is the largest. Null and empty texts go; repeated rows and rows
    without an id are judged one by one.
    """
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    named = identify(docs, model)
    clear = F.aggregate(F.filter("lang_mix", lambda x: x["share"] >= MIN_SHARE), F.lit(0.0), lambda total, x: total + x["share"])
    return named.filter((F.col("lang_pred") != "und") & (clear >= 0.5)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that ten documents or more share out of all texts; ``n_chars`` follows.

    Repeated rows and rows without an id count as documents of their own; every row stays, a null text and
    one whose lines all went with an empty text.
    """
    cut = drop_repeated_lines(docs, min_docs=10)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard of 0.8 or more, linked on, that of smallest id stays.

    Rows without an id go before none; of repeated rows and of rows with one id the smallest text stays.
    """
    return keep_one_similar(docs, width=5, least=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, exactly or at a similarity of 0.8 or more.

    Empty texts hold none; repeated rows are judged one by one.
    """
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies`` (1 to 3).

    Rows are told apart by a digest of all their columns. Repeated rows are rounded one by one; the mix
    says how many of them get how many copies, and as they are alike, any of them do. Null sources
    are one source, rows without words are never taken.
    """
    key = F.md5(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    keyed = docs.withColumn("mix_key", key)
    taken = mix(keyed, id_col="mix_key").filter("copies > 0").groupBy("mix_key", "copies").agg(F.count(F.lit(1)).alias("n"))
    rows = keyed.groupBy("mix_key").agg(F.first(F.struct(*docs.columns)).alias("row"))
    return numbered(rows.join(taken, "mix_key")).select("row.*", "copies")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: SQL states none of language inference, fingerprints, edit distance or seeded rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
