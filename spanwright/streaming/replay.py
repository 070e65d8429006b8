"""Structured Streaming over log folders: stateless screening and watermarked window counts.

``available now`` runs take what is there, write it to the shared checkpoint folder and end;
the same plans run continuously with another trigger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.text import matched_keywords
from spanwright.session import shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a folder, or one file)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


def _finished(stream: DataFrame) -> DataFrame:
    """Writes all that is available and returns what was written."""
    spark, out = stream.sparkSession, _folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def screened(spark: SparkSession, path: str, keywords: list[str]) -> DataFrame:
    """(conv_id, turn, matched) of user turns that hit a keyword."""
    turns = _source(spark, path).filter("role = 'user'")
    return _finished(turns.select("conv_id", "turn", matched_keywords(F.col("text"), keywords).alias("matched")).filter(F.size("matched") > 0))


def windowed_counts(spark: SparkSession, path: str, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of all windows of a finite input, those still open at its end too.

    A replay keeps whole results: each batch replaces the table of counts. For an endless stream run the
    plan in append mode, where ``late`` closes windows.
    """
    events = _source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    counts, out = w.select(F.col("window.start").alias("start"), "event_type", "n", "total"), _folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data")

    counts.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/data")
