"""An append-only log of interactions as JSON lines, written exactly once by a stream.

Every micro-batch has a folder of its own, named by the session and the batch number, and is listed in a manifest once it is whole.
A batch that Spark replays finds its entry and adds nothing; one that broke off half-way has none, is not read, and is
written over by its replay. Both tables are reached by Spark's own readers and writers, so the log may lie in any store.

Entries name their number of records and an order-free digest of them, so a log can be audited.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

MANIFEST = "session string, batch long, records long, digest long"


@dataclass(frozen=True)
class InteractionLog:
    """The log at ``path`` of records with ``schema``. ``interaction_id`` is added where records have none."""

    spark: SparkSession
    path: str
    schema: T.StructType

    @property
    def record_schema(self) -> T.StructType:
        named = "interaction_id" in self.schema.fieldNames()
        return self.schema if named else T.StructType([*self.schema.fields, T.StructField("interaction_id", T.StringType())])

    def manifest(self) -> DataFrame:
        """(session, batch, records, digest) of the whole batches."""
        if not self._begun():
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")

    def records(self) -> DataFrame:
        """All logged records with their ``session`` and ``batch``; batches without an entry are left out."""
        placed = T.StructType([*self.record_schema.fields, T.StructField("session", T.StringType()), T.StructField("batch", T.LongType())])
        if not self._begun():
            return self.spark.createDataFrame([], placed)
        lines = self.spark.read.schema(placed).json(f"{self.path}/data")
        return lines.join(self.manifest().select("session", "batch"), ["session", "batch"], "left_semi").select(placed.fieldNames())

    def write_batch(self, batch: DataFrame, session: str, number: int) -> int:
        """Logs one batch unless it is there already; returns how many records were added."""
        if self.manifest().filter((F.col("session") == session) & (F.col("batch") == number)).limit(1).count():
            return 0
        rows = batch.select(*[F.col(f"`{c}`") for c in self.schema.fieldNames()])
        if "interaction_id" not in self.schema.fieldNames():
            rows = rows.withColumn("interaction_id", interaction_id(*self.schema.fieldNames()))
        folder = f"{self.path}/data/session={session}/batch={number}"
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
        back = self.spark.read.schema(self.record_schema).json(folder)
        entry = back.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.bit_xor(F.xxhash64(*self.record_schema.fieldNames())), F.lit(0)).alias("digest"))
        found = entry.select(F.lit(session).alias("session"), F.lit(number).cast("long").alias("batch"), "records", "digest").first()
        self.spark.createDataFrame([found], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/entry={session}-{number}")
        return found.records

    def append(self, stream: DataFrame, session: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
        """Logs a stream under ``session``; ``checkpoint`` and session belong together over restarts. By default it takes what is there and ends."""
        query = stream.writeStream.foreachBatch(lambda batch, number: self.write_batch(batch, session, number))
        return query.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def broken(self) -> DataFrame:
        """Entries whose folder no longer holds the records that were logged."""
        names = self.record_schema.fieldNames()
        now = self.records().groupBy("session", "batch").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*names)).alias("x"))
        met = self.manifest().join(now, ["session", "batch"], "left")
        return met.filter((F.col("records") != F.coalesce("n", F.lit(0))) | (F.col("digest") != F.coalesce("x", F.lit(0)))).select("session", "batch", "records", "n")

    def _begun(self) -> bool:
        """Whether there is an entry at all; before the first one there is no folder to read."""
        try:
            self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        except Exception as missing:  # noqa: BLE001  (the class differs between classic and Connect sessions)
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return False
        return True


def interaction_id(*columns: str):
    """Twelve hexadecimal digits of the record's own content, so that a replay gives the same id."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256), 1, 12)
