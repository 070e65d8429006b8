"""Builds that make only what is missing: a manifest of what was built from which input, and partitions replaced one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An entry of the manifest: a variant, the fingerprint of what it was built from, the run that built it, its rows.
MANIFEST = "variant string, inputs string, run string, n_rows long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each variant; of a store that was never built, nothing."""
    try:
        entries = spark.read.schema(MANIFEST + ", nth long").json(f"{path}/manifest")
    except Exception as missing:  # noqa: BLE001  (the class differs between classic and Connect sessions)
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MANIFEST)
    return entries.groupBy("variant").agg(F.max_by(F.struct("inputs", "run", "n_rows"), "nth").alias("e")).select("variant", "e.*")


def missing(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (variant, inputs, ...) that the store has not, or has from other inputs."""
    return wanted.join(manifest(spark, path).select("variant", "inputs"), ["variant", "inputs"], "left_anti")


def build_missing(spark: SparkSession, path: str, wanted: DataFrame, build: Callable[[DataFrame], DataFrame], run: str) -> list[str]:
    """Builds the missing variants of ``wanted``, a row each; returns their names, in order. Nothing missing: nothing is written.

    ``build`` gets the missing rows and returns rows with a column ``variant``. They replace the partitions of these variants, all
    others stay as they are (dynamic overwrite). The manifest is written last: a run that breaks off builds its variants again. A variant without rows is
    built too. ``wanted`` is a list of configurations: its missing names pass through the driver.
    """
    todo = missing(spark, path, wanted)
    names = sorted(r.variant for r in todo.select("variant").collect())
    if len(set(names)) < len(names) or None in names:
        raise ValueError("a variant is wanted once, under a name")
    if not names:
        return []
    made = build(todo)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant").parquet(f"{path}/data")
    built = rows(spark, path, made).filter(F.col("variant").isin(names)).groupBy("variant").agg(F.count(F.lit(1)).alias("n_rows"))
    nth = manifest_size(spark, path)
    entries = todo.select("variant", "inputs").join(built, "variant", "left")
    entries = entries.select("variant", "inputs", F.lit(run).alias("run"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(nth).cast("long").alias("nth"))
    entries.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return names


def manifest_size(spark: SparkSession, path: str) -> int:
    """Number of entries ever written: later ones count."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest").count()
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return 0


def rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What the store holds, with the columns of ``like``."""
    return spark.read.schema(like.schema).parquet(f"{path}/data")
