"""Stream summaries as Structured Streaming queries.

Each summary is a native streaming aggregation over order-free aggregates
(``min``, ``max``, ``max_by``), so late or reordered rows change nothing.
Updates are written one table per micro-batch version; a replayed micro-batch
overwrites its own version, so a restart after a failure counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from oremill.functions.hashing import HashFamily
from oremill.operators.sampling import replacements
from oremill.operators.sketches import batch_of, fm_estimate_column, register_columns, with_residue


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of parquet files under ``path`` (a folder or a glob)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(updates: DataFrame, folder: str) -> None:
    """Run ``updates`` over all available input, writing each version under ``folder``."""

    def save(rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/data/version={version}")

    query = (
        updates.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, folder: str, schema, *keys: str) -> DataFrame:
    """The newest version of every key written by :func:`drain`."""
    names = [field.name for field in schema.fields if field.name not in keys]
    versioned = StructType([*schema.fields, StructField("version", IntegerType())])
    versions = spark.read.schema(versioned).parquet(f"{folder}/data")
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*names), "version").alias("state"))
    return newest.select(*keys, "state.*")


def _run(updates: DataFrame, folder: str, *keys: str) -> DataFrame:
    drain(updates, folder)
    return latest(updates.sparkSession, folder, updates.schema, *keys)


def stream_fm(stream: DataFrame, size: int, family: HashFamily, folder: str, groups: int = 1) -> DataFrame:
    """Streaming ``fm_estimate``.  The exact count keeps at most ``size`` users per batch."""
    updates = with_residue(stream, family).groupBy(batch_of(F.col("n"), size).alias("batch")).agg(
        F.size(F.collect_set("user")).cast("bigint").alias("truth"), *register_columns(family)
    )
    names = [F.col(f"r{i}") for i in range(len(family))]
    state = _run(updates, folder, "batch")
    return state.select("batch", "truth", fm_estimate_column(names, groups).alias("estimate"))


def stream_reservoir(stream: DataFrame, k: int, seed: int, folder: str) -> DataFrame:
    """Streaming ``reservoir``: ``(slot, user, n)`` once the input is drained."""
    updates = (
        replacements(stream, k, seed)
        .groupBy("slot")
        .agg(F.max_by("user", "n").alias("user"), F.max("n").alias("n"))
    )
    return _run(updates, folder, "slot")


def stream_first_arrivals(stream: DataFrame, folder: str) -> DataFrame:
    """Streaming ``first_arrivals``: the whole state a Bloom filter's history needs."""
    return _run(stream.groupBy("user").agg(F.min("n").alias("first")), folder, "user")
