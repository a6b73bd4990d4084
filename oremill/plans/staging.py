"""Cutting lineage in iterative jobs.

Loops write each state to a parquet table in the folder the cluster names in
``spark.checkpoint.dir``.  A table (unlike an executor-local copy) survives the
loss of any executor, and its file sizes give the planner true statistics for
the next iteration's joins.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for staged tables.

    Only a local-mode session may fall back to a temporary folder: on a cluster
    a machine-local path would not be readable by the other executors.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return f"{configured.rstrip('/')}/oremill/{context.applicationId}"
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="oremill-")
    return _local_roots[app]


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark drops the shuffle files of every job that has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, label: str = "state", by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table.

    The shuffle files of the write go with it, not when the driver next collects its
    garbage: what they held is read from the table from now on.  A DataFrame that already is such a table is returned as it is.  With ``by`` each
    value of that column gets a folder, so that a reader of one value reads no other.
    """
    if hasattr(df, "_oremill_path"):
        return df
    spark = df.sparkSession
    path = staging_path(spark, label)
    writer = df.write.partitionBy(by) if by else df.write
    with shuffles_dropped(spark):
        writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._oremill_path = path
    return staged


def stage_counted(df: DataFrame, label: str = "state") -> tuple[DataFrame, int]:
    """``stage`` plus the row count, observed while the table is written."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return staged, seen.get["rows"]


def stage_observed(df: DataFrame, label: str, **metrics) -> tuple[DataFrame, dict]:
    """``stage`` plus named aggregates, observed while the table is written."""
    seen = Observation()
    staged = stage(df.observe(seen, *[expr.alias(name) for name, expr in metrics.items()]), label)
    return staged, seen.get


def unstage(*tables: DataFrame | None) -> None:
    """Delete staged tables that a loop has superseded."""
    for table in tables:
        path = getattr(table, "_oremill_path", None)
        if path is None:
            continue
        jvm = table.sparkSession.sparkContext._jvm
        conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
