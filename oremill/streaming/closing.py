"""Stream summaries that answer while the stream runs, one final row a batch.

A batch holds ``size`` consecutive arrival numbers.  Rows may come in any order.

* The Bloom filter keeps versioned tables beside the stream's checkpoint: the users and
  bits that each micro-batch added, and the rows that wait for earlier ones.  A batch is
  judged once all rows before its end are there, so a verdict never changes.
* Trailing-zero counts and reservoir snapshots run on an arrival clock, one second an
  arrival, so that a batch is a time window.  A watermark of ``late`` arrivals closes
  windows in append mode and drops their state; rows later than that are lost, so choose
  it above the disorder of the source.  A source that ends closes its last windows with
  a row numbered ``CLOSING``.

A replayed micro-batch overwrites its own version of every table, so a restart counts
nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from oremill.functions.hashing import HashFamily, hash_values
from oremill.operators.sampling import SNAPSHOT_SLOTS, drawn_row, entry_slot, snapshots
from oremill.operators.sketches import batch_of, fm_estimate_column, register_columns, with_residue
from oremill.plans.staging import stage, unstage

VERSION = StructField("version", IntegerType())
#: An arrival number behind all others: it moves the watermark over every batch.
CLOSING = 1 << 40


class Versions:
    """Tables of a folder in versions, one a micro-batch."""

    def __init__(self, spark: SparkSession, folder: str, **schemas: str):
        self.spark, self.folder, self.schemas = spark, folder, schemas
        for name, schema in schemas.items():  # an empty first version, so that every read finds a table
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}/version=-1")

    def write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.folder}/{name}/version={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    def before(self, name: str, version: int | None = None) -> DataFrame:
        """Rows of all versions, or of those before one."""
        fields = StructType.fromDDL(self.schemas[name])
        rows = self.spark.read.schema(StructType([*fields.fields, VERSION])).parquet(f"{self.folder}/{name}")
        return rows if version is None else rows.where(F.col("version") < version)

    def last(self, name: str, version: int) -> DataFrame:
        """Rows of the version before one."""
        return self.before(name, version).where(F.col("version") == version - 1).drop("version")


def run(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``step`` on every micro-batch of the available input; the ended query tells of its state."""
    query = (
        stream.writeStream.outputMode("append")
        .foreachBatch(step)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def in_slices(stream: DataFrame, folder: str, slices: int) -> None:
    """Store the available input of ``stream`` (n, user) as ``slices`` ranges of ``n`` in each micro-batch."""

    def save(rows: DataFrame, version: int) -> None:
        ranged = rows.repartitionByRange(slices, "n").withColumn("slice", F.spark_partition_id())
        ranged.write.mode("overwrite").partitionBy("slice").parquet(f"{folder}/data/version={version}")

    run(stream, folder, save)


def arrive(spark: SparkSession, folder: str, number: int, feed: str) -> None:
    """Let a stored slice arrive in the folder that a stream reads."""
    stored = spark.read.schema("n bigint, user string, version int, slice int").parquet(f"{folder}/data")
    stored.where(F.col("slice") == number).select("n", "user").coalesce(1).write.mode("append").parquet(feed)


# Bloom filter


def bloom_tables(spark: SparkSession, folder: str) -> Versions:
    return Versions(
        spark,
        folder,
        users="user string, first bigint, x bigint",
        bits="bit bigint, set_at bigint",
        waiting="n bigint, user string",
        rates="batch bigint, fp bigint, tn bigint",
        marks="upto bigint",
    )


def stream_bloom(stream: DataFrame, size: int, family: HashFamily, folder: str) -> StreamingQuery:
    """Judge the available input of ``stream`` (n, user); read the outcome with :func:`bloom_rates`.

    Call it again on the same folder to go on with what has arrived since.
    """
    tables = bloom_tables(stream.sparkSession, folder)

    def step(rows: DataFrame, version: int) -> None:
        upto = tables.before("marks", version).agg(F.max("upto")).first()[0] or 0  # batches judged so far
        batch = batch_of(F.col("n"), size)
        came = rows.select("n", "user").where(batch >= upto).unionByName(tables.last("waiting", version)).distinct()
        here = stage(came, "arrived")
        full = here.groupBy(batch.alias("batch")).agg(F.count_distinct("n").alias("rows")).where(F.col("rows") == size)
        # Every full batch and the one behind it: the first that is not full ends what can be judged.
        marked = full.select("batch", F.lit(True).alias("full")).unionByName(full.select((F.col("batch") + 1).alias("batch"), F.lit(False).alias("full")))
        known = marked.groupBy("batch").agg(F.bool_or("full").alias("full"))
        first, gap = known.agg(F.min(F.when(F.col("full"), F.col("batch"))), F.min(F.when(~F.col("full"), F.col("batch")))).first()
        ready = gap if first == upto else upto
        done = here.where(batch < ready)
        users = tables.write(_new_users(tables, done, family, version), "users", version)
        bits = tables.write(_new_bits(tables, users, family, version), "bits", version)
        tables.write(_rates(tables, done, users, bits, size, family, version), "rates", version)
        tables.write(here.where(batch >= ready), "waiting", version)
        # Written last: a version counts once it has its mark.
        tables.write(tables.spark.range(1).select(F.lit(ready).cast("bigint").alias("upto")), "marks", version)
        unstage(here)

    return run(stream, folder, step)


def _new_users(tables: Versions, done: DataFrame, family: HashFamily, version: int) -> DataFrame:
    """Users whose first arrival is among ``done``, rows that follow all judged ones."""
    first = done.groupBy("user").agg(F.min("n").alias("first"))
    return with_residue(first.join(tables.before("users", version).select("user"), "user", "left_anti"), family)


def _probes(users: DataFrame, family: HashFamily) -> DataFrame:
    return users.select("first", F.explode(F.array(*hash_values(F.col("x"), family))).alias("bit"))


def _new_bits(tables: Versions, users: DataFrame, family: HashFamily, version: int) -> DataFrame:
    """Bits that these users are the first to set; earlier ones keep their time."""
    set_now = _probes(users, family).groupBy("bit").agg(F.min("first").alias("set_at"))
    return set_now.join(tables.before("bits", version).select("bit"), "bit", "left_anti")


def _rates(
    tables: Versions, done: DataFrame, users: DataFrame, bits: DataFrame, size: int, family: HashFamily, version: int
) -> DataFrame:
    """False positives and true negatives of every batch in ``done``."""
    set_at = tables.before("bits", version).select("bit", "set_at").unionByName(bits.select("bit", "set_at"))
    outcomes = _probes(users, family).join(set_at, "bit").groupBy("first").agg(F.bool_and(F.col("set_at") < F.col("first")).alias("positive"))
    per_batch = outcomes.groupBy(batch_of(F.col("first"), size).alias("batch")).agg(
        F.count_if("positive").alias("fp"), F.count_if(~F.col("positive")).alias("tn")
    )
    batches = done.select(batch_of(F.col("n"), size).alias("batch")).distinct()
    return batches.join(per_batch, "batch", "left").select("batch", F.coalesce("fp", F.lit(0)).alias("fp"), F.coalesce("tn", F.lit(0)).alias("tn"))


def bloom_rates(spark: SparkSession, size: int, family: HashFamily, folder: str) -> DataFrame:
    """``(batch, fp, tn, fpr)`` of the judged batches, and of the rows still waiting as they stand."""
    tables = bloom_tables(spark, folder)
    whole = tables.before("marks").agg(F.max("version")).first()[0]
    following = 0 if whole is None else whole + 1
    waiting = tables.last("waiting", following)
    users = _new_users(tables, waiting, family, following)
    bits = _new_bits(tables, users, family, following)
    rates = tables.before("rates", following).drop("version").unionByName(_rates(tables, waiting, users, bits, size, family, following))
    fp, tn = F.col("fp"), F.col("tn")
    return rates.select("batch", "fp", "tn", F.coalesce(F.try_divide(fp, fp + tn), F.lit(0.0)).alias("fpr"))


# Windows on an arrival clock


def clocked(stream: DataFrame, late: int) -> DataFrame:
    """``stream`` with ``clock``, a second an arrival from 0, and a watermark of ``late`` arrivals."""
    return stream.withColumn("clock", F.timestamp_seconds(F.col("n") - 1)).withWatermark("clock", f"{late} seconds")


def _batch_window(size: int) -> Column:
    return F.window("clock", f"{size} seconds")


def _batch_number(size: int) -> Column:
    return F.call_function("div", F.unix_seconds("window.start"), F.lit(size)).alias("batch")


def stream_fm_batches(stream: DataFrame, size: int, family: HashFamily, folder: str, late: int, groups: int = 1) -> DataFrame:
    """``fm_estimate`` with closing windows: ``(batch, truth, estimate)``, written once each."""
    state = with_residue(clocked(stream, late), family).groupBy(_batch_window(size)).agg(
        F.size(F.collect_set("user")).cast("bigint").alias("truth"), *register_columns(family)
    )
    names = [F.col(f"r{i}") for i in range(len(family))]
    closed = state.select(_batch_number(size), "truth", fm_estimate_column(names, groups).alias("estimate"))
    tables = Versions(stream.sparkSession, folder, estimates="batch bigint, truth bigint, estimate bigint")
    run(closed, folder, lambda rows, version: tables.write(rows, "estimates", version))
    return tables.before("estimates").drop("version")


def stream_snapshots(
    stream: DataFrame, k: int, size: int, seed: int, folder: str, late: int, slots: tuple[int, ...] = SNAPSHOT_SLOTS
) -> DataFrame:
    """``reservoir_snapshots`` with closing windows.

    A window keeps the last arrival that entered each chosen slot; a closed one is put
    behind those of the batches before it, of which one row a slot is carried on.
    """
    if max(slots) >= k:
        raise ValueError("slots must be below the sample size")
    slot = F.coalesce(entry_slot(F.col("n"), k, seed), F.lit(-1))
    entered = [F.max(F.when(F.col("slot") == s, F.struct("n", "user"))).alias(f"s{s}") for s in slots]
    state = clocked(stream, late).withColumn("slot", slot).groupBy(_batch_window(size)).agg(F.max("n").alias("seqnum"), *entered)
    closed = state.select(_batch_number(size), "seqnum", *[f"s{s}" for s in slots])
    kind = dict(stream.dtypes)["user"]
    shot = "batch bigint, seqnum bigint, " + ", ".join(f"`{s}_id` {kind}" for s in slots)
    tables = Versions(stream.sparkSession, folder, shots=shot, carried=f"n bigint, user {kind}, slot int")

    def step(rows: DataFrame, version: int) -> None:
        rows = stage(rows, "closed")
        now = [rows.where(F.col(f"s{s}").isNotNull()).select(f"s{s}.n", f"s{s}.user", F.lit(s).alias("slot")) for s in slots]
        history = tables.last("carried", version)
        for part in now:
            history = history.unionByName(part)
        tables.write(snapshots(history, rows.select("batch", "seqnum"), slots), "shots", version)
        latest = history.groupBy("slot").agg(F.max(F.struct("n", "user")).alias("e"))
        tables.write(latest.select("e.n", "e.user", "slot"), "carried", version)
        unstage(rows)

    run(closed, folder, step)
    return tables.before("shots").drop("version")


# Draws


def stream_bootstrap(draws: DataFrame, table: DataFrame, index: str, rows: int, batch_size: int, seed: int, folder: str) -> DataFrame:
    """``bootstrap_batches`` of a stream of draw numbers (column ``draw``, from 0) against a stored table of ``rows`` rows."""
    batch = F.call_function("div", F.col("draw"), F.lit(batch_size)).alias("batch")
    numbered = draws.select("draw", batch, drawn_row(F.col("draw"), seed, rows).alias("_row"))
    joined = numbered.join(table.withColumn("_row", F.col(index).cast("bigint")), "_row").drop("_row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    tables = Versions(draws.sparkSession, folder, drawn=schema)
    run(joined, folder, lambda found, version: tables.write(found, "drawn", version))
    return tables.before("drawn").drop("version")
