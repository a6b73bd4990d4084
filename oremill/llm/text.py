"""Expressions that several text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import mmap
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.plans.staging import shuffles_dropped, stage

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """All words of a text; none for null."""
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Characters that a worker takes up at once, which bounds its memory beside long texts.
SLICE_CHARS = 1_000_000


def sliced(texts: pa.Array) -> Iterator[list[str | None]]:
    """An Arrow batch in lists of about ``SLICE_CHARS`` characters, one at least."""
    held, chars = [], 0
    for text in texts:
        held.append(text.as_py())
        chars += len(held[-1] or "")
        if chars >= SLICE_CHARS:
            yield held
            held, chars = [], 0
    yield held


#: Memory of its own that a worker may keep from one task to the next.
KEPT_BYTES = 64 << 20


def own_bytes() -> int:
    """Memory of this process but for mapped files; 0 where the system does not tell."""
    try:
        pages = Path("/proc/self/statm").read_text().split()
    except OSError:
        return 0
    return (int(pages[1]) - int(pages[2])) * mmap.PAGESIZE


def tidy(function):
    """The function on batches, at whose end the worker gives freed memory back: idle workers of an executor count like busy ones."""

    @functools.wraps(function)
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        if own_bytes() > KEPT_BYTES:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Inside, the jobs that run hand batches of ``size`` to Python, whose arrays take several times that."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage_clean(df: DataFrame, label: str = "state") -> DataFrame:
    """``stage``, after which Spark drops the shuffle files of the write."""
    with shuffles_dropped(df.sparkSession):
        return stage(df, label)


def sweep(spark: SparkSession) -> None:
    """Have finished shuffles' files removed now, not when the driver next collects its garbage.

    What a stage wrote is read from its table; the shuffles behind it are never read again.
    """
    for _ in range(2):  # what the first round frees holds on to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)  # the files go in the background


#: Rows of texts vary in length by orders of magnitude, so batches for Python are bounded by bytes.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def tuned(function, settings: dict[str, str] = SETTINGS):
    """The function, with ``settings`` set on the session that is its first argument."""

    @functools.wraps(function)
    def run(spark: SparkSession, *args) -> DataFrame:
        for name, value in settings.items():
            spark.conf.set(name, value)
        return function(spark, *args)

    return run
