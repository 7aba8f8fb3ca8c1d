"""Small helpers that several operators use."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's setting for the rows of an Arrow batch, and what ``small_batches`` makes of it.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Where it is unset, a session
    in one process, as in tests, gets a new folder; any other one is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there (an eager checkpoint).

    Shuffle files of the plan go when it is written, not when the driver's garbage is collected.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions inside send at most ``BATCH_ROWS`` rows at once to Arrow tasks.

    A batch of whole texts stands several times in an executor's memory, and Spark's 10,000 rows are
    all rows of many a partition.  For actions only: a plan that runs later takes the setting of then.
    """
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def release_memory() -> None:
    """Give freed memory back to the system; Python workers live on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``, for ``DataFrame.transform``; a task that ends leaves its worker small."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(task, schema)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores in front as it takes to clash with no column."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending keys that cut ``df`` into about equal ranges.

    Reads the key column only; the driver holds n numbers.
    """
    if n < 2:
        return []
    probs = [i / n for i in range(1, n)]
    found = df.where(F.col(key).isNotNull()).approxQuantile(key, probs, 0.1 / n)
    return sorted({int(x) for x in found})


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """0 for null and keys up to the first bound, ..., len(bounds) beyond the last."""
    if not bounds:
        return F.lit(0)

    def place(lo: int, hi: int) -> Column:  # a binary search, written out as nested conditions
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(key > bounds[middle], place(middle + 1, hi)).otherwise(place(lo, middle))

    return F.when(key.isNull(), 0).otherwise(place(0, len(bounds)))


def running_before(df: DataFrame, value: str, key: str, out: str, group: list[str], order: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before in each group, by ``order``, which begins with ``key``.

    The key's range is cut into buckets; sums of whole buckets come from one
    row a bucket and group, so no task holds a whole group.
    """
    n = min(partitions(df.sparkSession), 1000)
    df = df.withColumn("_bucket", range_bucket(F.col(key), range_bounds(df, key, n)))
    sums = df.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = F.col("a._bucket") == F.col("b._bucket")
    for g in group:
        match &= F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = df.alias("a").join(sums.alias("b"), match, "left")
    return joined.select("a.*", (F.col("a._inside") + F.col("b._base")).cast("long").alias(out)).drop("_bucket", "_inside")
