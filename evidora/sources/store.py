"""Parquet tables: write, reload, upsert by parts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = 64
#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: list[str] = []  # paths in the shared folder, and tables over them
_TABLES: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset, a session
    in one process, as in tests, gets a new folder, and any other one is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete what this process wrote to the shared folder (indexes, staged tables); the number of paths.

    To be called when no DataFrame that reads them is needed any more; bucketed tables are dropped as well.
    """
    for name in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    n = len(_MADE)
    for path in _MADE:
        delete(spark, path)
    _MADE.clear()
    _TABLES.clear()
    return n


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver's garbage is collected."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for plans that read it several times."""
    path = scratch(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def written_in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` as a table in the shared folder, in sorted buckets of ``key``: joins by it neither shuffle nor sort it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    called = path.rpartition("/")[2].replace("-", "_")
    with shuffles_go(spark):
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(called)
    _TABLES.append(called)
    return spark.table(called)


def index_round_trip(tables: dict[str, DataFrame]) -> DataFrame:
    """Save every table, load it again and count the rows that differ (none, if the index can be rebuilt)."""
    out = None
    for name, df in tables.items():
        saved = written(df, name)
        # Each row of both sides once: how often it is saved less how often it is made again.
        both = saved.withColumn("_n", F.lit(1)).unionByName(df.withColumn("_n", F.lit(-1)))
        differing = both.groupBy(*df.columns).agg(F.sum("_n").alias("_n")).agg(F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("differing"))
        row = saved.agg(F.count("*").alias("n")).join(differing).select(F.lit(name).alias("part"), "n", "differing")
        out = row if out is None else out.unionByName(row)
    return out


def upsert(current: DataFrame | None, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``changes`` replace those with their key, all others stay; the latest of repeated changes (``seq``) wins."""
    if current is None:
        both = changes.withColumn("_new", F.lit(1))
    else:
        both = current.withColumn("seq", F.lit(0).cast("long")).withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.col("_new").desc(), F.col("seq").desc())
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new", "seq")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _part_column(spark: SparkSession, path: str) -> str | None:
    """The partition column of a table in parts; its name says how many there are."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    found = (re.match(r"(part_of_\d+)=", s.getPath().getName()) for s in fs.listStatus(at))
    return next((m[1] for m in found if m), None)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table in parts."""
    column = _part_column(spark, path)
    return spark.read.parquet(path).drop(column) if column else spark.read.parquet(path)


def upsert_parts(changes: DataFrame, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], key: str = "id", batch: str | None = None, parts: int = PARTS, order: list[str] | None = None) -> None:
    """Merge changes into a table that is cut into parts by a hash of its key; parts without changes are not read or written.

    ``merge(current, changes)`` gets the rows of the touched parts (None if there is no
    table) and all changes.  Merged parts are staged beside the table first and then
    replace those of the table, so ``batch``, a name of the changes, can be given again
    after a job was lost anywhere: what was staged whole is only moved again.  The
    driver gets the numbers of the touched parts.
    """
    spark = changes.sparkSession
    held = _part_column(spark, path)
    column = held or f"part_of_{parts}"
    parts = int(column.rpartition("_")[2])
    own = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    stage = f"{path}-staged"
    staged = f"{stage}/{batch or uuid.uuid4().hex}"
    if not exists(spark, f"{staged}/_SUCCESS"):
        touched = [r[0] for r in changes.select(own.alias("p")).distinct().collect()]
        current = spark.read.parquet(path).where(F.col(column).isin(touched)).drop(column) if held else None
        merged = merge(current, changes).withColumn(column, own)
        merged.repartition(column).sortWithinPartitions(column, *(order or [key])).write.partitionBy(column).mode("overwrite").parquet(staged)
    if _part_column(spark, staged):
        spark.read.parquet(staged).repartition(column).sortWithinPartitions(column, *(order or [key])).write.partitionBy(column).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for older in versions(spark, stage, ""):
        if f"{stage}/{older}" != staged or batch is None:
            delete(spark, f"{stage}/{older}")


def write_index(chunks: DataFrame, path: str, recreate: bool = False, batch: str | None = None) -> str:
    """Upsert chunks (with ``seq``) into the table at ``path``; an empty set is an error.

    Only the parts that changes reach are written again; inside, rows are sorted by
    the filter fields, for row groups to be skipped.  Returns ``path``.
    """
    spark = chunks.sparkSession
    if not chunks.limit(1).count():
        raise ValueError("no chunks to write")
    if recreate and exists(spark, path):
        delete(spark, path)
    upsert_parts(chunks, path, upsert, batch=batch, order=["legal_scope", "source_type", "id"])
    return path


def versions(spark: SparkSession, path: str, prefix: str = "v") -> list[str]:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix))
