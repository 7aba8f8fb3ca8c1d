"""Streaming jobs: the action log, and idempotent upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kg
from ..operators.replay import replay_stream
from ..sources.store import exists, upsert, upsert_parts

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay_job(spark: SparkSession, actions: DataFrame, sink: str, checkpoint: str) -> None:
    """Replay all available actions of a stream into a Parquet sink."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = replay_stream(actions).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def upsert_job(stream: DataFrame, first: DataFrame | None, merge: Callable[[DataFrame | None, DataFrame], DataFrame], base: str, checkpoint: str, key: str = "id") -> str:
    """Merge every micro-batch into the parts of a table that it reaches; returns the table's path.

    A batch is staged under its id before it replaces anything, so one that
    runs again after a lost driver gives the same table.
    """
    spark, path = stream.sparkSession, f"{base}/table"
    if first is not None and not exists(spark, f"{path}/_SUCCESS"):
        upsert_parts(first, path, lambda _, rows: rows, key, "first")

    def run(batch: DataFrame, batch_id: int) -> None:
        upsert_parts(batch, path, merge, key, f"b{batch_id:09d}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return path


def index_upsert(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Changed chunks (with seq) replace those with their id; nothing is deleted."""
    return upsert(current, batch)


def kg_node_upsert(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Nodes of finished responses; their origin never replaces a better one."""
    empty = batch.limit(0).select("key", "label", "name", "aliases", "props", "origin") if current is None else current
    return kg.merge_nodes(empty, batch, "pipeline")


def kg_edge_upsert(nodes: DataFrame) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge of edges of finished responses, to be kept in parts by ``source``; edges whose ends are not both among ``nodes`` are dropped."""

    def merge(current: DataFrame | None, batch: DataFrame) -> DataFrame:
        empty = batch.limit(0).select("source", "target", "type", "props").withColumn("origin", F.lit("pipeline"))
        return kg.merge_edges(empty if current is None else current, batch, nodes, "pipeline")

    return merge
