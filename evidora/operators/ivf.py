"""Approximate cosine search with an inverted file.

Cells are the means of k-means on a bounded sample.  A vector lies in the list of its
nearest mean as a residual code: what is left of the unit vector after its mean, in
8 bits an entry with one step a vector.  A search looks into the ``probes`` nearest cells
of each query, keeps the best by codes, and computes these again from the vectors.

Lists are packs of codes, written by cell and sorted.  (cell, part) is one task:
a cell with more than ``PART_ROWS`` vectors has several parts, and its queries go to each, so
a cell that holds a third of all vectors is no single task.  Tasks send the best of each
query only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import scratch
from .lexical import top_k

SAMPLE = 65_536  # vectors that the cells are learnt from, at most
CELLS = 4096  # at most; a broadcast of means has so many rows
ROUNDS = 8
PART_ROWS = 1 << 16
PACK = 64


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of length 1 (or 0) of a column of vectors of one length."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def means(u: np.ndarray, cells: int) -> np.ndarray:
    """k-means of unit vectors by inner products; an empty cell takes the vector that fits its own cell least."""
    centre = u[:cells].copy()
    for _ in range(ROUNDS):
        own, fit = _nearest(u, centre)
        total = np.zeros_like(centre)
        np.add.at(total, own, u)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centre)) == 0)
        total[empty] = u[np.argsort(fit, kind="stable")[: len(empty)]]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.divide(total, norm, out=total, where=norm > 0)
    return centre


def _nearest(u: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, fit = np.empty(len(u), np.int64), np.empty(len(u))
    for a in range(0, len(u), 4096):
        product = u[a : a + 4096] @ centre.T
        own[a : a + 4096] = product.argmax(axis=1)
        fit[a : a + 4096] = product.max(axis=1)
    return own, fit


@dataclass(frozen=True)
class Ivf:
    """A written index: means, and lists of codes by cell."""

    spark: SparkSession
    path: str

    @property
    def lists(self) -> DataFrame:
        """(cell, n, ids, steps, codes)"""
        return self.spark.read.parquet(f"{self.path}/lists")

    def size(self) -> int:
        """The number of cells."""
        return self.spark.read.parquet(f"{self.path}/means").count()

    def means(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/means").orderBy("cell").collect()
        return np.array([r["mean"] for r in rows])


def _encode(centre: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = unit_rows(batch.column(1))
            own, _ = _nearest(u, centre)
            order = np.argsort(own, kind="stable")
            own, rest = own[order], u[order] - centre[own[order]]
            step = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            code = np.round(rest / step[:, None]).astype(np.int8)
            ids = batch.column(0).take(pa.array(order))
            start = [a for first, n in zip(*_runs(own)) for a in range(first, first + n, PACK)]
            ends = [*start[1:], len(own)]
            lists = pa.ListArray.from_arrays(pa.array([*start, len(own)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[start]), pa.array([b - a for a, b in zip(start, ends)], pa.int64()), lists, *(pa.array([x[a:b].tobytes() for a, b in zip(start, ends)], pa.binary()) for x in (step.astype(np.float32), code))],
                ["cell", "n", "ids", "steps", "codes"],
            )

    return run


def _runs(sorted_values: np.ndarray) -> tuple[list[int], list[int]]:
    first = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return first.tolist(), np.diff(np.append(first, len(sorted_values))).tolist()


def build(vectors: DataFrame, cells: int | None = None, path: str | None = None) -> Ivf:
    """Index (id, embedding); by default with about the root of the number of vectors as cells."""
    spark = vectors.sparkSession
    path = path or scratch(spark, "ivf")
    total = vectors.count()
    number = max(1, min(CELLS, total, cells or round(total**0.5)))
    sample = vectors.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").coalesce(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unit_rows(b.column(0)) for b in batches if b.num_rows]
        if held:
            made = means(np.concatenate(held), number)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made))), pa.array(made.tolist(), pa.list_(pa.float64()))], ["cell", "mean"])

    sample.mapInArrow(learn, "cell long, mean array<double>").write.parquet(f"{path}/means")
    index = Ivf(spark, path)
    kind = vectors.schema["id"].dataType.simpleString()
    lists = vectors.select("id", "embedding").mapInArrow(_encode(index.means()), f"cell long, n long, ids array<{kind}>, steps binary, codes binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists.repartitionByRange(n, "cell").sortWithinPartitions("cell").write.parquet(f"{path}/lists")
    return index


def _probe(centre: np.ndarray, probes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, embedding) to (query_id, cell, base, query): the nearest cells of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit_rows(batch.column(1)) if batch.num_rows else np.zeros((0, centre.shape[1]))
            product = u @ centre.T
            cell = np.argsort(-product, axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(u)), cell.shape[1])
            query = pa.array([x.astype(np.float32).tobytes() for x in u], pa.binary())
            base = np.take_along_axis(product, cell, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cell.ravel()), pa.array(base.ravel()), query.take(pa.array(row))], ["query_id", "cell", "base", "query"])

    return run


def _scan(keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (cell, part, side), queries first, to the best (query_id, id, score) by codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asks, queries = None, [], None
        for batch in batches:
            ask_ids, row_ids = batch.column("query_id"), batch.column("ids")
            held = batch.select(["cell", "part", "side", "base", "query", "steps", "codes"]).to_pylist()
            out: list[tuple[list, list, np.ndarray]] = []
            for at, row in enumerate(held):
                if (row["cell"], row["part"]) != task:
                    task, asks, queries = (row["cell"], row["part"]), [], None
                if row["side"] == 0:
                    asks.append((ask_ids[at].as_py(), row["base"], row["query"]))
                    continue
                if not asks:
                    continue
                if queries is None:
                    queries = np.stack([np.frombuffer(a[2], np.float32) for a in asks]), np.array([a[1] for a in asks])
                step = np.frombuffer(row["steps"], np.float32)
                code = np.frombuffer(row["codes"], np.int8).reshape(len(step), -1).astype(np.float32)
                score = queries[1][:, None] + (queries[0] @ code.T) * step
                best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
                ids = row_ids[at].as_py()
                out.append(([a[0] for a in asks for _ in range(best.shape[1])], [ids[i] for i in best.ravel()], np.take_along_axis(score, best, axis=1).ravel()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for o in out for x in o[0]], ask_ids.type), pa.array([x for o in out for x in o[1]], row_ids.type.value_type), pa.array(np.concatenate([o[2] for o in out]).astype(np.float64))], ["query_id", "id", "score"])

    return run


def search(index: Ivf, vectors: DataFrame, queries: DataFrame, k: int, probes: int, rerank: int = 4) -> DataFrame:
    """(query_id, rank, id, score): top-k of the ``probes`` nearest cells; the best ``rerank`` x k by codes are scored exactly.

    vectors: (id, embedding), as indexed; queries: (query_id, embedding).
    """
    spark, lists = index.spark, index.lists
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select("query_id", "embedding")
    kind, id_kind = asked.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    near = asked.mapInArrow(_probe(index.means(), probes), f"query_id {kind}, cell long, base double, query binary")
    parts = lists.groupBy("cell").agg((F.floor(F.sum("n") / PART_ROWS) + 1).alias("parts"))  # no more rows than CELLS
    none = {"query_id": kind, "base": "double", "query": "binary", "ids": f"array<{id_kind}>", "steps": "binary", "codes": "binary"}
    columns = ["cell", "part", "side", *none]

    def shaped(df: DataFrame, side: int) -> DataFrame:
        return df.withColumn("side", F.lit(side)).select(*[c if c in df.columns or c == "side" else F.lit(None).cast(none[c]).alias(c) for c in columns])

    left = near.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = lists.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("codes"), F.col("parts")))
    tasks = shaped(left, 0).unionByName(shaped(right, 1)).repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "side")
    found = tasks.mapInArrow(_scan(rerank * k), f"query_id {kind}, id {id_kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    some = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rerank * k).select("query_id", "id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.einsum("ij,ij->i", unit_rows(batch.column(2)), unit_rows(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, 12))], ["query_id", "id", "score"])

    full = some.join(vectors.select("id", "embedding"), "id").join(asked.select("query_id", F.col("embedding").alias("asked")), "query_id")
    return top_k(full.select("query_id", "id", "embedding", "asked").mapInArrow(exact, f"query_id {kind}, id {id_kind}, score double"), k)
