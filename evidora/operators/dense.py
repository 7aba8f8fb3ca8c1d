"""Vectors: deterministic embeddings, checks and exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .lexical import top_k

DIM = 64
BLOCK_QUERIES = 1024
CHUNK_VECTORS = 8192


def hash_embed(chunks: DataFrame, text: Column, dim: int = DIM) -> DataFrame:
    """(id, embedding): token counts in md5 buckets, with length 1."""
    words = chunks.select("id", F.explode(tokenize(text)).alias("t"))
    # dim divides 16**7, so the last seven digits are enough.
    bucket = F.conv(F.substring(F.md5("t"), -7, 7), 16, 10).cast("long") % dim
    counts = words.groupBy("id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    held = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("norm"))
    empty = F.array_repeat(F.lit(0.0), dim)
    return chunks.select("id").join(held, "id", "left").select("id", F.when(F.col("norm").isNotNull(), vector).otherwise(empty).alias("embedding"))


def check_vectors(vectors: DataFrame, dim: int | None = None, column: str = "embedding") -> DataFrame:
    """One row (n, min_dim, max_dim, ok): all of one positive length, the stored one if given."""
    size = F.size(column)
    found = vectors.agg(F.count("*").alias("n"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))
    ok = (F.col("min_dim") == F.col("max_dim")) & (F.col("min_dim") > 0)
    return found.withColumn("ok", F.coalesce(ok if dim is None else ok & (F.col("min_dim") == dim), F.lit(False)))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): exact cosine top-k of (query_id, embedding) among (id, embedding).

    Queries are packed in Spark into blocks of ``BLOCK_QUERIES`` rows, vectors into
    chunks of ``CHUNK_VECTORS``.  Every chunk meets every block in a task of its own
    and gives the block's top k of the chunk, so only k rows a query and chunk are
    shuffled and neither side passes the driver.
    """
    id_type, query_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def packed(df: DataFrame, key: str, per: int, name: str) -> DataFrame:
        n = F.greatest(F.lit(1), F.ceil(F.count("*") / per)).cast("int").alias("n")
        dealt = df.join(F.broadcast(df.agg(n))).withColumn(name, F.pmod(F.xxhash64(key), F.col("n")))
        return dealt.groupBy(name).agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col("embedding").alias("v"))).alias(f"{name}_rows"))

    chunks, blocks = packed(vectors, "id", CHUNK_VECTORS, "chunk"), packed(queries, "query_id", BLOCK_QUERIES, "block")
    last = queries.agg((F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_QUERIES)).cast("long") - 1).alias("last"))
    tasks = chunks.join(F.broadcast(last)).select("chunk_rows", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block")).join(blocks, "block").select("chunk_rows", "block_rows")

    def matrix(rows: pa.ListScalar) -> tuple[pa.Array, np.ndarray]:
        held = rows.values
        keys, flat = held.field("key"), held.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return keys, _unit(flat.reshape(len(keys), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, asked in zip(batch.column(0), batch.column(1)):
                (keys, wide), (ids, narrow) = matrix(held), matrix(asked)
                order = pa.compute.sort_indices(keys).to_numpy()
                cosine = np.round(narrow @ wide[order].T, 12)
                best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                asker = np.repeat(np.arange(len(ids)), best.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(asker)), keys.take(pa.array(order[best].ravel())), pa.array(np.take_along_axis(cosine, best, axis=1).ravel())], ["query_id", "id", "score"])

    return top_k(tasks.mapInArrow(run, f"query_id {query_type}, id {id_type}, score double"), k)


def dense_search_native(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same by Spark expressions, for small data and as a check."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    v = vectors.select("id", F.col("embedding").alias("v"))
    q = queries.select("query_id", F.col("embedding").alias("q"))
    norm = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q")))
    return top_k(v.join(F.broadcast(q)).select("query_id", "id", F.round(F.coalesce(F.try_divide(dot(F.col("v"), F.col("q")), norm), F.lit(0.0)), 12).alias("score")), k)
