"""Rank fusion, reranking and merging of hit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dense, lexical

RRF_K = 60
CANDIDATES, RERANKED, TOP_K = 30, 20, 8


def rrf_fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, rank, id, score) of (query_id, list_id, pos, id): sum of 1 / (k + pos).

    An id that repeats in a list counts at its first place only; the repeats
    still take up their places.
    """
    best = rankings.groupBy("query_id", "list_id", "id").agg(F.min("pos").alias("pos"))
    fused = best.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("pos"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id")
    return fused.select("query_id", F.row_number().over(order).alias("rank"), "id", "score")


def hybrid_retrieve(chunks: DataFrame, text: Column, vectors: DataFrame, queries: DataFrame, predicate: Column, candidates: int = CANDIDATES, top_k: int = TOP_K, indexed: lexical.Index | None = None) -> DataFrame:
    """(query_id, rank, id, score) from both rankings under one filter; blank queries and top_k <= 0 find nothing.

    ``queries``: query_id, query, embedding; ``indexed``: the written index of all chunks.
    """
    asked = queries.where((F.trim("query") != "") & F.lit(top_k > 0))
    allowed = chunks.where(predicate).select("id")
    near = dense.dense_search(vectors.join(allowed, "id", "left_semi"), asked, candidates)
    worded = lexical.bm25_search(chunks, text, asked, candidates, predicate, indexed)
    both = near.select("query_id", F.lit("dense").alias("list_id"), F.col("rank").alias("pos"), "id").unionByName(worded.select("query_id", F.lit("bm25").alias("list_id"), F.col("rank").alias("pos"), "id"))
    return rrf_fuse(both).where(F.col("rank") <= top_k)


def rerank(fused: DataFrame, relevance: DataFrame, top_k: int = TOP_K, candidates: int = RERANKED) -> DataFrame:
    """The first ``candidates`` in the order of a given relevance (query_id, id, relevance), which becomes the score."""
    known = fused.where(F.col("rank") <= candidates).join(relevance, ["query_id", "id"])
    order = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "rank")
    return known.select("query_id", "id", F.col("relevance").alias("score"), F.row_number().over(order).alias("new_rank")).where(F.col("new_rank") <= top_k).select("query_id", F.col("new_rank").alias("rank"), "id", "score")


def merge_sources(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Concatenated groups of hits: of each (case keys, id) the first row stays; ``pos`` is its place."""
    first = Window.partitionBy(*keys, "id").orderBy(*order)
    place = Window.partitionBy(*keys).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("pos", F.row_number().over(place))


def web_hits_to_sources(hits: DataFrame) -> DataFrame:
    """Hits (case_id, query, rank, title, url, snippet, ...) as sources with ids, host and score."""
    seed = F.coalesce(F.when(F.col("url") != "", F.col("url")), F.concat("title", F.lit("|"), F.coalesce("snippet", F.lit(""))))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return hits.withColumns(
        {
            "id": F.concat(F.lit("web_"), F.substring(F.sha1(F.encode(seed, "UTF-8")), 1, 12)),
            "section": F.nullif(F.lower(host), F.lit("")),
            "score": F.greatest(F.lit(0.0), F.round(1 - 0.05 * (F.col("rank") - 1), 6)),
            "source_type": F.lit("web"),
        }
    )


def web_batch_merge(queries: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged hits of each case, and per case the number of failed queries.

    ``queries``: case_id, pos, query, failed.  Queries are trimmed and
    repeated ones dropped; hits follow query order, then rank.
    """
    asked = queries.withColumn("query", F.trim("query")).where("query != ''")
    once = Window.partitionBy("case_id", "query").orderBy("pos")
    asked = asked.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    met = asked.where("NOT failed").select("case_id", "query", F.col("pos").alias("query_pos")).join(hits, ["case_id", "query"])
    merged = merge_sources(web_hits_to_sources(met), ["case_id"], ["query_pos", "rank", "title"])
    errors = asked.groupBy("case_id").agg(F.count_if("failed").alias("failed_queries"), F.bool_or("failed").alias("web_search_failed"))
    return merged, errors
