"""BM25: an inverted index of blocks, and search for many queries at once.

Chunks are numbered in the order of their ids and cut into segments of ``SEGMENT``
numbers.  A block holds what one term has in one segment: delta-coded numbers, term
frequencies, and ``peak``, the largest part of a score that any of them can give.
Blocks are written by term: to ``SHARDS`` folders by its hash, sorted inside.

A search reads the shards of its terms only.  Blocks meet the queries that ask for
their term, and (segment, block of queries) is one small task: scores are sums in
a dense array of queries x segment.  A task keeps the k best of each query so far, and
leaves out the queries whose peaks in a segment cannot reach them.  So what is
shuffled is blocks, and k rows a query and task; no row for each query and posting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.store import scratch

K1, B, FLOOR = 1.5, 0.75, 0.25
SEGMENT = 4096
SHARDS = 64
QUERIES = 256  # of a task, on average
DIGITS = 9  # scores are compared after rounding


def tokens(chunks: DataFrame, text: Column) -> DataFrame:
    """(id, tokens); the only step that reads texts."""
    return chunks.select("id", tokenize(text).alias("tokens"))


def postings(tokenized: DataFrame) -> DataFrame:
    """(id, term, tf); counts combine before the shuffle."""
    return tokenized.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def doc_lengths(tokenized: DataFrame) -> DataFrame:
    return tokenized.select("id", F.size("tokens").alias("dl"))


@dataclass(frozen=True)
class Index:
    """The tables of a written index."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def chunks(self) -> DataFrame:
        """(number, id, dl)"""
        return self._table("chunks").select("number", "id", "dl")

    @property
    def segments(self) -> DataFrame:
        """(segment, places, lengths)"""
        return self._table("segments")

    @property
    def blocks(self) -> DataFrame:
        """(term, segment, n, places, tfs, peak, shard)"""
        return self._table("blocks")

    @property
    def terms(self) -> DataFrame:
        """(term, df, idf)"""
        return self._table("terms")

    @property
    def average(self) -> float:
        return self._table("sizes").first()["average"]


def _binaries(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """One binary value for each run of ``values`` that begins at ``start``."""
    offsets = (np.append(start, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _part(tf: np.ndarray, dl: np.ndarray, average: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _invert(average: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(number, tokens) in order to blocks; a segment that two batches share gives two blocks of a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, number = batch.num_rows, batch.column(0).to_numpy()
            dl = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            coded = batch.column(1).flatten().dictionary_encode()
            if not len(coded):
                continue
            pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), dl), return_counts=True)
            code, row = pair // n, pair % n
            segment, place = number[row] // SEGMENT, number[row] % SEGMENT
            start = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (segment[1:] != segment[:-1])))
            delta = np.diff(place, prepend=0)
            delta[start] = place[start]
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(code[start])),
                    pa.array(segment[start]),
                    pa.array(np.diff(np.append(start, len(tf)))),
                    _binaries(delta.astype(np.uint16), start),
                    _binaries(tf.astype(np.uint16 if tf.max() < 65536 else np.uint32), start),
                    pa.array(np.maximum.reduceat(_part(tf, dl[row], average), start)),
                ],
                ["term", "segment", "n", "places", "tfs", "peak"],
            )

    return run


def _shard() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int")


def index(chunks: DataFrame, text: Column, path: str | None = None) -> Index:
    """Write the index of chunks (id, text) below ``path``, by default in the shared folder.

    Ids are unique.  Texts are read and cut once; negative idf becomes a quarter
    of the mean idf of all terms.
    """
    spark = chunks.sparkSession
    path = path or scratch(spark, "bm25")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ordered before they are cut: finding the ranges reads ids only.
    cut = tokens(chunks.select("id", text.alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id"), F.col("text"))
    cut.select(F.monotonically_increasing_id().alias("number"), "id", F.size("tokens").alias("dl"), "tokens").write.parquet(f"{path}/chunks")
    built = Index(spark, path)
    held = spark.read.parquet(f"{path}/chunks")
    held.agg(F.count("*").alias("n"), F.avg("dl").alias("average")).coalesce(1).write.parquet(f"{path}/sizes")
    size = spark.read.parquet(f"{path}/sizes").first()
    place = (F.col("number") % SEGMENT).cast("int")
    rows = held.groupBy(F.floor(F.col("number") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "dl"))).alias("rows"))
    rows.select("segment", F.col("rows.place").alias("places"), F.col("rows.dl").alias("lengths")).write.parquet(f"{path}/segments")
    blocks = held.select("number", "tokens").mapInArrow(_invert(size["average"] or 1.0), "term string, segment long, n long, places binary, tfs binary, peak double")
    blocks.withColumn("shard", _shard()).repartition(n, "shard").sortWithinPartitions("shard", "term", "segment").write.partitionBy("shard").parquet(f"{path}/blocks")
    df = built.blocks.groupBy("term").agg(F.sum("n").alias("df"))
    raw = df.select("term", "df", (F.log(size["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw"))
    raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf")).write.parquet(f"{path}/terms")
    return built


def terms(indexed: Index) -> DataFrame:
    """(term, df, idf) of an index."""
    return indexed.terms


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): tokens with their multiplicity."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


class _Best:
    """The k best (score, number) of each query of a block so far."""

    def __init__(self, k: int):
        self.k = k
        self.q, self.number, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.zeros(0)

    def add(self, q: np.ndarray, number: np.ndarray, score: np.ndarray) -> None:
        q, number, score = (np.concatenate(x) for x in ((self.q, q), (self.number, number), (self.score, score)))
        order = np.lexsort((number, -np.round(score, DIGITS), q))
        q, number, score = q[order], number[order], score[order]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        keep = rank < self.k
        self.q, self.number, self.score = q[keep], number[keep], score[keep]
        full = rank[keep] == self.k - 1
        self.floor = np.full(int(self.q.max(initial=-1)) + 1, -np.inf)
        self.floor[self.q[full]] = self.score[full]


def _score_segment(segment: int, lengths: np.ndarray, allowed: np.ndarray, rows: list[tuple], best: _Best, average: float) -> None:
    """Add the best of one segment; rows: (places, tfs, peak, queries, weights) in order of their terms."""
    width = max(max(r[3]) for r in rows) + 1
    bound = np.zeros(width)
    for _, _, peak, asks, weights in rows:
        np.add.at(bound, asks, np.maximum(weights, 0) * peak)
    floor = np.full(width, -np.inf)
    floor[: len(best.floor)] = best.floor[:width]
    live = bound >= floor - 10.0**-DIGITS
    if not live.any():
        return
    score = np.zeros((width, SEGMENT))
    for places, tfs, _, asks, weights in rows:
        asks, weights = np.asarray(asks), np.asarray(weights)
        some = live[asks]
        if some.any():
            place = np.cumsum(np.frombuffer(places, np.uint16), dtype=np.int64)
            tf = np.frombuffer(tfs, np.uint16 if len(tfs) == len(places) else np.uint32).astype(float)
            score[np.ix_(asks[some], place)] += weights[some, None] * _part(tf, lengths[place], average)
    score[:, ~allowed] = 0
    least = floor
    if best.k < SEGMENT:
        least = np.maximum(floor, np.partition(score, SEGMENT - best.k, axis=1)[:, SEGMENT - best.k])
    q, place = np.nonzero((score > 0) & (score >= least[:, None] - 10.0**-DIGITS))
    best.add(q, segment * SEGMENT + place, score[q, place])


def _score(k: int, average: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (block, segment, term), the segment's own row (no term) first, to (block, q, number, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, lengths, allowed, rows, best = None, None, None, [], _Best(k)

        def found() -> Iterator[pa.RecordBatch]:
            if len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.q), task[0])), pa.array(best.q), pa.array(best.number), pa.array(best.score)], ["block", "q", "number", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["segment"]) != task:
                    if rows:
                        _score_segment(task[1], lengths, allowed, rows, best, average)
                    if task is not None and task[0] != row["block"]:
                        yield from found()
                        best = _Best(k)
                    task, rows = (row["block"], row["segment"]), []
                    lengths, allowed = np.zeros(SEGMENT), np.zeros(SEGMENT, bool)
                if row["term"] is None:
                    lengths[row["at"]], allowed[row["allowed"]] = row["lengths"], True
                elif allowed.any():
                    rows.append((row["places"], row["tfs"], row["peak"], row["asks"], row["weights"]))
        if rows:
            _score_segment(task[1], lengths, allowed, rows, best, average)
        yield from found()

    return run


def search(indexed: Index, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score) of the k best chunks with a positive score; ties by id.

    ``allowed`` (id) chooses among the scored chunks; statistics come from all.
    """
    spark = indexed.spark
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weighed = query_terms(queries).join(indexed.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    blocks = max(1, -(-queries.count() // QUERIES))
    numbered = queries.select("query_id").distinct().withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("long"))
    numbered = numbered.withColumn("q", F.row_number().over(Window.partitionBy("block").orderBy("query_id")).cast("long") - 1)
    asks = weighed.join(numbered, "query_id").groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("q", "weight"))).alias("asks"))
    asks = asks.select("term", "block", F.col("asks.q").alias("asks"), F.col("asks.weight").alias("weights"))
    shards = [r[0] for r in asks.select(_shard().alias("shard")).distinct().collect()]
    met = indexed.blocks.where(F.col("shard").isin(shards)).join(asks, "term")

    own = indexed.segments
    if allowed is None:
        own = own.withColumn("allowed", F.col("places"))
    else:
        held = indexed.chunks.join(allowed.select("id"), "id", "left_semi")
        held = held.groupBy(F.floor(F.col("number") / SEGMENT).alias("segment")).agg(F.collect_list((F.col("number") % SEGMENT).cast("int")).alias("allowed"))
        own = own.join(held, "segment")
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def none(kind: str) -> Column:
        return F.lit(None).cast(kind)

    ints, doubles = "array<int>", "array<double>"
    rows = met.select("block", "segment", "term", "places", "tfs", "peak", "asks", "weights", none(ints).alias("at"), none(ints).alias("lengths"), none(ints).alias("allowed"))
    heads = own.select("block", "segment", none("string").alias("term"), none("binary").alias("places"), none("binary").alias("tfs"), none("double").alias("peak"), none("array<long>").alias("asks"), none(doubles).alias("weights"), F.col("places").alias("at"), "lengths", "allowed")
    tasks = heads.unionByName(rows).repartition(n, "block", "segment").sortWithinPartitions("block", "segment", F.asc_nulls_first("term"))
    scored = tasks.mapInArrow(_score(k, indexed.average or 1.0), "block long, q long, number long, score double")
    order = Window.partitionBy("block", "q").orderBy(F.round("score", DIGITS).desc(), "number")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = top.join(numbered, ["block", "q"]).join(indexed.chunks.select("number", "id"), "number")
    return named.select("query_id", "id", "score", "rank")


def top_k(scored: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """(query_id, rank, id, score): best first, ties by id; scores are compared after rounding."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_search(chunks: DataFrame, text: Column, queries: DataFrame, k: int, predicate: Column | None = None, indexed: Index | None = None) -> DataFrame:
    """Search an index of all chunks, written now if none is given; the predicate only chooses among the scored ones."""
    allowed = None if predicate is None else chunks.where(predicate).select("id")
    return search(indexed or index(chunks, text), queries, k, allowed)


def require_index(chunks: DataFrame) -> DataFrame:
    """The chunks; an empty table or a repeated id is an error."""
    from .chunking import require_unique

    if not chunks.limit(1).count():
        raise ValueError("no chunks to index")
    return require_unique(chunks)
