"""Mixing sources to target weights (operator 6).

1. Sources get weights 5, 2, 1, 5, 2, 1, ... in code-point order, null last.
   They share ``TOTAL`` times all words by weight; a target stops at ``MOST``
   times its source's words, and the excess is shared again by weight.
2. A source's words, documents in the order of doc_id, are packed into blocks
   of ``BLOCK`` words.  A source takes as many slots as its target needs.
3. For every output shard, multinomial draws (seeded by source and shard
   range) say how many of each source's slots it holds.  The draws are made
   under the condition that a source's slots over all shards add up to its
   target (a sum of free draws would miss it, and could pass the limit of
   ``MOST`` times), so a shard holds about ``SHARD_BLOCKS`` slots, not exactly.
4. Slot j of a source reads block P(j mod B) of its B blocks, where P is a
   pseudorandom permutation (a keyed Feistel network on the next power of
   four, walked until it lands below B) that differs for each pass over the
   source.  So every block is read before any is read again.
5. Slots and pieces of documents meet in a join by (source, block).

No step holds a source in one task: running sums go through id ranges, and
joins are by block.

Defined cases: null texts have no words; documents without words take nothing;
null ids come first; repeated rows are separate documents; an empty table or
one without words gives targets 0; extra columns are kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, map_arrow, partitions, running_before
from .textblock import blocks, mix as scramble, words

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
BLOCK = 64
SHARD_BLOCKS = 4096
FANOUT = 1024
SEED = 20240607
BATCH = 1 << 16


def _sizes_partition(text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(words(data, offsets)[2]) for _, _, data, offsets in blocks(batch.column(text_at))]
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != text_at), pa.array(size, pa.int64())], [*(n for i, n in enumerate(batch.schema.names) if i != text_at), "size"])

    return run


def targets(sizes: DataFrame) -> DataFrame:
    """(sid, source, source_size, target): one row a source of a table (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    table = cut(totals.select(place.alias("sid"), "source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * float(MOST)
    whole = (table.agg(F.sum("source_size")).first()[0] or 0) * TOTAL
    level = 0.0
    while True:
        full = F.col("weight") * level >= cap
        found = table.agg(F.sum(F.when(full, cap)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        higher = (whole - (found.taken or 0.0)) / found.weights if found.weights else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return table.select("sid", "source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Where a keyed pseudorandom permutation of 0 .. size - 1 takes the indices."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = scramble(np.uint64(key & (1 << 64) - 1) + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (scramble(right ^ k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _large(rows: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of few rows each, gathered to batches of about ``BATCH`` rows."""
    held: list[list[np.ndarray]] = []
    for columns in rows:
        held.append(columns)
        if sum(len(c[0]) for c in held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held)], names)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for sid, n_blocks, lo, hi, offset, n in zip(*(c.to_pylist() for c in batch.columns)):
            edges = np.unique(np.linspace(lo, hi, min(FANOUT, hi - lo) + 1).astype(np.int64))
            rng = np.random.default_rng([SEED, sid, lo, hi])
            counts = rng.multinomial(n, np.diff(edges) / (hi - lo))
            some = counts > 0
            at = offset + np.cumsum(counts) - counts
            k = int(some.sum())
            yield [np.full(k, sid), np.full(k, n_blocks), edges[:-1][some], edges[1:][some], at[some], counts[some]]


def _split_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Draw how the slots of a shard range fall on up to FANOUT parts of it."""
    return _large(_split(batches), ["sid", "n_blocks", "lo", "hi", "offset", "n"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for sid, n_blocks, shard, _, offset, n in zip(*(c.to_pylist() for c in batch.columns)):
            for a in range(0, n, 1 << 16):
                slot = offset + np.arange(a, min(n, a + (1 << 16)))
                turn, index = slot // n_blocks, slot % n_blocks
                block = np.empty(len(slot), np.int64)
                for t in np.unique(turn):
                    block[turn == t] = permuted(index[turn == t], n_blocks, SEED * 1_000_003 + sid * 65_537 + int(t))
                yield [np.full(len(slot), sid), block, turn, np.full(len(slot), shard), slot]


def _slots_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block, pass and place of every slot."""
    return _large(_slots(batches), ["sid", "block", "turn", "shard", "slot"])


def slots(table: DataFrame) -> DataFrame:
    """(sid, block, turn, shard, slot) for a table of targets; shards hold about SHARD_BLOCKS slots."""
    n_blocks = F.ceil(F.col("source_size") / BLOCK)
    plan = table.where("source_size > 0").select("sid", n_blocks.alias("n_blocks"), F.round(F.col("target") / F.col("source_size") * n_blocks).cast("long").alias("n"))
    shards = max(1, -(-int(plan.agg(F.sum("n")).first()[0] or 0) // SHARD_BLOCKS))
    parts = plan.select(F.col("sid").cast("long").alias("sid"), "n_blocks", F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.lit(0).cast("long").alias("offset"), "n")
    reach = 1
    while True:
        parts = parts.transform(map_arrow, _split_partition, "sid long, n_blocks long, lo long, hi long, offset long, n long")
        reach *= FANOUT
        if reach >= shards:
            break
    # A fixed number of partitions: by their size, these few rows would all go to one task, and each makes many slots.
    spread = parts.repartition(partitions(table.sparkSession), "sid", "lo")
    return spread.transform(map_arrow, _slots_partition, "sid long, block long, turn long, shard long, slot long")


def placed(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Targets, and every document row with its size and its place in its source's words."""
    rows = docs.select("doc_id", "source", *columns, F.xxhash64("text").alias("_tie"), "text")
    schema = rows.drop("text").withColumn("size", F.lit(0).cast("long")).schema
    sized = cut(rows.transform(map_arrow, _sizes_partition(len(rows.columns) - 1), schema))
    table = targets(sized.select("source", "size"))
    table = cut(table)
    named = sized.join(table.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ordered = named.withColumn("_order", F.struct(F.col("doc_id"), F.col("_tie"), F.col("size")))
    return table, running_before(ordered, "size", "doc_id", "start", ["sid"], "_order").drop("_order")


def _pieces(rows: DataFrame) -> DataFrame:
    """One row for each block that a document reaches into, with its words there."""
    last = F.col("start") + F.col("size") - 1
    spans = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(last / BLOCK))))
    begin, end = F.greatest(F.col("start"), F.col("block") * BLOCK), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return spans.withColumns({"from_word": (begin - F.col("start")).cast("long"), "to_word": (end - F.col("start")).cast("long")})


def taken(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, taken."""
    table, rows = placed(docs, [])
    # Slots come from the small table of targets but grow with the words: never a broadcast.
    times = slots(table).groupBy("sid", "block").agg(F.count("*").alias("times"))
    keys = ["sid", "start", "doc_id", "size", "source_size", "target"]
    used = _pieces(rows).select(*keys, "block", (F.col("to_word") - F.col("from_word")).alias("words")).join(times.hint("merge"), ["sid", "block"], "left")
    mixed = used.groupBy(*keys).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    empty = rows.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return mixed.unionByName(empty).select("doc_id", "size", "source_size", "target", "taken")


def _cut_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, runs) to the row's columns with the texts of runs of words, one row a run; a run of all words is the whole text."""
    for batch in batches:
        names = [f.name for f in batch.column(0).type]
        table = pa.RecordBatch.from_arrays(batch.column(0).flatten(), names)
        text_at = names.index("text")
        for a, b, data, offsets in blocks(table.column(text_at)):
            starts, ends, first = words(data, offsets)
            source, texts = [], []
            for i, spans in enumerate(batch.column(1).slice(a, b - a).to_pylist()):
                merged: list[list[int]] = []
                for s, e in sorted((x["from_word"], x["to_word"]) for x in spans):
                    if merged and merged[-1][1] == s:
                        merged[-1][1] = e
                    else:
                        merged.append([s, e])
                n = int(first[i + 1] - first[i])
                for s, e in merged:
                    lo = offsets[i] if s == 0 else starts[first[i] + s]
                    hi = offsets[i + 1] if e == n else ends[first[i] + e - 1]
                    source.append(a + i)
                    texts.append(data[lo:hi].tobytes().decode())
            taken_rows = table.take(pa.array(source, pa.int64()))
            columns = list(taken_rows.columns)
            columns[text_at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([len(t) for t in texts], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents, with the columns of ``docs``, whatever their names.

    Every pass over a source gives the runs of words it takes from a document:
    the whole text, or parts of it cut at block borders, one row a run.
    ``n_chars`` follows the text.
    """
    table, rows = placed(docs.select("doc_id", "source", "text"), [])
    spans = _pieces(rows).select("sid", "block", "doc_id", "_tie", "size", "start", "from_word", "to_word")
    used = spans.join(slots(table).select("sid", "block", "turn").hint("merge"), ["sid", "block"])
    runs = used.groupBy("sid", "start", "doc_id", "_tie", "turn").agg(F.collect_list(F.struct("from_word", "to_word")).alias("runs"))
    # Equal rows have equal ids and texts: number them on both sides, so that each run meets one row.
    runs = runs.withColumn("_n", F.dense_rank().over(Window.partitionBy("doc_id", "_tie", "sid").orderBy("start")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("_tie"))
    texts = whole.join(table.select("sid", F.col("source").alias("_source")), F.col("row.source").eqNullSafe(F.col("_source")))
    texts = texts.select("row", "sid", "_tie", F.row_number().over(Window.partitionBy("row.doc_id", "_tie", "sid").orderBy("sid")).alias("_n"))
    runs = runs.select(F.col("sid").alias("_s"), F.col("doc_id").alias("_d"), F.col("_tie").alias("_t"), F.col("_n").alias("_m"), "runs")
    met = texts.join(runs.hint("merge"), (F.col("sid") == F.col("_s")) & F.col("row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_tie") == F.col("_t")) & (F.col("_n") == F.col("_m")))
    return met.select("row", "runs").transform(map_arrow, _cut_partition, docs.schema)
