"""Hard-negative mining by slots of the score (operator 11).

An anchor's positives are its best rows of the same label.  For each of them the
wanted negatives are the best rows of other labels whose score lies in a window
below the positive's: from ``low`` to ``high`` percent of it.  The windows of one
anchor overlap, so they are not searched one by one:

1. The upper limits of its positives, descending, cut the scores into disjoint
   slots; slot i holds what lies above limit i + 1 and not above limit i.
2. Tasks keep the top k of each slot (combiners: the top k of two parts is the
   top k of their union), and Spark the top k of what the tasks send.
3. What lies below limit i is the union of slots i, i + 1, ...: merging the slots
   from the lowest up gives the top k under every limit in one descent.  What is
   below the lower limit of a window comes last there, so it is cut afterwards.

Anchors and rows meet in tiles: rows are dealt to chunks, anchors to blocks, and
every (block, chunk) is one task's work, whose scores are never held for more
than ``STEP`` rows.  A tile costs block x chunk x width multiplications, but only
block + chunk rows moved, so work outweighs what is shuffled by some thousand
operations a byte; no anchor and no row passes the driver.

Defined cases: rows without id, label or vector, and with null or non-finite
entries, take no part.  Rows that repeat id, label and vector count once.  Several
rows under one id are rows of their own, but no partners of each other; equal
scores go by id, then by a hash of the row.  Shorter vectors end in zeros.
Components become floor(scale * x); scores are exact, and held at the ends of a
long if they are larger.  Other columns are not looked at; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, map_arrow, partitions
from .vectors import matrix, whole_products, widen

PACK_BYTES = 4096  # so that the 10,000 rows of an Arrow batch stay small
BLOCK_BYTES = 1 << 23  # of the anchors in a tile
CHUNK_ROWS = 1 << 16  # of the others in a tile
STEP, ANCHORS = 2048, 512  # scores held at once
LONG = 0x7FFFFFFFFFFFFFFF
PACK = "ids binary, labels binary, tags binary, scores binary, wide int, short boolean, data binary"
FOUND = "anchor_id long, anchor_tag long, slot int, id long, tag long, score long"
KEY = ["anchor_id", "anchor_tag"]


def percent_floor(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100) without overflow."""
    return percent * (score // 100) + percent * (score % 100) // 100


def percent_ceil(score: np.ndarray, percent: int) -> np.ndarray:
    return percent * (score // 100) - (-percent * (score % 100)) // 100


def _packs(scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (vec_id, label, tag, scores, embedding) as packs of about ``PACK_BYTES``, with whole components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, good = matrix(batch.column(4))
            at = np.flatnonzero(good)
            if not len(at):
                continue
            m = np.floor(m[at] * scale)
            short = bool(np.abs(m).max(initial=0) < 32768)
            m = m.astype(np.int16 if short else np.float64)
            fields = [batch.column(i).to_numpy(zero_copy_only=False)[at].astype(np.int64) for i in range(3)]
            fields.append(batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)[at])
            per = max(1, PACK_BYTES // max(1, m.itemsize * m.shape[1]))
            cuts = [slice(i, i + per) for i in range(0, len(at), per)]
            columns = [pa.array([f[c].tobytes() for c in cuts], pa.binary()) for f in fields]
            columns += [pa.array([m.shape[1]] * len(cuts), pa.int32()), pa.array([short] * len(cuts)), pa.array([m[c].tobytes() for c in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "labels", "tags", "scores", "wide", "short", "data"])

    return run


class _Rows:
    """Rows of several packs."""

    def __init__(self, packs: list[dict], order: bool = False):
        self.id, self.label, self.tag, scores = (np.concatenate([np.frombuffer(p[c], np.int64) for p in packs]) for c in ("ids", "labels", "tags", "scores"))
        wide = max(p["wide"] for p in packs)
        parts = [np.frombuffer(p["data"], np.int16 if p["short"] else np.float64).reshape(-1 if p["wide"] else len(p["ids"]) // 8, p["wide"]).astype(np.float64) for p in packs]
        self.m, self.scores = np.concatenate([widen(m, wide) for m in parts]), scores.reshape(len(self.id), -1)
        if order:
            at = np.lexsort((self.tag, self.id))
            self.id, self.label, self.tag, self.scores, self.m = self.id[at], self.label[at], self.tag[at], self.scores[at], self.m[at]


def best(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Places of the k best of each group, group by group: highest score, then smallest id and tag."""
    order = np.lexsort((tags, ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


class _Best:
    """The k best rows of each group of one block, kept while tiles go by."""

    def __init__(self, k: int, groups: int):
        self.k = k
        self.held = [np.zeros(0, np.int64)] * 4  # group, score, id, tag
        self.floor = np.full(groups, -LONG)  # the k-th best so far

    def add(self, *rows: np.ndarray) -> None:
        some = rows[1] >= self.floor[rows[0]]
        new = [np.concatenate((h, x[some])) for h, x in zip(self.held, rows)]
        keep = best(self.k, *new)
        self.held = [x[keep] for x in new]
        full = np.flatnonzero(np.bincount(self.held[0], minlength=len(self.floor)) == self.k)
        self.floor[full] = self.held[1][np.searchsorted(self.held[0], full, side="right") - 1]


#: Slots, or -1, of the scores of some anchors against some rows.
Pick = Callable[[_Rows, slice, _Rows, np.ndarray], np.ndarray]


def _tiles(k: int, slots: int, pick: Pick) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of each slot, from packs sorted by (block, chunk, side), anchors (side 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, packs, rows, waiting = None, [], [], 0
        anchors: _Rows | None = None
        state: _Best | None = None

        def compare() -> None:
            nonlocal anchors, state, rows, waiting
            if rows and packs:
                if anchors is None:
                    anchors = _Rows(packs, order=True)  # the same in every tile of a block
                state = state or _Best(k, slots * len(anchors.id))
                other = _Rows(rows)
                width = max(anchors.m.shape[1], other.m.shape[1])
                other.m, anchors.m = widen(other.m, width), widen(anchors.m, width)
                for lo in range(0, len(anchors.id), ANCHORS):
                    score = whole_products(anchors.m[lo : lo + ANCHORS], other.m)
                    if score.dtype == object:
                        score = np.clip(score, -LONG, LONG).astype(np.int64)
                    slot = pick(anchors, slice(lo, lo + ANCHORS), other, score)
                    i, j = np.nonzero(slot >= 0)
                    state.add((lo + i) * slots + slot[i, j], score[i, j], other.id[j], other.tag[j])
            rows, waiting = [], 0

        def found() -> Iterator[pa.RecordBatch]:
            if state is not None and len(state.held[0]):
                group, score, ids, tags = state.held
                of = group // slots
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.id[of], anchors.tag[of], (group % slots).astype(np.int32), ids, tags, score)], ["anchor_id", "anchor_tag", "slot", "id", "tag", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["chunk"]) != tile:
                    compare()
                    if tile is not None and row["block"] != tile[0]:
                        yield from found()
                        anchors = state = None
                    tile, packs = (row["block"], row["chunk"]), []
                if row["side"] == 0:
                    packs.append(row)
                else:
                    rows.append(row)
                    waiting += len(row["ids"]) // 8
                    if waiting >= STEP:
                        compare()
        compare()
        yield from found()

    return run


def _same_label(anchors: _Rows, part: slice, other: _Rows, score: np.ndarray) -> np.ndarray:
    return np.where((anchors.label[part, None] == other.label) & (anchors.id[part, None] != other.id), 0, -1).astype(np.int8)


def _slots(low: int, high: int) -> Pick:
    def pick(anchors: _Rows, part: slice, other: _Rows, score: np.ndarray) -> np.ndarray:
        positives = anchors.scores[part]
        least = np.where(positives > -LONG, positives, LONG).min(axis=1)
        may = (anchors.label[part, None] != other.label) & (score <= percent_floor(positives[:, :1], high)) & (score >= percent_ceil(np.maximum(least, 0), low)[:, None])
        slot = np.full(score.shape, -1, np.int8)
        i, j = np.nonzero(may)
        slot[i, j] = (percent_floor(positives[i], high) >= score[i, j, None]).sum(axis=1) - 1
        return slot

    return pick


def _top(packs: DataFrame, anchors: DataFrame, wide: int, k: int, slots: int, pick: Pick) -> DataFrame:
    """The k best rows of each anchor and slot."""
    n = partitions(packs.sparkSession)
    size = F.octet_length("ids") / 8
    rows, asked = (df.agg(F.sum(size).cast("long")).first()[0] or 0 for df in (packs, anchors))
    blocks, chunks = -(-asked * max(wide, 1) * 8 // BLOCK_BYTES) or 1, max(-(-rows // CHUNK_ROWS), 1)
    chunks = max(chunks, -(-n // blocks))  # no fewer tiles than tasks
    own = F.pmod(F.xxhash64("ids", "tags"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("ids", "tags"), F.lit(chunks)).cast("int")
    left = anchors.select("*", own[0].alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("side"))
    right = packs.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), own[1].alias("chunk"), F.lit(1).alias("side"))
    tiles = left.unionByName(right.select(left.columns)).repartition(n, "block", "chunk").sortWithinPartitions("block", "chunk", "side")
    ranked = Window.partitionBy(*KEY, "slot").orderBy(F.desc("score"), "id", "tag")
    return tiles.transform(map_arrow, _tiles(k, slots, pick), FOUND).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from (vec_id, label, embedding) rows.

    ``anchors`` says which rows are anchors.  A negative fits a positive if
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    known = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    known = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.xxhash64("label", "embedding").alias("tag"), "embedding", F.coalesce(anchors, F.lit(False)).alias("asks"))
    known = cut(known.dropDuplicates(["vec_id", "tag"]))
    wide = known.agg(F.max(F.size("embedding"))).first()[0] or 0

    def packed(df: DataFrame, scores: Column) -> DataFrame:
        return cut(df.select("vec_id", "label", "tag", scores.alias("scores"), "embedding").transform(map_arrow, _packs(scale), PACK))

    none = F.array_repeat(F.lit(-LONG), positives)
    rows, asking = packed(known, none), known.where("asks")
    near = cut(_top(rows, packed(asking, none), wide, positives, 1, _same_label).select(*KEY, "rank", "id", "tag", "score"))
    of = near.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))), lambda p: p.dropFields("rank")).alias("positives"))
    scores = F.slice(F.concat(F.col("positives.score"), none), 1, positives)
    limited = asking.join(of, (F.col("vec_id") == F.col("anchor_id")) & (F.col("tag") == F.col("anchor_tag")))
    slotted = _top(rows, packed(limited, scores), wide, negatives, positives, _slots(low, high))
    kept = slotted.groupBy(*KEY).agg(F.collect_list(F.struct((-F.col("score")).alias("below"), "id", "tag", "slot", "score")).alias("kept"))

    # From the lowest slot up: what is best under the next limit is the best of the slot and of what is under this one.
    item = "array<struct<below:bigint,id:bigint,tag:bigint,slot:int,score:bigint>>"
    start = F.struct(F.expr(f"cast(array() AS {item})").alias("best"), F.expr(f"cast(array() AS array<{item}>)").alias("out"))

    def descend(state: Column, slot: Column) -> Column:
        now = F.slice(F.array_sort(F.concat(state["best"], F.filter("kept", lambda c: c["slot"] == slot))), 1, negatives)
        return F.struct(now.alias("best"), F.concat(F.array(now), state["out"]).alias("out"))

    under = F.aggregate(F.sequence(F.lit(positives - 1), F.lit(0), F.lit(-1)), start, descend, lambda s: s["out"])
    def wide_enough(score: Column) -> Column:
        return score.cast("decimal(20,0)")

    pairs = of.join(kept, KEY).select("anchor_id", "positives", under.alias("under")).select("anchor_id", "under", F.posexplode("positives").alias("i", "positive"))
    fits = F.filter(F.element_at("under", F.col("i") + 1), lambda c: wide_enough(c["score"]) * 100 >= wide_enough(F.col("positive.score")) * low)
    rows = pairs.select("anchor_id", "positive", F.posexplode(fits).alias("r", "negative"))
    return rows.select("anchor_id", F.col("positive.id").alias("positive_id"), (F.col("r") + 1).alias("rank"), F.col("negative.id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"))


def contract(vectors: DataFrame) -> DataFrame:
    """The query's parameters: every 50th id asks, and every 7th label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)
