"""Near-duplicate components from sketches, verified on full sets.

The caller gives a function that sketches sets and makes band keys, and one
that estimates similarity from two sketches.

1. Documents with equal sets form a class (128-bit key of the set); all further
   work is on classes, so copies cost nothing.
2. Classes that share a band key are candidates.  The hub of a key is its member
   that meets most others over all its keys.  First every class is checked
   against the strongest hub of its keys only, one pair for each class.
3. Keys that then hold several components are open.  There every member is
   checked against the key's own hub, unless they are connected.
4. Keys that are still open are settled inside.  Their members are dealt by size
   (sets alike by ``threshold`` have sizes within 1 / ``threshold``) into blocks,
   and every pair of blocks of one key compares its sketches, in one small
   task.  Only sets that the estimate does not rule out for some partner in
   another component are then fetched and compared.

So every candidate pair is confirmed, refuted or already connected, and nothing
is capped.  What the estimate does not rule out (``SLACK`` below the threshold,
4.4 standard errors at 0.75 and 128 registers) is checked on the full sets of
shingle hashes.  Steps 2 and 3 take one row for each class, or class and key.
Step 4 takes rows of 256-byte sketches that grow with the square of what is left
in one key, over ``BLOCK_ROWS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components as connected
from .shared import cut, map_arrow, partitions
from .textblock import NULL_ID, binary_column, blocks, distinct_per_doc, gather_ranges, lower_ascii, mix, ngram_hashes, packed_partition, word_hashes

SHINGLE = 5
SLACK = 0.17
BLOCK_ROWS = 1024
BLOCK_ITEMS = 1 << 20
PAIRS = 1 << 20  # compared at once
TASK = ["key", "at", "lo", "hi"]

Sketch = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Estimate = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct five-word shingles of each text, and where each text begins (n + 1)."""
    h, first = word_hashes(lower_ascii(data), offsets)
    return distinct_per_doc(*ngram_hashes(h, first, SHINGLE, short=True))


def set_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set (n x 2), independent of order."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        with np.errstate(over="ignore"):
            for i, salt in enumerate((np.uint64(0x51ED270B), np.uint64(0xA5A5F00D))):
                out[some, i] = mix(np.add.reduceat(mix(values ^ mix(salt)), first[some]) + np.diff(first)[some].astype(np.uint64))
    return out


def _fixed_binary(values: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional array."""
    width = values.shape[1] * values.itemsize
    return binary_column(np.ascontiguousarray(values).view(np.uint8).ravel(), np.arange(len(values) + 1, dtype=np.int64) * width)


def _sketch_partition(sketch: Sketch) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                values, first = shingles(data, offsets)
                registers, bands = sketch(values, first)
                per = bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(np.diff(first), pa.int64()),
                        _fixed_binary(set_keys(values, first)),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * registers.shape[1], pa.int32()), pa.array(registers.view(np.int16).ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * per, pa.int32()), pa.array(bands.ravel().view(np.int64))),
                    ],
                    ["doc_id", "tie", "n_shingles", "node", "sketch", "bands"],
                )

    return run


def _sets_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.column(0):
            data = np.frombuffer(unpack.decompress(row.as_py()), np.uint8)
            values, first = shingles(data, np.array([0, len(data)]))
            yield pa.RecordBatch.from_arrays([_fixed_binary(set_keys(values, first)), binary_column(values.view(np.uint8), first * 8)], ["node", "items"])


def _estimate_partition(estimate: Estimate, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(i).flatten().to_numpy().view(np.uint16).reshape(batch.num_rows, -1) for i in (2, 4))
            n, m = (batch.column(i).to_numpy().astype(float) for i in (3, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(estimate(x, y, n, m) >= least))

    return run


def _verify_partition(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole tasks, and where each task begins (n + 1); a table holds about ``PAIRS`` pairs or one task."""
    rest: pa.Table | None = None
    for batch in _and_none(batches):
        table = rest if batch is None else pa.Table.from_batches([batch])
        if batch is not None and rest is not None:
            table = pa.concat_tables([rest, table])
        if table is None or not table.num_rows:
            continue
        task = np.stack([table.column(c).to_numpy() for c in TASK])
        begin = np.flatnonzero(np.append(True, (task[:, 1:] != task[:, :-1]).any(axis=0)))
        whole = len(begin) if batch is None else len(begin) - 1
        begin = np.append(begin, table.num_rows)
        size = np.diff(begin)
        until = np.cumsum(size * (size - 1) // 2)
        at = 0
        while at < whole:
            done = until[at - 1] if at else 0
            end = min(max(int(np.searchsorted(until, done + PAIRS, side="right")), at + 1), whole)
            yield table.slice(begin[at], begin[end] - begin[at]).combine_chunks(), begin[at : end + 1] - begin[at]
            at = end
        rest = table.slice(begin[whole]).combine_chunks()


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _likely(table: pa.Table, begin: np.ndarray, estimate: Estimate, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one task, in different components and of one block each, that may be alike."""
    percent = round(threshold * 100)
    n, left, own = (table.column(c).to_numpy() for c in ("n_shingles", "left", "own"))
    component = pd.factorize(np.array(table.column("component").to_pylist(), object))[0]
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint16).reshape(len(n), -1)
    within = table.column("lo").to_numpy() == table.column("hi").to_numpy()
    place = np.arange(len(n))
    partners = np.repeat(begin[1:], np.diff(begin)) - place - 1
    i, j = np.repeat(place, partners), gather_ranges(place + 1, partners)
    may = (component[i] != component[j]) & (own[i] | own[j]) & (within[i] | (left[i] != left[j])) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))
    i, j = i[may], j[may]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 8192):
        x, y = i[at : at + 8192], j[at : at + 8192]
        some = np.flatnonzero((sketch[x] == sketch[y]).mean(axis=1) >= threshold - SLACK - 0.05)  # a cheap look first
        x, y = x[some], y[some]
        keep[at + some] = estimate(sketch[x], sketch[y], n[x].astype(float), n[y].astype(float)) >= threshold - SLACK
    return i[keep], j[keep]


def _candidates_partition(threshold: float, estimate: Estimate) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that have a likely partner in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _whole_tasks(batches):
            yield from table.take(np.union1d(*_likely(table, begin, estimate, threshold))).combine_chunks().to_batches()

    return run


def _links_partition(threshold: float, estimate: Estimate) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between components, no more than it takes to join those that a few tasks hold."""
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _whole_tasks(batches):
            component, sets = table.column("component").to_pylist(), [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("items").combine_chunks()]
            parent: dict[bytes, bytes] = {}

            def find(c: bytes) -> bytes:
                while (up := parent.get(c, c)) != c:
                    parent[c] = parent.get(up, up)
                    c = up
                return c

            out = []
            for i, j in zip(*(x.tolist() for x in _likely(table, begin, estimate, threshold))):
                u, v = find(component[i]), find(component[j])
                if u != v:
                    x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        parent[u] = v
                        out.append((component[i], component[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def _links_inside(members: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float, estimate: Estimate) -> DataFrame:
    """Links (a, b) between components that meet in the keys of (key, node, component)."""
    n = partitions(members.sparkSession)
    # Keys with the same members need one look.
    same = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    members = members.join(same.groupBy("n", "x", "y").agg(F.min("key").alias("key")), "key", "left_semi")
    size = F.floor(F.log("n_shingles") / float(np.log(1 / threshold) + 1e-9)).alias("size")
    known = members.join(classes.select("node", "n_shingles", "sketch"), "node").select("*", size)
    # A set meets those of its own size class, and as a guest those of the next.
    meet = known.withColumn("at", F.explode(F.array("size", F.col("size") + 1))).withColumn("own", F.col("at") == F.col("size"))
    blocks = F.greatest(F.floor(F.count("*") / BLOCK_ROWS), F.floor(F.sum("n_shingles") / BLOCK_ITEMS)) + 1
    sizes = meet.groupBy("key", "at").agg(blocks.alias("blocks"), F.min("component").alias("first"), F.max("component").alias("last"), F.bool_or("own").alias("any")).where("first != last AND any")
    dealt = meet.join(sizes.select("key", "at", "blocks"), ["key", "at"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda t: F.struct(F.least(t, F.col("block")).alias("lo"), F.greatest(t, F.col("block")).alias("hi"))))
    rows = dealt.withColumn("pair", pair).select("key", "at", "pair.lo", "pair.hi", "node", "component", "n_shingles", "sketch", "own", (F.col("block") == F.col("pair.lo")).alias("left"))
    likely = cut(rows.repartition(n, *TASK).sortWithinPartitions(*TASK).transform(map_arrow, _candidates_partition(threshold, estimate), rows.schema))
    full = likely.join(sets, "node").repartition(n, *TASK).sortWithinPartitions(*TASK)
    return cut(full.transform(map_arrow, _links_partition(threshold, estimate), "a binary, b binary"))


def components(docs: DataFrame, sketch: Sketch, estimate: Estimate, threshold: float = 0.75) -> DataFrame:
    """Per document row: doc_id, tie (hash of its text), n_shingles, component, component_id (smallest doc_id reachable).

    Null and word-less texts have the empty set and are linked with nothing; their ``component`` is null.
    """
    rows = docs.select("doc_id", "text")
    schema = "doc_id long, tie long, n_shingles long, node binary, sketch array<short>, bands array<long>"
    table = cut(rows.withColumn("tie", F.xxhash64("text")).transform(map_arrow, _sketch_partition(sketch), schema))
    owners = table.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("owner"))
    classes = cut(
        table.where("n_shingles > 0")
        .join(owners.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("owner")))
        .select("node", "owner", "n_shingles", "sketch", "bands")
        .dropDuplicates(["node"])
    )
    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = banded.join(shared, "key").select("key", "node", "n")
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    members = cut(members.join(meets, "node").select("key", "node", "meets"))
    hubs = members.groupBy("key").agg(F.max(F.struct("meets", "node")).alias("hub"))
    stars = cut(members.join(hubs, "key").select("key", "node", "hub"))
    strongest = stars.groupBy("node").agg(F.max("hub").alias("hub")).select("node", F.col("hub.node").alias("hub")).where("node != hub")

    # The full sets of all candidates, from the text of one owner each; texts are moved once, compressed.
    wanted = members.select("node").distinct()
    owners = classes.join(wanted, "node", "left_semi").select(F.coalesce("owner", F.lit(NULL_ID)).alias("doc")).distinct()
    texts = rows.transform(map_arrow, packed_partition, "doc long, packed binary").join(owners, "doc", "left_semi").select("packed")
    sets = texts.transform(map_arrow, _sets_partition, "node binary, items binary")
    sets = cut(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]))

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs of classes whose sets are alike."""
        known = classes.select("node", "sketch", "n_shingles")
        left = known.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n_shingles").alias("n_a"))
        right = known.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n_shingles").alias("n_b"))
        likely = pairs.join(left, "a").join(right, "b").select("a", "b", "sketch_a", "n_a", "sketch_b", "n_b")
        likely = likely.transform(map_arrow, _estimate_partition(estimate, threshold - SLACK), "a binary, b binary")
        x = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
        y = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
        full = likely.join(x, "a").join(y, "b").select("a", "b", "items_a", "items_b")
        return cut(full.transform(map_arrow, _verify_partition(threshold), "a binary, b binary"))

    def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
        """Labels once links between their components are known."""
        over = connected(more).select(F.col("node").alias("component"), F.col("component").alias("onto"))
        return cut(nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component")).join(over, "component", "left").select("node", F.coalesce("onto", "component").alias("component")))

    def still_open(labels: DataFrame) -> DataFrame:
        """(key, node, hub, component) of the keys that hold several components."""
        placed = stars.join(labels, "node", "left").select("key", "node", F.col("hub.node").alias("hub"), F.coalesce("component", "node").alias("component"))
        keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
        return cut(placed.join(keys, "key"))

    nodes = cut(wanted)
    ordered = (F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    first = cut(strongest.select(*ordered).distinct())
    labels = connected(confirm(first))
    near = still_open(labels)
    of_hub = labels.select(F.col("node").alias("hub"), F.col("component").alias("of_hub"))
    apart = near.where("node != hub").join(of_hub, "hub", "left").where(F.col("component") != F.coalesce("of_hub", "hub"))
    links = confirm(apart.select(*ordered).distinct().join(first, ["a", "b"], "left_anti"))
    of = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    between = links.join(of.select(F.col("node").alias("a"), F.col("component").alias("p")), "a").join(of.select(F.col("node").alias("b"), F.col("component").alias("q")), "b")
    labels = joined(labels, between.select(F.col("p").alias("a"), F.col("q").alias("b")))
    labels = joined(labels, _links_inside(still_open(labels).select("key", "node", "component"), classes, sets, threshold, estimate))
    named = classes.join(labels, "node", "left").select("node", "owner", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("owner").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component", "component_id")
    return table.select("doc_id", "tie", "n_shingles", "node").join(named, "node", "left").select(
        "doc_id", "tie", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
