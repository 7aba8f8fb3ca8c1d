"""Removal of repeated byte strings by deep-shallow suffix sorting (operator 5).

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a
document with a smaller id, or earlier in the same one) is removed.  Suffixes
matter to depth ``LENGTH`` only, so they are windows of that many bytes, and
they can be dealt out by content:

1. *Spans.*  The minimizer of a window is the leftmost ``SEED``-byte string in
   it with the smallest hash; it depends on the window's bytes only.
   Neighbouring windows with the same minimizer form a span.  Equal windows
   have equal minimizers, so they meet in the bucket of that hash.
2. *Equal spans.*  Only 30 bytes a span are moved (hashes, id, place).  Of
   spans with equal bytes all but the first are repeated as a whole; copies in
   one task are settled there, before the shuffle.
3. *Other spans with one minimizer.*  Their bytes are fetched and their windows
   sorted in deep-shallow manner: a multikey sort, eight bytes a step, to the
   depth ``SHALLOW``; then a blind trie for each group that still ties orders
   its different members.  Neighbours in the order with a common prefix of
   ``LENGTH`` bytes are equal; all but the first are repeated.
4. A minimizer with more than ``HOT`` different spans is not collected in a task:
   its windows become rows, and an aggregation by two 64-bit hashes of their
   bytes finds the first of each.

Hashes decide only what is compared: spans count as equal on 128 bits (span and
minimizer), windows on their first ``SHALLOW`` bytes and 64 bits of the rest.

Defined cases: null texts are empty; texts under ``LENGTH`` bytes keep all;
rows with one doc_id share its positions, so a string is repeated if it starts
at a smaller (doc_id, place); rows that repeat id and text get one result
each; null ids come first; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, map_arrow, partitions
from .textblock import NULL_ID, blocks, gather_ranges, mix, packed_partition, prefix_hash, span_hash

LENGTH = 100
SEED = 32
SHALLOW = 72
HOT = 4096
CHUNK_BYTES = 8 << 20
_PLACE_BITS = 31


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer hash, content hash, document, start in the block and number of windows of each span."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    prefix = prefix_hash(data)
    seeds = span_hash(prefix, np.arange(n - SEED + 1), np.arange(SEED, n + 1))
    key = seeds >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(len(seeds), dtype=np.uint64)
    width, reach = LENGTH - SEED + 1, 1
    while reach * 2 <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    place = (key & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    window = np.flatnonzero(ends - np.arange(len(place)) >= LENGTH)
    if not len(window):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    at = place[window]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1))))
    count = np.diff(np.append(first, len(window)))
    start = window[first]
    content = span_hash(prefix, start, start + count - 1 + LENGTH)
    return seeds[at[first]], content, np.searchsorted(offsets, start, side="right") - 1, start, count


_SPAN = np.dtype([("seed", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("count", "<i4")])
_FIELDS = _SPAN.names


def _pack_spans(table: np.ndarray) -> bytes:
    """Column by column, so that ids and places compress."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(table[f]).tobytes() for f in _FIELDS))


def _unpack_spans(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = np.empty(len(raw) // _SPAN.itemsize, _SPAN), 0
    for f in _FIELDS:
        part = np.frombuffer(raw, _SPAN[f], len(out), at)
        out[f] = part
        at += part.nbytes
    return out


def _firsts(table: np.ndarray) -> np.ndarray:
    """Sorted by seed, content, id and place; True at the first of each (seed, content)."""
    first = np.ones(len(table), bool)
    first[1:] = (table["seed"][1:] != table["seed"][:-1]) | (table["content"][1:] != table["content"][:-1])
    return first


def _sorted(table: np.ndarray) -> np.ndarray:
    return table[np.lexsort((table["start"], table["doc"], table["content"], table["seed"]))]


def _repeated(table: np.ndarray) -> np.ndarray:
    """Which spans of a sorted table start after the first equal one (rows that repeat an id share its places)."""
    first = _firsts(table)
    at = np.flatnonzero(first)[np.cumsum(first) - 1] if len(table) else np.zeros(0, np.int64)
    return (table["doc"] != table["doc"][at]) | (table["start"] != table["start"][at])


def _ranges_batch(table: np.ndarray, bucket: int = 0) -> pa.RecordBatch:
    n = len(table)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, bucket, np.int32)), pa.nulls(n, pa.binary()), pa.array(table["doc"]), pa.array(table["start"]), pa.array(table["count"])],
        ["bucket", "spans", "doc", "start", "count"],
    )


def _spans_partition(n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of a partition by bucket, equal ones settled; repeated spans go on as ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            for a, _, data, offsets in blocks(batch.column(1)):
                seed, content, doc, start, count = spans(data, offsets)
                table = np.empty(len(seed), _SPAN)
                table["seed"], table["content"], table["doc"] = seed, content, ids[a + doc]
                table["start"], table["count"] = start - offsets[doc], count
                found.append(table)
        if not found:
            return
        table = _sorted(np.concatenate(found))
        first, again = _firsts(table), _repeated(table)
        # What is settled only passes through the next step: it is dealt by document, as a minimizer can be very frequent.
        for b, part in _by_bucket(table[again], table["doc"][again].view(np.uint64), n_buckets):
            yield _ranges_batch(part, b)
        keep = table[first]
        keep = keep[np.lexsort((keep["start"], keep["doc"]))]
        for b, part in _by_bucket(keep, keep["seed"], n_buckets):
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([_pack_spans(part)], pa.binary()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int32()))],
                ["bucket", "spans", "doc", "start", "count"],
            )

    return run


def _by_bucket(table: np.ndarray, seed: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (mix(seed ^ np.uint64(0xB0C4E7)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if edges[b + 1] > edges[b]:
            yield b, table[order[edges[b] : edges[b + 1]]]


_SETTLED = "doc long, start int, count int, seed long, hot boolean"


def _settle(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Ranges (seed null) of repeated spans, and the spans whose bytes must be compared."""

    def out(table: np.ndarray, hot: np.ndarray | None) -> pa.RecordBatch:
        seed = pa.nulls(len(table), pa.int64()) if hot is None else pa.array(np.ascontiguousarray(table["seed"]).view(np.int64))
        flag = pa.nulls(len(table), pa.bool_()) if hot is None else pa.array(hot)
        return pa.RecordBatch.from_arrays([pa.array(table["doc"]), pa.array(table["start"]), pa.array(table["count"]), seed, flag], ["doc", "start", "count", "seed", "hot"])

    found = []
    for batch in batches:
        ranges = batch.filter(batch.column(1).is_null())
        if ranges.num_rows:
            yield pa.RecordBatch.from_arrays([ranges.column(2), ranges.column(3), ranges.column(4), pa.nulls(ranges.num_rows, pa.int64()), pa.nulls(ranges.num_rows, pa.bool_())], ["doc", "start", "count", "seed", "hot"])
        found += [_unpack_spans(x.as_py()) for x in batch.column(1) if x.is_valid]
    if not found:
        return
    table = _sorted(np.concatenate(found))
    yield out(table[_repeated(table)], None)
    table = table[_firsts(table)]
    _, group, size = np.unique(table["seed"], return_inverse=True, return_counts=True)
    table, size = table[size[group] > 1], size[group][size[group] > 1]
    yield out(table, size > limit)


def _settle_partition(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _settle(batches, limit)


def _fetch_partition(n_buckets: int, hot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of wanted spans, by bucket of their minimizer; of hot ones, their windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = np.concatenate([t for t, _ in held])
            data = np.concatenate([d for _, d in held])
            lengths = table["count"].astype(np.int64) - 1 + LENGTH
            begin = np.cumsum(lengths) - lengths
            which = np.empty(len(table), [("row", "<i8")])
            which["row"] = np.arange(len(table))
            for b, part in _by_bucket(which, table["seed"], n_buckets):
                rows = part["row"]
                blob = press.compress(data[gather_ranges(begin[rows], lengths[rows])].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_pack_spans(table[rows])], pa.binary()), pa.array([blob], pa.binary())], ["bucket", "spans", "bytes"])

        for batch in batches:
            for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                data = np.frombuffer(unpack.decompress(text), np.uint8)
                table = np.empty(len(wanted), _SPAN)
                table["doc"] = doc
                for f in ("start", "count"):
                    table[f] = [w[f] for w in wanted]
                table["seed"] = np.array([w["seed"] for w in wanted], np.int64).view(np.uint64)
                table["content"] = 0
                lengths = table["count"].astype(np.int64) - 1 + LENGTH
                fits = table["start"] + lengths <= len(data)  # a row that repeats an id with another text
                table, lengths = table[fits], lengths[fits]
                if hot:
                    prefix = prefix_hash(data)
                    at = gather_ranges(table["start"].astype(np.int64), table["count"].astype(np.int64))
                    half = LENGTH // 2
                    one, two = span_hash(prefix, at, at + LENGTH), mix(span_hash(prefix, at, at + half) + np.uint64(3) * span_hash(prefix, at + half, at + LENGTH))
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32))], ["one", "two", "doc", "start"])
                    continue
                held.append((table, data[gather_ranges(table["start"].astype(np.int64), lengths)]))
                size += int(lengths.sum())
                if size > CHUNK_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


class BlindTrie:
    """A trie that keeps branching depths and one byte a branch; strings stay outside.

    To insert a string, walk down by the branch bytes alone, compare with one
    leaf below to find the true common prefix, and split the path there.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: int | list | None = None  # a leaf is an index, a node is [depth, {byte: child}]
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = i
            return
        node = self.root
        while not isinstance(node, int):
            branch = s[node[0]]
            node = node[1].get(branch, next(iter(node[1].values())))
        other = self.strings[node]
        common = next((d for d in range(len(s)) if s[d] != other[d]), len(s))
        if common == len(s):
            return
        parent, byte, node = None, None, self.root
        while not isinstance(node, int) and node[0] < common:
            parent, byte, node = node, s[node[0]], node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == common:
            node[1][s[common]] = i
            return
        split = [common, {other[common]: node, s[common]: i}]
        if parent is None:
            self.root = split
        else:
            parent[1][byte] = split

    def order(self) -> list[int]:
        """Indices of the different strings, ascending."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node is None:
                continue
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def deep_shallow(data: np.ndarray, suffixes: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` bytes (equal ones in the given order), and the class of each place in the order: equal strings have one class, classes ascend."""
    n = len(suffixes)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    symbol = np.zeros(len(data), np.uint64)
    for i in range(8):
        symbol = symbol << np.uint64(8) | padded[i : i + len(data)].astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_at = np.arange(n)  # places of the order whose group has more than one member
    shallow -= shallow % 8
    for at in range(0, shallow, 8):
        if not len(open_at):
            break
        members, held = order[open_at], group[open_at]
        keys = symbol[suffixes[members] + at]
        by = np.lexsort((keys, held))
        order[open_at], keys, held = members[by], keys[by], held[by]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (held[1:] != held[:-1])))
        group[open_at] = open_at[np.flatnonzero(new)][np.cumsum(new) - 1]
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        open_at = open_at[np.repeat(size, size) > 1]
    if len(open_at):
        members, held = order[open_at], group[open_at]
        prefix = prefix_hash(data)
        rest = span_hash(prefix, suffixes[members] + shallow, suffixes[members] + depth)
        code, kinds = pd.factorize(rest)
        by = np.lexsort((members, code, held))
        members, held, code = members[by], held[by], code[by]
        new = np.concatenate(([True], (code[1:] != code[:-1]) | (held[1:] != held[:-1])))
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(new)))
        head = np.concatenate(([True], held[starts[1:]] != held[starts[:-1]]))
        group_start = np.flatnonzero(head)
        group_size = np.diff(np.append(group_start, len(starts)))
        rank = np.arange(len(starts)) - np.repeat(group_start, group_size)
        for g in np.flatnonzero(group_size > 1).tolist():
            a, k = int(group_start[g]), int(group_size[g])
            strings = [data[(p := suffixes[members[starts[a + i]]]) + shallow : p + depth].tobytes() for i in range(k)]
            for r, i in enumerate(BlindTrie(strings).order()):
                rank[a + i] = r
        full = np.repeat(rank, size)
        by = np.lexsort((members, full, held))
        members, held, full = members[by], held[by], full[by]
        order[open_at] = members
        new = np.concatenate(([True], (full[1:] != full[:-1]) | (held[1:] != held[:-1])))
        group[open_at] = open_at[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, group


def _repeated_windows(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ranges of repeated windows among spans that are laid end to end, ascending by id and place."""
    count = table["count"].astype(np.int64)
    lengths = count - 1 + LENGTH
    begin = np.cumsum(lengths) - lengths
    suffixes = gather_ranges(begin, count)
    owner = np.repeat(np.arange(len(table)), count)
    place = table["start"][owner] + suffixes - begin[owner]
    order, group = deep_shallow(data, suffixes)
    first = order[np.searchsorted(group, group)] if len(order) else order
    repeated = np.zeros(len(suffixes), bool)
    same = (table["doc"][owner[order]] == table["doc"][owner[first]]) & (place[order] == place[first])
    repeated[order] = ~same
    hit = np.flatnonzero(repeated)
    new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))) if len(hit) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    out = np.empty(len(at), _SPAN)
    out["doc"], out["start"] = table["doc"][owner[hit[at]]], place[hit[at]]
    out["count"] = np.diff(np.append(at, len(hit)))
    return out


def _sort_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    tables, data = [], []
    for batch in batches:
        for table, raw in zip(batch.column(1), batch.column(2)):
            tables.append(_unpack_spans(table.as_py()))
            data.append(np.frombuffer(unpack.decompress(raw.as_py()), np.uint8))
    if not tables:
        return
    table, raw = np.concatenate(tables), np.concatenate(data)
    del tables, data
    lengths = table["count"].astype(np.int64) - 1 + LENGTH
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(table["seed"], kind="stable")
    seed = table["seed"][order]
    new = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
    filled = np.cumsum(lengths[order])
    a = 0
    while a < len(order):  # chunks of whole minimizers
        base = filled[a - 1] if a else 0
        b = int(np.searchsorted(filled, base + CHUNK_BYTES))
        b = int(new[np.searchsorted(new, b, side="right") - 1]) if b < len(order) else len(order)
        if b <= a:
            later = new[np.searchsorted(new, a, side="right") :]
            b = int(later[0]) if len(later) else len(order)
        rows = order[a:b]
        rows = rows[np.lexsort((table["start"][rows], table["doc"][rows]))]
        found = _repeated_windows(table[rows], raw[gather_ranges(begin[rows], lengths[rows])])
        yield pa.RecordBatch.from_arrays([pa.array(found[f]) for f in ("doc", "start", "count")], ["doc", "start", "count"])
        a = b


def repeated_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, start, count): ``count`` windows from ``start`` on begin repeated strings; null ids are the smallest long."""
    n = partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    found = rows.transform(map_arrow, _spans_partition(n), "bucket int, spans binary, doc long, start int, count int")
    settled = cut(found.repartitionById(n, "bucket").transform(map_arrow, _settle_partition(hot), _SETTLED))
    ranges = settled.where("seed IS NULL").select("doc", "start", "count")
    packed = rows.transform(map_arrow, packed_partition, "doc long, packed binary")

    def fetched(is_hot: bool, schema: str) -> DataFrame:
        wanted = settled.where(f"seed IS NOT NULL AND hot = {is_hot}").groupBy("doc").agg(F.collect_list(F.struct("start", "count", "seed")).alias("wanted"))
        return packed.join(wanted, "doc").select("doc", "packed", "wanted").transform(map_arrow, _fetch_partition(n, is_hot), schema)

    others = fetched(False, "bucket int, spans binary, bytes binary").repartitionById(n, "bucket").transform(map_arrow, _sort_partition, "doc long, start int, count int")
    ranges = ranges.unionByName(others)
    if settled.where("hot").limit(1).count():
        windows = fetched(True, "one long, two long, doc long, start int")
        first = windows.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        again = windows.join(first, ["one", "two"]).where(F.struct("doc", "start") != F.col("first"))
        ranges = ranges.unionByName(again.select("doc", "start", F.lit(1).alias("count")))
    return ranges


def _removed_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc, text, ranges in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
            data = np.frombuffer(unpack.decompress(text), np.uint8)
            n, kept = len(data), data
            removed = n_spans = 0
            if ranges:
                start = np.array([r["start"] for r in ranges])
                end = np.minimum(start + np.array([r["count"] for r in ranges]) - 1 + LENGTH, n)
                cover = np.zeros(n + 1, np.int32)
                np.add.at(cover, np.minimum(start, n), 1)
                np.add.at(cover, np.maximum(end, np.minimum(start, n)), -1)
                gone = np.cumsum(cover)[:n] > 0
                removed, kept = int(gone.sum()), data[~gone]
                n_spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
            rows.append((None if doc == NULL_ID else doc, n, removed, n_spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    packed = docs.select("doc_id", "text").transform(map_arrow, packed_partition, "doc long, packed binary")
    ranges = repeated_ranges(docs, hot).groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))
    met = packed.join(ranges, "doc", "left").select("doc", "packed", "ranges")
    return met.transform(map_arrow, _removed_partition, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
