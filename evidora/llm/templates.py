"""Line dedup with a log-template tree (operator 8).

A line with at least ``MIN_TOKENS`` tokens goes down a tree of fixed depth: by its
number of tokens, then by what it begins with, or, under a wildcard for lines
whose leading tokens vary, by what stands further on.  Tokens that hold a digit are
variable fields at once; a line that has more fields than other tokens (a table of
numbers) has no template.  A line is cut into six parts; at the leaf it stands for
itself and, from ``FIELD_TOKENS`` tokens on, for the templates in which any two of
its parts are variable, or any three from ``WIDE_TOKENS`` tokens on, as long as at
least two fifths of its tokens and three of them stay.  So lines that differ in up to two fields (three
in long lines), wherever they are, share a template, whatever order they come in.
Of three variable parts one half of the line has at most one, so two whole parts of a
half lead to the leaf; what shares none of these six pairs shares no template, and
leaves that fewer than ``MIN_DOCS`` texts reach need not be looked into.  Lines that are
shared as they are need no variable parts; their templates recur if they do, for other
lines to join.

A template is shared if ``MIN_DOCS`` different texts hold it, and it recurs if
``MIN_DOCS`` of these are unlike each other in what is their own: their lines
without shared templates.  A text has to own a sixth of its tokens to count
(two texts that own more, and nothing in common, are no near copies at 0.75).
Own parts are alike if at least half of ``MINIMA`` minima of hashes of their
five-word shingles agree.  Classes are taken greedily: the smallest sketch of a
template, the smallest one unlike that, and so on.  So boilerplate counts,
however much of a page it is, and the lines of copies and near copies do not:
those are left for near-duplicate detection.  All lines of recurring templates
are dropped, in every document.

Counting is a Spark aggregation of (template, hash of the text) pairs, which
combines before it shuffles.  Sketches (one a document, with the lines that the
minima come from) and shared lines meet in joins.

Defined cases: null texts stay null and have no lines; lines with fewer tokens
are never dropped; a text that loses all lines becomes empty; a line that
stands several times in a text counts once for it; rows that repeat id and
text count as copies; extra columns are kept by ``drop``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, map_arrow
from .textblock import binary_column, blocks, lower_ascii, mix, ngram_hashes, prefix_hash, runs, span_hash, words

MIN_TOKENS = 3
FIELD_TOKENS = 4  # from this many on, parts of a line can be variable
WIDE_TOKENS = 9  # from this many on, three of them
KEPT_TOKENS = 3  # constants of a template, and at least two fifths of its tokens
PARTS = 6
MIN_DOCS = 3
OWN = 6  # a text counts if at least one in so many tokens is its own
FEW = 1_000_000  # keys of 8 bytes that are broadcast at most
_FIELD = np.uint64(0xF1E1D5)
MINIMA = 32
PIECE = 1 << 18  # bytes of a text that are looked at at once
LEAST_MINIMA = 8  # with fewer to compare, two rests count as alike
BEST = 3  # smallest values kept of each hash, from different lines
_NONE = 0  # value of a minimum that is not known
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_rng = np.random.default_rng(88)
_MULTIPLY = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def _minima(gram: np.ndarray, begin: np.ndarray, first: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the ``BEST`` smallest values of each hash over different lines, and the lines they come from (BEST x n x MINIMA).

    Lines have grams from ``begin`` on and documents lines from ``first`` on;
    lines that are not ``alone`` repeat another one and are left out.
    """
    low = np.empty((len(begin), MINIMA), np.uint64)
    with np.errstate(over="ignore"):
        for p in range(MINIMA):
            low[:, p] = np.minimum.reduceat(gram * _MULTIPLY[p] + _ADD[p], begin)
    low[~alone] = _MAX
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(begin))))
    at = np.arange(len(begin))[:, None]
    values, holders = [], []
    for _ in range(BEST):
        best = np.minimum.reduceat(low, first, axis=0)
        holder = np.minimum.reduceat(np.where(low == best[of], at, len(begin)), first, axis=0)
        values.append(best)
        holders.append(holder)
        low[holder, np.arange(MINIMA)] = _MAX
    return np.stack(values), np.stack(holders)


def _packed(values: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Values, cut to 16 bits, and numbers of lines (BEST x n x MINIMA each) as one row of bytes a document."""
    none = values == _MAX
    short = np.where(none, _NONE, np.maximum(mix(values) >> np.uint64(48), np.uint64(2))).astype(np.uint16)
    lines = np.where(none, -1, numbers).astype(np.int32)
    return np.hstack([np.ascontiguousarray(x).view(np.uint8) for x in (*short, *lines)])


def line_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Document, line number, number of the first equal line, tokens and hashes of the parts of each line that can have a template; and document, tokens and minima.

    A text of over ``PIECE`` bytes is taken in pieces of whole lines, so memory does
    not grow with it but for some 50 bytes a line.
    """
    if len(offsets) > 2 or len(data) <= PIECE:
        found = _piece_parts(data, offsets)
        return found["lines"], {"doc": found["docs"], "n": found["n"], "minima": _packed(found["values"], found["numbers"])}
    ends = np.flatnonzero(data == 0x0A) + 1
    pieces, start, passed = [], 0, 0
    while start < len(data):
        at = np.searchsorted(ends, start + PIECE, side="right") - 1
        end = int(ends[at]) if at >= 0 and ends[at] > start else int(ends[at + 1]) if at + 1 < len(ends) else len(data)
        piece = _piece_parts(data[start:end], np.array([0, end - start]))
        for key in ("line", "same"):
            piece["lines"][key] = piece["lines"][key] + passed
        piece["numbers"] = piece["numbers"] + passed
        piece["number"] = piece["number"] + passed
        pieces.append(piece)
        passed += int(np.searchsorted(ends, end, side="right") - np.searchsorted(ends, start, side="right"))
        start = end
    return _joined(pieces)


def _joined(pieces: list[dict]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The parts of one text, whose pieces know only their own repeats."""
    number, whole = (np.concatenate([p[k] for p in pieces]) for k in ("number", "whole"))
    order = np.lexsort((number, whole))
    new = np.append(True, whole[order][1:] != whole[order][:-1])[: len(order)]
    first = np.empty(len(order), np.int64)
    first[order] = number[order][new][np.cumsum(new) - 1] if len(order) else 0
    lines = {k: np.concatenate([p["lines"][k] for p in pieces]) for k in pieces[0]["lines"]}
    lines["same"] = first[np.searchsorted(number, lines["line"])]
    held = [p for p in pieces if len(p["docs"])]
    if not held:
        return lines, {"doc": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "minima": np.zeros((0, 6 * BEST * MINIMA), np.uint8)}
    values, numbers = (np.concatenate([p[k][:, 0] for p in held]) for k in ("values", "numbers"))  # candidates x MINIMA
    repeats = (values != _MAX) & (first[np.minimum(np.searchsorted(number, numbers), len(number) - 1)] != numbers)
    values = np.where(repeats, _MAX, values)
    order = np.argsort(values, axis=0, kind="stable")[:BEST]
    values, numbers = (np.take_along_axis(x, order, axis=0)[:, None] for x in (values, numbers))
    return lines, {"doc": np.zeros(1, np.int64), "n": np.array([sum(int(p["n"].sum()) for p in held)]), "minima": _packed(values, numbers)}


def _piece_parts(data: np.ndarray, offsets: np.ndarray) -> dict:
    """What ``line_parts`` gives, before packing; and the number and hash of every line with tokens."""
    data = lower_ascii(data)
    token, token_end, _ = words(data, offsets)
    line, _ = runs(data != 0x0A, offsets)
    line_first = np.append(np.searchsorted(token, line), len(token))
    count = np.diff(line_first)
    doc = np.searchsorted(offsets, line, side="right") - 1
    newlines = np.concatenate(([0], np.cumsum(data == 0x0A)))
    number = newlines[line] - newlines[offsets[doc]]
    has = np.flatnonzero(count > 0)
    if not len(has):
        none = np.zeros(0, np.int64)
        lines = {"doc": none, "line": none, "same": none, "n": none, "parts": np.zeros((0, PARTS), np.int32)}
        empty = np.zeros((BEST, 0, MINIMA), np.uint64)
        return {"lines": lines, "docs": none, "n": none, "values": empty, "numbers": empty.astype(np.int64), "number": none, "whole": none.astype(np.uint64)}
    h = span_hash(prefix_hash(data), token, token_end)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    field = digits[token_end] > digits[token]
    of = np.repeat(np.arange(len(line)), count)
    place = np.arange(len(token)) - line_first[of]
    spot = mix(place.astype(np.uint64) + np.uint64(1))
    fields = np.concatenate(([0], np.cumsum(field)))
    mostly_constant = (2 * (fields[line_first[1:]] - fields[line_first[:-1]]) <= count)[has]
    begin = line_first[:-1][has]
    # Parts are runs of tokens; a part without tokens hashes to 0.
    parts = np.zeros(len(line) * PARTS, np.uint64)
    slot = of * PARTS + place * PARTS // count[of]
    new = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    with np.errstate(over="ignore"):
        parts[slot[new]] = mix(np.add.reduceat(mix(np.where(field, _FIELD, h) ^ spot), new))
        whole = mix(np.add.reduceat(mix(h ^ spot), begin) + count[has].astype(np.uint64))
    parts = (parts >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(-1, PARTS)
    line_doc, number, count = doc[has], number[has], count[has]
    # The first equal line of each line's document.
    order = np.lexsort((whole, line_doc))
    new = np.append(True, (whole[order][1:] != whole[order][:-1]) | (line_doc[order][1:] != line_doc[order][:-1]))
    same = np.empty(len(order), np.int64)
    same[order] = order[new][np.cumsum(new) - 1]
    docs, first = np.unique(line_doc, return_index=True)
    gram, gram_first = ngram_hashes(h, line_first, 5, short=True)
    values, holders = _minima(gram, gram_first[:-1][has], first, same == np.arange(len(same)))
    ok = np.flatnonzero((count >= MIN_TOKENS) & mostly_constant)
    lines = {"doc": line_doc[ok], "line": number[ok], "same": number[same[ok]], "n": count[ok], "parts": parts[has][ok]}
    return {"lines": lines, "docs": docs, "n": np.add.reduceat(count, first), "values": values, "numbers": number[holders], "number": number, "whole": whole}


def _tree_keys(n: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each line, and where each line's keys begin (n + 1): the line itself, and its leaves in the tree.

    Leaves are every two parts of one half that have tokens.
    """
    part, count = parts.view(np.uint32).astype(np.uint64), n.astype(np.int64)[:, None]
    border = -(-np.arange(PARTS + 1) * count // PARTS)
    some = np.diff(border, axis=1) > 0

    def key(kind: int, held: list[int]) -> np.ndarray:
        h = mix(n.astype(np.uint64) << np.uint64(8) | np.uint64(kind))
        for i in held:
            h = mix(h ^ part[:, i])
        return h

    pairs = [p for p in combinations(range(PARTS), 2) if p[0] // 3 == p[1] // 3]
    keys = np.stack([key(0, list(range(PARTS))), *(key(1 + at, list(p)) for at, p in enumerate(pairs))], axis=1)
    has = np.stack([np.ones(len(n), bool), *(some[:, i] & some[:, j] & (n >= FIELD_TOKENS) for i, j in pairs)], axis=1)
    return keys[has].view(np.int64), np.concatenate(([0], np.cumsum(has.sum(axis=1))))


def _binaries(values: np.ndarray) -> pa.Array:
    """One binary value for each row of bytes."""
    return binary_column(np.ascontiguousarray(values).ravel(), np.arange(len(values) + 1, dtype=np.int64) * values.shape[1])


def _lines_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lines, and one row with the minima for each document that has any."""
    names = ["doc_id", "tie", "line", "same", "n", "parts", "keys", "minima"]
    for batch in batches:
        for a, _, data, offsets in blocks(batch.column(2)):
            t, m = line_parts(data, offsets)
            rows, k = pa.array(a + t["doc"]), len(t["doc"])
            parts = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * PARTS, pa.int32()), pa.array(t["parts"].ravel()))
            keys, key_first = _tree_keys(t["n"], t["parts"])
            keys = pa.ListArray.from_arrays(pa.array(key_first, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(t[c], pa.int32()) for c in ("line", "same", "n")), parts, keys, pa.nulls(k, pa.binary())], names)
            held = np.isin(m["doc"], t["doc"])
            rows, k = pa.array(a + m["doc"][held]), int(held.sum())
            none = pa.nulls(k, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), none, none, pa.array(m["n"][held], pa.int32()), pa.nulls(k, parts.type), pa.nulls(k, keys.type), _binaries(m["minima"][held])], names)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _own_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, minima, shared) to (doc_id, tie, sketch): the minima outside of the lines in ``shared``."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        raw, k = _matrix(batch.column(2), 6 * BEST * MINIMA), 2 * MINIMA
        values = [np.ascontiguousarray(raw[:, i * k : (i + 1) * k]).view(np.uint16) for i in range(BEST)]
        lines = [np.ascontiguousarray(raw[:, (BEST + 2 * i) * k : (BEST + 2 * i + 2) * k]).view(np.int32).astype(np.int64) for i in range(BEST)]
        shared = batch.column(3)
        row = np.arange(n, dtype=np.int64) << 32
        out = np.repeat(row, shared.value_lengths().to_numpy()) + shared.flatten().to_numpy().astype(np.int64)
        sketch = np.full((n, MINIMA), _NONE, np.uint16)
        for value, line in reversed(list(zip(values, lines))):
            sketch = np.where((line >= 0) & ~np.isin(row[:, None] + line, out), value, sketch)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binaries(sketch.view(np.uint8))], ["doc_id", "tie", "sketch"])


def _unlike_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of (key, sketch, other) whose sketches are not alike."""
    for batch in batches:
        x, y = (_matrix(batch.column(i), 2 * MINIMA).view(np.uint16) for i in (1, 2))
        held = (x != _NONE) & (y != _NONE)
        n, equal = held.sum(axis=1), (held & (x == y)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["key", "sketch"]).filter(pa.array((n >= LEAST_MINIMA) & (2 * equal < n)))


def _with_classes(rests: DataFrame, least: int) -> DataFrame:
    """(key) of those with ``least`` sketches that are unlike each other, taken greedily."""
    rests = cut(rests)
    for _ in range(least - 1):
        # Cut, so that the join deals out both sides and can split a hot key.
        taken = cut(rests.groupBy("key").agg(F.min("sketch").alias("other")))
        rests = cut(rests.join(taken, "key").select("key", "sketch", "other").transform(map_arrow, _unlike_partition, "key long, sketch binary"))
    return cut(rests.select("key").distinct())


def _key(kind: int, parts: list[int]) -> Column:
    return F.xxhash64("n", F.lit(kind), *[F.get("parts", F.lit(i)) for i in parts])


def _tokens(part: int) -> Column:
    return F.ceil((part + 1) * F.col("n") / PARTS) - F.ceil(part * F.col("n") / PARTS)


def _template_keys() -> Column:
    """Its templates with any two parts variable, or any three of a long line, of those that keep enough tokens."""
    keys = []
    for at, gone in enumerate([*combinations(range(PARTS), 2), *combinations(range(PARTS), 3)]):
        kept = F.col("n") - sum(_tokens(i) for i in gone)
        fits = (kept >= KEPT_TOKENS) & (5 * kept >= 2 * F.col("n"))
        if len(gone) == 3:
            fits &= F.col("n") >= WIDE_TOKENS
        keys.append(F.when(fits, _key(10 + at, [k for k in range(PARTS) if k not in gone])))
    return F.array_compact(F.array(*keys))


def _held_by(keyed: DataFrame, least: int, more: DataFrame | None = None) -> DataFrame:
    """(key) of those that ``least`` different texts hold, and of ``more``; to be broadcast if they are few."""
    found = keyed.where("line = same").select("key", "tie").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")
    found = cut(found if more is None else found.union(more.select("key")).distinct())
    return F.broadcast(found) if found.count() <= FEW else found


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, tie, lines): the numbers of the lines to drop of each document that has any."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    found = cut(rows.transform(map_arrow, _lines_partition, "doc_id long, tie long, line int, same int, n int, parts array<int>, keys array<long>, minima binary"))
    lines = found.where("minima IS NULL")
    line = ["doc_id", "tie", "line", "same", "n"]
    leaves = lines.select(*line, "parts", F.posexplode("keys").alias("at", "key")).select(*line, "parts", "key", (F.col("at") == 0).alias("exact"))
    leaves = cut(leaves.join(_held_by(leaves, min_docs), "key", "left_semi"))
    exact = leaves.where("exact").select(*line, "key")
    near = leaves.groupBy(*line).agg(F.bool_or("exact").alias("exact"), F.first("parts").alias("parts")).where("NOT exact")
    near = near.select(*line, F.explode(_template_keys()).alias("key"))
    # The templates of lines that are shared as they are: other lines may join them.
    wider = leaves.where("exact").groupBy("key").agg(F.first("n").alias("n"), F.first("parts").alias("parts")).where(F.col("n") >= FIELD_TOKENS)
    wider = cut(wider.select(F.col("key").alias("whole"), F.explode(_template_keys()).alias("key")))
    shared = cut(exact.unionByName(near.join(_held_by(near, min_docs, wider), "key", "left_semi")))

    # What each text has of its own.
    gone = shared.select(*line).distinct().groupBy(F.col("doc_id").alias("_d"), F.col("tie").alias("_t")).agg(F.collect_set("same").alias("gone"), F.sum("n").alias("n_gone"))
    minima = found.where("minima IS NOT NULL").select("doc_id", "tie", "n", "minima").dropDuplicates(["doc_id", "tie"])
    own = minima.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tie") == F.col("_t"))).where(OWN * (F.col("n") - F.col("n_gone")) >= F.col("n"))
    own = own.select("doc_id", "tie", "minima", "gone").transform(map_arrow, _own_partition, "doc_id long, tie long, sketch binary")
    own = own.select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "sketch")
    once = shared.where("line = same").select("doc_id", "tie", "key")
    sketches = once.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tie") == F.col("_t"))).select("key", "sketch").distinct()
    recurring = _with_classes(sketches, min_docs)
    recurring = recurring.union(wider.join(recurring.withColumnRenamed("key", "whole"), "whole", "left_semi").select("key"))
    return shared.join(recurring, "key", "left_semi").groupBy("doc_id", "tie").agg(F.collect_set("line").alias("lines"))


def without_lines(text: str | None, lines: list[int] | None) -> str | None:
    if text is None or not lines:
        return text
    gone = set(lines)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)


def _drop_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, lines) to the row's columns, without those lines."""
    for batch in batches:
        row, lines = batch.columns
        columns, names = row.flatten(), [f.name for f in row.type]
        if lines.null_count < len(lines):
            at = names.index("text")
            texts = [without_lines(t, x) for t, x in zip(columns[at].to_pylist(), lines.to_pylist())]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([None if t is None else len(t) for t in texts], columns[at].type)
        yield pa.RecordBatch.from_arrays(columns, names)


def _with_lines(docs: DataFrame) -> DataFrame:
    """(row, lines): each row as a struct, so that no name of its columns can clash."""
    found = recurring_lines(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.xxhash64("text").alias("_tie"))
    return keyed.join(found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie")), "left").select("row", "lines")


def drop(docs: DataFrame) -> DataFrame:
    """The documents without the lines of recurring templates; ``n_chars`` follows the text."""
    return _with_lines(docs).transform(map_arrow, _drop_partition, docs.schema)


def _digest_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, lines in zip(*(c.to_pylist() for c in batch.columns)):
            kept = without_lines(text, lines) or ""
            rows.append((doc, 0 if not text else text.count("\n") + 1, len(lines or ()), hashlib.sha256(kept.encode()).hexdigest()))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 (of the remaining lines)."""
    return _with_lines(docs.select("doc_id", "text")).select("row.doc_id", "row.text", "lines").transform(map_arrow, _digest_partition, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
