"""Embedding near-dedup by randomised-rotation binary codes (operator 12).

A unit vector is turned by two random rotations; its codes are the signs of what
comes out.  With each code goes f, the inner product of the vector and the code
turned back (of length 1).  A turned-back code is f times the vector plus a
random direction across it, so the inner product of x's first code and y's second
one, divided by f_x f_y, is an unbiased estimate of the cosine (the rotations are
independent), and with g = sqrt(1 - f^2) / f its variance is about
((1 - cosine^2)(g_x^2 + g_y^2) + g_x^2 g_y^2) / (width - 1).  A pair is refuted if
both estimates (first with second code, second with first) are ``SIGMAS`` of these
deviations, or the largest error possible, below the threshold.  What is left is
computed again in double precision from the vectors; no link comes from an
estimate alone.

Candidates share a key: the places of the largest entries of ``k`` further
rotations, with signs.  Two vectors have a chance p (by their cosine and the
width, simulated once) to share one such place; k grows with the logarithm of the
number of vectors, so that strangers seldom share k, and the number of tables is
as large as it takes for a pair at the threshold to be missed by all of them with
a chance below ``MISS``.  Closer pairs are missed far less often (a thousandth of that at 0.95 and 64 entries).

Equal vectors are one class with a count, so copies cost nothing.  Keys with
over ``BLOCK_ROWS`` classes are dealt to blocks, and pairs of blocks are small
tasks.  Tasks on codes say only which members need their vectors; tasks on vectors
count the links of each member and give no more links than it takes to join them.
A pair that shares several keys is counted in the first of these tables.  Rows of
codes grow with the square of a group of *different* vectors in one key, divided
by ``BLOCK_ROWS``: what an exact count of links takes.

Defined cases: null and zero vectors, and those with null or non-finite entries,
link with nothing; vectors link only with those of their length.  Repeated rows
are copies: each counts the others.  Null ids count as links, and are the smallest
id of a component only if it has no other.  Other columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components as connected
from .neardup import TASK, _whole_tasks
from .shared import cut, map_arrow, partitions
from .textblock import gather_ranges, mix
from .vectors import binary_rows, from_binary_rows, matrix

MISS = 1e-3
SIGMAS = 4.5
BLOCK_ROWS = 1024
ROWS = 4096  # turned at once
SMALL = 64  # members of a task that is compared pair by pair
PAIRS = 1 << 15  # compared at once in full


@lru_cache(maxsize=256)
def rotation(width: int, number: int) -> np.ndarray:
    """The random orthogonal matrix of this width and number."""
    q, r = np.linalg.qr(np.random.default_rng((width, number)).standard_normal((width, width)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def places(turned: np.ndarray) -> np.ndarray:
    """The place of the largest entry of each row, with its sign in the last bit."""
    at = np.abs(turned).argmax(axis=1)
    return (2 * at + (turned[np.arange(len(turned)), at] < 0)).astype(np.uint16)


@lru_cache(maxsize=64)
def share(width: int, cosine: float, trials: int = 20_000) -> float:
    """The chance that two unit vectors of this cosine share a place."""
    x, y = np.random.default_rng((width, 77)).standard_normal((2, max(trials * 64 // max(width, 64), 2000), width))
    return float((places(x) == places(cosine * x + math.sqrt(max(1 - cosine * cosine, 0)) * y)).mean())


def plan(n: int, width: int, threshold: float) -> tuple[int, int]:
    """Places in a key, and tables, for n vectors."""
    k = max(1, round(math.log(max(n, 2)) / math.log(2 * width + 1)))
    p = min(max(share(width, threshold) ** k, 1e-6), 1 - 1e-9)
    return k, max(1, math.ceil(math.log(MISS) / math.log1p(-p)))


def units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares cannot overflow
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def encode(u: np.ndarray) -> np.ndarray:
    """Both codes and both f of unit vectors, as bytes."""
    parts = []
    for number in (0, 1):
        turned = u @ rotation(u.shape[1], number)
        parts += [np.packbits(turned >= 0, axis=1), (np.abs(turned).sum(axis=1) / math.sqrt(u.shape[1])).astype(np.float32).view(np.uint8).reshape(-1, 4)]
    return np.concatenate(parts, axis=1)


class Codes:
    """Rows of codes of one width, for bounds on the cosines of their pairs."""

    def __init__(self, codes: np.ndarray, width: int, threshold: float):
        per = (width + 7) // 8
        self.width, self.across = width, max(1 - threshold * threshold, 0)
        self.back, self.f, self.g = [], [], []
        for number in (0, 1):
            part = codes[:, number * (per + 4) : (number + 1) * (per + 4)]
            f = np.ascontiguousarray(part[:, per:]).view(np.float32).ravel().astype(np.float64)
            signs = np.unpackbits(part[:, :per], axis=1, count=width).astype(np.float32) * 2 - 1
            self.back.append(signs @ (rotation(width, number).T / math.sqrt(width)).astype(np.float32))
            self.f.append(f)
            self.g.append(np.sqrt(np.maximum(1 - f * f, 0)) / f)

    def _bound(self, product: np.ndarray, x: tuple, y: tuple) -> np.ndarray:
        (f, g), (h, k) = x, y
        most = math.sqrt(self.across) * (g + k) + g * k
        error = np.minimum(most, SIGMAS * np.sqrt((self.across * (g * g + k * k) + g * g * k * k) / max(self.width - 1, 1)))
        return product / (f * h) + error + 1e-4

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The largest cosine that both estimates of each pair (i, j) leave to a pair at or over the threshold."""
        out = np.empty(len(i))
        for a in range(0, len(i), 1 << 15):
            x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            ways = [np.einsum("ij,ij->i", self.back[0][p], self.back[1][q]) for p, q in ((x, y), (y, x))]
            bounds = [self._bound(w, (self.f[0][p], self.g[0][p]), (self.f[1][q], self.g[1][q])) for w, (p, q) in zip(ways, ((x, y), (y, x)))]
            out[a : a + (1 << 15)] = np.minimum(*bounds)
        return out

    def all_pairs(self, rows: slice) -> np.ndarray:
        """The same for every two of some rows, as a matrix."""
        (f, h), (g, k) = [x[rows] for x in self.f], [x[rows] for x in self.g]
        bound = self._bound(self.back[0][rows] @ self.back[1][rows].T, (f[:, None], g[:, None]), (h[None, :], k[None, :]))
        return np.minimum(bound, bound.T)


def _sketches(k: int, tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Classes with an embedding in the last column, its codes, places and keys; a batch may hold several widths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for width in np.unique(size):
                at = np.flatnonzero(size == width)
                for lo in range(0, len(at), ROWS):
                    rows = batch.take(pa.array(at[lo : lo + ROWS]))
                    u = units(matrix(rows.column("embedding"))[0])
                    marks = np.stack([places(u @ rotation(int(width), 2 + t)) for t in range(k * tables)], axis=1)
                    keys = np.empty((len(u), tables), np.uint64)
                    for t in range(tables):
                        key = mix(np.full(len(u), int(width) << 32 | t, np.uint64))
                        for i in range(t * k, t * k + k):
                            key = mix(key ^ marks[:, i].astype(np.uint64))
                        keys[:, t] = key
                    per = pa.array(np.arange(len(u) + 1) * tables, pa.int32())
                    made = [binary_rows(encode(u)), binary_rows(marks), pa.ListArray.from_arrays(per, pa.array(keys.view(np.int64).ravel()))]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *made], [*rows.schema.names, "code", "marks", "keys"])

    return run


def _likely(table: pa.Table, begin: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one task whose bounds reach the threshold: of one block in a task of one, else of two.

    Small tasks are taken together, pair by pair; large ones as products of matrices.
    """
    left, within = table.column("left").to_numpy(), table.column("lo").to_numpy() == table.column("hi").to_numpy()
    width, code = table.column("width").to_numpy(), table.column("code").combine_chunks()
    size = np.diff(begin)
    first, task_width = begin[:-1], width[begin[:-1]]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for w in np.unique(task_width):
        tasks = np.flatnonzero((task_width == w) & (size > 1))
        rows = gather_ranges(first[tasks], size[tasks])
        codes = Codes(from_binary_rows(code.take(pa.array(rows)), np.uint8), int(w), threshold) if len(rows) else None
        start = np.cumsum(size[tasks]) - size[tasks]
        small = size[tasks] <= SMALL
        of, n = np.repeat(start[small], size[tasks][small]), np.repeat(size[tasks][small], size[tasks][small])
        place = gather_ranges(start[small], size[tasks][small])
        partners = of + n - place - 1
        i, j = np.repeat(place, partners), gather_ranges(place + 1, partners)
        may = within[rows[i]] | (left[rows[i]] != left[rows[j]])
        i, j = i[may], j[may]
        may = codes.pairs(i, j) >= threshold if len(i) else np.zeros(0, bool)
        found.append((rows[i[may]], rows[j[may]]))
        for a, n in zip(start[~small].tolist(), size[tasks][~small].tolist()):
            part = rows[a : a + n]
            may = codes.all_pairs(slice(a, a + n)) >= threshold
            may &= np.arange(n)[:, None] < np.arange(n) if within[part[0]] else left[part, None] & ~left[None, part]
            i, j = np.nonzero(may)
            found.append((part[i], part[j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _needed(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that some partner of their task may be linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _whole_tasks(batches):
            yield from table.take(np.union1d(*_likely(table, begin, threshold))).combine_chunks().to_batches()

    return run


def _links(threshold: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, null, n): n links of a; and rows (a, b, null): links that join what a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _whole_tasks(batches):
            nodes, copies, at = table.column("c").to_pylist(), table.column("copies").to_numpy(), table.column("at").to_numpy()
            vectors, marks = table.column("embedding").combine_chunks(), table.column("marks").combine_chunks()
            counts, joins = np.zeros(len(nodes), np.int64), []
            parent: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := parent.get(c, c)) != c:
                    parent[c] = parent.get(up, up)
                    c = up
                return c

            i, j = _likely(table, begin, threshold)
            for start in range(0, len(i), PAIRS):
                x, y = i[start : start + PAIRS], j[start : start + PAIRS]
                rows = np.union1d(x, y)
                u, m = units(matrix(vectors.take(pa.array(rows)))[0]), from_binary_rows(marks.take(pa.array(rows)), np.uint16)
                m = m.reshape(len(rows), -1, k)
                p, q = np.searchsorted(rows, x), np.searchsorted(rows, y)
                linked = np.einsum("ij,ij->i", u[p], u[q]) >= threshold
                x, y, p, q = x[linked], y[linked], p[linked], q[linked]
                first = np.ones(len(x), bool)  # no table before this one has the pair
                for t in range(int(at[x].max(initial=0))):
                    first &= (t >= at[x]) | (m[p, t] != m[q, t]).any(axis=1)
                x, y = x[first], y[first]
                np.add.at(counts, x, copies[y])
                np.add.at(counts, y, copies[x])
                for v, w in zip(x.tolist(), y.tolist()):
                    r, s = find(nodes[v]), find(nodes[w])
                    if r != s:
                        parent[r] = s
                        joins.append((nodes[v], nodes[w]))
            linked = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([nodes[p] for p in linked] + [x for x, _ in joins], pa.int64()),
                    pa.array([None] * len(linked) + [y for _, y in joins], pa.int64()),
                    pa.array(counts[linked].tolist() + [None] * len(joins), pa.int64()),
                ],
                ["a", "b", "n"],
            )

    return run


def _usable(v: str) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(v).isNotNull() & finite & F.exists(v, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding)."""
    n = partitions(vectors.sparkSession)
    node = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64("embedding", *salt)), 16, "0") for salt in ([], [F.lit(1)])]))
    used = vectors.select("vec_id", "embedding").where(_usable("embedding"))
    size = used.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    k, tables = plan(size["n"], size["width"] or 1, threshold)

    classes = used.groupBy("embedding").agg(F.min("vec_id").alias("owner"), F.count("*").alias("copies"))
    classes = classes.select(F.monotonically_increasing_id().alias("c"), node.alias("node"), "owner", "copies", F.size("embedding").alias("width"), "embedding")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", code binary, marks binary, keys array<long>"
    classes = cut(classes.transform(map_arrow, _sketches(k, tables), schema))
    blocks = (F.floor(F.count("*") / BLOCK_ROWS) + 1).alias("blocks")
    met = classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"), blocks).where("n > 1").drop("n")
    rows = classes.select("c", "width", "code", F.posexplode("keys").alias("at", "key"))
    dealt = rows.join(met, "key").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda t: F.struct(F.least(t, F.col("block")).alias("lo"), F.greatest(t, F.col("block")).alias("hi"))))
    tasks = dealt.withColumn("pair", pair).select("key", "at", "pair.lo", "pair.hi", "c", "width", "code", (F.col("block") == F.col("pair.lo")).alias("left"))
    needed = cut(tasks.repartition(n, *TASK).sortWithinPartitions(*TASK).transform(map_arrow, _needed(threshold), tasks.schema))
    full = needed.join(classes.select("c", "embedding", "copies", "marks"), "c").repartition(n, *TASK).sortWithinPartitions(*TASK)
    found = cut(full.transform(map_arrow, _links(threshold, k), "a long, b long, n long"))

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("others"))
    labels = connected(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "c")
    named = classes.select("c", "node", "owner", "copies").join(counts, "c", "left").join(labels, "c", "left").withColumn("component", F.coalesce("component", "c"))
    smallest = named.groupBy("component").agg(F.min("owner").alias("component_id"))
    named = named.join(smallest, "component").select(F.col("node").alias("of"), "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    every = vectors.select("vec_id", F.when(_usable("embedding"), node).alias("node"))
    out = every.join(named, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("of").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
