"""SetSketch near-duplicate detection (operator 9).

A register holds the truncated minimum of exponentially distributed hash
values, on a logarithmic scale: K = floor(1 - log_b(x)), kept in [0, q + 1].
Every element gives one value to every register, at register (c + s j) mod m
in the j-th of m equally likely slices of the exponential distribution, so the
values of one element ascend with j.  A set is sketched slice by slice until
all registers are hit; later slices can only hold larger values.

* Mergeable: the registers of a union are the element-wise maxima.
* Locality-sensitive: two registers are equal with a chance of about the
  Jaccard similarity; ``ROWS`` registers make a band.
* Joint estimate: with the two sizes known, the numbers of registers that are
  larger, smaller and equal have a multinomial distribution that depends on
  the similarity only; the estimate maximises its likelihood.

At a similarity of 0.75 the chance that two documents share none of the 32
bands is 5e-6, and less above it.

Defined cases: null, empty and word-less texts have the empty set (registers
0, no links); fewer than five words give one shingle; repeated rows share a
component; the smallest doc_id of a component is kept, and a null one only if
the component has no other.  Other columns are not looked at, whatever their names;
``keep_one`` carries them along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .minhash import band_keys
from .textblock import mix

REGISTERS = 128
ROWS = 4
BASE = 1.001
RATE = 20.0
LIMIT = 65534  # q: registers are 16 bits

_J = np.arange(REGISTERS + 1)
_SLICE = np.concatenate((np.log1p(_J[:-1] / (REGISTERS - _J[:-1])) / RATE, [np.inf]))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers of each set (n x REGISTERS, 16 bits)."""
    n = len(first) - 1
    lowest = np.full(n * REGISTERS, _EMPTY, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    place, step = mix(values ^ np.uint64(0xC0FFEE)), (mix(values ^ np.uint64(0xBEEF)) | np.uint64(1))
    item = values
    with np.errstate(over="ignore"):
        for j in range(REGISTERS):
            if not len(item):
                break
            slot = ((place + step * np.uint64(j)) & np.uint64(REGISTERS - 1)).astype(np.int64)
            u = mix(item + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)
            np.minimum.at(lowest, doc * REGISTERS + slot, u | np.uint64(j << 53))
            waits = (lowest.reshape(n, REGISTERS) == _EMPTY).any(axis=1)[doc]
            if not waits.all():
                item, place, step, doc = item[waits], place[waits], step[waits], doc[waits]
    hit = lowest != _EMPTY
    j = np.minimum(lowest >> np.uint64(53), np.uint64(REGISTERS - 1)).astype(np.int64)
    u = (lowest & np.uint64((1 << 53) - 1)) / 2.0**53
    # Slice j holds the quantiles j/m to (j+1)/m of the exponential distribution.
    x = np.maximum(-np.log1p(-(j + u) / REGISTERS) / RATE, 1e-300)
    k = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1)
    return np.where(hit, k, 0).astype(np.uint16).reshape(n, REGISTERS)


def merge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(x, y)


def joint_estimate(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, grid: int = 101) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each pair of sketches with known set sizes."""
    above, below = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    equal = x.shape[1] - above - below
    u = (size_x / np.maximum(size_x + size_y, 1))[:, None]
    v = 1 - u
    top = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    j = top * np.linspace(0, 1, grid)[None, :]

    def p(z: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    fit = above * np.log(more + tiny) + below * np.log(less + tiny) + equal * np.log(np.maximum(1 - more - less, 0) + tiny)
    return j[np.arange(len(j)), np.argmax(fit, axis=1)]


def sketch(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = registers(values, first)
    return found, band_keys(found, ROWS)


def _verdicts(docs: DataFrame, threshold: float) -> DataFrame:
    found = neardup.components(docs, sketch, joint_estimate, threshold)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    return _verdicts(docs, threshold).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all columns.

    A null doc_id comes after all others.  Of several texts under the kept doc_id
    in one component, the one with the smallest hash is kept.  Texts without words
    are components of their own; rows that repeat id and text are kept once.
    """
    kept = _verdicts(docs.select("doc_id", "text"), threshold).where("kept")
    held = kept.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("tie", "doc_id")).alias("row")).select("row.doc_id", "row.tie")
    kept = held.union(kept.where("component IS NULL").select("doc_id", "tie").distinct())
    # The verdict is by row: an id can come with several texts, and null ids never meet in a plain join.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # so that no name of its columns can clash
    keyed = docs.select(row.alias("row")).select("row", F.col("row.doc_id").alias("own_id"), F.col("row.text").alias("own_text"), F.xxhash64("row.text").alias("own_tie"))
    kept = keyed.join(kept, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_tie") == F.col("tie")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_text"]).select("row.*")
