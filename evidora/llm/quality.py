"""Quality verdicts by gradient-boosted trees over document statistics (operator 4).

Statistics of whole texts are computed in Arrow tasks, a block of texts at a
time.  The trees are fitted in NumPy on the statistics of a bounded sample of
labelled rows (at most ``MAX_TRAIN`` ids, in the order of a hash of the id, and at
most twice as many rows of them), and are flattened to node arrays, so that scoring is ``depth`` gathers for all
rows and trees at once.  The odds of being kept can only fall as the shares of
repeated lines, repeated words and symbols rise (``FALLING``): a constraint
on every split and on the values below it.

Words are runs of bytes other than space and 0x09-0x0D.  A document fails the
base rules if it has fewer than 50 words or more than half of its words stand
in three-word windows that the text holds twice or more; it is never kept.

Defined cases: null texts count as empty (no words, base rules failed);
without labelled rows of both kinds the model keeps everything the base rules
pass; an id labelled twice counts as good only if all labels are 1; repeated
rows get repeated verdicts; ``keep`` judges every row by its own text, whatever its
id, and keeps extra columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, fresh, map_arrow, small_batches
from .textblock import blocks, lower_ascii, mix, ngram_hashes, prefix_hash, runs, span_hash, words

MAX_TRAIN = 20_000
MIN_WORDS = 50
WINDOW = 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "top_word_share", "letter_share", "digit_share", "upper_share", "mark_share", "wide_share", "line_words", "sentence_words", "long_word_share"]
FALLING = ["symbol_share", "dup_line_share", "repeat_share"]

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LETTER = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_MARK = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() for b in range(256)])
_STOP = np.isin(np.arange(256), list(b".!?"))


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and features of each text of a block."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    character = (data & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(character)))
    word_len = before[ends] - before[starts]
    sums = np.concatenate(([0], np.cumsum(word_len)))
    word_chars = sums[first[1:]] - sums[first[:-1]]
    prefix = prefix_hash(data)

    # Lines: a line that holds a word and equals an earlier one of its text.
    line_start, line_end = runs(data != 0x0A, offsets)
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    with np.errstate(over="ignore"):
        line_key = span_hash(prefix, line_start, line_end) ^ mix(line_doc.astype(np.uint64) + np.uint64(1))
    n_lines = np.bincount(line_doc, minlength=n)
    n_dup = np.bincount(line_doc[pd.Series(line_key).duplicated().to_numpy()], minlength=n)

    # Words in windows that occur twice or more.
    h = span_hash(prefix, starts, ends)
    gram, gram_first = ngram_hashes(h, first, WINDOW, short=False)
    doc_of_gram = np.repeat(np.arange(n), np.diff(gram_first))
    twice = np.flatnonzero(pd.Series(gram ^ mix(doc_of_gram.astype(np.uint64) + np.uint64(1))).duplicated(keep=False).to_numpy())
    at = first[doc_of_gram[twice]] + twice - gram_first[doc_of_gram[twice]]
    covered = np.zeros(len(h) + 1, bool)
    for i in range(WINDOW):
        covered[at + i] = True
    repeat = np.diff(np.concatenate(([0], np.cumsum(covered)))[first])

    # Distinct words, and the most frequent one.
    low = span_hash(prefix_hash(lower_ascii(data)), starts, ends)
    word_doc = np.repeat(np.arange(n), n_words)
    code, kinds = pd.factorize(low ^ mix(word_doc.astype(np.uint64) + np.uint64(1)))
    times = np.bincount(code, minlength=len(kinds))
    new = ~pd.Series(code).duplicated().to_numpy()
    n_distinct = np.bincount(word_doc[new], minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, word_doc[new], times[code[new]])

    chars = np.maximum(per_doc(character), 1)
    w = np.maximum(n_words, 1)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_doc(_SYMBOL[data]), "n_dup_lines": n_dup, "n_repeat_words": repeat}
    out |= {
        "log_words": np.log1p(n_words),
        "word_length": word_chars / w,
        "symbol_share": out["n_symbols"] / w,
        "dup_line_share": n_dup / np.maximum(n_lines, 1),
        "repeat_share": repeat / w,
        "distinct_share": n_distinct / w,
        "top_word_share": top / w,
        "letter_share": per_doc(_LETTER[data]) / chars,
        "digit_share": per_doc(_DIGIT[data]) / chars,
        "upper_share": per_doc(_UPPER[data]) / chars,
        "mark_share": per_doc(_MARK[data]) / chars,
        "wide_share": per_doc(data >= 0xC0) / chars,
        "line_words": n_words / np.maximum(n_lines, 1),
        "sentence_words": n_words / (1 + per_doc(_STOP[data])),
        "long_word_share": np.bincount(word_doc, word_len > 20, n) / w,
    }
    return out


@dataclass
class Trees:
    """All trees in node arrays; a leaf points to itself and its threshold is infinite."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.bias + self.value[node].sum(axis=1)


def train(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 2.0, falling: tuple[int, ...] = tuple(FEATURES.index(f) for f in FALLING)) -> Trees:
    """Newton boosting of the logistic loss over binned features."""
    y = np.asarray(y, float)
    share = float(y.mean()) if len(y) else 1.0
    nodes: list[list[float]] = []  # feature, threshold, left, right, value

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    bias, roots = float(np.log((share + 1e-6) / (1 - share + 1e-6))), []
    if len(y) and 0 < share < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
        odds = np.full(len(y), bias)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-sum_g / (sum_h + ridge), low, high))
            best = (1e-6, 0, 0, 0.0, 0.0)
            for f in range(x.shape[1]) if level < depth and len(rows) >= 20 else ():
                b = binned[rows, f]
                hg, hh, hn = (np.cumsum(np.bincount(b, w, len(cuts[f]) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                if not len(hg):
                    continue
                lv, rv = -hg / (hh + ridge), -(sum_g - hg) / (sum_h - hh + ridge)
                gain = hg**2 / (hh + ridge) + (sum_g - hg) ** 2 / (sum_h - hh + ridge) - sum_g**2 / (sum_h + ridge)
                gain[(hn < 10) | (len(rows) - hn < 10)] = -1
                if f in falling:
                    gain[np.clip(lv, low, high) < np.clip(rv, low, high)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(np.clip(lv[k], low, high)), float(np.clip(rv[k], low, high)))
            if best[0] <= 1e-6:
                out = leaf(rate * value)
                fitted[rows] = rate * value
                return out
            _, f, k, lv, rv = best
            me = len(nodes)
            nodes.append([f, cuts[f][k], -1, -1, 0.0])
            middle = (lv + rv) / 2
            goes = binned[rows, f] <= k
            left_bounds, right_bounds = ((max(low, middle), high), (low, min(high, middle))) if f in falling else ((low, high), (low, high))
            nodes[me][2] = grow(rows[goes], g, h, level + 1, *left_bounds)
            nodes[me][3] = grow(rows[~goes], g, h, level + 1, *right_bounds)
            return me

        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-odds))
            fitted = np.zeros(len(y))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
            odds += fitted
    if not roots:
        roots = [leaf(0.0)]
    a = np.array(nodes)
    return Trees(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots), depth, bias)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def _features_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in blocks(batch.column(1)):
            s = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(s[f]) for f in FEATURES), batch.column(2).slice(a, b - a)], ["doc_id", *FEATURES, "quality"])


def _verdict_partition(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                s = statistics(data, offsets)
                failed = base_failed(s["n_words"], s["n_repeat_words"])
                odds = trees.odds(np.stack([s[f] for f in FEATURES], axis=1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(s[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(1 / (1 + np.exp(-odds))), pa.array(~failed & (odds >= 0))],
                    ["doc_id", *COUNTS, "base_failed", "score", "kept"],
                )

    return run


def _keep_partition(shared, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = _verdict_partition(shared)
        for batch in batches:
            judged = [b.column(b.num_columns - 1) for b in verdict(iter([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(text_at)], ["doc_id", "text"])]))]
            kept = pa.chunked_array(judged, pa.bool_()).combine_chunks()
            yield pa.RecordBatch.from_arrays([*batch.columns, kept], [*batch.schema.names, "kept"])

    return run


def training_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and label of the bounded sample.

    Ids and labels meet in one aggregation, without joins and sorts, each of which takes
    pages of tens of MB in every task; the label goes through the task with its text.
    """
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    met = docs.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(True).alias("here")).unionByName(marks.withColumn("here", F.lit(False)))
    ids = met.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("here").alias("here"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = ids.where(F.col("here") & F.col("quality").isNotNull()).orderBy(*order).limit(MAX_TRAIN).select("doc_id", "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    stats = rows.transform(map_arrow, _features_partition, ", ".join(["doc_id long", *(f"{f} double" for f in FEATURES), "quality int"]))
    return stats.orderBy(*order, *FEATURES).limit(2 * MAX_TRAIN)


def _train_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trees from all rows of the (only) partition, pickled."""
    rows = [np.stack([np.asarray(c, float) for c in batch.columns], axis=1) for batch in batches]
    sample = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES) + 1))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sample[:, :-1], sample[:, -1].astype(int)))], pa.binary())], ["trees"])


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Train in one task on the bounded sample; the driver gets the trees alone."""
    with small_batches(docs.sparkSession):
        rows = training_statistics(docs, labels).select(*FEATURES, "quality").coalesce(1).transform(map_arrow, _train_partition, "trees binary").collect()
    return pickle.loads(rows[0].trees) if rows else train(np.zeros((0, len(FEATURES))), np.zeros(0, int))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, score (odds of good as a share), kept.

    The rows, short as they are, are gathered into partitions of the session's advisory size and cut:
    so the texts go to the tasks in small batches, whatever reads the rows, and few files are
    written; without Hadoop's native library each one costs the executor a child process.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # a few thousand nodes
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "score double", "kept boolean"])
    with small_batches(docs.sparkSession):
        return cut(docs.select("doc_id", "text").transform(map_arrow, _verdict_partition(shared), schema).hint("rebalance", "doc_id"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns; every row is judged by its own text."""
    columns, key = docs.columns, fresh("_kept", docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.BooleanType())])
    return docs.transform(map_arrow, _keep_partition(shared, columns.index("text")), schema).where(F.col(key)).select(*columns)
