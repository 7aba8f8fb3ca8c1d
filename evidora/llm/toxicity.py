"""Toxicity scores from averaged subword embeddings (operator 3).

A word (run of letters, digits and bytes beyond ASCII, lower-cased) is the mean
of the embeddings of its character 3- to 5-grams, word borders included, so a
misspelt word shares most of its vector with the word it comes from.  A
segment of ``SEGMENT`` words is the mean of its words, and a linear softmax
turns it into the odds of label 1.  A text is as toxic as its worst segment,
so a long text does not dilute what it holds.  Embeddings and softmax are
trained jointly by gradient descent in NumPy.

For scoring, softmax and embeddings collapse to one number a bucket of
n-grams (``Model.bucket``, fixed size), so a block of texts is scored by table
look-ups and prefix sums.

Training reads the whole texts of a sample of at most ``MAX_TRAIN`` labelled ids of
each label, taken in the order of a hash of the id.  Scoring reads every whole text.

Defined cases: null and empty texts have no segment and get the score of the
bias alone; without rows of both labels to learn from, every score is the
share of label 1 among the rows (0.0 without any); labels other than 0 and 1
and labelled ids without a document are ignored; an id that is labelled twice
counts as toxic if any label is 1; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, map_arrow
from .textblock import blocks, gather_ranges, lower_ascii, prefix_hash, runs, span_hash

MAX_TRAIN = 2000
SEGMENT = 3
BITS = 18
PRIOR = 2.0
SMOOTH = 2.0
DIM = 16
SIZES = (3, 4, 5)

_INSIDE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_TABLES = np.random.default_rng(3).integers(0, 1 << 63, (max(SIZES), 256), dtype=np.uint64).astype(np.uint32)


@dataclass
class Model:
    bucket: np.ndarray  # what a bucket of n-grams adds to the log odds
    bias: float


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with separators as spaces and one more before each text and at the end; word starts, ends, first word of each text."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    out = np.full(len(data) + n + max(SIZES), 0x20, np.uint8)
    low = lower_ascii(data)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lengths)] = np.where(_INSIDE[low], low, 0x20)
    starts, ends = runs(out != 0x20, np.zeros(1, np.int64))
    return out, starts, ends, np.searchsorted(starts, np.append(offsets[:-1] + np.arange(1, n + 1), len(out)))


def _grams(padded: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: the bucket at every start, and whether an n-gram of one word begins there."""
    m = len(padded) - max(SIZES) + 1
    inside = padded != 0x20
    h = np.zeros(m, np.uint32)
    ok = np.ones(m, bool)
    for k in range(max(SIZES)):
        h ^= _TABLES[k][padded[k : k + m]]
        if k >= 2:
            ok &= inside[k - 1 : k - 1 + m]
        if k + 1 in SIZES:
            yield k + 1, (h * np.uint32(2654435761) >> np.uint32(32 - BITS)), ok


def _word_scores(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    m = len(padded) - max(SIZES) + 1
    value, count = np.zeros(m + 1), np.zeros(m + 1)
    for _, h, ok in _grams(padded):
        value[1:] += np.where(ok, bucket[h], 0)
        count[1:] += ok
    np.cumsum(value, out=value)
    np.cumsum(count, out=count)
    a, b = starts - 1, np.minimum(ends - 1, m)
    return (value[b] - value[a]) / np.maximum(count[b] - count[a], 1)


def _segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each segment, and first segment of each text (n + 1)."""
    parts = -(-np.diff(first) // SEGMENT)
    seg_first = np.concatenate(([0], np.cumsum(parts)))
    return np.repeat(first[:-1] - seg_first[:-1] * SEGMENT, parts) + np.arange(seg_first[-1]) * SEGMENT, seg_first


def _odds(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    padded, starts, ends, first = _padded(data, offsets)
    out = np.full(len(offsets) - 1, model.bias)
    if not len(starts):
        return out
    words = _word_scores(padded, starts, ends, model.bucket)
    begin, seg_first = _segments(first)
    lengths = np.diff(np.append(begin, first[-1]))
    seg = np.add.reduceat(words, begin) / lengths + model.bias
    some = np.diff(seg_first) > 0
    out[some] = np.maximum.reduceat(seg, seg_first[:-1][some])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(texts: list[str], labels: np.ndarray, steps: int = 60, rate: float = 2.0, seed: int = 7) -> Model:
    """Fit embeddings and softmax to whole texts; NumPy only."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    # Words of a block of texts at a time; the n-grams of each word that is new to its block.
    keys, counts, held_keys, gram_bucket, gram_count = [], [], [], [], []
    for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
        padded, starts, ends, word_first = _padded(data, offsets)
        key = span_hash(prefix_hash(padded), starts, ends)
        own, one = np.unique(key, return_index=True)
        per_size = [(h, np.maximum(ends[one] - starts[one] + 3 - n, 0)) for n, h, _ in _grams(padded)]
        found = np.concatenate([h[gather_ranges(starts[one] - 1, c)] for h, c in per_size])
        of = np.concatenate([np.repeat(np.arange(len(one)), c) for _, c in per_size])
        gram_bucket.append(found[np.argsort(of, kind="stable")])
        gram_count.append(sum(c for _, c in per_size))
        keys.append(key)
        counts.append(np.diff(word_first))
        held_keys.append(own)
    first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    distinct, at = np.unique(np.concatenate(held_keys), return_index=True)
    word = np.searchsorted(distinct, np.concatenate(keys))
    per = np.concatenate(gram_count)
    begin_of = np.cumsum(per) - per
    one = at
    bucket = np.concatenate(gram_bucket)[gather_ranges(begin_of[one], per[one])].astype(np.int32)
    of = np.repeat(np.arange(len(one), dtype=np.int32), per[one])
    del keys, counts, held_keys, gram_bucket, gram_count
    # Buckets that few texts hold say little; they stay at zero.
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    pairs = np.divmod(np.unique(doc * len(one) + word), len(one))
    pair_begin = np.searchsorted(pairs[0], np.arange(len(texts) + 1))
    seen = np.bincount(bucket, np.bincount(pairs[1], minlength=len(one))[of], 1 << BITS) >= 3
    held = seen[bucket]
    bucket, of = bucket[held], of[held]
    used, bucket = np.unique(bucket, return_inverse=True)
    bucket = bucket.astype(np.int32)
    per_word = np.maximum(np.bincount(of, minlength=len(one)), 1)
    begin, seg_first = _segments(first)
    seg_of_word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, first[-1])))
    seg_len = np.bincount(seg_of_word, minlength=len(begin))
    some = np.diff(seg_first) > 0
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    soft = rng.normal(0, 0.3, (DIM, 2))
    # The first dimension begins as the smoothed log odds of the texts that hold the bucket, the rest at random.
    order, per = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(one))
    by_word, gram_begin = bucket[order], np.cumsum(per) - per
    held_by = np.zeros((2, len(used)))
    for d in range(len(texts)):
        w = pairs[1][pair_begin[d] : pair_begin[d + 1]]
        held_by[int(labels[d]), np.unique(by_word[gather_ranges(gram_begin[w], per[w])])] += 1
    neg, pos = held_by
    del order, by_word
    emb[:, 0] = PRIOR * np.log((pos + SMOOTH * labels.mean()) / (labels.sum() + SMOOTH) * (len(labels) - labels.sum() + SMOOTH) / (neg + SMOOTH * (1 - labels.mean())))
    soft[0] = -0.5, 0.5
    bias, speed_e, speed_s, speed_b = np.zeros(2), np.zeros_like(emb), np.zeros_like(soft), np.zeros(2)
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    for step in range(steps):
        direction = soft[:, 1] - soft[:, 0]
        scores = np.bincount(of, (emb @ direction)[bucket], len(one)) / per_word
        seg = np.bincount(seg_of_word, scores[word], len(begin)) / seg_len + bias[1] - bias[0]
        odds = np.full(len(texts), bias[1] - bias[0])
        share = np.zeros(len(begin))  # how much of a text's odds comes from each segment
        if step < steps // 4:
            docs = np.repeat(np.arange(len(texts)), np.diff(seg_first))
            share = 1 / np.diff(seg_first)[docs]
            odds[some] = np.bincount(docs, seg * share, len(texts))[some]
        else:
            odds[some] = np.maximum.reduceat(seg, seg_first[:-1][some])
            worst = np.flatnonzero(seg == np.repeat(odds, np.diff(seg_first)))
            share[worst] = 1
        error = (sigmoid(odds) - labels) * balance
        by_seg = np.repeat(error, np.diff(seg_first)) * share / seg_len
        by_word = np.bincount(word, by_seg[seg_of_word], len(one)) / per_word
        by_bucket = np.bincount(bucket, by_word[of], len(used))
        g_soft = (by_bucket @ emb)[:, None] * np.array([-1.0, 1.0])
        g_emb = by_bucket.astype(np.float32)[:, None] * direction.astype(np.float32)
        g_bias = error.sum() * np.array([-1.0, 1.0])
        for value, speed, g, scale in ((emb, speed_e, g_emb, 4.0), (soft, speed_s, g_soft, 0.1), (bias, speed_b, g_bias, 0.2)):
            speed *= 0.9
            speed -= rate * 0.1 * scale * g / (np.linalg.norm(g) + 1e-9) * min(1.0, np.abs(error).sum() + 0.02)
            value += speed
    out = np.zeros(1 << BITS, np.float32)
    out[used] = emb @ (soft[:, 1] - soft[:, 0])
    return Model(out, float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample: (text, toxic) of labelled rows outside the held-out fifth."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Choose ids first, so that only the sample's texts are moved.
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = rows.select("doc_id").join(marks, "doc_id").distinct()
    chosen = ids.where("toxic = 1").orderBy(*order).limit(MAX_TRAIN).unionByName(ids.where("toxic = 0").orderBy(*order).limit(MAX_TRAIN))
    return rows.join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").limit(2 * MAX_TRAIN).select("text", "toxic")


def held_out(key: str):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def _train_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model from all rows of the (only) partition."""
    texts: list[str] = []
    labels: list[int] = []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    model = train(texts, np.array(labels))
    yield pa.RecordBatch.from_arrays([pa.array([model.bucket.tobytes()], pa.binary()), pa.array([model.bias])], ["bucket", "bias"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train in one task on the bounded sample; the driver gets the model alone."""
    rows = training_rows(docs, labels).coalesce(1).transform(map_arrow, _train_partition, "bucket binary, bias double").collect()
    if not rows:
        return train([], np.zeros(0))
    return Model(np.frombuffer(rows[0].bucket, np.float32), rows[0].bias)


def _score_partition(shared, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [_odds(data, offsets, model) for _, _, data, offsets in blocks(batch.column(text_at))]
            score = sigmoid(np.concatenate(scores)) if scores else np.zeros(0)
            keep = [i for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(score)], [*(batch.schema.names[i] for i in keep), "score"])

    return run


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """Add ``score`` to every row; the text itself is dropped unless ``keep_text``."""
    kept = [c for c in docs.columns if c != "score" and (keep_text or c != "text")]
    rows = docs.select(*kept, F.col("text").alias(fresh("_text", kept)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size, 2**BITS floats
    schema = docs.select(*kept).withColumn("score", F.lit(0.0)).schema
    return rows.transform(map_arrow, _score_partition(shared, len(kept)), schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    model = fit(docs, labels)
    kept, own = docs.columns, fresh("_own_score", docs.columns)
    renamed = docs.withColumnRenamed("score", own) if "score" in kept else docs
    return score(renamed, model, keep_text=True).where("score < 0.5").drop("score").withColumnRenamed(own, "score").select(*kept)
