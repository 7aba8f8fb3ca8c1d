"""MinHash fingerprints of documents (operator 7).

A document's set is its distinct lower-cased five-word shingles; with fewer
words, the whole word sequence; without words, nothing.  ``PERMS`` universal
hash functions (multiply-add modulo 2**64, high bits) give one minimum each;
a fingerprint is the high 16 bits of every minimum, in base64.  The share of
equal positions estimates the Jaccard similarity.

``near_duplicates`` bands the minima, joins bands in Spark and verifies the
Jaccard similarity of the full sets; see ``neardup``.

Defined cases: null texts count as empty; a text without words has the empty
fingerprint (all positions at their maximum), whose likeness to another empty
one is 1 and to any other about 0; repeated ids are ordered by their texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .ordered import in_order_with_next
from .shared import map_arrow
from .textblock import BLOCK_BYTES, distinct_per_doc, lower_ascii, mix, ngram_hashes, text_arrays, word_hashes

PERMS = 128
SHINGLE = 5

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and where each text begins (n + 1)."""
    h, first = word_hashes(lower_ascii(data), offsets)
    return distinct_per_doc(*ngram_hashes(h, first, SHINGLE, short=True))


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minima of each set under every hash function (n x PERMS, 16 bits)."""
    n = len(first) - 1
    out = np.full((n, PERMS), 0xFFFF, np.uint16)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        begin = first[some]
        with np.errstate(over="ignore"):
            for p in range(PERMS):
                out[some, p] = (np.minimum.reduceat(values * _MULTIPLY[p] + _ADD[p], begin) >> np.uint64(48)).astype(np.uint16)
    return out


def of_texts(texts: list[str]) -> np.ndarray:
    """Signatures of texts, computed in blocks."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        data, offsets = text_arrays(pa.array(texts[at:end], pa.string()))
        out.append(signatures(*shingles(data[offsets[0] : offsets[-1]], offsets - offsets[0])))
        at = end
    return np.concatenate(out) if out else np.zeros((0, PERMS), np.uint16)


def text_of(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u2").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own rows of a sorted range, each with the text that follows it."""
    ids: list = []
    texts: list[str] = []

    def emit(n: int) -> Iterator[pa.RecordBatch]:
        """Rows 0 .. n - 1, the follower of each being the row after it."""
        at = 0
        while at < n:
            end, size = at, 0
            while end < n and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
                size += len(texts[end])
                end += 1
            changed = [edited(texts[i], texts[i + 1]) for i in range(at, end)]
            own, new = of_texts(texts[at : end + 1]), of_texts(changed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[at:end], pa.int64()),
                    pa.array([len(t) for t in texts[at:end]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(map(text_of, own[:-1])),
                    pa.array(map(text_of, new)),
                    pa.array(likeness(own[:-1], new)),
                    pa.array(likeness(own[:-1], own[1:])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            at = end

    for batch in batches:
        lent = batch.column(2).to_pylist()
        own = lent.index(1) if 1 in lent else len(lent)
        ids += batch.column(0).slice(0, own).to_pylist()
        texts += [t or "" for t in batch.column(1).slice(0, own).to_pylist()]
        if own < len(lent):
            if ids:
                texts.append(batch.column(1)[own].as_py() or "")
                yield from emit(len(ids))
            return
        if len(ids) > 1:
            yield from emit(len(ids) - 1)
            del ids[:-1], texts[:-1]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how near they and the next document's are."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order_with_next(docs.select("doc_id", "text")).select("doc_id", "text", "_next_range").transform(map_arrow, _walk, schema)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` positions (n x PERMS // rows)."""
    n, bands = len(signature), signature.shape[1] // rows
    parts = signature[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for i in range(rows):
        key = mix(key + parts[:, :, i] + np.uint64(1))
    return key


def sketch(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and their band keys, as ``neardup`` takes them."""
    found = signatures(values, first)
    return found, band_keys(found, 4)


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id; links have sets at least ``threshold`` alike."""
    from . import neardup

    return neardup.components(docs, sketch, lambda x, y, _n, _m: likeness(x, y), threshold).select("doc_id", "n_shingles", "component_id")
