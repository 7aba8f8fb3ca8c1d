"""Token ids in compressed binary shards (operator 2).

Format.  A store is a folder of Parquet tables that Spark can write to and
read from any shared file system:

* ``dictionary``: one row with the zstandard dictionary, its SHA-256, the id
  width in bytes and the end id.
* ``shards``: rows (bucket, shard, first_id, last_id, n_docs, offset, n_tokens,
  data), ascending by doc_id.  ``data`` is one binary file: the header
  ``TOKS``, version, id width, number of documents, dictionary hash; then the
  doc_ids, the token counts, the offset index (n + 1), and one zstandard frame
  for each document.  A short document costs one frame: the index says where.
* ``buckets``: ids of all buckets before each bucket.

The dictionary is trained on serialised id arrays of a bounded sample
(the first ``SAMPLE_BYTES`` of the arrays of ``SAMPLE_DOCS`` documents, in the order
of a hash of the id); every document is compressed on its own with it.  A sample
that is too small or too uniform for zstandard gives an empty dictionary.

Pieces of the text (see ``pretoken``) are encoded by the ``tokenizers``
library, each distinct piece once for as long as it stays in memory; with a
tokenizer that does not split by that pattern, and where a text holds one of the
tokenizer's added tokens (which the library takes out first), whole texts are.

Order is kept without a global sort: ids are cut into ranges by quantiles, a
range is one partition, and starts are sums over whole ranges plus the running
sum inside.

Defined cases: null texts count as empty (only the end id); repeated ids are
all kept, ordered by their token counts and bytes; null ids come first, and the
id -2**63 reads as null; extra columns are ignored; an empty table gives an empty
store.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PieceCodec
from .shared import map_arrow, partitions, range_bounds, range_bucket
from .textblock import blocks

SAMPLE_DOCS = 1000
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 32 << 10
SHARD_BYTES = 4 << 20
LEVEL = 3
_HEADER = struct.Struct("<4sHHI32s")


@lru_cache(maxsize=2)
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    split = whole.pre_tokenizer

    def whole_texts(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in whole.encode_batch(texts, add_special_tokens=False)]

    if whole.normalizer is not None or type(split).__name__ != "ByteLevel" or split.add_prefix_space or not getattr(split, "use_regex", True):

        def texts_to_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return _joined(whole_texts(texts))

        return texts_to_ids, whole.get_vocab_size()
    # The library's model reads bytes as the characters of the public byte-level alphabet.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    alphabet = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(shifted)}
    tokenize = whole.model.tokenize
    pieces = PieceCodec(lambda piece: [t.id for t in tokenize(piece.encode().decode("latin-1").translate(alphabet))])
    added = [str(t.content) for t in whole.get_added_tokens_decoder().values()]

    def texts_to_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = [i for i, t in enumerate(texts) if any(a in t for a in added)]
        ids, first = pieces.encode(texts)
        if not special:
            return ids, first
        found = [ids[a:b] for a, b in zip(first[:-1], first[1:])]
        for i, own in zip(special, whole_texts([texts[i] for i in special])):
            found[i] = own
        return _joined(found)

    texts_to_ids.forget = pieces.known.clear
    return texts_to_ids, whole.get_vocab_size()


def _joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate(([0], np.cumsum([len(ids) for ids in found]))).astype(np.int64)


def _width(path: str) -> int:
    return 2 if _encoder(path)[1] <= 1 << 16 else 4


def _serialised(texts: list[str], path: str, end_id: int) -> Iterator[tuple[int, bytes]]:
    """Token count and serialised ids of each text, end id included."""
    ids, first = _encoder(path)[0](texts)
    dtype = f"<u{_width(path)}"
    ids = ids.astype(dtype)
    end = np.array([end_id], dtype).tobytes()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield b - a + 1, ids[a:b].tobytes() + end


def _sample_partition(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in blocks(batch.column(0)):
                found = [x[:SAMPLE_BYTES] for _, x in _serialised([t or "" for t in batch.column(0).slice(a, b - a).to_pylist()], path, end_id)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["ids"])

    return run


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = 0) -> bytes:
    """The shared dictionary; empty if the sample is too small or too uniform to train one."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    sample = docs.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE_DOCS).select("text")
    samples = [bytes(r.ids) for r in sample.transform(map_arrow, _sample_partition(tokenizer, end_id), "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_dict_id=False)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _frames_partition(tokenizer: str, end_id: int, dictionary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _compressor(dictionary)
        for batch in batches:
            for a, b, _, _ in blocks(batch.column(2)):
                rows = batch.slice(a, b - a)
                counts, frames = [], []
                for n, ids in _serialised([t or "" for t in rows.column(2).to_pylist()], tokenizer, end_id):
                    counts.append(n)
                    frames.append(press.compress(ids))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["bucket", "doc_id", "n_tokens", "frame"])
        getattr(_encoder(tokenizer)[0], "forget", lambda: None)()

    return run


def pack(doc_ids: list[int | None], counts: list[int], frames: list[bytes], dictionary_hash: bytes, width: int) -> bytes:
    """One binary shard."""
    at = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8")
    known = [-(1 << 63) if d is None else d for d in doc_ids]
    return b"".join([_HEADER.pack(b"TOKS", 1, width, len(frames), dictionary_hash), np.array(known, "<i8").tobytes(), np.array(counts, "<u8").tobytes(), at.tobytes(), *frames])


class Shard:
    """A binary shard, opened for reading."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, self.width, self.n, held = _HEADER.unpack_from(data)
        if magic != b"TOKS" or version != 1:
            raise ValueError("not a token shard")
        if held != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at, n = _HEADER.size, self.n
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.counts = np.frombuffer(data, "<u8", n, at + 8 * n)
        self.index = np.frombuffer(data, "<u8", n + 1, at + 16 * n)
        self.frames, self.base, self.open = memoryview(data), at + 16 * n + 8 * (n + 1), _decompressor(dictionary)

    def ids(self, i: int) -> np.ndarray:
        """The ids of document number i."""
        frame = self.frames[self.base + int(self.index[i]) : self.base + int(self.index[i + 1])]
        return np.frombuffer(self.open.decompress(frame), f"<u{self.width}").astype("<u4")


def _shards_partition(dictionary_hash: bytes, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["bucket", "shard", "first_id", "last_id", "n_docs", "offset", "n_tokens", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, frames, size, shard, offset, bucket = [], [], [], 0, 0, 0, None

        def close() -> pa.RecordBatch:
            data = pack(ids, counts, frames, dictionary_hash, width)
            known = [i for i in ids if i is not None]
            values = [bucket, shard, known[0] if known else None, known[-1] if known else None, len(ids), offset, sum(counts), data]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in batches:
            for b, i, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (b != bucket or size >= SHARD_BYTES):
                    yield close()
                    offset, shard = (0, 0) if b != bucket else (offset + sum(counts), shard + 1)
                    ids, counts, frames, size = [], [], [], 0
                bucket = b
                ids.append(i)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
        if ids:
            yield close()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every whole text and write the store."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    width = _width(tokenizer)
    held = bytearray(dictionary)
    spark.createDataFrame([(held, hashlib.sha256(dictionary).hexdigest(), width, end_id)], "dictionary binary, sha256 string, width int, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")
    bounds = range_bounds(docs, "doc_id", partitions(spark))
    dealt = docs.select(range_bucket(F.col("doc_id"), bounds).alias("bucket"), "doc_id", "text")
    frames = dealt.transform(map_arrow, _frames_partition(tokenizer, end_id, dictionary), "bucket int, doc_id long, n_tokens long, frame binary")
    ordered = frames.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "n_tokens", "frame")
    schema = "bucket int, shard long, first_id long, last_id long, n_docs long, offset long, n_tokens long, data binary"
    ordered.transform(map_arrow, _shards_partition(hashlib.sha256(dictionary).digest(), width), schema).write.parquet(f"{path}/shards")
    totals = spark.read.parquet(f"{path}/shards").groupBy("bucket").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals.select("bucket", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/buckets")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)


def _read_partition(dictionary: bytes, wanted: tuple[int, ...] | None, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py(), dictionary)
                starts = start + np.cumsum(shard.counts) - shard.counts
                pick = range(shard.n) if wanted is None else np.flatnonzero(np.isin(shard.doc_ids, wanted)).tolist()
                ids = [shard.ids(i) for i in pick]
                known = shard.doc_ids[list(pick)]
                columns = [pa.array(known, mask=known == -(1 << 63)), pa.array(starts[list(pick)].astype(np.int64))]
                if whole:
                    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
                    at = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32))))
                    names = ["doc_id", "start", "ids"]
                else:
                    columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _opened(spark: SparkSession, path: str) -> DataFrame:
    bases = F.broadcast(spark.read.parquet(f"{path}/buckets"))  # one row a range
    return spark.read.parquet(f"{path}/shards").join(bases, "bucket")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32, read from its shards."""
    rows = _opened(spark, path).select((F.col("base") + F.col("offset")).alias("start"), "data")
    return rows.transform(map_arrow, _read_partition(_dictionary(spark, path), None, False), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a store: doc_id, start, ids."""
    rows = _opened(spark, path).select((F.col("base") + F.col("offset")).alias("start"), "data")
    return rows.transform(map_arrow, _read_partition(_dictionary(spark, path), None, True), "doc_id long, start long, ids array<int>")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """A few documents by id: reads only shards whose id range holds one, and only their frames."""
    may = F.lit(False)
    for i in doc_ids:
        may |= (F.col("first_id") <= i) & (F.col("last_id") >= i)
    rows = _opened(spark, path).where(may).select((F.col("base") + F.col("offset")).alias("start"), "data")
    return rows.transform(map_arrow, _read_partition(_dictionary(spark, path), tuple(doc_ids), True), "doc_id long, start long, ids array<int>")
