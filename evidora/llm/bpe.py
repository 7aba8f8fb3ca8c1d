"""Byte-level BPE encoding and decoding (operator 10).

**Encoder.**  Byte-pair merging of a piece has exactly one result, and a
sequence of tokens is that result if and only if every two neighbours are (two
tokens are neighbours if merging their joined bytes gives just those two).
So a transducer can read a piece byte by byte: a hypothesis is a node of the
vocabulary's trie for the token being read and the token before it.  Reading a
byte moves every hypothesis down the trie; where a token may end and fits its
left neighbour, one more hypothesis begins there.  Of the hypotheses that end
at the same place only one can be right, so the set stays as small as the
longest token.  The determinised states (sets of hypotheses) and the arcs
between them are built when they are first met; a bounded memory forgets those
that have not been met for long.  Tokens are written when all hypotheses share
them, a bounded number of bytes after they end.

**Decoder.**  Tokens are bytes, and a character may be split between tokens.
``StreamDecoder`` keeps the state of a UTF-8 automaton between calls and gives
out characters as soon as they are whole.

Defined cases: null and empty texts have no tokens; texts are read whole;
special tokens do not exist (their strings are ordinary text); repeated rows
give repeated results; extra columns are kept unless they bear the name of a
result column, which replaces them.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import Struct
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pretoken
from .piece_memory import PieceMemory
from .shared import map_arrow
from .textblock import blocks, gather_ranges

#: What a worker remembers at most, in bytes: arcs of the transducer and ids of pieces.
ARC_BYTES = 128 << 20
PIECE_BYTES = 96 << 20
ENTRY = 100  # what an entry of a dict takes besides key and value, about
WINDOW = 1024  # bytes of a piece between two looks at what is settled
CHUNK = 1 << 16  # bytes that the decoder is fed at once
_STATE, _PAIR = Struct("<i"), Struct("<ii")
_BYTE = [bytes([b]) for b in range(256)]
BAD = 8

Partition = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """Byte-pair merging by its definition: always the leftmost pair of lowest rank (under ``below``)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min([(ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)])
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Aged:
    """A memory of about ``limit`` bytes that forgets by age.

    It has a younger and an older half.  When the younger one is full, the
    older one is forgotten; what is asked for again becomes young again.
    """

    def __init__(self, limit: int):
        self.half = limit // 2
        self.clear()

    def clear(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def get(self, key: object) -> object | None:
        value = self.young.get(key)
        if value is None and (value := self.old.pop(key, None)) is not None:
            self.put(key, value)
        return value

    def put(self, key: object, value: object) -> None:
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += getsizeof(key) + getsizeof(value) + ENTRY


class Transducer:
    """The lazily determinised transducer for one table of ranks.

    A state is the token that ends where it stands and its hypotheses: (token
    before the one being read, node of the trie), 4 bytes a number.  That
    names it, so that arcs, (state, byte) to state, can be forgotten one by one.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = ARC_BYTES):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        self.step: dict[int, int] = {}
        self.ends, self.depth, self.inner = array("i", [-1]), array("H", [0]), bytearray(1)
        for t in sorted(ranks):
            self.token[ranks[t]] = t
            node = 0
            for byte in t:
                nxt = self.step.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.step[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = nxt
            self.ends[node] = ranks[t]
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.alone: dict[int, bool] = {}
        self.arcs = Aged(limit)
        self.start = _STATE.pack(-1)

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may directly follow ``left`` (-1: the start of a piece)."""
        if (known := self.alone.get(right)) is None:
            known = self.alone[right] = len(merge(self.token[right], self.ranks)) == 1
        return known and (left < 0 or self._stay_apart(left, right))

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self.made_of:
            t = self.token[token]
            parts = merge(t, self.ranks, below=token) if len(t) > 1 else [t]
            self.made_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.made_of[token]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of ``a`` and ``b`` never merges across their border.

        Go back through the merges that made the two tokens, latest first (of
        equal ranks the right one, as the left is merged first).  At each
        point in time the border lies between two parts; they would merge if
        their joint rank comes before the merge that was just undone.
        """
        before = 1 << 60  # merges at this point in time have lower ranks ...
        on_tie = False  # ... or this rank, if the border lies left of the undone merge
        ranks, token = self.ranks, self.token
        while True:
            joint = ranks.get(token[a] + token[b])
            if joint is not None and (joint < before or on_tie and joint == before):
                return False
            x, y = self._halves(a), self._halves(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and a > b:
                before, on_tie, a = a, False, x[1]
            else:
                before, on_tie, b = b, True, y[0]

    def _hypotheses(self, state: bytes) -> Iterator[tuple[int, int]]:
        """(token before, node) of each, the one that began first first."""
        yield from _PAIR.iter_unpack(state[4:])
        yield _STATE.unpack_from(state)[0], 0

    def _advance(self, state: bytes, byte: int) -> bytes:
        moved, closed = [], -1
        for last, node in self._hypotheses(state):
            nxt = self.step.get(node << 8 | byte)
            if nxt is None:
                continue
            token = self.ends[nxt]
            if closed < 0 <= token and self.fits(last, token):
                closed = token
            if self.inner[nxt]:
                moved.append(_PAIR.pack(last, nxt))
        if closed < 0:
            raise ValueError(f"byte {byte} has no token")
        return _STATE.pack(closed) + b"".join(moved)

    def _settled(self, states: list[bytes]) -> int:
        """Where the tokens end that all hypotheses of the last state share."""
        here = len(states) - 1
        begin = {here - self.depth[node] for _, node in self._hypotheses(states[-1])}
        while len(begin) > 1:
            last = max(begin)
            begin.remove(last)
            begin.add(last - len(self.token[_STATE.unpack_from(states[last])[0]]))
        return begin.pop()

    def _tokens(self, states: list[bytes], end: int) -> list[int]:
        """The tokens from the first state to ``end``, read from the back."""
        out = []
        while end > 0:
            token = _STATE.unpack_from(states[end])[0]
            out.append(token)
            end -= len(self.token[token])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece.

        After every ``WINDOW`` bytes the tokens that are settled are written
        and their states forgotten, so a piece of any length needs little.
        """
        out: list[int] = []
        state, states, young = self.start, [self.start], self.arcs.young
        for byte in piece:
            key = state + _BYTE[byte]
            nxt = young.get(key)
            if nxt is None:
                if (nxt := self.arcs.get(key)) is None:
                    nxt = self._advance(state, byte)
                    self.arcs.put(key, nxt)
                young = self.arcs.young
            state = nxt
            states.append(state)
            if len(states) > WINDOW:
                settled = self._settled(states)
                out += self._tokens(states, settled)
                del states[:settled]
        out += self._tokens(states, len(states) - 1)
        return out


def _automaton() -> np.ndarray:
    """Next state of the UTF-8 automaton by state and byte.

    0: between characters; 1 to 3: so many bytes are missing; 4 to 7: after a
    first byte that narrows the second (E0, ED, F0, F4); BAD: no way on.
    """
    table = np.full((8, 256), BAD, np.uint8)
    table[0, :0x80], table[0, 0xC2:0xE0], table[0, 0xE0:0xF0], table[0, 0xF0:0xF5] = 0, 1, 2, 3
    table[0, [0xE0, 0xED, 0xF0, 0xF4]] = 4, 5, 6, 7
    for state, low, high, then in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state, low : high + 1] = then
    return table


_UTF8 = _automaton()


class StreamDecoder:
    """Takes bytes of tokens chunk by chunk; ``feed`` returns the UTF-8 bytes of all characters that are whole.

    What is held between calls are the bytes of a character that is not yet
    whole.  The automaton runs over all characters of a chunk at once, one
    step for each of their at most four bytes.  Bytes it cannot go on with
    become U+FFFD as with Python's ``errors="replace"``.
    """

    def __init__(self) -> None:
        self.held = np.zeros(0, np.uint8)

    def feed(self, data: np.ndarray) -> bytes:
        if not len(self.held) and (not len(data) or data.max() < 0x80):
            return data.tobytes()
        return self._run(np.concatenate((self.held, data)), last=False)

    def close(self) -> bytes:
        return self._run(self.held, last=True)

    def _run(self, data: np.ndarray, last: bool) -> bytes:
        n, state = len(data), _UTF8[0][data]
        free = state == BAD  # bytes that belong to no character
        broken = []  # first byte and length of what becomes U+FFFD
        end, at = n, np.flatnonzero((state != 0) & ~free)
        state = state[at]
        for k in range(1, 4):
            whole = at + k < n
            if not whole.all():  # the chunk ends in its last character
                if last:
                    broken.append((int(at[-1]), k))
                else:
                    end = int(at[-1])
                at, state = at[whole], state[whole]
            state = _UTF8[state, data[at + k]]
            good = state != BAD
            broken += [(p, k) for p in at[~good].tolist()]
            free[at[good] + k] = False
            at, state = at[state % BAD > 0], state[state % BAD > 0]
        self.held = data[end:].copy()
        broken += [(p, 1) for p in np.flatnonzero(free[:end]).tolist()]
        out, done = [], 0
        for p, k in sorted(broken):
            out += [data[done:p].tobytes(), b"\xef\xbf\xbd"]
            done = p + k
        return b"".join([*out, data[done:end].tobytes()])


class PieceCodec:
    """Encodes blocks of texts; remembers the ids of pieces it has met lately.

    ``encode_piece`` gives the ids of one piece.
    """

    def __init__(self, encode_piece: Callable[[str], list[int]], limit: int = PIECE_BYTES):
        self.encode_piece, self.known = encode_piece, PieceMemory(limit)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids begin (n + 1)."""
        joined, cps, starts, ends, first = pretoken.split(texts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        hashes, at, which = pretoken.distinct(cps, starts, ends)
        begin, end = starts[at], ends[at]
        entry = self.known.find(hashes, cps, begin, end)
        new = np.flatnonzero(entry < 0)
        if len(new):
            begin, end = begin[new], end[new]
            ids, n_ids = array("I"), []
            for s, e in zip(begin.tolist(), end.tolist()):
                own = self.encode_piece(joined[s:e])
                ids.extend(own)
                n_ids.append(len(own))
            entry[new] = self.known.young.add(hashes[new], cps[gather_ranges(begin, end - begin)], end - begin, np.array(ids, np.uint32), np.array(n_ids))
        table, entry = self.known.young, entry[which]
        n = table.id_at[entry + 1] - table.id_at[entry]
        return table.ids[gather_ranges(table.id_at[entry], n)], np.concatenate(([0], np.cumsum(n)))[first]


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[PieceCodec, Transducer]:
    fst = Transducer(read_ranks(path))
    return PieceCodec(lambda piece: fst.encode(piece.encode("utf-8", "surrogatepass"))), fst


def _forgetting(run: Partition) -> Partition:
    """``run``, after which a worker keeps nothing: what it would keep costs other stages more than half a second a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            codec.cache_clear()
            token_bytes.cache_clear()

    return task


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens one after the other, their starts and lengths."""
    token = codec(path)[1].token
    lengths = np.array([len(t) for t in token], np.int64)
    return np.frombuffer(b"".join(token), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_ids(ids: np.ndarray, first: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each run of ids, and where each begins (n + 1)."""
    data, starts, lengths = token_bytes(path)
    n = lengths[ids]
    return data[gather_ranges(starts[ids], n)], np.concatenate(([0], np.cumsum(n)))[first]


def decoded(data: np.ndarray) -> Iterator[bytes]:
    """The bytes of a document's tokens through the automaton, chunk by chunk."""
    decoder = StreamDecoder()
    for at in range(0, len(data), CHUNK):
        yield decoder.feed(data[at : at + CHUNK])
    yield decoder.close()


def _sha256(chunks: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for chunk in chunks:
        digest.update(chunk)
    return digest.hexdigest()


def _encode_partition(path: str, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = codec(path)
        for batch in batches:
            for a, b, _, _ in blocks(batch.column(text_at)):
                rows = batch.slice(a, b - a)
                ids, first = pieces.encode([t or "" for t in rows.column(text_at).to_pylist()])
                ids_column = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(rows.columns) if i != text_at), ids_column], [*(n for i, n in enumerate(rows.schema.names) if i != text_at), "ids"])

    return run


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Replace the text column by ``ids`` (array of int); other columns stay."""
    kept = [c for c in docs.columns if c not in (text, "ids")]
    docs = docs.select(*kept, text)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.transform(map_arrow, _forgetting(_encode_partition(path, len(kept))), schema)


def _decode_partition(path: str, ids_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids_at).fill_null([])
            ids = column.flatten().to_numpy(zero_copy_only=False)
            data, at = decode_ids(ids, np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy()))), path)
            texts = [b"".join(decoded(data[s:e])).decode() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != ids_at), pa.array(texts, pa.string())], [*(n for i, n in enumerate(batch.schema.names) if i != ids_at), "text"])

    return run


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Replace ``ids`` by ``text``; bytes that are no UTF-8 become U+FFFD."""
    kept = [c for c in encoded.columns if c not in (ids, "text")]
    encoded = encoded.select(*kept, ids)
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("text", T.StringType())])
    return encoded.transform(map_arrow, _forgetting(_decode_partition(path, len(kept))), schema)


def _digest_partition(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, fst = codec(path)
        decimal = np.array([str(i) for i in range(len(fst.token))], object)
        for batch in batches:
            for a, b, _, _ in blocks(batch.column(1)):
                rows = batch.slice(a, b - a)
                ids, first = pieces.encode([t or "" for t in rows.column(1).to_pylist()])
                data, at = decode_ids(ids, first, path)
                shown = decimal[ids]
                bounds = list(zip(first[:-1].tolist(), first[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([hashlib.sha256(" ".join(shown[s:e]).encode()).hexdigest() for s, e in bounds]),
                        pa.array([_sha256(decoded(data[s:e])) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: token count and digests of the ids and of the bytes decoded from them.

    Encoding and decoding happen in one pass, so ids never leave the task.
    """
    return docs.select("doc_id", "text").transform(map_arrow, _forgetting(_digest_partition(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
