"""The memory of pieces as flat arrays."""

import random

import numpy as np
import pytest

from evidora.llm import bpe
from evidora.llm.piece_memory import PieceMemory, Table


def words(first, n):
    return ["".join(chr(97 + int(c)) for c in str(1_000_000 + i)) for i in range(first, first + n)]


def test_more_pieces_than_before_are_encoded_once():
    calls = [0]

    def encode(piece):
        calls[0] += 1
        return [len(piece), 7]

    texts = [" ".join(words(25_000 * k, 25_000)) for k in range(12)]
    codec = bpe.PieceCodec(encode)
    first = [codec.encode([t])[0].tolist() for t in texts]
    once = calls[0]
    assert [codec.encode([t])[0].tolist() for t in texts] == first
    assert calls[0] == once
    assert codec.known.size <= bpe.PIECE_BYTES


@pytest.mark.parametrize("limit", [1, 200_000, 96 << 20])
def test_ids_are_those_of_every_piece_whatever_is_forgotten(limit):
    def encode(piece):
        return [ord(c) for c in piece[1:]]  # a piece of one character has no ids

    rng = random.Random(5)
    few = words(0, 300)
    codec = bpe.PieceCodec(encode, limit)
    for block in range(40):
        texts = ["".join(rng.choice([" ", "\n", "x ", "ä", "\ud800", "👍 ", *few[: 30 + 7 * block]]) for _ in range(rng.randrange(60))) for _ in range(9)]
        ids, first = codec.encode(texts)
        for t, a, b in zip(texts, first[:-1], first[1:]):
            _, _, starts, ends, _ = bpe.pretoken.split([t])
            assert ids[a:b].tolist() == [i for s, e in zip(starts, ends) for i in encode(t[s:e])]
    assert len(codec.encode(["", ""])[0]) == 0


def test_a_clash_of_hashes_gives_no_other_piece():
    table = Table()
    cps = np.array([97, 98, 97, 99, 97], np.uint32)  # "ab", "ac", "a"
    entry = table.add(np.array([7], np.uint64), cps[:2], np.array([2]), np.array([5], np.uint32), np.array([1]))
    at = np.array([0, 2, 4]), np.array([2, 4, 5])
    assert table.find(np.array([7, 7, 7], np.uint64), cps, *at).tolist() == [entry[0], -1, -1]
    assert table.find(np.array([7 + len(table.slots), 8, 7], np.uint64), cps, *at).tolist() == [-1, -1, -1]


def test_a_table_over_the_limit_is_not_kept():
    memory = PieceMemory(1000)
    none = np.zeros(0, np.int64)
    memory.young.add(np.array([7], np.uint64), np.zeros(5000, np.uint32), np.array([5000]), np.array([5], np.uint32), np.array([1]))
    memory.find(np.zeros(0, np.uint64), np.zeros(0, np.uint32), none, none)
    assert memory.young.n == memory.old.n == 0
