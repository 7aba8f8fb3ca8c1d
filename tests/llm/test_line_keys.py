"""The leaves that a line reaches in the template tree."""

import math

import numpy as np

from evidora.llm import templates


def test_keys_are_the_line_itself_and_the_pairs_of_parts_with_tokens():
    n = np.array([3, 4, 6, 9, 9, 40])
    parts = np.arange(36, dtype=np.int32).reshape(6, 6)
    parts[4] = parts[3]
    parts[4, 0] = 99  # line 4 is line 3 with another first part
    keys, first = templates._tree_keys(n, parts)
    lines = [keys[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    for count, found in zip(n.tolist(), lines):
        held = [math.ceil((i + 1) * count / 6) > math.ceil(i * count / 6) for i in range(6)]
        pairs = sum(held[i] and held[j] for i, j in ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)))
        assert len(found) == len(set(found)) == 1 + (pairs if count >= templates.FIELD_TOKENS else 0)
    assert lines[3][0] != lines[4][0] and len(set(lines[3]) & set(lines[4])) == 4  # pairs 12, 34, 35, 45
    assert templates._tree_keys(np.zeros(0, np.int64), np.zeros((0, 6), np.int32))[1].tolist() == [0]
