"""The byte-level BPE split of a text into pieces, without a regex engine.

The pattern is the public GPT-2 one::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Pieces are runs of one character class, where a space directly before a run
of letters, digits or other signs belongs to the run.  So all borders of a
block of texts come from comparing the classes of neighbouring code points:

* a run of two or more white-space characters before something else gives all
  but its last character as one piece; the last one joins the next run if it
  is a space, and is a piece of its own otherwise;
* an apostrophe that begins a run of other signs of length one, with no space
  joined to it, and is followed by s, t, re, ve, m, ll or d, takes those
  letters with it; the letters after them begin a new piece.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pandas as pd

from .textblock import prefix_hash, span_hash

LETTER, NUMBER, SPACE, OTHER, BORDER = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the pattern's \\p{L}, \\p{N} and \\s see it."""
    import regex

    points = np.arange(sys.maxunicode + 1, dtype="<u4")
    points[0xD800:0xE000] = 0xFFFD
    every = points.tobytes().decode("utf-32-le")
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined text, its code points, piece starts, piece ends, first piece of each text (n + 1).

    Texts are joined with one border character between them, which is in no piece.
    """
    joined = "\0".join(texts) + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    borders = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = classes()[cps]
    kind[borders] = BORDER
    n = len(kind)
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = kind[1:] != kind[:-1]
    begins[1:] |= kind[:-1] == BORDER
    space_run = np.flatnonzero(begins & (kind == SPACE))
    if len(space_run):
        run_starts = np.flatnonzero(begins)
        ends = run_starts[np.searchsorted(run_starts, space_run, side="right")]
        before_text = kind[ends] != BORDER
        last, run, ends = ends[before_text] - 1, space_run[before_text], ends[before_text]
        begins[last] = True
        joins = cps[last] == 0x20
        begins[ends[joins]] = False
    quote = np.flatnonzero((cps == 0x27) & begins)
    if len(quote):
        pad = np.append(cps, [0, 0])
        one, two = pad[quote + 1], pad[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = np.zeros(len(quote), bool)
        for a, b in pairs:
            long |= (one == a) & (two == b)
        short_at, long_at = quote[short], quote[long & ~short]
        begins[short_at + 1] = False
        begins[long_at + 1] = False
        for at, width in ((short_at, 2), (long_at, 3)):
            begins[at + width] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    keep = kind[starts] != BORDER
    starts, ends = starts[keep], ends[keep]
    first = np.searchsorted(starts, np.concatenate(([0], borders + 1)))
    return joined, cps, starts, ends, first


def distinct(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first place of each distinct piece, and for every piece its index among them."""
    which, found = pd.factorize(span_hash(prefix_hash(cps), starts, ends))
    at = np.empty(len(found), np.int64)
    at[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return found, at, which
