"""Pre-token bounds of whole pieces of text, without a regular expression.

Code points are looked up in a class array (letter, number, white space, other).  What a regular expression
decides by running along the text, whether an apostrophe begins a contraction or belongs to a run of
punctuation, is a small automaton here.  Its transition of one character is a function of four states to four
states, so one of 256, and composing two of them is a look-up in a table.  As composition is associative, the
state at every position comes from a scan over blocks: all blocks advance together, the blocks' totals are
scanned in turn, and a second look-up applies them.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Code points with the Unicode property White_Space (fixed values).
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings of contractions (fixed values).
ONE, TWO = ("s", "t", "m", "d"), ("re", "ve", "ll")

#: States of the automaton, after a character: nothing that an apostrophe could join, a run of punctuation,
#: a blank that goes with the next run, an apostrophe that began a contraction.
FREE, RUN, BLANK, CONTRACTION = range(4)
_BLOCK = 64


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE)] = SPACE
    return out


def _packed(images: tuple[int, int, int, int]) -> int:
    return sum(image << 2 * state for state, image in enumerate(images))


@lru_cache(maxsize=1)
def _composed() -> np.ndarray:
    """composed[f, g] = first f, then g; functions of four states packed into a byte."""
    f, g = np.arange(256)[:, None], np.arange(256)[None, :]
    out = np.zeros((256, 256), np.int64)
    for state in range(4):
        out |= (g >> 2 * (f >> 2 * state & 3) & 3) << 2 * state
    return out.astype(np.uint8).ravel()


def scan(functions: np.ndarray) -> np.ndarray:
    """The composition of functions[0] .. functions[i] for every i."""
    n, table = len(functions), _composed()
    if n <= _BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[int(out[i - 1]) * 256 + int(out[i])]
        return out
    identity = _packed((0, 1, 2, 3))
    rows = -(-n // _BLOCK)
    grid = np.full(rows * _BLOCK, identity, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK).T)
    for i in range(1, _BLOCK):
        grid[i] = table[grid[i - 1].astype(np.int64) * 256 + grid[i]]
    before = np.full(rows, identity, np.uint8)
    before[1:] = scan(np.ascontiguousarray(grid[-1][:-1]))
    return table[before.astype(np.int64)[None, :] * 256 + grid].T.ravel()[:n]


def bounds(points: np.ndarray, begins: np.ndarray, blanks: bool, digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of code points; ``begins``: where a text begins, among the points.

    blanks: a blank goes with the run after it, and other white space makes pre-tokens too (else white space is
    dropped).  digits: every number is a pre-token of its own (else runs of them)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    fresh = np.zeros(n + 1, bool)  # a text begins here
    fresh[begins] = True
    fresh[n] = True
    white = kind == SPACE
    change = fresh[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    last_white = white.copy()  # white space that a run follows in the same text
    last_white[:-1] &= ~white[1:]
    last_white &= ~fresh[1:]
    joins = last_white & (points == 32) if blanks else np.zeros(n, bool)

    ending = np.zeros(n, np.int8)  # letters of the contraction that could begin here
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        far = np.concatenate([points, [0, 0]])
        one = np.isin(far[quotes + 1], [ord(c) for c in ONE]) & ~fresh[np.minimum(quotes + 1, n)]
        two = np.zeros(len(quotes), bool)
        for pair in TWO:
            two |= (far[quotes + 1] == ord(pair[0])) & (far[quotes + 2] == ord(pair[1]))
        two &= ~fresh[np.minimum(quotes + 1, n)] & ~fresh[np.minimum(quotes + 2, n)]
        ending[quotes] = np.where(one, 1, np.where(two, 2, 0))

    step = np.full(n, _packed((FREE,) * 4), np.uint8)
    step[kind == OTHER] = _packed((RUN,) * 4)
    step[ending > 0] = _packed((CONTRACTION, RUN, RUN, CONTRACTION))
    step[joins] = _packed((BLANK,) * 4)
    opening = fresh[:n] & (ending > 0)
    step[opening] = _packed((CONTRACTION,) * 4)
    contracted = np.flatnonzero((scan(step) & 3 == CONTRACTION) & (ending > 0))  # from FREE, the state before all text

    start = change & ~white
    start[1:] &= ~joins[:-1] | fresh[1:n]
    if digits:
        start |= kind == NUMBER
    if blanks:
        start |= white & (change | last_white)
    inner = contracted + 1
    start[inner] = False
    after = contracted + 1 + ending[contracted]
    after = after[after < n]
    start[after] |= ~white[after] | blanks
    starts = np.flatnonzero(start)
    if blanks:
        return starts, np.append(starts[1:], n)
    stop = np.zeros(n + 1, bool)
    stop[starts] = True
    stop[np.flatnonzero(white)] = True
    stop |= fresh
    stops = np.flatnonzero(stop)
    return starts, stops[np.searchsorted(stops, starts, side="right")]
