"""Whole columns of text as numpy arrays: no loop over characters, words or documents.

A string column of Arrow is one run of UTF-8 bytes with offsets.  ``chunks`` cuts a batch at document
bounds into pieces of a bounded number of bytes (one longer document is a piece of its own), and the
rest of this module works on such a piece: word bounds, 64-bit hashes of arbitrary slices, eight bytes
a step, and distinct slices, so that a million words cost a handful of array operations.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at a time.
CHUNK = 1 << 19


def lean(run):
    """``run`` for mapInArrow, giving freed memory back to the system when a task has ended: workers stay for later tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = U64(0xD1342543DE82EF95)
_EMPTY = U64(0xA0761D6478BD642F)
#: Bytes of a slice that array steps hash, eight at a time; longer slices are hashed one by one.
SHORT = 32
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Piece:
    """Documents first .. first + len(self) - 1 of a batch; document i has bytes offsets[i]:offsets[i + 1]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Piece]:
    """Pieces of a string column, in order; nulls count as empty texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[end])
        yield Piece(at, data[lo:hi], offsets[at : end + 1] - lo)
        at = end


def words(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of all runs without ASCII white space."""
    inside = ~SPACE[piece.data]
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = piece.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(piece.offsets[1:], starts, side="right")


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; beyond the end stand zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they stand.

    Each step joins the next eight bytes by a bijection of what was there before, so slices of one size that differ in one
    step only never meet; others meet by chance alone.  Slices beyond ``SHORT`` bytes go through BLAKE2."""
    data = _LOWER[data] if lower else data
    wide, sizes = eights(data), ends - starts
    out = mixed(sizes.astype(U64) + _EMPTY)
    at = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
    for done in range(0, SHORT, 8):
        at = at[sizes[at] > done]
        if not len(at):
            break
        out[at] = mixed((out[at] ^ wide[starts[at] + done] & KEEP[np.minimum(sizes[at] - done, 8)]) * BASE)
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        found = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())])
        out[long] = np.frombuffer(found, "<u8")
    return out


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring hashes, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k, U64)
    for i in range(k):
        out = mixed(out * BASE + hashes[i : i + n])
    return out


def shingles(piece: Piece, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words, lower-cased A-Z, and their documents; a document of fewer words
    has its whole sequence as one, a document without words has none."""
    starts, ends, doc = words(piece)
    hashes = slice_hashes(piece.data, starts, ends, lower=True)
    full = window_hashes(hashes, k)
    whole = doc[: len(full)] == doc[k - 1 :] if len(full) else np.zeros(0, bool)
    count = np.bincount(doc, minlength=len(piece))
    short = np.flatnonzero((count > 0) & (count < k))
    begin = np.cumsum(count) - count
    rest = np.zeros(len(short), U64)
    for size in range(1, k):
        mine = count[short] == size
        at = begin[short[mine]]
        out = np.full(len(at), size, U64)
        for i in range(size):
            out = mixed(out * BASE + hashes[at + i])
        rest[mine] = out
    return np.concatenate([full[whole], rest]), np.concatenate([doc[: len(full)][whole], short])


def distinct_sorted(hashes: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in ascending order, one document after the other, and where each begins."""
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order].astype(np.uint16 if docs < 1 << 16 else np.int64), kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(docs + 1))


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, .. of every slice, one slice after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total)


def unique_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For slices of bytes: one position of each distinct slice, and each slice's number among those.

    Exact: slices of up to 7 bytes are compared as they are, packed into one number with their size; longer ones are brought
    together by hash and then compared byte by byte."""
    sizes, wide = ends - starts, eights(data)
    key = wide[starts] & KEEP[np.minimum(sizes, 7)] | np.minimum(sizes, 7).astype(U64) << U64(56)
    long = np.flatnonzero(sizes > 7)
    if len(long):
        key[long] = slice_hashes(data, starts[long], ends[long]) | U64(1 << 63)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    if len(long) and not _equal(data, wide, starts, sizes, long, first[inverse[long]]):
        raw, numbers = data.tobytes(), {}
        inverse = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        first = np.unique(inverse, return_index=True)[1]
    return first, inverse


def _equal(data: np.ndarray, wide: np.ndarray, starts: np.ndarray, sizes: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> bool:
    """Whether each slice of ``mine`` has the bytes of the slice of ``theirs`` beside it."""
    other = mine != theirs
    mine, theirs = mine[other], theirs[other]
    if (sizes[mine] != sizes[theirs]).any():
        return False
    at = np.flatnonzero(sizes[mine] <= SHORT)
    for done in range(0, SHORT, 8):
        at = at[sizes[mine[at]] > done]
        keep = KEEP[np.minimum(sizes[mine[at]] - done, 8)]
        if ((wide[starts[mine[at]] + done] ^ wide[starts[theirs[at]] + done]) & keep).any():
            return False
    far = np.flatnonzero(sizes[mine] > SHORT)
    raw = memoryview(np.ascontiguousarray(data))
    return all(raw[a : a + n] == raw[b : b + n] for a, b, n in zip(starts[mine[far]].tolist(), starts[theirs[far]].tolist(), sizes[mine[far]].tolist()))
