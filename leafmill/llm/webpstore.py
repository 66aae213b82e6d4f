"""Samples stored as lossless WebP: the writer, and the operator over documents.

Four samples make a pixel (blue, green, red, alpha), sixteen pixels a row.  Each frame is stored by the way that takes the fewest bits:

* ``PLAIN``: literals by fixed prefix codes, made for text;
* ``SHARED``: the same with back-references to earlier passages of four pixels or more, and a colour cache;
* ``ABOVE``: what prediction from the pixel above and cross-colour leave, by codes made for small numbers;
* ``BESIDE``: what prediction from the pixel to the left and subtracted green leave, by the same codes;
* ``COLOURS``: a palette, for frames of at most 16 different pixels.

All choices and all bits of a column are found by array operations; only passages and palettes are walked one by one.  Samples beyond
``FRAME`` follow in another file behind the first.

Scale: a map over the rows without a shuffle; memory is bounded by a batch or the largest row.

Defined results of ``samples_stored``.  Null or empty text: 64 bytes of 0.  Equal texts: equal files, digests and features.  Repeated
rows: equal results.  Empty table: no rows.  Only doc_id and text are read.  Texts of any length are stored whole, in frames of 1 MiB."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrays import U64, Piece, chunks, gathered, lean, mixed, window_hashes
from leafmill.llm.common import ship, table
from leafmill.llm.webp import CROSS_COLOUR, LENGTH_ORDER, NEIGHBOURS, PALETTE, PREDICTOR, SUBTRACT_GREEN, decode_many, reversed_codes

WIDTH = 64  # samples of a row
ROW = WIDTH // 4  # pixels of a row
FRAME = WIDTH << 14  # samples of a file: the format allows 16384 rows
TOGETHER = 8 << 20  # samples that are decoded side by side
PLAIN, SHARED, ABOVE, BESIDE, COLOURS = range(5)
CACHE_BITS = 9
PASSAGE = 4  # least pixels of a back-reference
LONGEST = 4096  # most pixels of one
LEFT, TOP = 1, 2  # modes of the predictor

#: Bytes by how common they are in text; all others follow in ascending order.
COMMON = b" etaonihsrdlucmgfpwybvk.,\n"
#: How many symbols have a code of each length, by rank; the codes are complete: the shares 2 ** -length add up to 1.
TEXT = {3: 2, 4: 6, 5: 6, 6: 4, 10: 18, 11: 220}
SMALL = {1: 1, 6: 16, 9: 17, 10: 222}  # by distance from 0
DISTANCES = {5: 24, 6: 16}


class Writing:
    """Bits to be stored, lowest first."""

    def __init__(self) -> None:
        self.value, self.count = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.count
        self.count += int(n)


def _ranked(profile: dict[int, int], ranks: list[int]) -> np.ndarray:
    lengths = np.zeros(len(ranks), np.int64)
    lengths[ranks] = np.repeat(list(profile), list(profile.values()))
    return lengths


def even(used: np.ndarray, size: int) -> np.ndarray:
    """A complete code over the symbols in use, as even as can be."""
    lengths = np.zeros(size, np.int64)
    used = np.unique(used)
    k = (len(used) - 1).bit_length()
    lengths[used] = k
    lengths[used[: (1 << k) - len(used)]] = k - 1
    if len(used) == 1:
        lengths[used] = 1
    return lengths


def put_code(out: Writing, lengths: np.ndarray) -> None:
    """A prefix code by its lengths: as a simple one if a single symbol is used, else with runs."""
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] < 256:
        out.put(1, 1), out.put(0, 1), out.put(1, 1), out.put(used[0], 8)
        return
    told, at = [], 0
    edges = [*(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    for end in edges:
        n, run = int(lengths[at]), end - at
        if n:
            told.append((n, 0, 0))
            run -= 1
        while run:
            symbol, least, most, bits = (16, 3, 6, 2) if n else (18, 11, 138, 7) if run > 10 else (17, 3, 10, 3)
            part = min(run, most) if run >= least else 1
            told.append((symbol, part - least, bits) if run >= least else (n, 0, 0))
            run -= part
        at = end
    own = even(np.array([symbol for symbol, _, _ in told]), 19)
    codes = reversed_codes(own)
    alone = np.count_nonzero(own) == 1
    out.put(0, 1), out.put(15, 4)
    for i in LENGTH_ORDER:
        out.put(own[i], 3)
    out.put(0, 1)
    for symbol, more, bits in told:
        out.put(codes[symbol], 0 if alone else own[symbol]), out.put(more, bits)


ONE = {value: even(np.array([value]), 256) for value in (0, TOP, LEFT, 32, 255)}
_NONE = np.zeros(24, np.int64)  # no code for lengths of back-references


def _uniform(out: Writing, kind: int, alpha: int, red: int, green: int, blue: int) -> None:
    """A transform with one element for the whole picture, which takes no bits but its codes."""
    out.put(1, 1), out.put(kind, 2), out.put(7, 3)  # blocks of 512 pixels
    out.put(0, 1)  # no cache
    put_code(out, np.concatenate([ONE[green], _NONE]))
    for value in (red, blue, alpha):
        put_code(out, ONE[value])
    put_code(out, ONE[0][:40])


@lru_cache(maxsize=1)
def ways() -> list[tuple[list[tuple[np.ndarray, np.ndarray]], int, int]]:
    """For every way but the palette: codes and lengths of green, red, blue, alpha and distances, and the bits of the header."""
    text = _ranked(TEXT, [*COMMON, *(b for b in range(256) if b not in COMMON)])
    small = _ranked(SMALL, sorted(range(256), key=lambda b: (min(b, 256 - b), b)))
    lengths_of_copies = np.repeat([7, 6], [16, 8])
    shared = np.concatenate([text + 1, lengths_of_copies, np.full(1 << CACHE_BITS, CACHE_BITS + 2)])
    far = np.repeat(list(DISTANCES), list(DISTANCES.values()))
    out = []
    for way in range(COLOURS):
        head = Writing()
        if way == ABOVE:
            _uniform(head, PREDICTOR, 255, 0, TOP, 0)
            _uniform(head, CROSS_COLOUR, 255, 0, 32, 32)
        if way == BESIDE:
            _uniform(head, PREDICTOR, 255, 0, LEFT, 0)
            head.put(1, 1), head.put(SUBTRACT_GREEN, 2)
        head.put(0, 1)
        head.put(way == SHARED, 1)
        if way == SHARED:
            head.put(CACHE_BITS, 4)
        head.put(0, 1)  # one group of codes
        own = text if way in (PLAIN, SHARED) else small
        codes = [shared if way == SHARED else np.concatenate([own, _NONE]), own, own, own, far if way == SHARED else ONE[0][:40]]
        for lengths in codes:
            put_code(head, lengths)
        out.append(([(reversed_codes(n).astype(U64), n) for n in codes], head.value, head.count))
    return out


def _literals(channels: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each pixel (blue, green, red, alpha) as one number, and how many they are."""
    codes = ways()[way][0]
    value, size = codes[0][0][channels[:, 1]], codes[0][1][channels[:, 1]]
    for k, at in ((1, 2), (2, 0), (3, 3)):
        value = value | codes[k][0][channels[:, at]] << size.astype(U64)
        size = size + codes[k][1][channels[:, at]]
    return value, size


def _left_over(channels: np.ndarray, opens: np.ndarray, way: int) -> np.ndarray:
    """What prediction and the transform of colours leave; ``opens``: whether a frame begins at a row."""
    rows = channels.reshape(-1, ROW, 4)
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    beside = np.zeros_like(rows)
    beside[:, 1:] = rows[:, :-1]
    guess = above if way == ABOVE else beside
    guess[opens] = beside[opens]
    guess[~opens, 0] = above[~opens, 0]
    guess[opens, 0] = (0, 0, 0, 255)
    out = (rows - guess).reshape(-1, 4)
    out[:, 0] -= out[:, 1]
    out[:, 2] -= out[:, 1]
    return out


def passages(pixels: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """Rows start, length, distance of back-references, in order and without overlap: the nearest earlier passage, as far as it goes."""
    n = len(pixels) - PASSAGE + 1
    if n <= 0:
        return np.zeros((0, 3), np.int64)
    key = window_hashes(pixels.astype(U64), PASSAGE) ^ mixed(frame[:n].astype(U64) + U64(1))
    key[frame[:n] != frame[PASSAGE - 1 :]] = 0
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (key[order[1:]] != 0)
    here, there = order[1:][same], order[:-1][same]
    good = frame[here] == frame[there]
    for k in range(PASSAGE):
        good &= pixels[here + k] == pixels[there + k]
    here, there = here[good], there[good]
    by = np.argsort(here)
    here, back = here[by], (here - there)[by]
    if not len(here):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero((np.diff(here) != 1) | (np.diff(back) != 0) | (frame[here[1:]] != frame[here[:-1]])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(here)]]) - 1
    out, at = [], 0
    for a, b, d in zip(here[first].tolist(), here[last].tolist(), back[first].tolist()):
        a, b = max(a, at), b + PASSAGE
        while b - a >= PASSAGE:
            out.append((a, min(LONGEST, b - a), d))
            a = at = a + out[-1][1]
    return np.array(out, np.int64).reshape(-1, 3)


@lru_cache(maxsize=1)
def _near_codes() -> np.ndarray:
    """The code of each short distance, or 0."""
    out = np.zeros(8 * ROW + 8, np.int64)
    for code, (x, y) in reversed(list(enumerate(NEIGHBOURS, 1))):
        out[max(1, x + y * ROW)] = code
    return out


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distances, the bits that follow and their number."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1).astype(float))[1] - 1  # position of the highest bit
    more = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> np.maximum(more, 0) & 1)), v & (1 << more) - 1, more


def _shared(pixels: np.ndarray, channels: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each pixel with back-references and the cache; what a reference covers takes none."""
    value, size = _literals(channels, SHARED)
    codes = ways()[SHARED][0]
    slot = (pixels * np.uint32(0x1E35A7BD) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    key = frame << CACHE_BITS | slot
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(pixels), bool)
    fresh = np.ones(len(pixels), bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    again[1:] = ~fresh[1:] & (pixels[order[1:]] == pixels[order[:-1]])
    again |= fresh & (pixels[order] == 0)  # caches begin with zeros
    hit = order[again]
    value[hit], size[hit] = codes[0][0][280 + slot[hit]], codes[0][1][280 + slot[hit]]
    found = passages(pixels, frame)
    if len(found):
        start, length, back = found.T
        near = _near_codes()
        code = np.where(back < len(near), near[np.minimum(back, len(near) - 1)], 0)
        symbol, extra, more = _prefix(length)
        v, n = codes[0][0][256 + symbol], codes[0][1][256 + symbol]
        v, n = v | extra.astype(U64) << n.astype(U64), n + more
        symbol, extra, more = _prefix(np.where(code > 0, code, back + 120))
        v, n = v | codes[4][0][symbol] << n.astype(U64), n + codes[4][1][symbol]
        v, n = v | extra.astype(U64) << n.astype(U64), n + more
        inside = gathered(start, length)
        value[inside], size[inside] = 0, 0
        value[start], size[start] = v, n
    return value, size


def _palette(pixels: np.ndarray) -> tuple[int, int]:
    """All bits behind the size of a frame as a palette and the numbers of its colours."""
    colours, index = np.unique(pixels, return_inverse=True)
    packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
    each, per = 8 >> packed, 1 << packed
    out = Writing()
    out.put(1, 1), out.put(PALETTE, 2), out.put(len(colours) - 1, 8)
    steps = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8))
    numbers = (index.reshape(-1, per).astype(np.int64) << np.arange(per) * each).sum(axis=1)
    zero = np.zeros(len(numbers), np.uint8)
    for parts, main in ((steps[:, [1, 2, 0, 3]], False), (np.stack([numbers.astype(np.uint8), zero, zero, zero], axis=1), True)):
        if main:
            out.put(0, 1)  # no more transforms
        out.put(0, 1 + main)  # no cache, one group
        codes = []
        for k in range(4):
            lengths = even(parts[:, k], 256)
            put_code(out, np.concatenate([lengths, _NONE]) if not k else lengths)
            codes.append((reversed_codes(lengths), lengths if np.count_nonzero(lengths) > 1 else 0 * lengths))
        put_code(out, ONE[0][:40])
        for row in parts.tolist():
            for symbol, (own, lengths) in zip(row, codes):
                out.put(own[symbol] if lengths[symbol] else 0, lengths[symbol])
    return out.value, out.count


def write_samples(samples: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """WebP files of texts of samples, whose sizes are multiples of 64; text i is samples[begins[i]:begins[i + 1]]."""
    pixels = np.ascontiguousarray(samples).view("<u4")
    channels = pixels.view(np.uint8).reshape(-1, 4)
    starts, ends, owner = [], [], []
    for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
        for at in range(a, b, FRAME):
            starts.append(at // 4), ends.append(min(b, at + FRAME) // 4), owner.append(i)
    starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
    frame = np.repeat(np.arange(len(starts)), ends - starts)
    opens = np.zeros(len(pixels) // ROW, bool)
    opens[starts // ROW] = True

    def summed(size: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(size)])
        return sums[ends] - sums[starts]

    bits = np.full((COLOURS + 1, len(starts)), np.iinfo(np.int64).max)
    each = []
    for way in range(COLOURS):
        made = _shared(pixels, channels, frame) if way == SHARED else _literals(channels if way == PLAIN else _left_over(channels, opens, way), way)
        each.append(made)
        bits[way] = summed(made[1]) + ways()[way][2]
    kinds = np.sort(frame.astype(U64) << U64(32) | pixels)
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    colours = np.bincount((kinds[new] >> U64(32)).astype(np.int64), minlength=len(starts))
    palettes: dict[bytes, tuple[int, int]] = {}
    own: dict[int, tuple[int, int]] = {}
    for f in np.flatnonzero(colours <= 16).tolist():
        part = pixels[starts[f] : ends[f]]
        key = part.tobytes()
        if key not in palettes:
            palettes[key] = _palette(part)
        own[f] = palettes[key]
        bits[COLOURS, f] = own[f][1]
    way = bits.argmin(axis=0)
    heads = np.array([ways()[w][2] if w < COLOURS else own[f][1] for f, w in enumerate(way.tolist())], np.int64)
    value, size = np.zeros(len(pixels), U64), np.zeros(len(pixels), np.int64)
    for w in range(COLOURS):
        mine = (way == w)[frame]
        value[mine], size[mine] = each[w][0][mine], each[w][1][mine]
    return _laid(starts, ends, owner, frame, way, heads, own, value, size, len(begins) - 1)


def _laid(starts: np.ndarray, ends: np.ndarray, owner: list[int], frame: np.ndarray, way: np.ndarray, heads: np.ndarray, own: dict[int, tuple[int, int]], value: np.ndarray, size: np.ndarray, texts: int) -> list[bytes]:
    """The files of all texts from the bits of their pixels: every pixel's bits are added where they belong."""
    sums = np.concatenate([[0], np.cumsum(size)])
    sizes = (40 + heads + sums[ends] - sums[starts] + 7) // 8 + 1  # bytes of each chunk
    where = np.cumsum(sizes) - sizes
    at = sums[:-1] + (8 * where + 40 + heads - sums[starts])[frame]
    shift = (at & 31).astype(U64)
    low, high = value << shift, value >> U64(1) >> (U64(63) - shift)
    words = np.zeros(int(sizes.sum()) // 4 + 4)
    for k, part in enumerate((low & U64(0xFFFFFFFF), low >> U64(32), high)):
        words += np.bincount((at >> 5) + k, weights=part.astype(float), minlength=len(words))[: len(words)]
    raw = words.astype(np.uint32).view(np.uint8)
    out: list[list[bytes]] = [[] for _ in range(texts)]
    for f, (i, rows, o, n, w) in enumerate(zip(owner, ((ends - starts) // ROW).tolist(), where.tolist(), sizes.tolist(), way.tolist())):
        head, count = (ways()[w][1], ways()[w][2]) if w < COLOURS else own[f]
        chunk = raw[o : o + n].copy()
        chunk[:5] = list((0x2F | (ROW - 1) << 8 | (rows - 1) << 22 | 1 << 36).to_bytes(5, "little"))
        whole = (count + 7) // 8
        chunk[5 : 5 + whole] |= np.frombuffer(head.to_bytes(whole, "little"), np.uint8)
        odd = b"\0" * (n & 1)
        out[i] += [b"RIFF", (12 + n + len(odd)).to_bytes(4, "little"), b"WEBPVP8L", n.to_bytes(4, "little"), chunk.tobytes(), odd]
    return [b"".join(parts) for parts in out]


def padded(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a piece with bytes of 0 up to a positive multiple of 64, and where each begins."""
    sizes = np.diff(piece.offsets)
    room = np.maximum(WIDTH, -(-sizes // WIDTH) * WIDTH)
    begins = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(int(begins[-1]), np.uint8)
    out[gathered(begins[:-1], sizes)] = piece.data
    return out, begins


def read_samples(media: list[bytes]) -> list[bytes]:
    """The samples of files that ``write_samples`` or anyone else has written: blue, green, red and alpha of every pixel."""
    return [b"".join(f.astype("<u4").tobytes() for f in own) for own in decode_many(media)]


def feature(samples: bytes) -> str:
    """Mean, spread, mean step to the right neighbour and a 16-part histogram of a picture."""
    x = np.frombuffer(samples, np.uint8)
    step = np.abs(np.diff(x.reshape(-1, WIDTH).astype(np.int16), axis=1))
    parts = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    return f"{len(x) // WIDTH};{x.mean():.4f};{x.std():.4f};{step.mean():.4f};" + parts.astype(np.uint8).tobytes().hex()


def samples_stored(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n_bytes, media (the stored file), samples (read back from it), feature (of what was read back)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            back = read_samples(media)
            made = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(sizes)), pa.array(media, pa.binary()), pa.array(back, pa.binary()), pa.array(list(map(feature, back)), pa.string())], ["doc_id", "n_bytes", "media", "samples", "feature"])
            for x in (ids, sizes, media):
                x.clear()
            return made

        ids, sizes, media, held = [], [], [], 0
        for batch in batches:
            for piece in chunks(batch.column(1)):
                samples, begins = padded(piece)
                media += write_samples(samples, begins)
                ids.append(batch.column(0).slice(piece.first, len(piece)))
                sizes.append(np.diff(piece.offsets))
                held += len(samples)
                if held >= TOGETHER:
                    yield out()
                    held = 0
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary, samples binary, feature string")


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = samples_stored(table(spark, sf_dir, "documents"))
    tail = F.expr("substring(samples, -64, 64)")
    return stored.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
