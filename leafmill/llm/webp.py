"""Lossless WebP: a decoder for the whole format, image by image and for whole columns.

``decode`` reads prefix codes (simple and normal), back-references, the colour cache and groups of codes per block, and inverts
the predictor, cross-colour, subtract-green and palette transforms; the result is an array of ARGB pixels.  ``decode_many`` takes a
whole column: images that share their codes are decoded side by side, one pixel of every image in each step, literals, back-references
and cache alike, so that array operations do the work; the last few long ones, and images with groups of codes, go pixel by
pixel.  Transforms are inverted by array steps (prediction along slanted fronts of pixels that do not depend on each other).

``webpstore`` writes such files and has the operator over documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from leafmill.llm.arrays import eights

FEW = 6  # images that are no longer worth decoding side by side
CACHED = 1 << 22  # entries of colour caches that are held side by side
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

# Fixed values of the format: in which order the lengths of the code for code lengths are stored, and which
# neighbour (x to the left, y up) each of the first 120 distance codes means.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# fmt: off
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
# fmt: on


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7) & (1 << n) - 1

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends within its data")

    def read(self, n: int) -> int:
        found = self.peek(n)
        self.skip(n)
        return found


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the given lengths, with the bit that is read first lowest."""
    codes = np.zeros(len(lengths), np.int64)
    code = 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        code <<= 1
        for symbol in np.flatnonzero(lengths == size):
            codes[symbol] = int(f"{code:0{size}b}"[::-1], 2)
            code += 1
    return codes


@dataclass
class Code:
    """A prefix code as a table: entry = symbol << 4 | length for every window of ``width`` bits."""

    table: np.ndarray
    width: int
    only: int | None  # the symbol of a code that takes no bits

    @classmethod
    def of(cls, lengths: np.ndarray) -> Code:
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            only = int(used[0]) if len(used) else 0
            return cls(np.array([only << 4]), 0, only)
        width = int(lengths.max())
        if sum(1 << width - int(n) for n in lengths[used]) != 1 << width:
            raise ValueError("a prefix code is not complete")
        table, codes = np.zeros(1 << width, np.int64), reversed_codes(lengths)
        for symbol in used:
            table[codes[symbol] :: 1 << int(lengths[symbol])] = symbol << 4 | int(lengths[symbol])
        return cls(table, width, None)

    def read(self, bits: Bits) -> int:
        entry = int(self.table[bits.peek(self.width)])
        bits.read(entry & 15)
        return entry >> 4


def read_code(bits: Bits, symbols: int) -> Code:
    lengths = np.zeros(symbols, np.int64)
    if bits.read(1):  # simple: one or two symbols
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code.of(lengths)
    own = np.zeros(19, np.int64)
    for i in LENGTH_ORDER[: bits.read(4) + 4]:
        own[i] = bits.read(3)
    code = Code.of(own)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    at, last = 0, 8
    while at < symbols and most:
        most -= 1
        size = code.read(bits)
        if size < 16:
            lengths[at] = size
            last, at = size or last, at + 1
            continue
        value, times = (last, 3 + bits.read(2)) if size == 16 else (0, 3 + bits.read(3)) if size == 17 else (0, 11 + bits.read(7))
        if at + times > symbols:
            raise ValueError("code lengths go beyond the symbols")
        lengths[at : at + times] = value
        at += times
    return Code.of(lengths)


@dataclass
class Layer:
    """What stands before the pixels of an image or of one of its sub-images."""

    cache_bits: int
    groups: list[tuple[Code, ...]]
    blocks: np.ndarray | None = None  # number of the group of each block
    block_bits: int = 0


def read_layer(bits: Bits, width: int, height: int, main: bool) -> Layer:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    layer, groups = Layer(cache_bits, []), 1
    if main and bits.read(1):
        layer.block_bits = bits.read(3) + 2
        w, h = ((n + (1 << layer.block_bits) - 1) >> layer.block_bits for n in (width, height))
        layer.blocks = (read_pixels(bits, w, h, read_layer(bits, w, h, False)) >> 8 & 0xFFFF).reshape(h, w)
        groups = int(layer.blocks.max()) + 1
    cache = 1 << cache_bits if cache_bits else 0
    layer.groups = [tuple(read_code(bits, n) for n in (256 + 24 + cache, 256, 256, 256, 40)) for _ in range(groups)]
    return layer


def _prefixed(bits: Bits, code: int) -> int:
    """A length or distance from its prefix and the extra bits that follow."""
    if code < 4:
        return code + 1
    extra = code - 2 >> 1
    return (2 + (code & 1) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, layer: Layer, out: list[int] | None = None) -> np.ndarray:
    """ARGB values of width * height pixels, one after the other; ``out``: those that have been read already."""
    total, out = width * height, [] if out is None else out
    mask = (1 << layer.cache_bits) - 1
    cache, shift, kept = [0] * (mask + 1), 32 - layer.cache_bits, 0
    tables: dict[int, list[tuple[list[int], int]]] = {}
    number, data = 0, bits.data
    while len(out) < total:
        if layer.blocks is not None:
            y, x = divmod(len(out), width)
            number = int(layer.blocks[y >> layer.block_bits, x >> layer.block_bits])
        if number not in tables:
            tables[number] = [(c.table.tolist(), (1 << c.width) - 1) for c in layer.groups[number]]
        own, value = tables[number], 0
        window, used = int.from_bytes(data[bits.at >> 3 : (bits.at >> 3) + 9], "little") >> (bits.at & 7), 0
        entry = own[0][0][window & own[0][1]]
        green, used = entry >> 4, entry & 15
        if green < 256:
            for k, place in ((1, 16), (2, 0), (3, 24)):
                entry = own[k][0][window >> used & own[k][1]]
                used += entry & 15
                value |= entry >> 4 << place
            bits.skip(used)
            out.append(value | green << 8)
            continue
        bits.skip(used)
        if green >= 280:
            while kept < len(out):  # the cache is brought up to date when it is asked
                cache[0x1E35A7BD * out[kept] >> shift & mask] = out[kept]
                kept += 1
            out.append(cache[green - 280])
            continue
        length = _prefixed(bits, green - 256)
        back = distance(_prefixed(bits, layer.groups[number][4].read(bits)), width)
        if back > len(out) or len(out) + length > total:
            raise ValueError("a back-reference leaves the image")
        copy(out, length, back)
    return np.array(out, np.int64)


def distance(code: int, width: int) -> int:
    """How many pixels a distance code goes back."""
    if code > 120:
        return code - 120
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


def copy(out: list[int], length: int, back: int) -> None:
    """Adds the ``length`` pixels from ``back`` pixels before, which may begin to be among them."""
    while length:
        part = out[-back:][:length]
        out += part
        length -= len(part)


@dataclass
class Image:
    width: int
    height: int
    transforms: list[tuple[int, int, np.ndarray | None]] = field(default_factory=list)  # kind, bits, sub-image
    inner: int = 0  # width of the stored pixels
    layer: Layer | None = None
    start: int = 0  # bit at which the pixels begin


def read_header(data: bytes) -> Image:
    """Everything before the pixels of a VP8L chunk."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    image = Image(bits.read(14) + 1, bits.read(14) + 1)
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    width = image.width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (t[0] for t in image.transforms):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            w, h = ((n + (1 << size) - 1) >> size for n in (width, image.height))
            image.transforms.append((kind, size, read_pixels(bits, w, h, read_layer(bits, w, h, False)).reshape(h, w)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = read_pixels(bits, n, 1, read_layer(bits, n, 1, False))
            colours = sum((np.cumsum(steps >> s & 255) & 255) << s for s in (0, 8, 16, 24))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            image.transforms.append((kind, packed, colours))
            width = (width + (1 << packed) - 1) >> packed
        else:
            image.transforms.append((kind, 0, None))
    image.inner = width
    image.layer = read_layer(bits, width, image.height, True)
    image.start = bits.at
    return image


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], axis=-1)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.int64) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predicted(mode: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction of pixels (rows of channels) by their modes from their neighbours: left, top, top right, top left."""
    plane, mean = left + top - corner, left + top >> 1
    nearer = (np.abs(plane - left).sum(axis=-1) < np.abs(plane - top).sum(axis=-1))[..., None]
    off = mean - corner
    # fmt: off
    ways = (
        np.broadcast_to([255, 0, 0, 0], left.shape), left, top, right, corner, (left + right >> 1) + top >> 1, left + corner >> 1, mean,
        corner + top >> 1, top + right >> 1, (left + corner >> 1) + (top + right >> 1) >> 1, np.where(nearer, left, top), np.clip(plane, 0, 255),
        np.clip(mean + (np.abs(off) >> 1) * np.sign(off), 0, 255),
    )
    # fmt: on
    out = np.zeros(left.shape, np.int64)
    for m in np.unique(mode):
        mine = mode == m
        out[mine] = ways[m if m < len(ways) else 0][mine]
    return out


def _unpredict(pixels: np.ndarray, size: int, modes: np.ndarray) -> np.ndarray:
    """Pixels of one front, x + 2 y, depend on earlier fronts only, so each front is one step."""
    h, w = pixels.shape
    out = _channels(pixels)
    kinds = modes >> 8 & 15
    out[0, 0] = out[0, 0] + [255, 0, 0, 0] & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    if h > 1:
        out[:, 0] = np.cumsum(out[:, 0], axis=0) & 255
    for front in range(3, w + 2 * h - 2):
        y = np.arange(max(1, -(-(front - w + 1) // 2)), min(h - 1, (front - 1) // 2) + 1)
        x = front - 2 * y
        if not len(y):
            continue
        last = x + 1 == w
        right = out[np.where(last, y, y - 1), np.where(last, 0, x + 1)]
        guess = predicted(kinds[y >> size, x >> size], out[y, x - 1], out[y - 1, x], right, out[y - 1, x - 1])
        out[y, x] = out[y, x] + guess & 255
    return _packed(out)


def _signed(byte: np.ndarray) -> np.ndarray:
    return (byte + 128 & 255) - 128


def _uncross(pixels: np.ndarray, size: int, elements: np.ndarray) -> np.ndarray:
    h, w = pixels.shape
    own = _channels(elements)[np.arange(h)[:, None] >> size, np.arange(w)[None, :] >> size]
    red_blue, green_blue, green_red = (_signed(own[..., i]) for i in (1, 2, 3))
    out = _channels(pixels)
    green = _signed(out[..., 2])
    out[..., 1] = out[..., 1] + (green_red * green >> 5) & 255
    out[..., 3] = out[..., 3] + (green_blue * green >> 5) + (red_blue * _signed(out[..., 1]) >> 5) & 255
    return _packed(out)


def _unpalette(pixels: np.ndarray, packed: int, colours: np.ndarray, width: int) -> np.ndarray:
    each = 8 >> packed
    x = np.arange(width)
    number = (pixels[:, x >> packed] >> 8 & 255) >> (x & (1 << packed) - 1) * each & (1 << each) - 1
    return np.append(colours, np.zeros(256, np.int64))[number]  # beyond the palette: transparent


def inverted(image: Image, pixels: np.ndarray) -> np.ndarray:
    """Pixels (height x inner width) after all transforms are taken back, last first."""
    for kind, size, extra in reversed(image.transforms):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, size, extra)
        elif kind == CROSS_COLOUR:
            pixels = _uncross(pixels, size, extra)
        elif kind == PALETTE:
            pixels = _unpalette(pixels, size, extra, image.width)
        else:
            green = pixels >> 8 & 255
            pixels = pixels & 0xFF00FF00 | (pixels >> 16) + green << 16 & 0xFF0000 | (pixels & 255) + green & 255
    return pixels


def frames(data: bytes) -> Iterator[bytes]:
    """The VP8L chunks of RIFF files that stand one behind the other."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        chunk, found = at + 12, False
        while chunk < end:
            size = int.from_bytes(data[chunk + 4 : chunk + 8], "little")
            if data[chunk : chunk + 4] == b"VP8L":
                yield data[chunk + 8 : chunk + 8 + size]
                found = True
            chunk += 8 + size + (size & 1)
        if not found:
            raise ValueError("no lossless image in the file")
        at = end + (end & 1)


def decode(chunk: bytes) -> np.ndarray:
    """ARGB pixels (height x width) of one VP8L chunk."""
    image = read_header(chunk)
    pixels = read_pixels(Bits(chunk, image.start), image.inner, image.height, image.layer)
    return inverted(image, pixels.reshape(image.height, image.inner))


class Headers:
    """Headers that do not depend on the image's size are parsed once: most images of a column share theirs."""

    def __init__(self) -> None:
        self.known: list[tuple[bytes, int, Image]] = []

    def read(self, chunk: bytes) -> Image:
        width, height = ((int.from_bytes(chunk[1:5], "little") >> s & 0x3FFF) + 1 for s in (0, 14))
        for raw, spare, image in self.known:
            n = len(raw)
            if chunk[5 : 4 + n] == raw[:-1] and len(chunk) > 4 + n and not (chunk[4 + n] ^ raw[-1]) & (1 << spare) - 1:
                return Image(width, height, image.transforms, width, image.layer, image.start)
        image = read_header(chunk)
        if all(t[0] == SUBTRACT_GREEN for t in image.transforms) and image.layer.blocks is None:
            end = image.start + 7 >> 3
            self.known = [(chunk[5:end], (image.start - 1 & 7) + 1, image), *self.known[:15]]
        return image


def _abreast(layer: Layer) -> bool:
    """Whether images of this layer can be decoded side by side: one group, whose codes of a pixel fit into one window."""
    return layer.blocks is None and sum(c.width for c in layer.groups[0][:4]) <= 56


def _together(chunks_: list[bytes], starts: np.ndarray, sizes: np.ndarray, widths: np.ndarray, layer: Layer) -> list[np.ndarray]:
    """Pixels of images that share a layer.

    Step t decodes pixel t of all images that have one; images are ordered by size, so those are always the first ones."""
    order = np.argsort(-sizes, kind="stable")
    lengths = np.fromiter(map(len, chunks_), np.int64, len(chunks_))
    raw = np.frombuffer(b"".join(chunks_) + bytes(16), np.uint8)
    wide = eights(raw)
    first = np.cumsum(lengths) - lengths
    at, last = (8 * first + starts)[order], (8 * (first + lengths))[order]
    ordered, width = sizes[order], widths[order]
    to = (np.cumsum(sizes) - sizes)[order]
    out = np.zeros(int(sizes.sum()), np.uint32)
    tables = [(c.table.astype(np.int64), np.uint64((1 << c.width) - 1)) for c in layer.groups[0]]
    bits = layer.cache_bits
    cache = np.zeros((len(order), 1 << bits), np.uint32) if bits else None
    every = np.arange(len(order))
    left, back = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    copying = False

    def window(rows: np.ndarray, behind: np.ndarray | int = 0) -> np.ndarray:
        bit = at[rows] + behind
        return wide[bit >> 3] >> (bit & 7).astype(np.uint64)

    def extra(rows: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Lengths or distances from their prefixes and the bits that follow."""
        more = np.maximum(code - 2 >> 1, 0)
        value = (window(rows) & (np.uint64(1) << more.astype(np.uint64)) - np.uint64(1)).astype(np.int64)
        at[rows] += more
        return np.where(code < 4, code + 1, (2 + (code & 1) << more) + value + 1)

    active, step = len(order), 0
    while active:
        while active and ordered[active - 1] <= step:
            active -= 1
        if active < FEW:
            break
        rows = np.flatnonzero(left[:active] == 0) if copying else every[:active]
        seen = window(rows)
        entry = tables[0][0][seen & tables[0][1]]
        green, used = entry >> 4, entry & 15
        pixel = (green & 255) << 8
        taken = used
        for (table, mask), place in zip(tables[1:4], (16, 0, 24)):
            entry = table[seen >> taken.astype(np.uint64) & mask]
            taken = taken + (entry & 15)
            pixel |= entry >> 4 << place
        other = np.flatnonzero(green > 255)
        if len(other):
            taken[other] = used[other]
        at[rows] += taken
        if len(other):
            hit = other[green[other] >= 280]
            if len(hit):
                pixel[hit] = cache[rows[hit], green[hit] - 280]
            begun = other[green[other] < 280]
            if len(begun):
                who = rows[begun]
                left[who] = extra(who, green[begun] - 256)
                entry = tables[4][0][window(who) & tables[4][1]]
                at[who] += entry & 15
                code = extra(who, entry >> 4)
                back[who] = [distance(c, w) for c, w in zip(code.tolist(), width[who].tolist())]
                if (back[who] > step).any() or (left[who] + step > ordered[who]).any():
                    raise ValueError("a back-reference leaves the image")
                copying = True
        out[to[rows] + step] = pixel
        if copying:
            rows = np.flatnonzero(left[:active])
            out[to[rows] + step] = out[to[rows] + step - back[rows]]
            left[rows] -= 1
            copying = bool(left[:active].any())
        if bits:
            now = out[to[:active] + step]
            cache[every[:active], now * np.uint32(0x1E35A7BD) >> np.uint32(32 - bits)] = now
        step += 1
    if (at[active:] > last[active:]).any():
        raise ValueError("an image ends within its data")
    for k in range(active):  # the longest few, one by one
        i, a = int(order[k]), int(to[k])
        done = out[a : a + step].tolist()
        copy(done, int(left[k]), int(back[k]) or 1)
        rest = Bits(chunks_[i], int(at[k]) - 8 * int(first[i]))
        out[a : a + int(ordered[k])] = read_pixels(rest, int(width[k]), int(ordered[k]) // int(width[k]), layer, done)
    ends = np.cumsum(sizes)
    return [out[end - n : end] for end, n in zip(ends.tolist(), sizes.tolist())]


def decode_many(media: list[bytes]) -> list[list[np.ndarray]]:
    """ARGB pixels (height x width) of the frames of each file."""
    known, out = Headers(), [[] for _ in media]
    waiting: dict[int, list[tuple[int, int, bytes, Image]]] = {}
    for i, data in enumerate(media):
        for k, chunk in enumerate(frames(data)):
            image = known.read(chunk)
            out[i].append(None)
            if _abreast(image.layer):
                waiting.setdefault(id(image.layer), []).append((i, k, chunk, image))
            else:
                pixels = read_pixels(Bits(chunk, image.start), image.inner, image.height, image.layer)
                out[i][k] = inverted(image, pixels.reshape(image.height, image.inner))
    for group in waiting.values():
        layer = group[0][3].layer
        most = max(1, CACHED >> layer.cache_bits)
        for part in (group[a : a + most] for a in range(0, len(group), most)):
            sizes, widths, starts = (np.array(x, np.int64) for x in zip(*((g[3].inner * g[3].height, g[3].inner, g[3].start) for g in part)))
            for (i, k, _, image), pixels in zip(part, _together([g[2] for g in part], starts, sizes, widths, layer)):
                pixels = pixels.reshape(image.height, image.inner)
                out[i][k] = inverted(image, pixels.astype(np.int64)) if image.transforms else pixels
    return out
