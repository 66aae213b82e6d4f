"""The decoder against a writer of its own that uses every feature of the format."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from leafmill.llm import webp, webpstore
from leafmill.llm.arrays import chunks


class Writer:
    def __init__(self):
        self.value, self.count = 0, 0

    def put(self, value, n):
        self.value |= int(value) << self.count
        self.count += int(n)

    def bytes(self):
        return self.value.to_bytes(self.count + 7 >> 3, "little")


def even_lengths(symbols, size):
    """A complete code over the symbols, as even as can be."""
    lengths = np.zeros(size, np.int64)
    symbols = sorted(symbols)
    if len(symbols) == 1:
        lengths[symbols[0]] = 1
        return lengths
    k = (len(symbols) - 1).bit_length()
    short = (1 << k) - len(symbols)
    for i, s in enumerate(symbols):
        lengths[s] = k - 1 if i < short else k
    return lengths


OWN = np.array([3] + [4] + [5] * 14 + [3, 3, 3])


def put_code(w, lengths):
    """A simple code where possible, else a normal one with runs."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and used.max(initial=0) < 256:
        w.put(1, 1), w.put(len(used) - 1, 1), w.put(used[0] > 1, 1), w.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    w.put(0, 1), w.put(15, 4)
    for i in webp.LENGTH_ORDER:
        w.put(OWN[i], 3)
    codes = webp.reversed_codes(OWN)
    end = int(used[-1]) + 1
    tokens, at, last = [], 0, 8
    while at < end:
        run = 1
        while at + run < end and lengths[at + run] == lengths[at]:
            run += 1
        n = int(lengths[at])
        if n == 0 and run >= 11:
            run = min(run, 138)
            tokens.append((18, run - 11, 7))
        elif n == 0 and run >= 3:
            tokens.append((17, run - 3, 3))
        elif n and n == last and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run = 1
            tokens.append((n, 0, 0))
            last = n or last
        at += run
    w.put(1, 1), w.put(3, 3), w.put(len(tokens) - 2, 8)  # only so many lengths
    for symbol, extra, bits in tokens:
        w.put(codes[symbol], OWN[symbol]), w.put(extra, bits)


def prefixed(v):
    """Prefix code, extra bits and their number of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    h = (v - 1).bit_length() - 1
    return 2 * h + ((v - 1) >> h - 1 & 1), (v - 1) & (1 << h - 1) - 1, h - 1


def put_pixels(w, pixels, width, tokens, cache_bits=0, main=False, blocks=None, block_bits=2):
    """tokens: ("lit", argb) | ("copy", length, distance code) | ("cache", index); blocks: group of each block."""
    w.put(cache_bits > 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(blocks is not None, 1)
        if blocks is not None:
            w.put(block_bits - 2, 3)
            put_pixels(w, None, blocks.shape[1], [("lit", 0xFF000000 | int(b) << 8) for b in blocks.ravel()])
    groups = int(blocks.max()) + 1 if blocks is not None else 1
    used = [[set() for _ in range(5)] for _ in range(groups)]
    at, plan = 0, []
    for token in tokens:
        g = int(blocks[at // width >> block_bits, at % width >> block_bits]) if blocks is not None else 0
        if token[0] == "lit":
            parts = [(0, token[1] >> 8 & 255), (1, token[1] >> 16 & 255), (2, token[1] & 255), (3, token[1] >> 24 & 255)]
            at += 1
        elif token[0] == "copy":
            (lc, le, lb), (dc, de, db) = prefixed(token[1]), prefixed(token[2])
            parts = [(0, 256 + lc), (None, le, lb), (4, dc), (None, de, db)]
            at += token[1]
        else:
            parts = [(0, 280 + token[1])]
            at += 1
        plan.append((g, parts))
        for p in parts:
            if p[0] is not None:
                used[g][p[0]].add(p[1])
    codes = []
    for g in range(groups):
        own = []
        for kind, size in enumerate((280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)):
            lengths = even_lengths(used[g][kind] or {0}, size)
            put_code(w, lengths)
            own.append((webp.reversed_codes(lengths), lengths if np.count_nonzero(lengths) > 1 else np.zeros(size, int)))
        codes.append(own)
    for g, parts in plan:
        for p in parts:
            if p[0] is None:
                w.put(p[1], p[2])
            else:
                w.put(codes[g][p[0]][0][p[1]] if codes[g][p[0]][1][p[1]] else 0, codes[g][p[0]][1][p[1]])


def opening(width, height):
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    return w


def literals(pixels):
    return [("lit", int(p)) for p in pixels.ravel()]


def picture(seed, h, w, colours=None):
    r = np.random.default_rng(seed)
    if colours:
        return r.choice(r.integers(0, 1 << 32, colours), (h, w))
    base = np.cumsum(r.integers(-3, 4, (h, w, 4)), axis=1) + 120
    return webp._packed(base)


def test_literals_and_groups():
    pixels = picture(1, 13, 10)
    w = opening(10, 13)
    w.put(0, 1)
    blocks = np.array([[(x + y) % 3 for x in range(3)] for y in range(4)])
    put_pixels(w, pixels, 10, literals(pixels), main=True, blocks=blocks)
    assert (webp.decode(w.bytes()) == pixels).all()


def test_back_references_and_cache():
    r = random.Random(5)
    width, height, bits = 12, 20, 4
    pixels, tokens, cache = [], [], [0] * 16
    while len(pixels) < width * height:
        room = width * height - len(pixels)
        kind = r.random()
        if kind < 0.3 and len(pixels) > width and room > 1:
            length = min(room, r.choice([1, 2, 3, 4, 5, 9, 30]))
            code = r.choice([1, 2, 3, 121, 120 + len(pixels), 120 + r.randint(1, len(pixels))])
            back = {1: width, 2: 1, 3: width + 1}.get(code, code - 120)
            tokens.append(("copy", length, code))
            for _ in range(length):
                pixels.append(pixels[-back])
        elif kind < 0.55 and pixels:
            for p in pixels:
                cache[0x1E35A7BD * p >> 32 - bits & 15] = p
            i = 0x1E35A7BD * r.choice(pixels) >> 32 - bits & 15
            tokens.append(("cache", i))
            pixels.append(cache[i])
        else:
            pixels.append(r.randrange(1 << 32))
            tokens.append(("lit", pixels[-1]))
    w = opening(width, height)
    w.put(0, 1)
    put_pixels(w, None, width, tokens, cache_bits=bits, main=True)
    assert webp.decode(w.bytes()).ravel().tolist() == pixels


def test_back_reference_outside():
    w = opening(4, 1)
    w.put(0, 1)
    put_pixels(w, None, 4, [("lit", 1), ("copy", 3, 125)], main=True)
    with pytest.raises(ValueError):
        webp.decode(w.bytes())


@pytest.mark.parametrize("colours", [1, 2, 4, 13, 200])
def test_palette(colours):
    pixels = picture(colours, 9, 21, colours)
    table = np.unique(pixels)
    index = np.searchsorted(table, pixels)
    packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    each, inner = 8 >> packed, (21 + (1 << packed) - 1) >> packed
    stored = np.zeros((9, inner), np.int64)
    for x in range(21):
        stored[:, x >> packed] |= index[:, x] << each * (x & (1 << packed) - 1)
    w = opening(21, 9)
    w.put(1, 1), w.put(webp.PALETTE, 2), w.put(len(table) - 1, 8)
    channels = webp._channels(table)
    put_pixels(w, None, len(table), literals(webp._packed(np.diff(channels, axis=0, prepend=0))))
    w.put(0, 1)
    put_pixels(w, None, inner, literals(stored << 8), main=True)
    assert (webp.decode(w.bytes()) == pixels).all()


def one(mode, *neighbours):
    return webp.predicted(np.array([mode]), *(n[None] for n in neighbours))[0]


def residuals(pixels, modes, size):
    """What is left of pixels after prediction."""
    h, width = pixels.shape
    c, out = webp._channels(pixels), np.zeros((h, width, 4), np.int64)
    for y in range(h):
        for x in range(width):
            if not x and not y:
                guess = np.array([255, 0, 0, 0])
            elif not y:
                guess = c[0, x - 1]
            elif not x:
                guess = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                guess = one(int(modes[y >> size, x >> size]), c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])
            out[y, x] = c[y, x] - guess
    return webp._packed(out)


def test_predictor_cross_colour_and_green():
    pixels, size = picture(8, 17, 19), 2
    modes = np.arange(25).reshape(5, 5) % 14
    cross = np.random.default_rng(3).integers(0, 256, (5, 5, 3))
    now = residuals(pixels, modes, size)
    c = webp._channels(now)
    own = cross[np.arange(17)[:, None] >> size, np.arange(19)[None, :] >> size]
    sign = webp._signed
    red = c[..., 1] - (sign(own[..., 2]) * sign(c[..., 2]) >> 5)
    blue = c[..., 3] - (sign(own[..., 1]) * sign(c[..., 2]) >> 5) - (sign(own[..., 0]) * sign(c[..., 1]) >> 5)
    now = webp._packed(np.stack([c[..., 0], red, c[..., 2], blue], axis=-1))
    c = webp._channels(now)
    now = webp._packed(np.stack([c[..., 0], c[..., 1] - c[..., 2], c[..., 2], c[..., 3] - c[..., 2]], axis=-1))
    w = opening(19, 17)
    w.put(1, 1), w.put(webp.PREDICTOR, 2), w.put(size - 2, 3)
    put_pixels(w, None, 5, literals(0xFF000000 | modes << 8))
    w.put(1, 1), w.put(webp.CROSS_COLOUR, 2), w.put(size - 2, 3)
    put_pixels(w, None, 5, literals(0xFF000000 | cross[..., 0] << 16 | cross[..., 1] << 8 | cross[..., 2]))
    w.put(1, 1), w.put(webp.SUBTRACT_GREEN, 2), w.put(0, 1)
    put_pixels(w, None, 19, literals(now), main=True)
    assert (webp.decode(w.bytes()) == pixels).all()


def test_predictions():
    """The modes by the format's own arithmetic, one channel."""
    left, top, right, corner = (np.array([v] * 4) for v in (10, 21, 200, 12))
    want = {0: None, 1: 10, 2: 21, 3: 200, 4: 12, 5: ((10 + 200) // 2 + 21) // 2, 6: 11, 7: 15, 8: 16, 9: 110, 10: (11 + 110) // 2, 11: 21, 12: 19, 13: 15 + 1}
    for mode, value in want.items():
        got = one(mode, left, top, right, corner)
        assert got.tolist() == ([255, 0, 0, 0] if value is None else [value] * 4), mode


def test_damage():
    good = webpstore.write_samples(np.arange(64, dtype=np.uint8), np.array([0, 64]))[0]
    for bad in (b"RIFX" + good[4:], good[:-60], good[:20] + b"\0" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode_many([bad])
    with pytest.raises(ValueError):
        webp.Code.of(np.array([1, 2, 0]))


def test_samples_and_mixed_columns():
    pictures = [picture(i, 3 + i, 64) for i in range(3)]
    files = []
    for p in pictures:
        w = opening(64, len(p))
        w.put(0, 1)
        put_pixels(w, None, 64, literals(p), main=True)
        chunk = w.bytes() + b"\0" * (len(w.bytes()) & 1)
        files.append(b"RIFF" + (12 + len(chunk)).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk)
    samples = np.random.default_rng(1).integers(0, 256, 64 * 50, dtype=np.uint8)
    own = webpstore.write_samples(samples, np.array([0, 64, 640, 64 * 50]))
    got = webp.decode_many([own[0], files[0], own[1], files[1], own[2], files[2]])
    for i in range(3):
        assert (got[2 * i + 1][0] == pictures[i]).all()
    assert b"".join(webpstore.read_samples(own)) == samples.tobytes()
    assert [f.astype("<u4").tobytes() for f in map(webp.decode, webp.frames(own[2]))] == [samples[640:].tobytes()]


def payloads():
    """For each way of storing, something that it suits best; and texts at random."""
    r = np.random.default_rng(6)
    text = b" ".join(b"word%d" % r.integers(0, 300) for _ in range(900))
    slope = (np.arange(64)[None, :] * 37 % 251 + np.arange(120)[:, None] * 1 + r.integers(0, 2, (120, 64))).astype(np.uint8).tobytes()
    steps = np.cumsum(np.cumsum(r.integers(-1, 2, (30, 64)), axis=1), axis=0).astype(np.uint8).tobytes()
    grey = np.repeat(np.cumsum(r.integers(-40, 41, (30, 16)), axis=1) & 255, 4, axis=1).astype(np.uint8).tobytes()
    out = [b"", b"\0" * 6400, b"short", "é漢字😀".encode() * 9, text[:60], text[:1500], text + text[100:4000] + text[:333] + b"x" + text[1:900], b"abcd" * 40_000, slope, steps, grey, r.bytes(700), (b"-" * 61 + b"+\n\0") * 30]
    out += [text[a : a + n] for a, n in zip(r.integers(0, 4000, 40).tolist(), r.integers(0, 900, 40).tolist())]
    return [x + bytes(max(64, -(-len(x) // 64) * 64) - len(x)) for x in out]


def test_every_way(monkeypatch):
    raw, seen = payloads(), set()
    samples, begins = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    laid = webpstore._laid
    monkeypatch.setattr(webpstore, "_laid", lambda *a: seen.update(a[4].tolist()) or laid(*a))
    media = webpstore.write_samples(samples, begins)
    assert seen == {webpstore.PLAIN, webpstore.SHARED, webpstore.ABOVE, webpstore.BESIDE, webpstore.COLOURS}
    assert webpstore.read_samples(media) == raw
    for file, payload in zip(media, raw):  # and one by one, pixel by pixel
        assert b"".join(webp.decode(f).astype("<u4").tobytes() for f in webp.frames(file)) == payload
    for few, cached in ((1, 1 << 22), (10**9, 1 << 22), (1, 1)):
        monkeypatch.setattr(webp, "FEW", few)
        monkeypatch.setattr(webp, "CACHED", cached)
        assert webpstore.read_samples(media) == raw
    alone = [webpstore.write_samples(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in raw]
    assert alone == media  # equal texts, equal files, whatever stands beside them


def test_passages():
    r = random.Random(9)
    for _ in range(60):
        pixels, frame = np.array([r.randrange(3) for _ in range(200)], np.uint32), np.sort([r.randrange(3) for _ in range(200)])
        covered = 0
        for start, length, back in webpstore.passages(pixels, frame).tolist():
            assert start >= covered and length >= webpstore.PASSAGE and frame[start - back] == frame[start + length - 1]
            assert all(pixels[i] == pixels[i - back] for i in range(start, start + length))
            covered = start + length


def test_query_and_odd(spark, rows, documents, odd, empty):
    got = rows("op3_webp")
    for i, text in zip(documents.doc_id, documents.text):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = webpstore.samples_stored(odd).collect()
    assert sorted(bytes(r.samples).rstrip(b"\0") for r in stored) == sorted((r.text or "").encode() for r in odd.collect())
    assert len({(bytes(r.media), r.feature) for r in stored}) == len({bytes(r.samples) for r in stored})
    for r in stored:  # the stored file by the decoder that goes pixel by pixel, the feature by plain arithmetic
        raw = b"".join(webp.decode(f).astype("<u4").tobytes() for f in webp.frames(bytes(r.media)))
        assert raw == bytes(r.samples)
        lines = [raw[a : a + 64] for a in range(0, len(raw), 64)]
        mean = sum(raw) / len(raw)
        spread = (sum((x - mean) ** 2 for x in raw) / len(raw)) ** 0.5
        step = sum(abs(a - b) for line in lines for a, b in zip(line, line[1:])) / (63 * len(lines))
        parts = bytes(sum(x >> 4 == k for x in raw) * 255 // len(raw) for k in range(16)).hex()
        head, own_mean, own_spread, own_step, *rest = r.feature.split(";")
        assert head == str(len(lines)) and rest == [parts]
        assert all(abs(float(a) - b) < 1e-4 for a, b in ((own_mean, mean), (own_spread, spread), (own_step, step)))
    assert webpstore.samples_stored(empty).count() == 0


def test_frames():
    import pyarrow as pa

    for piece in chunks(pa.array(["ab\n" * 800_000, None])):
        samples, begins = webpstore.padded(piece)
        media = webpstore.write_samples(samples, begins)
        assert webpstore.read_samples(media) == [samples[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:])]
