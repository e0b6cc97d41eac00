"""Lossless WebP files against a plain reader, written pixel by pixel from the format's public specification."""

import numpy as np
import pytest

from talentloom.llm import media, webp

# The order in which the lengths of the code for code lengths stand.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


class Bits:
    def __init__(self, data):
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def read(self, n):
        assert n <= self.left
        out, self.value, self.left = self.value & ((1 << n) - 1), self.value >> n, self.left - n
        return out


class Code:
    """Canonical prefix code; a lone symbol takes no bits."""

    def __init__(self, lengths):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.alone = used[0][1] if len(used) == 1 else None
        self.symbols, code, before = {}, 0, 0
        for n, s in sorted(used):
            code <<= n - before
            self.symbols[n, code] = s
            code, before = code + 1, n

    def read(self, bits):
        if self.alone is not None:
            return self.alone
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.read(1)
            if (n, code) in self.symbols:
                return self.symbols[n, code]
        raise AssertionError("no such code")


def read_code(bits, size):
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = [0] * 19
    for k in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[k]] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    inner, at, last = Code(of_lengths), 0, 8
    while at < size and most:
        most -= 1
        s = inner.read(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            value, n = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
            lengths[at : at + n] = [value] * n
            at += n
    return Code(lengths)


def prefixed(bits, symbol):
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits, w, h, main):
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits)
    shift, blocks = 0, None
    if main and bits.read(1):
        shift = bits.read(3) + 2
        blocks = [p >> 8 & 0xFFFF for p in read_pixels(bits, -(-w >> shift), -(-h >> shift), False)]
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(max(blocks) + 1 if blocks else 1)]
    out, near = [], webp.near_offsets()
    while len(out) < w * h:
        x, y = len(out) % w, len(out) // w
        green, red, blue, alpha, distance = groups[blocks[(y >> shift) * (-(-w >> shift)) + (x >> shift)] if blocks else 0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            new = [a << 24 | r << 16 | s << 8 | b]
        elif s < 280:
            n = prefixed(bits, s - 256)
            d = prefixed(bits, distance.read(bits))
            d = d - 120 if d > 120 else max(1, near[d - 1][0] + near[d - 1][1] * w)
            new = [out[-d + k] if k < d else None for k in range(n)]
            for k in range(d, n):
                new[k] = new[k - d]
        else:
            new = [cache[s - 280]]
        out += new
        if cache_bits:
            for p in new:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return out


def split(p):
    return [p >> k & 255 for k in (24, 16, 8, 0)]


def joined(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def average(a, b):
    return [(x + y) // 2 for x, y in zip(a, b, strict=True)]


def predicted(mode, left, top, right, corner):
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [x + y - z for x, y, z in zip(left, top, corner, strict=True)]
        far = lambda q: sum(abs(x - y) for x, y in zip(p, q, strict=True))
        return left if far(left) < far(top) else top
    if mode == 12:
        return [clamp(x + y - z) for x, y, z in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(x + int((x - z) / 2)) for x, z in zip(average(left, top), corner, strict=True)]
    return [
        [255, 0, 0, 0], left, top, right, corner, average(average(left, right), top), average(left, corner), average(left, top), average(corner, top), average(top, right),
        average(average(left, corner), average(top, right)),
    ][mode]


def undo(pixels, w, kind, shift, table):
    signed = lambda v: v - 256 if v > 127 else v
    delta = lambda t, c: signed(t) * signed(c) >> 5
    across = -(-w >> shift)
    if kind == 0:
        for i, p in enumerate(pixels):
            x, y = i % w, i // w
            if i == 0:
                guess = [255, 0, 0, 0]
            elif y == 0:
                guess = split(pixels[i - 1])
            elif x == 0:
                guess = split(pixels[i - w])
            else:
                mode = table[(y >> shift) * across + (x >> shift)] >> 8 & 15
                guess = predicted(mode, *(split(pixels[i - d]) for d in (1, w, w - 1, w + 1)))
            pixels[i] = joined([a + b for a, b in zip(split(p), guess, strict=True)])
    elif kind == 1:
        for i, p in enumerate(pixels):
            _, to_blue_from_red, to_blue, to_red = split(table[(i // w >> shift) * across + (i % w >> shift)])
            a, r, g, b = split(p)
            r = (r + delta(to_red, g)) & 255
            pixels[i] = joined([a, r, g, b + delta(to_blue, g) + delta(to_blue_from_red, r)])
    elif kind == 2:
        for i, p in enumerate(pixels):
            a, r, g, b = split(p)
            pixels[i] = joined([a, r + g, g, b + g])
    return pixels


def plain_decode(data):
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and int.from_bytes(data[4:8], "little") + 8 == len(data)
    bits = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    assert bits.read(8) == 0x2F
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    assert bits.read(3) == 0
    now, done = w, []
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            shift = bits.read(3) + 2
            done.append((kind, now, shift, read_pixels(bits, -(-now >> shift), -(-h >> shift), False)))
        elif kind == 2:
            done.append((kind, now, 0, None))
        else:
            n = bits.read(8) + 1
            table = read_pixels(bits, n, 1, False)
            for k in range(1, n):
                table[k] = joined([a + b for a, b in zip(split(table[k]), split(table[k - 1]), strict=True)])
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            done.append((kind, now, shift, table))
            now = -(-now >> shift)
    pixels = read_pixels(bits, now, h, True)
    for kind, own, shift, table in reversed(done):
        if kind < 3:
            pixels = undo(pixels, own, kind, shift, table)
            continue
        each, wide = 8 >> shift, -(-own >> shift)
        index = lambda x, y: pixels[y * wide + (x >> shift)] >> 8 >> ((x & ((1 << shift) - 1)) * each) & ((1 << each) - 1)  # noqa: B023, E731
        pixels = [table[k] if (k := index(x, y)) < len(table) else 0 for y in range(h) for x in range(own)]
    return np.array(pixels, np.uint32).reshape(h, w)


@pytest.mark.parametrize("colours", [2, 4, 16, 200, 1 << 24])
@pytest.mark.parametrize("cache_bits", [0, 5])
def test_files_with_all_transforms(colours, cache_bits):
    rng = np.random.default_rng(colours + cache_bits)
    h, w = 11, 13
    pixels = (rng.integers(0, colours, (h, w)).astype(np.uint32) * np.uint32(0x010305)) | np.uint32(webp.OPAQUE)
    pixels[6:] = pixels[:5]
    modes = rng.integers(0, 14, (-(-h >> 2), -(-w >> 2)))
    mixing = rng.integers(0, 1 << 32, (-(-h >> 3), -(-w >> 3)), dtype=np.uint32)
    variants = [(), ((webp.SUBTRACT_GREEN,),), ((webp.PREDICTOR, 2, modes),), ((webp.CROSS_COLOUR, 3, mixing),), ((webp.PREDICTOR, 2, modes), (webp.CROSS_COLOUR, 3, mixing), (webp.SUBTRACT_GREEN,))]
    if colours <= 256:
        variants.append(((webp.PALETTE,),))
    for t in variants:
        assert np.array_equal(plain_decode(webp.encode(pixels, cache_bits, True, t)), pixels), t


@pytest.mark.parametrize("text", ["", "abc", "word " * 700, "The quick brown fox jumps over the lazy dog. " * 40, "Ünïcödé ÇA 日本語 " * 60, "".join(map(chr, range(32, 127))) * 9])
def test_stored_documents(text):
    payload = media.payload_of(text.encode())
    got = b"".join(media.samples(plain_decode(f)).tobytes() for f in media.split_files(media.to_images(payload)))
    assert got == payload


def test_the_published_file_of_one_pixel():
    import base64

    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert np.array_equal(plain_decode(data), webp.decode_many([data])[0])
