"""Lossless WebP: pixel arrays to RIFF/VP8L files and back.

Files are read as the format's public specification has them: prefix codes, back-references,
colour cache, prefix-code groups, and the predictor, cross-colour, subtract-green and palette
transforms. Many images are read together: each step decodes one pixel of every image that still
has any, with array operations over the images.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_CODES, DISTANCE_CODES, NEAR = 24, 40, 120
HASH = 0x1E35A7BD
OPAQUE = 0xFF000000
#: Pixels of an image that is always looked at for a palette.
FEW_PIXELS = 128
#: Zero lengths in a row that are written at once.
MOST_ZEROS = 600


@cache
def near_offsets() -> list[tuple[int, int]]:
    """Columns and rows back of the short distance codes: nearest first, then by column, right before left."""
    offsets = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(offsets, key=lambda o: (o[0] ** 2 + o[1] ** 2, abs(o[0]), o[0] < 0))


# ---------------------------------------------------------------- reading


class Bits:
    """Numbers from a byte string, least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        self.code: tuple | None = None  # the last prefix code: symbols, bits, their value, table

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + (n + 14) // 8 + 1], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + (n + 14) // 8 + 1], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """A table from the next bits to symbol << 4 | length, and how many bits it takes."""
    used = lengths.nonzero()[0]
    if len(used) <= 1:  # the only symbol takes no bits
        return np.array([int(used[0]) << 4 if len(used) else 0], np.int32), 0
    own = lengths[used]
    order = own.argsort(kind="stable")
    own = own[order]
    most = int(own[-1])
    spans = 1 << (most - own)
    table = (used[order] << 4 | own).astype(np.int32).repeat(spans)
    if len(table) != 1 << most:
        raise ValueError("a prefix code isn't complete")
    return table[_reversed_bits(most)], most


@cache
def _reversed_bits(n: int) -> np.ndarray:
    """At i, the number whose n bits are those of i the other way round."""
    out = np.zeros(1, np.int64)
    for k in range(n):
        out = np.concatenate([out, out | 1 << (n - 1 - k)])
    return out


def _read_code(bits: Bits, symbols: int) -> np.ndarray:
    """The lengths of one prefix code; a lone symbol has length 1."""
    lengths = np.zeros(symbols, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    n = 4 + bits.read(4)
    packed = bits.read(3 * n)
    meta = np.zeros(19, np.int64)
    meta[list(CODE_LENGTH_ORDER[:n])] = [packed >> 3 * k & 7 for k in range(n)]
    table, width = _length_table(meta.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    mask, found, before, n, at, data = (1 << width) - 1, [], 8, 0, bits.at, bits.data
    while n < symbols and left:
        # at least 57 bits; a length takes at most 14
        window, used = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7), 0
        while used <= 42 and n < symbols and left:
            left -= 1
            entry = table[window >> used & mask]
            used += entry & 15
            s = entry >> 4
            if s < 16:
                found.append(s)
                n += 1
                if s:
                    before = s
                continue
            again, more, least = (0, 3, 3) if s == 17 else (0, 7, 11) if s == 18 else (before, 2, 3)
            run = least + (window >> used & ((1 << more) - 1))
            used += more
            found += [again] * run
            n += run
        at += used
    bits.at = at
    lengths[: len(found)] = found[:symbols]
    return lengths


@lru_cache(maxsize=256)
def _length_table(meta: bytes) -> tuple[list[int], int]:
    table, width = lookup(np.frombuffer(meta, np.int64))
    return table.tolist(), width


def _read_table(bits: Bits, symbols: int) -> tuple[np.ndarray, int]:
    """The lookup table of the next prefix code; one like the code before it is taken over."""
    if bits.code and bits.code[0] == symbols and bits.peek(bits.code[1]) == bits.code[2]:
        bits.at += bits.code[1]
        return bits.code[3]
    start = bits.at
    table = lookup(_read_code(bits, symbols))
    n, bits.at = bits.at - start, start
    bits.code = (symbols, n, bits.peek(n), table)
    bits.at += n
    return table


@dataclass
class Coded:
    """An entropy-coded image that is yet to be read."""

    bits: Bits
    width: int
    height: int
    cache_bits: int
    groups: list  # of five (table, width) each
    group_of: np.ndarray | None = None  # by block
    block_bits: int = 0


def _coded(bits: Bits, width: int, height: int, main: bool) -> Generator:
    """Reads an image's codes and has its pixels read by the caller."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    group_of, block_bits, n = None, 0, 1
    if main and bits.read(1):
        block_bits = bits.read(3) + 2
        group_of = ((yield from _coded(bits, -(-width >> block_bits), -(-height >> block_bits), False)) >> 8 & 0xFFFF).astype(np.int64)
        n = int(group_of.max()) + 1
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    groups = [[_read_table(bits, s) for s in sizes] for _ in range(n)]
    return (yield Coded(bits, width, height, cache_bits, groups, group_of, block_bits))


def _image(data: bytes) -> Generator:
    """Yields Coded parts, gets their pixels, and returns the image as rows of ARGB numbers."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != SIGNATURE:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data, 21 * 8)
    full = width = bits.read(14) + 1
    height = bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo = []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            element = yield from _coded(bits, -(-width >> size), -(-height >> size), False)
            undo.append((kind, width, size, element.reshape(-(-height >> size), -1)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, width, 0, None))
        else:
            n = bits.read(8) + 1
            colours = (yield from _coded(bits, n, 1, False)).view(np.uint8).reshape(n, 4).cumsum(axis=0, dtype=np.uint8).view(np.uint32).ravel()
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, width, pack, colours))
            width = -(-width >> pack)
    pixels = (yield from _coded(bits, width, height, True)).reshape(height, width)
    for kind, w, size, element in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, size, element)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, size, element)
        elif kind == SUBTRACT_GREEN:
            green = pixels >> 8 & 0xFF
            pixels = pixels & 0xFF00FF00 | (pixels + (green << 16) & 0xFF0000) | (pixels + green & 0xFF)
        else:
            per, each = 1 << size, 8 >> size
            index = (pixels >> 8 & 0xFF)[:, :, None] >> (np.arange(per, dtype=np.uint32) * each) & ((1 << each) - 1)
            held = np.zeros(256, np.uint32)
            held[: len(element)] = element
            pixels = held[index.reshape(height, -1)[:, :w]]
    return pixels[:, :full]


def _bytes(pixels: np.ndarray) -> np.ndarray:
    """Channels blue, green, red, alpha as the last axis."""
    return np.ascontiguousarray(pixels.astype(np.uint32)).view(np.uint8).reshape(*pixels.shape, 4)


def predict(mode: int, left, top, top_left, top_right) -> np.ndarray:
    """The prediction from neighbours, arrays of channels."""
    a, b, c, d = (x.astype(np.int32) for x in (left, top, top_left, top_right))
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255], np.uint8), left.shape)
    if mode == 11:
        nearer = np.abs(b - c).sum(axis=-1, keepdims=True) < np.abs(a - c).sum(axis=-1, keepdims=True)
        return np.where(nearer, a, b).astype(np.uint8)
    half = (a + b) // 2
    out = {
        1: lambda: a,
        2: lambda: b,
        3: lambda: d,
        4: lambda: c,
        5: lambda: ((a + d) // 2 + b) // 2,
        6: lambda: (a + c) // 2,
        7: lambda: half,
        8: lambda: (c + b) // 2,
        9: lambda: (b + d) // 2,
        10: lambda: ((a + c) // 2 + (b + d) // 2) // 2,
        12: lambda: np.clip(a + b - c, 0, 255),
        13: lambda: np.clip(half + np.trunc((half - c) / 2).astype(np.int32), 0, 255),
    }[mode]()
    return out.astype(np.uint8)


def _prediction(rows: np.ndarray, y: int, x: int, mode: int) -> np.ndarray:
    """From the pixels before (x, y); the first row and column have modes of their own."""
    h, w, _ = rows.shape
    zero = np.zeros(4, np.uint8)
    if y == 0:
        return rows[0, x - 1] if x else np.array([0, 0, 0, 255], np.uint8)
    if x == 0:
        return rows[y - 1, 0]
    right = rows[y - 1, x + 1] if x + 1 < w else rows[y, 0]
    return predict(mode, rows[y, x - 1] if x else zero, rows[y - 1, x], rows[y - 1, x - 1], right)


def _undo_predictor(pixels: np.ndarray, size: int, modes: np.ndarray) -> np.ndarray:
    rows = _bytes(pixels)
    modes = (modes >> 8 & 0xFF).astype(int)
    h, w, _ = rows.shape
    for y in range(h):
        for x in range(w):
            rows[y, x] += _prediction(rows, y, x, int(modes[y >> size, x >> size]))
    return rows.view(np.uint32).reshape(h, w)


def _cross_delta(t: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32)) >> 5


def _undo_cross_colour(pixels: np.ndarray, size: int, element: np.ndarray) -> np.ndarray:
    rows = _bytes(pixels)
    h, w, _ = rows.shape
    e = _bytes(element).repeat(1 << size, axis=0).repeat(1 << size, axis=1)[:h, :w]
    to_red, to_blue, red_to_blue = e[..., 0], e[..., 1], e[..., 2]
    blue, green, red = (rows[..., k].copy() for k in range(3))
    red = (red + _cross_delta(to_red, green)).astype(np.uint8)
    rows[..., 2] = red
    rows[..., 0] = (blue + _cross_delta(to_blue, green) + _cross_delta(red_to_blue, red)).astype(np.uint8)
    return rows.view(np.uint32).reshape(h, w)


def _prefixed(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and extra bits of length and distance symbols."""
    extra = np.maximum(symbol - 2, 0) >> 1
    value = np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + (window & ((1 << extra) - 1))) + 1
    return value, extra


def read_pixels(parts: list[Coded]) -> list[np.ndarray]:
    """The pixels of several coded images, read side by side; their bit positions move to the end."""
    order = sorted(range(len(parts)), key=lambda k: -parts[k].width * parts[k].height)
    lanes = [parts[k] for k in order]
    n = len(lanes)
    total = np.array([p.width * p.height for p in lanes])
    base = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(int(base[-1]), np.uint32)
    # all bytes in one buffer, seen as a 64-bit number at each byte
    starts, chunks, at = [], [], 0
    for p in lanes:
        starts.append(at * 8 + p.bits.at)
        chunks.append(p.bits.data)
        at += len(p.bits.data)
    buffer = np.frombuffer(b"".join(chunks) + bytes(16), np.uint8)
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    pos = np.array(starts, np.int64)
    # each lane's tables lie one after the other; row g of table_at is a group
    tables, table_at, masks, first_group, size = [], [], [], [], 0
    for p in lanes:
        first_group.append(len(table_at))
        for group in p.groups:
            table_at.append([])
            masks.append([])
            for t, width in group:
                table_at[-1].append(size)
                masks[-1].append((1 << width) - 1)
                tables.append(t)
                size += len(t)
    table, table_at, masks, group = np.concatenate(tables), np.array(table_at).T.copy(), np.array(masks, np.uint64).T.copy(), np.array(first_group)
    grouped = [k for k, p in enumerate(lanes) if p.group_of is not None]
    cached = np.array([p.cache_bits for p in lanes])
    cache_at = np.concatenate([[0], np.cumsum(np.where(cached, 1 << cached, 0))])
    held = np.zeros(int(cache_at[-1]) + 1, np.uint32)
    cache_lanes, down = np.flatnonzero(cached), (32 - cached).astype(np.uint64)
    left, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    copying = 0
    wide = np.array([p.width for p in lanes])
    near = np.array(near_offsets())
    live = n
    base = base[:-1]
    everyone = np.arange(n)
    # images of one alpha value have no bits for it
    one_alpha = not masks[3].any()
    alphas = (table[table_at[3]] >> 4).astype(np.uint32) << 24 if one_alpha else None

    def symbol(which: int, lanes_, window, used):
        entry = table[table_at[which, group[lanes_]] + (window & masks[which, group[lanes_]]).astype(np.int64)]
        length = (entry & 15).astype(np.uint64)
        return entry >> 4, window >> length, used + (entry & 15)

    for step in range(int(total[0]) if n else 0):
        while total[live - 1] <= step:
            live -= 1
        for k in grouped:
            if k < live:
                p = lanes[k]
                y, x = divmod(step, p.width)
                blocks = -(-p.width >> p.block_bits)
                group[k] = first_group[k] + p.group_of[(y >> p.block_bits) * blocks + (x >> p.block_bits)]
        who = everyone[:live]
        if copying:
            busy = left[:live] > 0
            who, again = who[~busy], who[busy]
            out[base[again] + step] = out[base[again] + step - back[again]]
            left[again] -= 1
            copying = int(left[:live].any())
        if len(who):
            here = pos[who]
            window = words[here >> 3] >> (here & 7).astype(np.uint64)
            green, window, used = symbol(0, who, window, 0)
            plain = green < 256
            whole = plain.all()
            lit, g = (who, green) if whole else (who[plain], green[plain])
            if len(lit):
                win, use = (window, used) if whole else (window[plain], used[plain])
                red, win, use = symbol(1, lit, win, use)
                # four codes may take 60 bits; a window has at least 57
                win = words[(pos[lit] + use) >> 3] >> ((pos[lit] + use) & 7).astype(np.uint64)
                blue, win, use = symbol(2, lit, win, use)
                if one_alpha:
                    alpha = alphas[group[lit]]
                else:
                    alpha, win, use = symbol(3, lit, win, use)
                    alpha = alpha.astype(np.uint32) << 24
                out[base[lit] + step] = alpha | (red << 16 | g << 8 | blue).astype(np.uint32)
                pos[lit] += use
            if not whole:
                rest, s, use = who[~plain], green[~plain], used[~plain]
                pos[rest] += use
                hit = s >= 256 + LENGTH_CODES
                if hit.any():
                    own = rest[hit]
                    out[base[own] + step] = held[cache_at[own] + s[hit] - 256 - LENGTH_CODES]
                ref, s = rest[~hit], s[~hit] - 256
                if len(ref):
                    here = pos[ref]
                    length, extra = _prefixed(s.astype(np.int64), (words[here >> 3] >> (here & 7).astype(np.uint64)).astype(np.int64))
                    here += extra
                    far, window, use = symbol(4, ref, words[here >> 3] >> (here & 7).astype(np.uint64), 0)
                    here += use
                    code, extra = _prefixed(far.astype(np.int64), (words[here >> 3] >> (here & 7).astype(np.uint64)).astype(np.int64))
                    pos[ref] = here + extra
                    close = near[np.minimum(code, NEAR) - 1]
                    back[ref] = np.where(code > NEAR, code - NEAR, np.maximum(1, close[:, 0] + close[:, 1] * wide[ref]))
                    out[base[ref] + step] = out[base[ref] + step - back[ref]]
                    left[ref] = length - 1
                    copying = 1
        if len(cache_lanes):
            own = cache_lanes[cache_lanes < live]
            colour = out[base[own] + step]
            held[cache_at[own] + ((colour.astype(np.uint64) * HASH & 0xFFFFFFFF) >> down[own]).astype(np.int64)] = colour
    results: list = [None] * n
    shift = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
    for k, i in enumerate(order):
        parts[i].bits.at = int(pos[k] - shift[k] * 8)
        results[i] = out[base[k] : base[k] + total[k]]
    return results


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Each file's rows of ARGB numbers."""
    results: list = [None] * len(files)
    running = {k: _image(f) for k, f in enumerate(files)}
    waiting = {k: next(g) for k, g in running.items()}
    while waiting:
        keys, pixels = list(waiting), read_pixels(list(waiting.values()))
        waiting = {}
        for k, p in zip(keys, pixels, strict=True):
            try:
                waiting[k] = running[k].send(p)
            except StopIteration as end:
                results[k] = end.value
    return results


# ---------------------------------------------------------------- writing


class BitsOut:
    """Bits as one number, the first written in its lowest place."""

    def __init__(self) -> None:
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Values of at most 63 bits each: every one falls into one or two 64-bit words."""
        ends = sizes.cumsum()
        n = int(ends[-1]) if len(ends) else 0
        word, shift = ends - sizes >> 6, (ends - sizes & 63).astype(np.uint64)
        values, words = values.astype(np.uint64), np.zeros((n >> 6) + 2, np.uint64)
        np.add.at(words, word, values << shift)
        np.add.at(words, word + 1, values >> np.uint64(1) >> (np.uint64(63) - shift))
        self.put(int.from_bytes(words.tobytes(), "little"), n)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code: -log2 of the shares rounded up, then shortened while room is left."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    own = counts[used]
    own = np.maximum(own, own.sum() >> 12)  # so that no code takes over 13 bits
    exact = np.log2(own.sum() / own)
    up = np.ceil(exact)
    own = np.maximum(up, 1).astype(np.int64)
    room = (1 << 13) - int((1 << (13 - own)).sum())
    order = (exact - up).argsort(kind="stable").tolist()
    own = own.tolist()
    while room:
        before = room
        for k in order:
            need = 1 << (13 - own[k])
            if need <= room and own[k] > 1:
                own[k] -= 1
                room -= need
                if not room:
                    break
        if room == before:
            raise AssertionError("a code can't be completed")
    lengths[used] = own
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, its bits in stream order."""
    codes, used = np.zeros(len(lengths), np.int64), lengths.nonzero()[0]
    if len(used):
        own = lengths[used]
        order = own.argsort(kind="stable")
        spans = 1 << (int(own[order[-1]]) - own[order])
        codes[used[order]] = _reversed_bits(int(own[order[-1]]))[spans.cumsum() - spans]
    return codes


#: Lengths 0 to 13 and the two runs of zeros, four bits each: one complete code for all headers.
_LENGTH_SYMBOLS = (*range(14), 17, 18)


@cache
def _length_code() -> list[int]:
    lengths = np.zeros(19, np.int64)
    lengths[list(_LENGTH_SYMBOLS)] = 4
    return canonical(lengths).tolist()


def _put_code(out: BitsOut, counts: np.ndarray, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for the counts; gives codes and lengths (0 for a lone symbol)."""
    bits, codes, lengths = _code(counts)
    for _ in range(times):
        out.put(*bits)
    return codes, lengths


def _code(counts: np.ndarray) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
    used = np.flatnonzero(counts)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        none = np.zeros(len(counts), np.int64)
        # simple, one symbol, whether it takes eight bits, the symbol
        return (1 | (s > 1) << 2 | s << 3, 11 if s > 1 else 4), none, none
    if len(used) < 2:  # a lone symbol too large for the short form gets a neighbour
        counts = counts.copy()
        counts[0] = 1
        used = np.flatnonzero(counts)
    lengths, out = code_lengths(counts), BitsOut()
    out.put(*_length_header())
    gaps = np.diff(used, prepend=-1, append=len(counts)) - 1
    if gaps.max() > MOST_ZEROS:
        for gap, length in zip(gaps.tolist(), [*lengths[used].tolist(), None], strict=True):
            out.put(*_zeros(gap))
            if length:
                out.put(_length_code()[length], 4)
        return (out.value, out.size), canonical(lengths), lengths
    zeros, sizes = _zero_runs()
    values, sizes = zeros[gaps], sizes[gaps]
    values[:-1] |= _length_codes()[lengths[used]] << sizes[:-1]
    sizes[:-1] += 4
    out.put_all(values, sizes)
    return (out.value, out.size), canonical(lengths), lengths


@cache
def _length_codes() -> np.ndarray:
    return np.array(_length_code(), np.int64)


@cache
def _zero_runs() -> tuple[np.ndarray, np.ndarray]:
    """``_zeros`` of the numbers whose bits, with a length behind, fit one word."""
    pairs = np.array([_zeros(n) for n in range(MOST_ZEROS + 1)], np.int64)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


@cache
def _length_header() -> tuple[int, int]:
    """A normal code whose lengths are all written, in the code above."""
    out = BitsOut()
    out.put(0, 1)
    out.put(13, 4)
    for s in CODE_LENGTH_ORDER[:17]:
        out.put(4 if s in _LENGTH_SYMBOLS else 0, 3)
    out.put(0, 1)
    return out.value, out.size


@cache
def _zeros(n: int) -> tuple[int, int]:
    """The bits that say n lengths of zero, and how many they are."""
    out, code = BitsOut(), _length_code()
    while n:
        run = 1 if n < 3 else min(n, 138)
        if run < 3:
            out.put(code[0], 4)
        elif run < 11:
            out.put(code[17], 4)
            out.put(run - 3, 3)
        else:
            out.put(code[18], 4)
            out.put(run - 11, 7)
        n -= run
    return out.value, out.size


def _prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their value for numbers from 1; small ones from a table."""
    if int(value.max()) < len(_small_prefixes()[0]):
        return tuple(t[value] for t in _small_prefixes())
    return _prefixes(value)


@cache
def _small_prefixes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _prefixes(np.maximum(np.arange(1 << 13), 1))


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their value for numbers from 1."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(float))[1] - 1  # place of the top bit
    extra = np.where(v < 4, 0, high - 1)
    symbol = np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1))
    return symbol, extra, np.where(v < 4, 0, v & ((1 << extra) - 1))


def back_references(pixels: np.ndarray, least: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeats of at least ``least`` pixels, not overlapping, in order."""
    n = len(pixels) - least + 1
    if n < 2:
        return []
    p = pixels.astype(np.uint64)
    key = p[:n].copy()
    for k in range(1, least):
        key = key * np.uint64(0x9E3779B97F4A7C15) + p[k : k + n]
    # half of the key above the place: equal keys come in order of place
    both = np.sort((key & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64))
    same = both[1:] >> np.uint64(32) == both[:-1] >> np.uint64(32)
    if not same.any():
        return []
    order = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    i, j = order[1:][same], order[:-1][same]
    sort = np.argsort(i)
    i, d = i[sort], (i - j)[sort]
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(d) != 0)) + 1
    out, end = [], 0
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(i)], strict=True):
        start, stop, far = max(int(i[a]), end), int(i[b - 1]) + least, int(d[a])
        if stop - start < least or (pixels[start:stop] != pixels[start - far : stop - far]).any():
            continue
        for s in range(start, stop, 4096):
            if min(stop, s + 4096) - s >= least:
                out.append((s, min(stop, s + 4096) - s, far))
                end = out[-1][0] + out[-1][1]
    return out


def cache_hits(pixels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pixel is in the colour cache when it comes, and its place there."""
    slot = ((pixels.astype(np.uint64) * HASH & 0xFFFFFFFF) >> np.uint64(32 - bits)).astype(np.int64)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return hit, slot


def _put_pixels(out: BitsOut, pixels: np.ndarray, main: bool, cache_bits: int, references: bool, hits: tuple | None = None, alike: bool = False) -> None:
    n = len(pixels)
    refs = back_references(pixels) if references else []
    if 16 * sum(r[1] for r in refs) < n:
        refs = []  # the code of distances would cost more than they save
    free = np.ones(n, bool)
    for s, length, _ in refs:
        free[s : s + length] = False
    hit = slot = None
    if cache_bits:
        hit, slot = hits or cache_hits(pixels, cache_bits)
        hit = hit & free
    out.put(int(bool(cache_bits)), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    lit = np.flatnonzero(free & ~hit) if cache_bits else np.flatnonzero(free)
    px = pixels[lit]
    channels = [(px >> s & 0xFF).astype(np.int64) for s in (8, 16, 0, 24)]
    counts = [np.bincount(c, minlength=256) for c in channels]
    counts[0] = np.concatenate([counts[0], np.zeros(LENGTH_CODES + (1 << cache_bits if cache_bits else 0), np.int64)])
    if cache_bits:
        stored = np.flatnonzero(hit)
        counts[0][256 + LENGTH_CODES :] += np.bincount(slot[stored], minlength=1 << cache_bits)
    far_counts = np.zeros(DISTANCE_CODES, np.int64)
    if refs:
        ref = np.array(refs, np.int64)
        ls, le, lv = _prefix_of(ref[:, 1])
        ds, de, dv = _prefix_of(ref[:, 2] + NEAR)
        np.add.at(counts[0], 256 + ls, 1)
        np.add.at(far_counts, ds, 1)
    gc, gl = _put_code(out, counts[0])
    if alike:
        (rc, rl) = (bc, bl) = _put_code(out, counts[1] + counts[2], 2)
    else:
        (rc, rl), (bc, bl) = _put_code(out, counts[1]), _put_code(out, counts[2])
    (ac, al), (dc, dl) = _put_code(out, counts[3]), _put_code(out, far_counts)
    # one entry for each token: where it starts, its bits, how many
    value, size = gc[channels[0]], gl[channels[0]]
    for code, length, c in ((rc, rl, channels[1]), (bc, bl, channels[2]), (ac, al, channels[3])):
        value, size = value | code[c] << size, size + length[c]
    at, values, sizes = [lit], [value], [size]
    if cache_bits:
        s = 256 + LENGTH_CODES + slot[stored]
        at.append(stored)
        values.append(gc[s])
        sizes.append(gl[s])
    if refs:
        value, size = gc[256 + ls], gl[256 + ls]
        for v, k in ((lv, le), (dc[ds], dl[ds]), (dv, de)):
            value, size = value | v << size, size + k
        at.append(ref[:, 0])
        values.append(value)
        sizes.append(size)
    order = np.argsort(np.concatenate(at), kind="stable") if len(at) > 1 else slice(None)
    out.put_all(np.concatenate(values)[order], np.concatenate(sizes)[order])


def encode(pixels: np.ndarray, cache_bits: int = 0, references: bool = True, transforms: tuple = (), hits: tuple | None = None, alike: bool = False) -> bytes:
    """A file of rows of ARGB numbers; ``alike``: red and blue have one code.

    ``transforms`` lists, in the order of writing, (PREDICTOR, size, modes by block),
    (CROSS_COLOUR, size, elements by block), (SUBTRACT_GREEN,) or (PALETTE,).
    """
    height, width = pixels.shape
    out = BitsOut()
    out.put(SIGNATURE, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1)
    out.put(0, 3)
    px = pixels.astype(np.uint32)
    for kind, *how in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == PREDICTOR:
            size, modes = how
            out.put(size - 2, 3)
            _put_pixels(out, (OPAQUE | modes.astype(np.uint32) << 8).ravel(), False, 0, True)
            rows = _bytes(px)
            less = rows.copy()
            for y in range(height):
                for x in range(px.shape[1]):
                    less[y, x] -= _prediction(rows, y, x, int(modes[y >> size, x >> size]))
            px = less.view(np.uint32).reshape(px.shape)
        elif kind == CROSS_COLOUR:
            size, element = how
            out.put(size - 2, 3)
            _put_pixels(out, element.astype(np.uint32).ravel(), False, 0, True)
            rows = _bytes(px)
            e = _bytes(element).repeat(1 << size, axis=0).repeat(1 << size, axis=1)[:height, : px.shape[1]]
            blue, green, red = (rows[..., k].copy() for k in range(3))
            rows[..., 2] = (red - _cross_delta(e[..., 0], green)).astype(np.uint8)
            rows[..., 0] = (blue - _cross_delta(e[..., 1], green) - _cross_delta(e[..., 2], red)).astype(np.uint8)
            px = rows.view(np.uint32).reshape(px.shape)
        elif kind == SUBTRACT_GREEN:
            green = px >> 8 & 0xFF
            px = px & 0xFF00FF00 | (px - (green << 16) & 0xFF0000) | (px - green & 0xFF)
        else:
            colours, index = np.unique(px, return_inverse=True)
            n = len(colours)
            out.put(n - 1, 8)
            steps = np.diff(_bytes(colours).astype(np.int16), axis=0, prepend=np.zeros((1, 4), np.int16)).astype(np.uint8)
            _put_pixels(out, np.ascontiguousarray(steps).view(np.uint32).ravel(), False, 0, True)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            per, each = 1 << pack, 8 >> pack
            index = index.reshape(px.shape).astype(np.uint32)
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % per)))
            packed = (index.reshape(height, -1, per) << (np.arange(per, dtype=np.uint32) * each)).sum(axis=2, dtype=np.uint32)
            px = OPAQUE | packed << 8
    out.put(0, 1)
    _put_pixels(out, px.ravel(), True, cache_bits, references, hits, alike)
    body = out.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def encode_best(pixels: np.ndarray) -> bytes:
    """For text as samples, whose channels are alike: a palette where there are few colours, a colour
    cache where pixels recur, back-references always."""
    flat = pixels.ravel()
    hits = cache_hits(flat, 9)
    recurring = int(hits[0].sum())
    if 2 * recurring >= len(flat) or len(flat) <= FEW_PIXELS:
        n = len(np.unique(flat))
        if n <= 16 or n <= 256 and 4 * n <= len(flat):
            return encode(pixels, transforms=((PALETTE,),))
    if 2 * recurring >= len(flat):
        return encode(pixels, 9, hits=hits, alike=True)
    return encode(pixels, alike=True)
