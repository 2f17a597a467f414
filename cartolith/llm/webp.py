"""Lossless WebP (VP8L): a whole decoder, and an encoder for byte payloads.

Pixels are ARGB as unsigned 32-bit numbers. :func:`decode` reads prefix codes
(simple and normal, with code-length codes), meta prefix images, LZ77
back-references with the distance map, the colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. Where an image has one
group of prefix codes, no cache and one channel that varies, symbols are read
several at a time by a table.

:func:`encode_bytes` writes one channel: repeated stretches of ``MATCH`` bytes or
more as back-references, the rest as literals, by one of two fixed codes. Either
the bytes stand in the green channel with a code for Latin text, or a palette
transform numbers them by falling frequency and the code is one for ranks; the
shorter stream is taken. The palette's own image has a colour cache, since its
differences repeat. Predictors and cross-colour gain nothing on one channel of
text, so the encoder does not write them.
"""

from __future__ import annotations

import bisect
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Fixed values of the format: order of the code-length code's lengths, prefix sizes, and the distance map.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES = 24, 40
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE = 1 << 14
_LOOK = 16  # bits of a table's window


class Bits:
    """Reads bits from the least significant end of each byte."""

    def __init__(self, data: bytes) -> None:
        self.data = data + bytes(16)
        self.end = 8 * len(data)
        self.at = 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def wide(self, n: int) -> int:
        """The next bits, any number of them."""
        byte, shift = self.at >> 3, self.at & 7
        return (int.from_bytes(self.data[byte : byte + (n + shift + 7) // 8], "little") >> shift) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n) if n else 0
        self.at += n
        if self.at > self.end:
            raise ValueError("the image's data ends early")
        return out


def canonical(lengths: tuple[int, ...]) -> list[int]:
    """Codes of a prefix code, bit-reversed as they stand in the stream."""
    out = [0] * len(lengths)
    code = 0
    for n in range(1, 16):
        for s, k in enumerate(lengths):
            if k == n:
                out[s] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
        code <<= 1
    return out


class Prefix:
    """A prefix code's table: (symbol, bits) for the next 15 bits, grown on demand by width."""

    def __init__(self, lengths: tuple[int, ...]) -> None:
        used = [(s, n) for s, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("an empty prefix code")
        self.lengths = lengths
        self.single = used[0][0] if len(used) == 1 else None
        self.width = max(n for _, n in used)
        if self.single is None and sum(1 << (15 - n) for _, n in used) != 1 << 15:
            raise ValueError("a prefix code that is not complete")
        self.table: list[tuple[int, int]] = []
        if self.single is None:
            table = [(0, 0)] * (1 << self.width)
            codes = canonical(lengths)
            for s, n in used:
                for high in range(1 << (self.width - n)):
                    table[codes[s] | high << n] = (s, n)
            self.table = table

    def next(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        s, n = self.table[bits.peek(self.width)]
        bits.read(n)
        return s


@lru_cache(maxsize=256)
def prefix(lengths: tuple[int, ...]) -> Prefix:
    return Prefix(lengths)


def _read_prefix(bits: Bits, symbols: int) -> Prefix:
    if bits.read(1):
        count = bits.read(1) + 1
        lengths = [0] * symbols
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if count == 2:
            lengths[bits.read(8)] = 1
        return prefix(tuple(lengths))
    own = [0] * 19
    for i in range(bits.read(4) + 4):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = prefix(tuple(own))
    left = symbols
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    lengths: list[int] = []
    before = 8
    while len(lengths) < symbols and left:
        left -= 1
        s = code.next(bits)
        if s < 16:
            lengths.append(s)
            before = s or before
        elif s == 16:
            lengths += [before] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > symbols:
        raise ValueError("too many code lengths")
    return prefix(tuple(lengths + [0] * (symbols - len(lengths))))


#: Declarations of prefix codes met of late: alphabet sizes, bits of the stream, their number, the codes.
_MET: list[tuple[tuple[int, ...], int, int, list[Prefix]]] = []


def _read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[Prefix]:
    """The prefix codes of a group; equal bits declare equal codes, so that those met before are not read again."""
    for own, value, n, codes in _MET:
        if own == sizes and bits.at + n <= bits.end and bits.wide(n) == value:
            bits.at += n
            return codes
    start = bits.at
    codes = [_read_prefix(bits, n) for n in sizes]
    n, bits.at = bits.at - start, start
    value = bits.wide(n)
    bits.at += n
    _MET.append((sizes, value, n, codes))
    del _MET[:-8]
    return codes


def _extra(bits: Bits, symbol: int) -> int:
    """The number that a length or distance prefix and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    meta, meta_bits, groups = None, 0, 1
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = (_read_image(bits, _blocks(width, meta_bits), _blocks(height, meta_bits), False) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(meta.max()) + 1
    sizes = (256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = [_read_codes(bits, sizes) for _ in range(groups)]
    if groups == 1 and not cache_bits:
        green, red, blue, alpha, distance = codes[0]
        if None not in (red.single, blue.single, alpha.single):
            rest = alpha.single << 24 | red.single << 16 | blue.single
            return (_one_channel(bits, green, distance, width, width * height).astype(np.uint32) << np.uint32(8)) | np.uint32(rest)
    return _read_pixels(bits, width, height, codes, meta, meta_bits, cache_bits)


@lru_cache(maxsize=8)
def _runs(lengths: tuple[int, ...]) -> tuple[list[bytes], list[int]]:
    """For each window of 16 bits, the bytes whose codes it holds whole before a back-reference, and their bits."""
    code = prefix(lengths)
    size = 1 << _LOOK
    table = code.table
    symbol = np.array([s for s, _ in table])
    length = np.array([n for _, n in table], np.int64)
    window = np.arange(size)
    rest, used = window.copy(), np.zeros(size, np.int64)
    out = [b""] * size
    live = window
    while len(live):
        at = rest[live] & ((1 << code.width) - 1)
        n = length[at]
        live = live[(used[live] + n <= _LOOK) & (symbol[at] < 256)]
        at = rest[live] & ((1 << code.width) - 1)
        for w, s in zip(live.tolist(), symbol[at].tolist(), strict=True):
            out[w] += _BYTE[s]
        used[live] += length[at]
        rest[live] >>= length[at]
    return out, used.tolist()


_BYTE = [bytes([i]) for i in range(256)]


def _distance(code: int, width: int) -> int:
    """How many pixels a distance code goes back."""
    if code > len(DISTANCE_MAP):
        return code - len(DISTANCE_MAP)
    dx, dy = DISTANCE_MAP[code - 1]
    return max(1, dx + dy * width)


def _one_channel(bits: Bits, code: Prefix, distance: Prefix, width: int, count: int) -> np.ndarray:
    """``count`` bytes of one channel: literals by the table, and back-references."""
    if code.single is not None:
        if code.single >= 256:
            raise ValueError("a back-reference outside the image")
        return np.full(count, code.single, np.uint8)
    text, used = _runs(code.lengths)
    size_of = np.array(code.lengths[:256])
    raw = np.frombuffer(bits.data, np.uint8)
    out = bytearray()
    own: list[bytes] = []
    add = own.append
    spent = 0  # bits of the literals in ``out`` and of back-references
    got = 0  # bytes of ``out`` and of ``own``, brought up to date at a back-reference or a chunk's end

    def flush() -> None:
        nonlocal spent
        part = b"".join(own)[: count - len(out)]
        own.clear()
        spent += int(size_of[np.frombuffer(part, np.uint8)].sum())
        out.extend(part)

    step = 1 << 16  # bytes of the stream whose windows stand in memory at once
    byte, p = bits.at >> 3, bits.at & 7
    while got < count:
        chunk = raw[byte : byte + step + 2].astype(np.uint32)
        if len(chunk) < 3:
            raise ValueError("the image's data ends early")
        windows = (chunk[:-2] | chunk[1:-1] << np.uint32(8) | chunk[2:] << np.uint32(16)).tolist()
        end = 8 * len(windows)
        while p < end:
            w = (windows[p >> 3] >> (p & 7)) & 0xFFFF
            n = used[w]
            if n:
                add(text[w])
                p += n
                continue
            flush()
            got = len(out)
            if got == count:
                break
            reader = Bits(b"")
            reader.data, reader.end, reader.at = bits.data, bits.end, 8 * byte + p
            length = _extra(reader, code.next(reader) - 256)
            back = _distance(_extra(reader, distance.next(reader)), width)
            if back > got or got + length > count:
                raise ValueError("a back-reference outside the image")
            seen = bytes(out[got - back : got - back + length])
            out += (seen * (length // back + 1))[:length] if back < length else seen
            got += length
            spent += reader.at - 8 * byte - p
            p = reader.at - 8 * byte
        if got < count:
            got = len(out) + sum(map(len, own))
        byte += p >> 3
        p &= 7
        if byte >= len(raw) and got < count:
            raise ValueError("the image's data ends early")
    flush()
    bits.at += spent
    if bits.at > bits.end:
        raise ValueError("the image's data ends early")
    return np.frombuffer(bytes(out), np.uint8, count)


def _read_pixels(bits, width, height, codes, meta, meta_bits, cache_bits) -> np.ndarray:
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    across = _blocks(width, meta_bits) if meta is not None else 0
    group_of = meta.tolist() if meta is not None else None
    at = 0
    green, red, blue, alpha, distance = codes[0]
    while at < total:
        if group_of is not None:
            green, red, blue, alpha, distance = codes[group_of[(at // width >> meta_bits) * across + (at % width >> meta_bits)]]
        s = green.next(bits)
        if s < 256:
            r = red.next(bits)
            b = blue.next(bits)
            pixel = alpha.next(bits) << 24 | r << 16 | s << 8 | b
            out[at] = pixel
            at += 1
            if cache is not None:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
        elif s < 256 + LENGTH_CODES:
            length = _extra(bits, s - 256)
            code = _extra(bits, distance.next(bits))
            back = _distance(code, width)
            if back > at or at + length > total:
                raise ValueError("a back-reference outside the image")
            for k in range(at, at + length):
                pixel = out[k] = out[k - back]
                if cache is not None:
                    cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
            at += length
        else:
            if cache is None:
                raise ValueError("a colour cache code without a cache")
            pixel = out[at] = cache[s - 256 - LENGTH_CODES]
            cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
            at += 1
    return np.array(out, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """Bytes of pixels: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _half(a: int, b: int) -> int:
    return (a + b) >> 1


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _select(left: list[int], up: list[int], corner: list[int]) -> list[int]:
    by_left = sum(abs(u - c) for u, c in zip(up, corner, strict=True))
    by_up = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
    return left if by_left < by_up else up


def predict(mode: int, left: list[int], up: list[int], corner: list[int], right: list[int]) -> list[int]:
    """The predicted channels from the neighbours: left, above, above left and above right."""
    near = zip(left, up, corner, right, strict=True)
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode in (1, 2, 3, 4):
        return (left, up, right, corner)[mode - 1]
    if mode == 5:
        return [_half(_half(a, d), b) for a, b, _, d in near]
    if mode == 6:
        return [_half(a, c) for a, _, c, _ in near]
    if mode == 7:
        return [_half(a, b) for a, b, _, _ in near]
    if mode == 8:
        return [_half(c, b) for _, b, c, _ in near]
    if mode == 9:
        return [_half(b, d) for _, b, _, d in near]
    if mode == 10:
        return [_half(_half(a, c), _half(b, d)) for a, b, c, d in near]
    if mode == 11:
        return _select(left, up, corner)
    if mode == 12:
        return [_clamp(a + b - c) for a, b, c, _ in near]
    return [_clamp((h := _half(a, b)) + int((h - c) / 2)) for a, b, c, _ in near]


def _predictor(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    out = _channels(pixels.reshape(height, width)).astype(int).tolist()
    across = _blocks(width, bits)
    for y in range(height):
        row, above = out[y], out[y - 1]
        for x in range(width):
            if not y:
                guess = [0, 0, 0, 255] if not x else row[x - 1]
            elif not x:
                guess = above[0]
            else:
                mode = int(modes[(y >> bits) * across + (x >> bits)]) >> 8 & 15
                right = above[x + 1] if x + 1 < width else row[0]
                guess = predict(mode, row[x - 1], above[x], above[x - 1], right)
            row[x] = [(p + g) & 255 for p, g in zip(row[x], guess, strict=True)]
    return np.array(out, np.uint8).reshape(-1, 4).copy().view("<u4").ravel().astype(np.uint32)


def colour_delta(multiplier: np.ndarray, channel: np.ndarray) -> np.ndarray:
    """The product of two signed bytes over 32."""
    return (multiplier.astype(np.int8).astype(np.int32) * channel.astype(np.int8).astype(np.int32)) >> 5


def _cross_colour(pixels: np.ndarray, width: int, height: int, bits: int, data: np.ndarray) -> np.ndarray:
    c = _channels(pixels.reshape(height, width)).copy()
    grid = data.reshape(_blocks(height, bits), _blocks(width, bits))
    m = _channels(np.repeat(np.repeat(grid, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width])
    green = c[..., 1]
    red = (c[..., 2].astype(np.int32) + colour_delta(m[..., 0], green)) & 255
    blue = c[..., 0].astype(np.int32) + colour_delta(m[..., 1], green) + colour_delta(m[..., 2], red.astype(np.uint8))
    c[..., 2], c[..., 0] = red, blue & 255
    return c.reshape(-1, 4).view("<u4").ravel().astype(np.uint32)


def _add_green(pixels: np.ndarray) -> np.ndarray:
    c = _channels(pixels).copy()
    c[:, 0] += c[:, 1]
    c[:, 2] += c[:, 1]
    return c.view("<u4").ravel().astype(np.uint32)


def _palette(pixels: np.ndarray, width: int, height: int, bits: int, colours: np.ndarray) -> np.ndarray:
    packed = (pixels >> np.uint32(8)) & np.uint32(255)
    if bits:
        each = 8 >> bits
        parts = packed.reshape(height, -1, 1) >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each))
        packed = (parts & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :width].ravel()
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[packed]


def decode_stream(data: bytes) -> np.ndarray:
    """Pixels (height, width) of a VP8L chunk's data."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo: list[tuple] = []
    seen: set[int] = set()
    now = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            grid = _read_image(bits, _blocks(now, size), _blocks(height, size), False)
            undo.append((kind, now, size, grid))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, now, 0, None))
        else:
            count = bits.read(8) + 1
            deltas = _channels(_read_image(bits, count, 1, False))
            colours = np.cumsum(deltas, axis=0, dtype=np.uint8).view("<u4").ravel().astype(np.uint32)
            pack = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            undo.append((kind, now, pack, colours))
            now = _blocks(now, pack)
    pixels = _read_image(bits, now, height, True)
    for kind, across, size, own in reversed(undo):
        if kind == PREDICTOR:
            pixels = _predictor(pixels, across, height, size, own)
        elif kind == CROSS_COLOUR:
            pixels = _cross_colour(pixels, across, height, size, own)
        elif kind == SUBTRACT_GREEN:
            pixels = _add_green(pixels)
        else:
            pixels = _palette(pixels, across, height, size, own)
    return pixels.reshape(height, width)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) of a WebP file with a lossless image."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, 8 + int.from_bytes(data[4:8], "little")
    while at + 8 <= min(end, len(data)):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def wrap(stream: bytes) -> bytes:
    """A WebP file around a VP8L stream."""
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


class BitWriter:
    """Writes bits from the least significant end."""

    def __init__(self) -> None:
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= (value & ((1 << n) - 1)) << self.size
        self.size += n

    def to_bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of an optimal prefix code of at most ``most`` bits, by merging packages of coins."""
    used = sorted((c, s) for s, c in enumerate(counts) if c)
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0][1]] = 1
        return out
    coins = [(c, (s,)) for c, s in used]
    level = list(coins)
    for _ in range(most - 1):
        pairs = [(level[i][0] + level[i + 1][0], level[i][1] + level[i + 1][1]) for i in range(0, len(level) - 1, 2)]
        level = sorted([*coins, *pairs], key=lambda x: x[0])
    for _, symbols in level[: 2 * len(used) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def put_prefix(out: BitWriter, lengths: list[int]) -> None:
    """Write a prefix code: simple if it has one symbol, else with a flat code for its lengths."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(used[0], 8)
        return
    out.put(0, 1)
    out.put(19 - 4, 4)
    flat = [0] * 19
    for n in range(16):
        flat[n] = 4
    for s in CODE_LENGTH_ORDER:
        out.put(flat[s], 3)
    codes = canonical(tuple(flat))
    out.put(0, 1)
    for n in lengths:
        out.put(codes[n], 4)


def put_single(out: BitWriter, *symbols: int) -> None:
    """Prefix codes of one symbol each."""
    for only in symbols:
        put_prefix(out, [int(i == only) for i in range(256)])


#: Usual shares of bytes in Latin text, in hundredths of a per cent.
BYTE_SHARES = {
    " ": 1700, "e": 1000, "t": 750, "a": 650, "n": 620, "o": 600, "i": 580, "r": 500, "s": 480, "h": 460, "d": 330,
    "l": 330, "u": 250, "c": 210, "m": 200, "f": 180, "p": 150, "g": 160, "w": 150, "y": 120, "b": 120, ".": 80,
    ",": 80, "v": 80, "\n": 40, "k": 60, "x": 12, "j": 10, "q": 30, "z": 25, "-": 15, "'": 10, "\0": 20,
}


def _byte_counts() -> list[int]:
    """Expected counts of bytes for the fixed code; every byte has one."""
    counts = [1] * 256
    for c in range(0x80, 0xC0):
        counts[c] = 4
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
        counts[c] = 10
    counts[0xC3] = 150
    for c in (0xA9, 0xA8, 0xA4, 0xB3, 0xBC):
        counts[c] = 30
    for c, n in BYTE_SHARES.items():
        counts[ord(c)] = n
    return counts


#: Shortest back-reference that the encoder writes, bytes within which it looks for them, and the longest.
MATCH, MATCH_WINDOW, LONGEST = 16, 1 << 20, 4096
#: Bits of the colour cache of the palette's image.
PALETTE_CACHE = 5


@dataclass(frozen=True)
class _Code:
    """A fixed code: codes and lengths of bytes and length prefixes, and the stream's part that declares it."""

    codes: np.ndarray
    lengths: np.ndarray
    head: int
    head_size: int


#: Lengths of the distance code: a complete code in which far ones are a bit shorter.
_DISTANCE_LENGTHS = [6] * 16 + [5] * 24


@lru_cache(maxsize=2)
def _fixed_code(ranked: bool) -> _Code:
    """The code for Latin bytes, or for the ranks of bytes by frequency; length prefixes are rare in both."""
    counts = [int(20_000 * np.exp(-r / 9)) + 8 for r in range(256)] if ranked else [8 * n for n in _byte_counts()]
    lengths = code_lengths(counts + [sum(counts) // 400] * LENGTH_CODES)
    head = BitWriter()
    head.put(0, 1)  # no colour cache
    head.put(0, 1)  # one group of prefix codes
    put_prefix(head, lengths)
    put_single(head, 0, 0, 255)
    put_prefix(head, _DISTANCE_LENGTHS)
    return _Code(np.array(canonical(tuple(lengths)), np.uint32), np.array(lengths, np.uint8), head.value, head.size)


@lru_cache(maxsize=1)
def _distance_code() -> list[int]:
    return canonical(tuple(_DISTANCE_LENGTHS))


@lru_cache(maxsize=1)
def _palette_code() -> tuple[list[int], list[int]]:
    """Half of the code space for literals, half for the colour cache."""
    lengths = [9] * 256 + [0] * LENGTH_CODES + [PALETTE_CACHE + 1] * (1 << PALETTE_CACHE)
    return canonical(tuple(lengths)), lengths


def _put_palette(out: BitWriter, colours: list[int]) -> None:
    """The palette transform: colours as bytes of the green channel, each as its difference from the one before."""
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(len(colours) - 1, 8)
    out.put(1, 1)
    out.put(PALETTE_CACHE, 4)
    codes, lengths = _palette_code()
    put_prefix(out, lengths)
    # the first pixel is opaque, the differences of the others are not: two literals of the alpha channel
    out.put(1, 1)
    out.put(0, 1)
    out.put(0, 1)
    out.put(0, 1)  # red: always 0
    out.put(1, 1)
    out.put(0, 1)
    out.put(0, 1)
    out.put(0, 1)  # blue: always 0
    out.put(1, 1)
    out.put(1, 1)
    out.put(0, 1)
    out.put(0, 1)
    out.put(255, 8)  # alpha: 0 or 255
    out.put(1, 1)
    out.put(0, 1)
    out.put(0, 1)
    out.put(0, 1)  # no distances
    cache = [0] * (1 << PALETTE_CACHE)
    before = 0
    for k, c in enumerate(colours):
        alpha = 0 if k else 255
        pixel = alpha << 24 | (c - before & 255) << 8
        before = c
        place = (CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - PALETTE_CACHE)
        if cache[place] == pixel:
            symbol = 256 + LENGTH_CODES + place
            out.put(codes[symbol], lengths[symbol])
        else:
            out.put(codes[pixel >> 8 & 255], 9)
            out.put(int(alpha > 0), 1)
            cache[place] = pixel


def _matches(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of stretches that stood before, from left to right, without overlap."""
    out: list[tuple[int, int, int]] = []
    raw = data.tobytes()
    for base in range(0, len(data), MATCH_WINDOW):
        part = data[base : base + MATCH_WINDOW]
        n = len(part) - MATCH + 1
        if n < 2:
            continue
        words = np.lib.stride_tricks.as_strided(part, (len(part) - 7, 8), (1, 1)).copy().view("<u8").ravel()
        h = (words[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        places = np.uint64(MATCH_WINDOW - 1)
        key = np.sort((h & ~places) | np.arange(n, dtype=np.uint64))
        same = (key[1:] ^ key[:-1]) <= places
        if not same.any():
            continue
        here, there = (key[1:][same] & places).astype(np.int64), (key[:-1][same] & places).astype(np.int64)
        order = np.argsort(here)
        starts, froms = here[order].tolist(), there[order].tolist()
        at, k, stop = 0, 0, base + len(part)
        while k < len(starts):
            i, j = base + starts[k], base + froms[k]
            if i < at or raw[i : i + MATCH] != raw[j : j + MATCH]:
                k += 1
                continue
            length = _extent(raw, i, j, stop)
            for done in range(0, length, LONGEST):
                if (size := min(LONGEST, length - done)) >= MATCH:
                    out.append((i + done, size, i - j))
                    at = i + done + size
            k = bisect.bisect_left(starts, at - base, k + 1)
    return out


def _extent(raw: bytes, i: int, j: int, stop: int) -> int:
    """How long the stretches at i and j agree."""
    length, step = MATCH, 64
    while i + length < stop:
        size = min(step, stop - i - length)
        a, b = raw[i + length : i + length + size], raw[j + length : j + length + size]
        if a != b:
            lo, hi = 0, size
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
            return length + lo
        length += size
        step = min(2 * step, 1 << 16)
    return length


def _prefixed(value: int) -> tuple[int, int, int]:
    """The prefix symbol of a length or distance, its extra bits and their number."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + (v >> n), v & ((1 << n) - 1), n


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    """Distance codes of the map, by how far they go back."""
    out: dict[int, int] = {}
    for code in range(len(DISTANCE_MAP), 0, -1):
        out[_distance(code, width)] = code
    return out


def _reference(code: _Code, length: int, distance: int, width: int) -> tuple[list[int], list[int]]:
    """Fields and their bits of a back-reference."""
    symbol, extra, n = _prefixed(length)
    far, far_extra, far_n = _prefixed(_near_codes(width).get(distance, distance + len(DISTANCE_MAP)))
    fields = [int(code.codes[256 + symbol]), extra, _distance_code()[far], far_extra & 0x7FFF, far_extra >> 15]
    return fields, [int(code.lengths[256 + symbol]), n, _DISTANCE_LENGTHS[far], min(far_n, 15), max(far_n - 15, 0)]


def _packed(fields: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> bytes:
    """Bits ``first``, then fields of at most 15 bits, least significant first."""
    pieces, packed = [first], []
    for at in range(0, len(fields), 1 << 18):
        bits = (fields[at : at + (1 << 18), None] >> np.arange(15, dtype=np.uint16)).astype(np.uint8) & 1
        pieces.append(bits[np.arange(15, dtype=np.uint8) < sizes[at : at + (1 << 18), None]])
        joined = np.concatenate(pieces)
        whole = len(joined) // 8 * 8
        packed.append(np.packbits(joined[:whole], bitorder="little").tobytes())
        pieces = [joined[whole:]]
    packed.append(np.packbits(pieces[0], bitorder="little").tobytes())
    return b"".join(packed)


def _image(data: np.ndarray) -> bytes:
    width = 64 * max(1, -(-len(data) // (64 * MAX_SIDE)))
    height = -(-len(data) // width)
    if len(data) < width * height:
        data = np.concatenate([data, np.zeros(width * height - len(data), np.uint8)])
    matches = _matches(data)
    literal = np.ones(len(data), bool)
    for start, length, _ in matches:
        literal[start : start + length] = False
    counts = np.bincount(data[literal] if matches else data, minlength=256)
    plain, ranked = _fixed_code(False), _fixed_code(True)
    order = np.argsort(-counts, kind="stable")
    colours = order[: int((counts > 0).sum())]
    fallen = counts[colours]
    by_rank = int((fallen * ranked.lengths[: len(colours)]).sum()) + 12 * len(colours) + 1_300  # the palette and its codes
    use_palette = len(colours) > 16 and by_rank < int((counts * plain.lengths[:256]).sum())  # smaller palettes would pack pixels
    code = ranked if use_palette else plain
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1)
    out.put(0, 3)
    if use_palette:
        _put_palette(out, colours.tolist())
        rank = np.zeros(256, np.uint8)
        rank[colours] = np.arange(len(colours))
        data = rank[data]
    out.put(0, 1)  # no further transform
    out.put(code.head, code.head_size)
    first = np.unpackbits(np.frombuffer(out.to_bytes(), np.uint8), bitorder="little")[: out.size]
    if not matches:
        return wrap(_packed(code.codes[data].astype(np.uint16), code.lengths[data], first))
    fields: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    at = 0
    for start, length, distance in [*matches, (len(data), 0, 0)]:
        part = data[at:start]
        fields.append(code.codes[part])
        sizes.append(code.lengths[part])
        if length:
            values, bits = _reference(code, length, distance, width)
            fields.append(np.array(values, np.uint32))
            sizes.append(np.array(bits, np.uint8))
        at = start + length
    return wrap(_packed(np.concatenate(fields).astype(np.uint16), np.concatenate(sizes), first))


#: Bytes of one image at most; longer payloads become several, one after the other.
IMAGE_BYTES = 1 << 26


def encode_bytes(payload: bytes) -> bytes:
    """Store bytes, 64 pixels a row (more where the height would not do)."""
    data = np.frombuffer(payload, np.uint8)
    return b"".join(_image(data[at : at + IMAGE_BYTES]) for at in range(0, max(1, len(data)), IMAGE_BYTES))


def decode_bytes(media: bytes, size: int) -> bytes:
    """The ``size`` bytes that :func:`encode_bytes` stored."""
    out = []
    at = 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(((decode(media[at:end]).ravel() >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes())
        at = end
    sizes = [min(IMAGE_BYTES, size - k * IMAGE_BYTES) for k in range(len(out))]
    return b"".join(part[:n] for part, n in zip(out, sizes, strict=True))
