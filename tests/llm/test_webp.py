import hashlib
import zlib

import numpy as np
import pytest

from cartolith.llm import media as M
from cartolith.llm import webp as W

from .helpers import documents, rows

SIZES = (256 + 24, 256, 256, 256, 40)


def image(out, tokens, used, flags, cache=0):
    """Write flags, five prefix codes of 1, 2 or 4 symbols and the tokens (channel, symbol)."""
    for value, n in flags:
        out.put(value, n)
    codes = []
    for k, (symbols, size) in enumerate(zip(used, SIZES, strict=True)):
        lengths = [0] * (size + (cache if k == 0 else 0))
        for s in symbols:
            lengths[s] = max(1, len(symbols).bit_length() - 1)
        W.put_prefix(out, lengths)
        codes.append((W.canonical(tuple(lengths)), lengths, len(symbols) > 1))
    for channel, symbol in tokens:
        code, lengths, many = codes[channel]
        assert symbol in used[channel]
        if many:
            out.put(code[symbol], lengths[symbol])


def start(width, height):
    out = W.BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        out.put(value, n)
    return out


def decoded(out):
    return W.decode(W.wrap(out.to_bytes()))


def greens(out):
    found = decoded(out)
    assert (found & np.uint32(0xFFFF00FF) == 0xFF000000).all()
    return ((found >> np.uint32(8)) & np.uint32(255)).tolist()


NO_TRANSFORM, PLAIN, INNER = [(0, 1)], [(0, 1), (0, 1)], [(0, 1)]
OPAQUE = ([0], [0], [255])


def test_back_references():
    out = start(4, 3)
    tokens = [(0, 10), (0, 20), (0, 256), (4, 1), (0, 10), *[(0, 259), (4, 0)] * 2]  # one left, then four above, twice
    image(out, tokens, ([10, 20, 256, 259], *OPAQUE, [0, 1]), NO_TRANSFORM + PLAIN)
    assert greens(out) == [[10, 20, 20, 10]] * 3


def test_colour_cache():
    place = lambda g: (0x1E35A7BD * (0xFF000000 | g << 8) & 0xFFFFFFFF) >> 31
    a, b = 1, next(g for g in range(2, 256) if place(g) != place(1))
    out = start(5, 1)
    tokens = [(0, a), (0, b), (0, 280 + place(a)), (0, 280 + place(b)), (0, 280 + place(a))]
    image(out, tokens, (sorted([a, b, 280, 281]), *OPAQUE, [0]), NO_TRANSFORM + [(1, 1), (1, 4), (0, 1)], cache=2)
    assert greens(out) == [[a, b, a, b, a]]


def test_groups_of_prefix_codes():
    out = start(8, 4)
    for value, n in NO_TRANSFORM + [(0, 1), (1, 1), (0, 3)]:
        out.put(value, n)
    image(out, [(0, 0), (0, 1)], ([0, 1], *OPAQUE, [0]), INNER)
    image(out, [], ([30], *OPAQUE, [0]), [])
    image(out, [], ([40], *OPAQUE, [0]), [])
    assert greens(out) == [[30] * 4 + [40] * 4] * 4


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    half = lambda a, b: (a + b) // 2
    clamp = lambda x: min(255, max(0, x))
    guess = [
        lambda l, t, r, c: 0, lambda l, t, r, c: l, lambda l, t, r, c: t, lambda l, t, r, c: r, lambda l, t, r, c: c,
        lambda l, t, r, c: half(half(l, r), t), lambda l, t, r, c: half(l, c), lambda l, t, r, c: half(l, t), lambda l, t, r, c: half(c, t),
        lambda l, t, r, c: half(t, r), lambda l, t, r, c: half(half(l, c), half(t, r)),
        lambda l, t, r, c: l if abs(t - c) < abs(l - c) else t, lambda l, t, r, c: clamp(l + t - c),
        lambda l, t, r, c: clamp(half(l, t) + int((half(l, t) - c) / 2)),
    ][mode]
    width, rest = 4, [3, 90, 200, 7, 7, 200, 3, 90, 90, 3, 7, 200]
    out = start(width, 3)
    for value, n in ((1, 1), (0, 2), (0, 3)):
        out.put(value, n)
    image(out, [], ([mode], *OPAQUE, [0]), INNER)
    image(out, [(0, g) for g in rest], ([3, 7, 90, 200], [0], [0], [0], [0]), NO_TRANSFORM + PLAIN)
    want = []
    for i, g in enumerate(rest):
        y, x = divmod(i, width)
        if not y or not x:
            near = want[i - 1] if x else want[i - width] if y else 0
        else:
            near = guess(want[i - 1], want[i - width], want[i - width + 1], want[i - width - 1])
        want.append(g + near & 255)
    assert sum(greens(out), []) == want


def test_cross_colour_and_subtracted_green():
    out = start(2, 1)
    for value, n in ((1, 1), (1, 2), (0, 3)):
        out.put(value, n)
    image(out, [], ([8], [32], [0xF0], [255], [0]), INNER)  # green to blue, red to blue, green to red
    image(out, [], ([100], [5], [7], [255], [0]), NO_TRANSFORM + PLAIN)
    # red: 5 + (-16 * 100 >> 5) = -45; blue: 7 + (8 * 100 >> 5) + (32 * -45 >> 5) = -13
    assert decoded(out).tolist() == [[255 << 24 | 211 << 16 | 100 << 8 | 243] * 2]
    out = start(2, 1)
    out.put(1, 1)
    out.put(2, 2)
    image(out, [], ([100], [200], [7], [255], [0]), NO_TRANSFORM + PLAIN)
    assert decoded(out).tolist() == [[255 << 24 | 44 << 16 | 100 << 8 | 107] * 2]


def test_palette():
    out = start(5, 2)
    for value, n in ((1, 1), (3, 2), (2, 8)):
        out.put(value, n)
    table = [(0, 10), (3, 255), (0, 20), (3, 0), (0, 20), (3, 0)]  # differences of three colours
    image(out, table, ([10, 20], [0], [0], [0, 255], [0]), INNER)
    image(out, [(0, 0b01100100), (0, 2), (0, 2), (0, 0b01100100)], ([2, 0b01100100], *OPAQUE, [0]), NO_TRANSFORM + PLAIN)
    assert greens(out) == [[10, 30, 50, 30, 50], [50, 10, 10, 10, 10]]


def test_media_like_plain_python(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "word and word " * 3000, "\U0001f600 \0", "a"]
    found = M.read_back(M.store(documents(spark, texts))).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(texts)))
    media = {r["doc_id"]: bytes(r["media"]) for r in M.store(documents(spark, texts)).collect()}
    for r in found:
        raw = (texts[r["doc_id"]] or "").encode()
        data = raw + bytes(max(64, (len(raw) + 63) // 64 * 64) - len(raw))
        cut = [data[i * len(data) // 65 : (i + 1) * len(data) // 65] for i in range(65)] if len(data) >= 65 else None
        means = [sum(p) / len(p) for p in cut] if cut else [data[i % len(data)] for i in range(65)]
        bits = "".join("01"[b > a] for a, b in zip(means, means[1:], strict=False))
        own = media[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(data[-64:]), len(own), hashlib.sha256(own).hexdigest())
        assert r["feature"] == f"{int(bits, 2):016x}"
    assert rows(M.read_back(M.store(documents(spark, [])))) == []


def slow_image(bits, width, height, top):
    """The image by single symbols alone, without the table."""
    cache = bits.read(4) if bits.read(1) else 0
    assert not (top and bits.read(1))
    sizes = (256 + W.LENGTH_CODES + ((1 << cache) if cache else 0), 256, 256, 256, W.DISTANCE_CODES)
    return W._read_pixels(bits, width, height, [[W._read_prefix(bits, n) for n in sizes]], None, 0, cache)


def test_encoder_streams_hold_references_palettes_and_caches(monkeypatch):
    r = np.random.default_rng(7)
    line = b"a line that stands here again and again, "
    cyrillic = "".join(chr(0x430 + int(x)) for x in r.geometric(0.15, 900) % 32).encode()
    payloads = [
        line * 40 + b"end", b"x" * 10_000, cyrillic + b"0123456789" * 3, bytes(r.integers(0, 256, 5000).astype(np.uint8)),
        line + bytes(r.integers(97, 120, 9000).astype(np.uint8)) + line + b"!" + line, bytes(range(256)) * 20, b"\0" * 64, b"ab" * 3000,
        bytes(r.integers(0, 200, 70_000).astype(np.uint8)) * 2,
    ]
    held = {"palette": 0, "cached": 0, "references": 0, "mapped": 0}
    for p in payloads:
        p += bytes(-len(p) % 64)
        media = W.encode_bytes(p)
        assert W.decode_bytes(media, len(p)) == p and media == W.encode_bytes(p)
        found = W._matches(np.frombuffer(p, np.uint8))
        at = 0
        for start, length, distance in found:
            assert start >= at and W.MATCH <= length <= W.LONGEST and 0 < distance <= start
            assert all(p[start + k] == p[start + k - distance] for k in range(length))
            at = start + length
        held["references"] += len(found)
        held["mapped"] += sum(d in W._near_codes(64) for _, _, d in found)
        held["palette"] += media[25] & 1
        with monkeypatch.context() as m:
            m.setattr(W, "_read_image", slow_image)
            assert W.decode_bytes(media, len(p)) == p
        colours = np.frombuffer(p, np.uint8)
        deltas = np.diff(np.unique(colours).astype(int))
        held["cached"] += len(deltas) - len(set(deltas.tolist()))
    assert min(held.values()) > 0
    whole = W.encode_bytes(line * 40)
    for cut in range(30, len(whole) - 2, 7):
        with pytest.raises(ValueError):
            W.decode(whole[:cut])


def test_op4_reads_back_what_lies_in_the_shared_folder(spark):
    texts = [None, "", "a", "a", "é" * 40, "long text " * 30_000, "x" * 64]
    stored = M.store(documents(spark, texts))
    assert "media-" in stored.inputFiles()[0]
    found = rows(M.read_back(stored), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "media_bytes")
    for (i, n, size, digest, crc, own, media), text in zip(found, texts, strict=True):
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (n, size, digest, crc) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert own == hashlib.sha256(W.encode_bytes(padded)).hexdigest() and media == len(W.encode_bytes(padded))
    assert found[2][1:] == found[3][1:] and found[0][1:] == found[1][1:]
    assert rows(M.read_back(M.store(documents(spark, [])))) == []
