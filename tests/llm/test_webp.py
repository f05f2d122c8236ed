"""The WebP decoder against a small encoder of every feature, and the payload round trip."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import webp


class Writer:
    """Streams with flat 8-bit codes for all literals; lengths and cached colours get 9-bit ones."""

    def __init__(self, width, height):
        self.value, self.n, self.width, self.height = 0, 0, width, height
        self.put(0x2F, 8), self.put(width - 1, 14), self.put(height - 1, 14), self.put(1, 1), self.put(0, 3)

    def put(self, value, bits):
        self.value |= int(value) << self.n
        self.n += bits

    def code(self, lengths):
        """A code given by its lengths (at most 10), as plain numbers: code lengths 0 to 15 all have 4 bits."""
        self.put(0, 1), self.put(15, 4)
        for k in webp.CODE_LENGTH_ORDER:
            self.put(4 if k < 16 else 0, 3)
        self.put(0, 1)
        flat = webp.reversed_codes(np.array([4] * 16 + [0] * 3))
        for n in lengths:
            self.put(flat[n], 4)
        return webp.reversed_codes(np.array(lengths)), lengths

    def codes(self, cache_bits):
        green = [9] * 256 + [0] * 24 + ([] if not cache_bits else [0] * (1 << cache_bits))
        rest = 280 + (1 << cache_bits if cache_bits else 0) - 256
        extra = [k for k in range(256, 256 + rest)][: 256]
        for k in extra:
            green[k] = 9
        missing = 512 - 256 - len(extra)  # the code must be complete: shorten the first ones
        for k in range(missing):
            green[k] = 8
        out = [self.code(green)] + [self.code([8] * 256) for _ in range(3)]
        self.put(0, 1), self.put(15, 4)
        for k in webp.CODE_LENGTH_ORDER:
            self.put(4 if k < 16 else 0, 3)
        self.put(0, 1)
        distance = [5] * 24 + [6] * 16
        flat = webp.reversed_codes(np.array([4] * 16 + [0] * 3))
        for n in distance:
            self.put(flat[n], 4)
        return [*out, (webp.reversed_codes(np.array(distance)), distance)]

    def emit(self, code, symbol):
        codes, lengths = code
        self.put(codes[symbol], lengths[symbol])

    def prefixed(self, code, value, base):
        if value <= 4:
            self.emit(code, base + value - 1)
            return
        d = value - 1
        top = d.bit_length() - 1
        self.emit(code, base + 2 * top + (d >> (top - 1) & 1))
        self.put(d & ((1 << (top - 1)) - 1), top - 1)

    def pixels(self, argb, cache_bits=0, copies=False, main=True):
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(0, 1)
        codes = self.codes(cache_bits)
        self.body(argb, codes, cache_bits, copies)

    def body(self, argb, codes, cache_bits, copies):
        argb, k, cache = [int(x) for x in argb], 0, {}

        def remember(x):
            if cache_bits:
                cache[(x * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = x

        while k < len(argb):
            if copies:
                best = max(((next((n for n in range(200) if k + n >= len(argb) or argb[k + n] != argb[k + n - d]), 200), -d) for d in range(1, min(k, 400) + 1)), default=(0, 0))
                if best[0] >= 3:
                    n, d = best[0], -best[1]
                    self.prefixed(codes[0], n, 256)
                    near = next((j + 1 for j, (x, y) in enumerate(webp.NEAR) if x + y * self.width == d), None)
                    self.prefixed(codes[4], near or d + 120, 0)
                    for x in argb[k : k + n]:
                        remember(x)
                    k += n
                    continue
            x = argb[k]
            key = (x * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            if cache_bits and cache.get(key) == x and codes[0][1][280 + key]:
                self.emit(codes[0], 280 + key)
            else:
                for code, shift in zip(codes, (8, 16, 0, 24), strict=False):
                    self.emit(code, x >> shift & 255)
            remember(x)
            k += 1

    def file(self):
        body = self.value.to_bytes((self.n + 7) // 8, "little")
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        return b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk


def picture(seed, width=13, height=9, colours=40):
    rng = np.random.default_rng(seed)
    palette = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
    out = palette[rng.integers(0, colours, (height, width))]
    out[3:5] = out[1:3]
    return out


def channels(argb):
    return argb.astype(np.uint32).view(np.uint8).reshape(*argb.shape, 4).astype(np.int64)


@pytest.mark.parametrize("cache_bits", [0, 1, 5, 7])
@pytest.mark.parametrize("copies", [False, True])
def test_literals_copies_and_cache(cache_bits, copies):
    want = picture(cache_bits)
    w = Writer(13, 9)
    w.put(0, 1)
    w.pixels(want.ravel(), cache_bits, copies)
    ((got,),) = webp.decode([w.file()])
    assert (got == want).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    want = picture(mode, colours=200)
    c = channels(want)
    height, width = want.shape
    residual = c.copy()
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = np.array([0, 0, 0, 255]) if x == 0 else c[0, x - 1]
            elif x == 0:
                p = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                p = reference(mode, c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])
            residual[y, x] = (c[y, x] - p) & 255
    w = Writer(width, height)
    w.put(1, 1), w.put(webp.PREDICTOR, 2), w.put(0, 3)
    blocks = -(-width // 4) * -(-height // 4)
    w.pixels([0xFF000000 | mode << 8] * blocks, main=False)
    w.put(0, 1)
    w.pixels(residual.astype(np.uint8).view(np.uint32).ravel())
    ((got,),) = webp.decode([w.file()])
    assert (got == want).all()


def reference(mode, left, top, right, corner):
    """The predictors as the format's specification words them, one channel at a time."""
    avg = lambda a, b: [(int(x) + int(y)) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 0:
        return np.array([0, 0, 0, 255])
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode < 11:
        return np.array([avg(avg(left, right), top), avg(left, corner), avg(left, top), avg(corner, top), avg(top, right), avg(avg(left, corner), avg(top, right))][mode - 5])
    if mode == 11:
        guess = [int(a) + int(b) - int(c) for a, b, c in zip(left, top, corner, strict=True)]
        near = lambda v: sum(abs(g - int(x)) for g, x in zip(guess, v, strict=True))
        return left if near(left) < near(top) else top
    if mode == 12:
        return np.array([clamp(int(a) + int(b) - int(c)) for a, b, c in zip(left, top, corner, strict=True)])
    return np.array([clamp(a + int((a - int(c)) / 2)) for a, c in zip(avg(left, top), corner, strict=True)])


def test_cross_colour_and_subtract_green():
    want = picture(3, colours=200)
    c, (g2r, g2b, r2b) = channels(want), (-77, 45, 101)
    sign = lambda x: ((x & 255) ^ 128) - 128
    red, green, blue = c[..., 2], c[..., 1], c[..., 0]
    out = c.copy()
    out[..., 2] = (red - (g2r * sign(green) >> 5)) & 255
    out[..., 0] = (blue - (g2b * sign(green) >> 5) - (r2b * sign(red) >> 5)) & 255
    out[..., 2] = (out[..., 2] - green) & 255  # cross-colour first, then green off both
    out[..., 0] = (out[..., 0] - green) & 255
    w = Writer(13, 9)
    w.put(1, 1), w.put(webp.CROSS_COLOUR, 2), w.put(1, 3)
    w.pixels([0xFF000000 | (r2b & 255) << 16 | (g2b & 255) << 8 | (g2r & 255)] * (2 * 2), main=False)
    w.put(1, 1), w.put(webp.SUBTRACT_GREEN, 2), w.put(0, 1)
    w.pixels(out.astype(np.uint8).view(np.uint32).ravel())
    ((got,),) = webp.decode([w.file()])
    assert (got == want).all()


@pytest.mark.parametrize("colours", [2, 3, 11, 60])
def test_palette(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
    index = rng.integers(0, colours, (9, 13))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, each = 1 << bits, 8 >> bits
    padded = np.zeros((9, -(-13 // per) * per), np.int64)
    padded[:, :13] = index
    packed = (padded.reshape(9, -1, per) << (np.arange(per) * each)).sum(2) if bits else index
    w = Writer(13, 9)
    w.put(1, 1), w.put(webp.PALETTE, 2), w.put(colours - 1, 8)
    deltas = np.diff(channels(palette), axis=0, prepend=0) & 255
    w.pixels(deltas.astype(np.uint8).view(np.uint32).ravel(), main=False)
    w.put(0, 1)
    w.width = packed.shape[1]
    w.pixels((0xFF000000 | packed << 8).ravel(), copies=True)
    ((got,),) = webp.decode([w.file()])
    assert (got == palette[index]).all()


def test_code_groups():
    want = picture(8)
    w = Writer(13, 9)
    w.put(0, 1), w.put(0, 1)  # no transform, no cache
    w.put(1, 1), w.put(1, 3)  # groups of 8 x 8
    w.pixels([g << 8 for g in (0, 1, 1, 0)], main=False)
    groups = [w.codes(0), w.codes(0)]
    for y in range(9):
        for x in range(13):
            w.body([want[y, x]], groups[(0, 1, 1, 0)[y // 8 * 2 + x // 8]], 0, False)
    ((got,),) = webp.decode([w.file()])
    assert (got == want).all()


def test_many_pictures_at_once_equal_one_by_one():
    files, want = [], []
    for seed in range(12):
        p = picture(seed, 5 + seed, 9)
        w = Writer(5 + seed, 9)
        w.put(0, 1)
        w.pixels(p.ravel(), seed % 3 * 2, seed % 2 == 1)
        files.append(w.file())
        want.append(p)
    for (got,), p in zip(webp.decode(files), want, strict=True):
        assert (got == p).all()


def test_damage_is_refused():
    (good,), _ = webp.encode(pa.array(["text " * 50]))
    for bad in (b"", good[:-1], b"RIFX" + good[4:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(webp.BadPicture):
            webp.decode([bad])
    cut = good[: len(good) // 2]
    cut = cut[:4] + struct.pack("<I", len(cut) - 8) + cut[8:16] + struct.pack("<I", len(cut) - 20) + cut[20:]
    with pytest.raises(webp.BadPicture):
        webp.decode([cut])


def test_payloads_come_back(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "\0" * 70, "x" * 300_000, "é漢😀" * 999, *("".join(rng.choice("abc \n|#é") for _ in range(rng.randint(1, 9000))) for _ in range(30))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS feature", "1 AS n_bytes")
    got = webp.store_and_read(docs).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        payload = ("a" if r.doc_id != r.doc_id else texts[int(r.doc_id)] or "").encode()
        padded = payload + b"\0" * (max(1, -(-len(payload) // 64)) * 64 - len(payload))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    same = got[got.doc_id.isna() | (got.doc_id == 2)]
    assert same.drop(columns="doc_id").drop_duplicates().shape[0] == 1
    assert webp.store_and_read(docs.limit(0)).count() == 0


def test_a_picture_of_another_encoder():
    """The public one-pixel lossless sample that browsers' feature checks use."""
    import base64

    ((pixels,),) = webp.decode([base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")])
    assert pixels.shape == (1, 1)
