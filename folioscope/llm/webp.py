"""Lossless WebP (VP8L): a decoder for whole batches of pictures, and an encoder for payloads stored as grey samples.

The decoder reads prefix codes, back-references and the colour cache, inverts the predictor, cross-colour,
subtract-green and palette transforms, and returns pixel arrays. It decodes many pictures in step: one numpy
operation moves every picture on by one symbol. Sub-pictures (predictor modes, palettes, code groups) go through the
same routine.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import slices, text_bytes

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MULTIPLIER = np.uint32(0x1E35A7BD)


class BadPicture(ValueError):
    """The bytes are no lossless WebP picture."""


# --- reading ---------------------------------------------------------------------------------------------------------


@dataclass
class Bits:
    """A cursor over the words of a buffer that holds many streams."""

    words: np.ndarray
    at: int

    def read(self, n: int) -> int:
        if not n:
            return 0
        k, s = self.at >> 5, self.at & 31
        self.at += n
        return (int(self.words[k]) | int(self.words[k + 1]) << 32) >> s & ((1 << n) - 1)


@dataclass(frozen=True)
class Code:
    """A prefix code as a table over the next ``bits`` bits: symbol << 4 | length. One symbol alone takes no bits."""

    table: np.ndarray
    bits: int

    def read(self, b: Bits) -> int:
        k, s = b.at >> 5, b.at & 31
        entry = int(self.table[(int(b.words[k]) | int(b.words[k + 1]) << 32) >> s & ((1 << self.bits) - 1)])
        b.at += entry & 15
        return entry >> 4


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, first bit lowest."""
    out, code, previous = np.zeros(len(lengths), np.int64), 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[s])
        if not n:
            continue
        code <<= n - previous
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, previous = code + 1, n
    return out


@cache
def code_of(lengths: bytes) -> Code:
    sizes = np.frombuffer(lengths, np.uint8).astype(np.int64)
    used = np.flatnonzero(sizes)
    if len(used) == 1:
        return Code(np.array([used[0] << 4], np.int32), 0)
    bits = int(sizes.max()) if len(used) else 0
    if not bits or (1 << bits >> sizes[used]).sum() != 1 << bits:
        raise BadPicture("a prefix code is not complete")
    table, codes = np.zeros(1 << bits, np.int32), reversed_codes(sizes)
    for s in used.tolist():
        table[codes[s] :: 1 << sizes[s]] = s << 4 | sizes[s]
    return Code(table, bits)


def read_code(b: Bits, alphabet: int) -> Code:
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        symbols = [b.read(8 if wide else 1)] + ([b.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise BadPicture("a symbol lies outside its alphabet")
        if len(set(symbols)) == 1:
            return Code(np.array([symbols[0] << 4], np.int32), 0)
        lengths = np.zeros(alphabet, np.uint8)
        lengths[symbols] = 1
        return code_of(lengths.tobytes())
    sizes = np.zeros(19, np.uint8)
    for k in CODE_LENGTH_ORDER[: 4 + b.read(4)]:
        sizes[k] = b.read(3)
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else alphabet
    meta, lengths, n, last = code_of(sizes.tobytes()), np.zeros(alphabet, np.uint8), 0, 8
    while n < alphabet and left:
        left -= 1
        s = meta.read(b)
        if s < 16:
            lengths[n] = s
            n, last = n + 1, s or last
        else:
            times = 3 + b.read(2) if s == 16 else 3 + b.read(3) if s == 17 else 11 + b.read(7)
            if n + times > alphabet:
                raise BadPicture("code lengths run over their alphabet")
            if s == 16:
                lengths[n : n + times] = last
            n += times
    return code_of(lengths.tobytes())


@dataclass
class Picture:
    """What is known of a picture before its pixels are read."""

    width: int
    height: int
    coded_width: int = 0
    transforms: list[tuple[int, int, np.ndarray | None]] = field(default_factory=list)
    cache_bits: int = 0
    group_bits: int = 0
    groups_at: np.ndarray | None = None
    groups: list[tuple[Code, ...]] = field(default_factory=list)

    @property
    def size(self) -> int:
        return self.coded_width * self.height


def read_codes(b: Bits, p: Picture, top: bool) -> None:
    if b.read(1):
        p.cache_bits = b.read(4)
        if not 1 <= p.cache_bits <= 11:
            raise BadPicture("the colour cache has no valid size")
    count = 1
    if top and b.read(1):
        p.group_bits = b.read(3) + 2
        grid = sub_picture(b, (p.coded_width + (1 << p.group_bits) - 1) >> p.group_bits, (p.height + (1 << p.group_bits) - 1) >> p.group_bits)
        p.groups_at = (grid >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
        count = int(p.groups_at.max()) + 1
    sizes = (280 + (1 << p.cache_bits if p.cache_bits else 0), 256, 256, 256, 40)
    p.groups = [tuple(read_code(b, n) for n in sizes) for _ in range(count)]


def sub_picture(b: Bits, width: int, height: int) -> np.ndarray:
    p = Picture(width, height, width)
    read_codes(b, p, False)
    (pixels,), (end,) = read_pixels(b.words, [p], [b.at])
    b.at = int(end)
    return pixels


def read_header(b: Bits) -> Picture:
    if b.read(8) != 0x2F:
        raise BadPicture("no VP8L signature")
    p = Picture(b.read(14) + 1, b.read(14) + 1)
    p.coded_width = p.width
    b.read(1)
    if b.read(3):
        raise BadPicture("unknown version")
    while b.read(1):
        kind = b.read(2)
        if kind in (t for t, _, _ in p.transforms):
            raise BadPicture("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = b.read(3) + 2
            data = sub_picture(b, (p.coded_width + (1 << bits) - 1) >> bits, (p.height + (1 << bits) - 1) >> bits)
            p.transforms.append((kind, bits, data))
        elif kind == PALETTE:
            size = b.read(8) + 1
            deltas = sub_picture(b, size, 1)
            channels = deltas.view(np.uint8).reshape(-1, 4)
            bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            p.transforms.append((kind, bits, np.cumsum(channels, 0, dtype=np.uint8).view(np.uint32).ravel()))
            p.coded_width = (p.coded_width + (1 << bits) - 1) >> bits
        else:
            p.transforms.append((kind, 0, None))
    read_codes(b, p, True)
    return p


def lengthened(words: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value of each length or distance prefix with its extra bits, new positions)."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    k = at >> 5
    window = (words[k].astype(np.uint64) | words[k + 1].astype(np.uint64) << np.uint64(32)) >> (at & 31).astype(np.uint64)
    more = (window & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + more + 1), at + extra


def read_pixels(words: np.ndarray, pictures: Sequence[Picture], starts: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """(ARGB pixels as coded, of each picture; the bit after each). Pictures advance together, the longest first."""
    order = sorted(range(len(pictures)), key=lambda i: -pictures[i].size)
    ranked = [pictures[i] for i in order]
    size = np.array([p.size for p in ranked], np.int64)
    base = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint32)
    at, done = np.array([starts[i] for i in order], np.int64), np.zeros(len(ranked), np.int64)
    # All codes' tables in a row; for each group of a picture, where its five tables are and how many bits they read.
    place: dict[int, int] = {}
    tables, total = [], 0
    for code in {id(c): c for p in ranked for g in p.groups for c in g}.values():
        place[id(code)] = total
        tables.append(code.table)
        total += len(code.table)
    table = np.concatenate(tables)
    first_group = np.cumsum([0] + [len(p.groups) for p in ranked])[:-1]
    where = np.array([[place[id(c)] for c in g] for p in ranked for g in p.groups], np.int64).T
    masks = np.array([[(1 << c.bits) - 1 for c in g] for p in ranked for g in p.groups], np.uint64).T
    plain = np.array([all(c.bits == 0 for c in g[1:4]) for p in ranked for g in p.groups])
    fixed = np.array([(int(g[3].table[0]) >> 4) << 24 | (int(g[1].table[0]) >> 4) << 16 | int(g[2].table[0]) >> 4 for p in ranked for g in p.groups], np.uint32)
    cached = np.array([p.cache_bits for p in ranked], np.uint32)
    cache_size = 1 << int(cached.max()) if len(cached) and cached.max() else 0
    colours = np.zeros((len(ranked), cache_size), np.uint32)
    many = [i for i, p in enumerate(ranked) if len(p.groups) > 1]
    # A copy and a cached pixel leave the cache to be filled from the pixels, up to ``filled``.
    filled = np.zeros(len(ranked), np.int64)
    limit = len(words) * 32

    def symbol(which: int, group: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = position >> 5
        window = (words[k].astype(np.uint64) | words[k + 1].astype(np.uint64) << np.uint64(32)) >> (position & 31).astype(np.uint64)
        entry = table[where[which][group] + (window & masks[which][group]).astype(np.int64)]
        return entry >> 4, position + (entry & 15)

    def fill_cache(lane: int) -> None:
        lo, hi = int(filled[lane]), int(done[lane])
        if hi > lo:
            new = out[base[lane] + lo : base[lane] + hi]
            colours[lane, new * MULTIPLIER >> (np.uint32(32) - cached[lane])] = new
            filled[lane] = hi

    live = np.flatnonzero(size > 0)
    while len(live):
        group = first_group[live]
        if many:
            for lane in many:
                if done[lane] < size[lane]:
                    p, (y, x) = ranked[lane], divmod(int(done[lane]), ranked[lane].coded_width)
                    across = (p.coded_width + (1 << p.group_bits) - 1) >> p.group_bits
                    group[np.searchsorted(live, lane)] += p.groups_at[(y >> p.group_bits) * across + (x >> p.group_bits)]
        position = at[live]
        if len(position) and position.max() + 64 > limit:
            raise BadPicture("a picture is cut short")
        green, position = symbol(0, group, position)
        literal = green < 256
        if literal.all():
            lit, pos, lanes, g = green, position, live, group
        else:
            lit, pos, lanes, g = green[literal], position[literal], live[literal], group[literal]
        colour = fixed[g] | lit.astype(np.uint32) << np.uint32(8)
        if not plain[g].all():
            red, pos = symbol(1, g, pos)
            blue, pos = symbol(2, g, pos)
            alpha, pos = symbol(3, g, pos)
            colour = (alpha << 24 | red << 16 | lit << 8 | blue).astype(np.uint32)
        out[base[lanes] + done[lanes]] = colour
        done[lanes] += 1
        at[lanes] = pos
        if len(lanes) < len(live):
            for which in (True, False):
                chosen = ~literal & ((green < 280) == which)
                lanes = live[chosen]
                if not len(lanes):
                    continue
                if which:
                    length, pos = lengthened(words, position[chosen], green[chosen] - 256)
                    prefix, pos = symbol(4, group[chosen], pos)
                    distance, pos = lengthened(words, pos, prefix)
                    at[lanes] = pos
                    for lane, n, d in zip(lanes.tolist(), length.tolist(), distance.tolist(), strict=True):
                        if d > 120:
                            d -= 120
                        else:
                            dx, dy = NEAR[d - 1]
                            d = max(1, dx + dy * ranked[lane].coded_width)
                        start, to = int(base[lane]), int(base[lane] + done[lane])
                        n = min(n, int(size[lane] - done[lane]))
                        if d > to - start:
                            raise BadPicture("a copy reaches before the picture")
                        out[to : to + n] = np.resize(out[to - d : min(to, to - d + n)], n)
                        done[lane] += n
                else:
                    for lane, k in zip(lanes.tolist(), (green[chosen] - 280).tolist(), strict=True):
                        if not cached[lane]:
                            raise BadPicture("a cached colour without a cache")
                        fill_cache(lane)
                        out[base[lane] + done[lane]] = colours[lane, k]
                        done[lane] += 1
                    at[lanes] = position[chosen]
        if done[live[-1]] >= size[live[-1]] or len(live) < 64 or not literal.all():
            live = live[done[live] < size[live]]
    result: list[np.ndarray] = [out] * len(pictures)
    ends = np.zeros(len(pictures), np.int64)
    for rank, i in enumerate(order):
        result[i] = out[base[rank] : base[rank] + size[rank]]
        ends[i] = at[rank]
    return result, ends


# --- transforms ------------------------------------------------------------------------------------------------------


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a mode predicts from the neighbours left, above, above right and above left, channel by channel."""
    if mode == 11:
        p = left + top - corner
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = average(left, top)
        d = a - corner
        return np.clip(a + np.sign(d) * (np.abs(d) >> 1), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: average(average(left, right), top), 6: lambda: average(left, corner), 7: lambda: average(left, top),
        8: lambda: average(corner, top), 9: lambda: average(top, right), 10: lambda: average(average(left, corner), average(top, right)),
    }.get(mode, lambda: np.array([0, 0, 0, 255], np.int64))()


def inverse_predictor(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    out = pixels.view(np.uint8).reshape(height, width, 4).astype(np.int64)
    across = (width + (1 << bits) - 1) >> bits
    mode = (modes >> np.uint32(8) & np.uint32(15)).astype(np.int64).reshape(-1, across)
    out[0, 0] += (0, 0, 0, 255)
    out[0] = np.cumsum(out[0], 0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        kinds = np.repeat(mode[y >> bits], 1 << bits)[:width]
        if width > 1 and (kinds[1:] == 1).all():
            out[y] = np.cumsum(row, 0) & 255
            continue
        if (kinds[1:] == 2).all():
            row[1:] = (row[1:] + above[1:]) & 255
            continue
        for x in range(1, width):
            right = above[x + 1] if x + 1 < width else row[0]
            row[x] = (row[x] + predicted(int(kinds[x]), row[x - 1], above[x], right, above[x - 1])) & 255
    return out.astype(np.uint8).view(np.uint32).ravel()


def inverse_cross_colour(pixels: np.ndarray, width: int, height: int, bits: int, data: np.ndarray) -> np.ndarray:
    channels = pixels.view(np.uint8).reshape(height, width, 4).copy()
    across = (width + (1 << bits) - 1) >> bits
    grid = data.view(np.int8).reshape(-1, across, 4).astype(np.int64)
    element = grid[np.arange(height)[:, None] >> bits, np.arange(width)[None] >> bits]
    green = channels[..., 1].view(np.int8).astype(np.int64)
    red = (channels[..., 2] + (element[..., 0] * green >> 5)).astype(np.uint8)
    blue = channels[..., 0] + (element[..., 1] * green >> 5) + (element[..., 2] * red.view(np.int8).astype(np.int64) >> 5)
    channels[..., 2], channels[..., 0] = red, blue.astype(np.uint8)
    return channels.view(np.uint32).ravel()


def inverse_palette(pixels: np.ndarray, coded_width: int, width: int, height: int, bits: int, palette: np.ndarray) -> np.ndarray:
    index = (pixels >> np.uint32(8) & np.uint32(255)).reshape(height, coded_width)
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = (index[..., None] >> (np.arange(per) * each).astype(np.uint32) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :width]
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index].ravel()


def finished(p: Picture, pixels: np.ndarray) -> np.ndarray:
    """ARGB pixels (height x width) after all transforms, inverted from the last to the first."""
    width = p.coded_width
    for kind, bits, data in reversed(p.transforms):
        if kind == PREDICTOR:
            pixels = inverse_predictor(pixels, width, p.height, bits, data)
        elif kind == CROSS_COLOUR:
            pixels = inverse_cross_colour(pixels, width, p.height, bits, data)
        elif kind == SUBTRACT_GREEN:
            green = pixels >> np.uint32(8) & np.uint32(255)
            pixels = pixels & np.uint32(0xFF00FF00) | (pixels + (green << np.uint32(16)) & np.uint32(0xFF0000)) | (pixels + green & np.uint32(255))
        else:
            pixels, width = inverse_palette(pixels, width, p.width, p.height, bits, data), p.width
    return pixels.reshape(p.height, p.width)


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data):
            raise BadPicture("a chunk is cut short")
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def streams(file: bytes) -> list[bytes]:
    """The VP8L streams of a file: one, or one for each frame."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP" or int.from_bytes(file[4:8], "little") + 8 != len(file):
        raise BadPicture("no WebP file")
    out = []
    for kind, body in chunks(file[12:]):
        if kind == b"VP8L":
            out.append(body)
        elif kind == b"ANMF":
            out += [x for k, x in chunks(body[16:]) if k == b"VP8L"]
    if not out:
        raise BadPicture("no lossless picture")
    return out


def decode(files: Sequence[bytes]) -> list[list[np.ndarray]]:
    """The ARGB pixel arrays of the frames of each file."""
    parts = [streams(f) for f in files]
    flat = [s for part in parts for s in part]
    starts, at = [], 0
    for s in flat:
        starts.append(at * 8)
        at += -(-len(s) // 4) * 4
    words = np.frombuffer(b"".join(s + b"\0" * (-len(s) % 4) for s in flat) + b"\0" * 16, np.uint32)
    pictures, begins = [], []
    known: tuple[int, int, int, Picture] | None = None  # the head's bits after the size, their number, alpha and version, the picture
    for s, start in zip(flat, starts, strict=True):
        size = int.from_bytes(s[1:5], "little")
        if known is not None and size >> 28 == known[2] and int.from_bytes(s[5 : 5 + (known[1] + 7) // 8], "little") & ((1 << known[1]) - 1) == known[0]:
            # The frames of a file, and short files, have one head but for the size: it is read once.
            width, height = (size & 0x3FFF) + 1, (size >> 14 & 0x3FFF) + 1
            pictures.append(Picture(width, height, width, known[3].transforms, groups=known[3].groups))
            begins.append(start + 40 + known[1])
            continue
        b = Bits(words, start)
        p = read_header(b)
        pictures.append(p)
        begins.append(b.at)
        # A head with pictures inside, or a cache, depends on the size.
        plain = not p.cache_bits and len(p.groups) == 1 and p.groups_at is None and all(kind == SUBTRACT_GREEN for kind, _, _ in p.transforms)
        bits = b.at - start - 40
        known = (int.from_bytes(s[5 : 5 + (bits + 7) // 8], "little") & ((1 << bits) - 1), bits, size >> 28, p) if plain else None
    pixels, _ = read_pixels(words, pictures, begins)
    done = [finished(p, x) for p, x in zip(pictures, pixels, strict=True)]
    out, k = [], 0
    for part in parts:
        out.append(done[k : k + len(part)])
        k += len(part)
    return out


# --- storing payloads ------------------------------------------------------------------------------------------------

WIDTH = 64
#: Rows of a frame: a longer payload is a file of several frames, one below the other.
ROWS = 64
#: Payloads from this size on have prefix codes of their own.
OWN_CODES = 4096
#: Equal samples in a row from which on a run is a back-reference.
RUN = 8
LONGEST = 11
#: Text bytes that are stored and read together: some twenty arrays of eight bytes a sample stand at once.
SLICE_BYTES = 2 << 20


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of the symbols that occur, none over LONGEST."""
    counts = counts.astype(np.int64)
    used = np.flatnonzero(counts).tolist()
    while True:
        heap = [(int(counts[s]), k, (s,)) for k, s in enumerate(used)]
        lengths, tie = np.zeros(len(counts), np.uint8), len(heap)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            lengths[list(a[2] + b[2])] += 1
            heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
            tie += 1
        if lengths.max() <= LONGEST:
            return lengths
        counts = np.where(counts > 0, (counts + 1) // 2, 0)


def usual_counts() -> np.ndarray:
    """How often bytes are taken to occur in short texts, by a rule: letters by rank, then spaces, stops, digits, the rest."""
    out = np.ones(280, np.int64)
    out[32:127] = 12
    out[[32, 10, 46, 44]] = 700, 60, 60, 60
    for rank, c in enumerate(b"etaoinshrdlucmfwypvbgkjqxz"):
        out[c] = 40 + 1500 // (rank + 3)
    out[0x80:0xC0], out[0xC3], out[256:] = 10, 70, 3
    out[0] = 30
    return out


def head_bits(lengths: np.ndarray) -> tuple[int, int]:
    """(value, number of bits) of a stream's head after the size: subtract-green, no cache, one group of codes."""
    value, n = 0, 0

    def put(x: int, bits: int) -> None:
        nonlocal value, n
        value |= x << n
        n += bits

    put(1, 1), put(SUBTRACT_GREEN, 2), put(0, 1)
    put(0, 1), put(0, 1)  # no colour cache, no code groups
    put(0, 1), put(15, 4)
    sizes = np.zeros(19, np.uint8)
    sizes[: LONGEST + 1], sizes[17:] = 4, 3
    for k in CODE_LENGTH_ORDER:
        put(int(sizes[k]), 3)
    put(0, 1)
    codes, k = reversed_codes(sizes.astype(np.int64)), 0
    while k < len(lengths):
        zeros = 0
        while k + zeros < len(lengths) and zeros < 138 and not lengths[k + zeros]:
            zeros += 1
        if zeros >= 3:
            s = 17 if zeros < 11 else 18
            put(int(codes[s]), int(sizes[s]))
            put(zeros - (3 if s == 17 else 11), 3 if s == 17 else 7)
            k += zeros
        else:
            put(int(codes[lengths[k]]), int(sizes[lengths[k]]))
            k += 1
    for symbol in (0, 0, 255, 1):  # red and blue after subtraction, alpha, and the distance of the sample before
        put(1, 1), put(0, 1), put(int(symbol > 1), 1), put(symbol, 8 if symbol > 1 else 1)
    return value, n


def container(frames: list[bytes], rows: int) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    three = lambda x: struct.pack("<I", x)[:3]
    if len(frames) == 1:
        body = chunk(b"VP8L", frames[0])
    else:
        body = chunk(b"VP8X", b"\2\0\0\0" + three(WIDTH - 1) + three(rows - 1)) + chunk(b"ANIM", b"\0" * 6)
        for k, frame in enumerate(frames):
            high = min(ROWS, rows - k * ROWS)
            body += chunk(b"ANMF", three(0) + three(k * ROWS // 2) + three(WIDTH - 1) + three(high - 1) + three(0) + b"\2" + chunk(b"VP8L", frame))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def encode(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """(a file for each text, bytes of each text): its UTF-8 bytes, zero-padded to a positive multiple of 64, as grey samples."""
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    n = len(size)
    if not n:
        return [], size
    rows = np.maximum(1, -(-size // WIDTH))
    begin = np.cumsum(rows * WIDTH) - rows * WIDTH
    samples = np.zeros(int((rows * WIDTH).sum()), np.uint8)
    samples[np.arange(len(data)) + np.repeat(begin - offsets[:-1], size)] = data
    frames = -(-rows // ROWS)
    of = np.repeat(np.arange(n), frames)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(frames) - frames, frames)
    high = np.minimum(ROWS, rows[of] - nth * ROWS)
    first = begin[of] + nth * ROWS * WIDTH
    # Symbols: the first sample of a long run carries a copy of the rest.
    opens = np.ones(len(samples), bool)
    opens[1:] = samples[1:] != samples[:-1]
    opens[first] = True
    starts = np.flatnonzero(opens)
    run = np.diff(np.append(starts, len(samples)))
    long = run >= RUN
    inside = np.zeros(len(samples) + 1, np.int32)
    np.add.at(inside, starts[long] + 1, 1)
    np.add.at(inside, starts[long] + run[long], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    symbol = samples[at].astype(np.int64)
    copy = np.zeros(len(samples), np.int64)
    copy[starts[long]] = run[long] - 1
    copy = copy[at]
    d = np.maximum(copy - 1, 1)
    top = np.floor(np.log2(d)).astype(np.int64)
    near = copy <= 4
    prefix = np.where(near, copy - 1, 2 * top + (d >> np.maximum(top - 1, 0) & 1))
    extra = np.where(near, 0, top - 1)
    rest = np.where(near, 0, d & ((1 << np.maximum(top - 1, 0)) - 1))
    # Codes: one set for all short payloads, own ones for the others.
    owner = np.searchsorted(begin, at, side="right") - 1
    sets = [code_lengths(usual_counts())]
    which = np.zeros(n, np.int64)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for i in np.flatnonzero(rows * WIDTH >= OWN_CODES).tolist():
        own = slice(bounds[i], bounds[i + 1])
        copies = prefix[own][copy[own] > 0]
        which[i] = len(sets)
        sets.append(code_lengths(np.bincount(np.concatenate([symbol[own], copies + 256]), minlength=280)))
    lengths, codes = np.array(sets, np.int64), np.array([reversed_codes(x.astype(np.int64)) for x in sets], np.uint64)
    heads = [head_bits(x) for x in sets]
    w = which[owner]
    bits = lengths[w, symbol]
    value = codes[w, symbol]
    far = np.flatnonzero(copy)
    more, wf = 256 + prefix[far], w[far]
    value[far] |= (codes[wf, more] | rest[far].astype(np.uint64) << lengths[wf, more].astype(np.uint64)) << bits[far].astype(np.uint64)
    bits[far] += lengths[wf, more] + extra[far]
    frame = np.searchsorted(first, at, side="right") - 1
    in_frame = np.bincount(frame, bits, len(of)).astype(np.int64)
    head = np.array([40 + k for _, k in heads])[which[of]]
    total = (head + in_frame + 7) // 8
    word = np.cumsum(-(-total // 8) + 1) - (-(-total // 8) + 1)
    words = np.zeros(int(word[-1] + total[-1] // 8 + 3), np.uint64)
    before = np.cumsum(bits) - bits
    lead = np.zeros(len(of), np.int64)
    some = np.unique(frame, return_index=True)
    lead[some[0]] = before[some[1]]
    place = word[frame] * 64 + head[frame] + before - lead[frame]
    k, shift = place >> 6, (place & 63).astype(np.uint64)
    np.add.at(words, k, value << shift)
    np.add.at(words, k + 1, np.where(shift > 0, value >> (np.uint64(63) - np.maximum(shift, np.uint64(1)) + np.uint64(1)), np.uint64(0)))
    packed = [np.frombuffer((v << 40 | 0x2F | (WIDTH - 1) << 8).to_bytes((m + 40 + 63) // 64 * 8, "little"), np.uint64) for v, m in heads]
    raw = words.view(np.uint8)
    out: list[list[bytes]] = [[] for _ in range(n)]
    for j, (i, tall, at_word, long_) in enumerate(zip(of.tolist(), high.tolist(), word.tolist(), total.tolist(), strict=True)):
        h = packed[which[i]]
        words[at_word : at_word + len(h)] += h
        words[at_word] += np.uint64((tall - 1) << 22)
        out[i].append(raw[at_word * 8 : at_word * 8 + long_].tobytes())
    return [container(x, int(r)) for x, r in zip(out, rows, strict=True)], size


def samples_of(frames: list[np.ndarray]) -> np.ndarray:
    """The grey samples of a file's frames, row after row."""
    return np.concatenate([(f >> np.uint32(8)).astype(np.uint8) for f in frames])


def described(samples: np.ndarray) -> str:
    """rows:mean:hash of a picture; a bit of the hash says whether a field of the 8 x 8 grid is lighter than the whole."""
    rows = len(samples)
    band = np.arange(rows) * 8 // rows
    sums, count = np.zeros((8, 8), np.int64), np.zeros((8, 1), np.int64)
    across = samples.reshape(rows, 8, WIDTH // 8).sum(2, dtype=np.int64)
    np.add.at(sums, band, across)
    np.add.at(count, band, WIDTH // 8)
    total, n = int(sums.sum()), rows * WIDTH
    lighter = (sums * n > total * count).ravel()
    return f"{rows}:{total // n}:{int(np.packbits(lighter).tobytes().hex(), 16):016x}"


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row.

    The payload values come from the pixels read back; a payload that differs from what was stored is an error. Null
    and empty texts are 64 zero bytes; a row's values depend on its text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE_BYTES):
            files, size = encode(batch.column("text"))
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            rows = []
            for file, frames, n, text in zip(files, decode(files), size.tolist(), texts, strict=True):
                samples = samples_of(frames)
                payload = samples.tobytes()
                if payload[:n] != text.encode() or any(payload[n:]):
                    raise BadPicture("a payload did not come back whole")
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), described(samples)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=COLUMNS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
