"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

A text is normalised (lower case, one space for white space) and read in windows of an item's size. Walks leave out
what only parts words (spaces, a single _ or - between words), so that words that are glued or parted otherwise walk
alike. Anchors are word starts, and every character of long words and of scripts without spaces; all of them unless
winnowing is set to thin them out. From each anchor a random walk (Chakraborty, Goldenberg, Koucky 2016) copies characters and moves on or stays by shared random
bits of step and character, which turns few edits into few differing positions; a table samples some positions of one
walk and looks their hash up among the items' anchors. A hit places an item-sized window in the text, and the least
edit distance between the item and any stretch of that window (wide enough for all allowed edits) decides. Walks are
repeated over all anchors of an item and several tables, so that a copy collides in one of them:
measured in the tests, up to the fifth of the characters that may be edited. Items too short for walks are cut into
one piece more than edits are allowed, so that a copy holds one piece unchanged: every place of a piece is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import mix, slices, text_bytes


@dataclass(frozen=True)
class Settings:
    #: Edits allowed, as a share of the item's characters.
    edits: float = 0.2
    #: Steps of a walk, positions sampled from it, and walks.
    steps: int = 32
    bits: int = 16
    tables: int = 4
    #: Words in a row that hold an anchor.
    winnow: int = 1
    #: Items that are shorter (64 at most), or too short for a walk without their spaces, are found by their pieces.
    least: int = 40
    #: In words of more characters every character is an anchor: they may be glued from words of the item.
    word: int = 20
    #: Items that are looked for in one pass over the texts; their tables are broadcast.
    block: int = 20_000
    seed: int = 5


def lower_table() -> np.ndarray:
    out = np.arange(1 << 16, dtype=np.uint32)
    for c in [*range(0x180), *range(0x370, 0x530)]:
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x3000):
        out[c] = 32
    return out


LOWER = lower_table()


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, normalised, a 0 after each text, and the n + 1 offsets of the texts in them."""
    data, offsets = text_bytes(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    codes = LOWER[codes] if not len(codes) or codes.max() < 1 << 16 else np.where(codes < 1 << 16, LOWER[codes & 0xFFFF], codes)
    # A 0 after each text, then without the spaces that follow a space.
    codes = np.insert(codes, at[1:], 0)
    at = at + np.arange(len(at))
    blank = codes == 32
    twice = np.flatnonzero(blank[1:] & blank[:-1]) + 1
    if len(twice):
        codes, at = np.delete(codes, twice), at - np.searchsorted(twice, at)
    return codes, at


# Code points of scripts that are written without spaces between words (from, to).
SPACELESS = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xABFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def joined(codes: np.ndarray) -> np.ndarray:
    """Whether a character only parts words: a space, or a _ or - on its own between characters of words."""
    mark = (codes == ord("_")) | (codes == ord("-"))
    solid = (codes > 32) & ~mark
    return (codes == 32) | mark & np.concatenate([[False], solid[:-1]]) & np.concatenate([solid[1:], [False]])


def walked(codes: np.ndarray) -> np.ndarray:
    """Places of the characters that walks go over: all but those that only part words; at least every second one."""
    return np.flatnonzero(~joined(codes)) if len(codes) else np.zeros(0, np.int64)


def begins(codes: np.ndarray, place: np.ndarray, word: int) -> np.ndarray:
    """Of each of these characters, whether a word starts there, it is in a long word or in a script without spaces."""
    kept = codes[place]
    first = np.concatenate([[True], (np.diff(place) > 1) | (kept[:-1] == 0)])[: len(place)]
    size = np.diff(np.append(np.flatnonzero(first), len(place)))
    first |= np.repeat(size, size) > word
    for low, high in SPACELESS:
        first |= (kept >= low) & (kept <= high)
    return first & (kept > 32)


def needs_pieces(text: str, s: Settings) -> bool:
    """Whether an item is too short for walks: under ``least`` characters, or fewer than ``steps`` to walk over."""
    return len(text) < s.least or len(walked(np.array([ord(c) for c in text], np.uint32))) < s.steps


class Walks:
    """The shared random bits: for each table and step, whether a character moves the walk on, and the steps sampled."""

    def __init__(self, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.moves = rng.integers(0, 2, (s.tables, s.steps, 1024)).astype(np.int32)
        self.sampled = [set(rng.choice(s.steps, s.bits, replace=False).tolist()) for _ in range(s.tables)]

    def anchors(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(characters that walks go over, anchors as places among them), the least of ``winnow`` in a row by hash."""
        place = walked(codes)
        starts = np.flatnonzero(begins(codes, place, self.s.word))
        if len(starts) < self.s.winnow or self.s.winnow == 1:
            return place, starts
        padded = np.concatenate([codes[place], np.zeros(8, np.uint32)])
        h = np.zeros(len(starts), np.uint64)
        for k in range(5):
            h = h * np.uint64(1000003) + padded[starts + k]
        windows = np.lib.stride_tricks.sliding_window_view(mix(h), self.s.winnow)
        return place, starts[np.unique(np.arange(len(windows)) + windows.argmin(1))]

    def keys(self, codes: np.ndarray, at: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the sampled positions of the walk from each anchor, where each walk ends)."""
        codes = np.concatenate([codes, np.zeros(self.s.steps + 1, np.uint32)])
        small = (codes & np.uint32(1023)).astype(np.int16)
        place, h = at.astype(np.int32), np.full(len(at), 0x9E3779B97F4A7C15 + table, np.uint64)
        for step in range(self.s.steps):
            if step in self.sampled[table]:
                h = (h ^ codes[place]) * np.uint64(0x100000001B3)
            place = place + self.moves[table, step][small[place]]
        return mix(h), place


def edit_distance(item: str, window: str) -> tuple[int, int]:
    """(least edit distance between item and any stretch of window, where that stretch ends), by bit-parallel columns."""
    m, masks = len(item), {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp, hm = minus | (full & ~(d | plus)), plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = hm | (full & ~(x | hp)), hp & x
        if score < best:
            best, end = score, j + 1
    return best, end


GRAMS = (1, 3, 4)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(codes) - q + 1)
    h = np.zeros(n, np.uint32)
    for k in range(q):
        h = (h ^ codes[k : k + n]) * np.uint32(0x9E3779B1)
    return h >> np.uint32(20)


def bag(codes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed q-grams that occur, how often); a collision can only hide that one is missing."""
    value, count = np.unique(gram_hashes(codes, q), return_counts=True)
    return value.astype(np.uint16), count.astype(np.int32)


def lacking(stretch: np.ndarray, q: int, own: tuple[np.ndarray, np.ndarray]) -> int:
    """How many of an item's q-grams the stretch lacks."""
    return int(np.maximum(own[1] - np.bincount(gram_hashes(stretch, q), minlength=1 << 12)[own[0]], 0).sum())


def piece_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` characters from each position on."""
    n = max(0, len(codes) - size + 1)
    h = np.full(n, 0x9E3779B97F4A7C15 + size, np.uint64)
    for k in range(size):
        h = (h ^ codes[k : k + n]) * np.uint64(0x100000001B3)
    return mix(h)


class Short:
    """Items shorter than a walk needs: where their pieces' hashes lead, and the places of each character in them."""

    def __init__(self, texts: list[str], s: Settings) -> None:
        self.numbers = np.array([n for n, t in enumerate(texts) if needs_pieces(t, s)], np.int64)
        self.sizes = np.array([len(texts[n]) for n in self.numbers], np.int64)
        self.allowed = (s.edits * self.sizes).astype(np.int64)
        rows: dict[int, list[tuple[int, int, int]]] = {}
        masks: dict[int, int] = {}
        for i, n in enumerate(self.numbers):
            codes = np.array([ord(c) for c in texts[n]], np.uint32)
            cuts = np.linspace(0, len(codes), self.allowed[i] + 2).astype(int).tolist()
            for low, high in zip(cuts, cuts[1:]):
                rows.setdefault(high - low, []).append((int(piece_hashes(codes[low:high], high - low)[0]), i, low))
            for place, c in enumerate(codes.tolist()):
                masks[i << 32 | c] = masks.get(i << 32 | c, 0) | 1 << place
        self.pieces = []  # of each length: hashes, sorted, the item and the place of each
        for size, found in sorted(rows.items()):
            found.sort()
            self.pieces.append((size, np.array([r[0] for r in found], np.uint64), np.array([r[1] for r in found], np.int64), np.array([r[2] for r in found], np.int64)))
        self.at = np.array(sorted(masks), np.int64)
        self.masks = np.array([masks[k] for k in self.at.tolist()], np.uint64)

    def verify(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """edit_distance of many windows at once, where an item begins about at ``begin`` in the text from low to high."""
        allowed, one = self.allowed[item], np.uint64(1)
        top = one << (self.sizes[item] - 1).astype(np.uint64)
        plus, minus = np.full(len(item), ~np.uint64(0)), np.zeros(len(item), np.uint64)
        score, best, end = self.sizes[item].copy(), self.sizes[item].copy(), np.zeros(len(item), np.int64)
        for step in range(int((self.sizes[item] + 2 * allowed).max(initial=0))):
            place = begin - allowed + step
            inside = (place >= low) & (place < high)
            key = item << 32 | np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], 0)
            k = np.minimum(np.searchsorted(self.at, key), len(self.at) - 1)
            eq = np.where(self.at[k] == key, self.masks[k], np.uint64(0))
            x = eq | minus
            d = (((eq & plus) + plus) ^ plus) | eq | minus
            hp, hm = minus | ~(d | plus), plus & d
            score += ((hp & top) != 0).astype(np.int64) - ((hm & top) != 0)
            hp, hm = hp << one, hm << one
            plus, minus = hm | ~(x | hp), hp & x
            better = score < best
            best[better], end[better] = score[better], (place - low + 1)[better]
        return best, end

    def search(self, codes: np.ndarray, offsets: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(row, item index, distance, end) of every place where an item is within its edits."""
        for size, keys, items, places in self.pieces:
            hashes = piece_hashes(codes, size)
            for first in range(0, len(hashes), 1 << 16):
                part = hashes[first : first + (1 << 16)]
                low = np.searchsorted(keys, part)
                n = np.searchsorted(keys, part, side="right") - low
                hits = np.repeat(np.arange(len(part)), n)
                k = np.arange(len(hits)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                for begin in range(0, len(hits), 1 << 17):
                    own, at = items[k[begin : begin + (1 << 17)]], first + hits[begin : begin + (1 << 17)]
                    row = np.searchsorted(offsets, at, side="right") - 1
                    distance, end = self.verify(codes, offsets[row], offsets[row + 1] - 1, at - places[k[begin : begin + (1 << 17)]], own)
                    for i in np.flatnonzero(distance <= self.allowed[own]):
                        text, r = texts[self.numbers[own[i]]], row[i]
                        if self.allowed[own[i]] or self.apart(codes, offsets[r] + end[i] - len(text), text):
                            yield int(r), int(self.numbers[own[i]]), int(distance[i]), int(end[i])

    def apart(self, codes: np.ndarray, begin: int, text: str) -> bool:
        """Whether an item too short for any edit isn't a part of a longer word; scripts without spaces have no such words."""
        word = lambda c: c < 0x2E80 and chr(c).isalnum()
        before, after = int(codes[begin - 1]) if begin else 0, int(codes[begin + len(text)])
        return not (word(before) and word(ord(text[0])) or word(after) and word(ord(text[-1])))


@dataclass
class Items:
    """A block of items and where their anchors' hashes lead."""

    settings: Settings
    ids: list[int]
    texts: list[str]
    keys: list[np.ndarray]  # of each table, sorted
    owners: list[np.ndarray]  # index of the item, and the anchor's offset in it
    places: list[np.ndarray]
    filters: list[np.ndarray]  # which low bits of a hash occur at all
    short: Short
    bags: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # of the items met so far, their q-grams

    def bag(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n not in self.bags:
            self.bags[n] = [bag(np.array([ord(c) for c in self.texts[n]], np.uint32), q) for q in GRAMS]
        return self.bags[n]


FILTER_BITS = 20


def index(items: list[tuple[int, str]], s: Settings = Settings()) -> Items:
    """Items without text are left out."""
    walks = Walks(s)
    ids, texts = [], []
    for i, text in items:
        codes, at = normalised(pa.array([text or ""], pa.string()))
        clean = "".join(map(chr, codes[: at[1] - 1])).strip(" ")
        if clean:
            ids.append(i)
            texts.append(clean)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(s.tables)]
    for n, text in enumerate(texts):
        if needs_pieces(text, s):
            continue
        codes = np.array([ord(c) for c in text], np.uint32)
        place, at = walks.anchors(codes)
        for table in range(s.tables):
            keys, end = walks.keys(codes[place], at, table)
            found[table] += [(int(k), n, int(place[a])) for k, a, e in zip(keys, at, end, strict=True) if e <= len(place)]
    out = Items(s, ids, texts, [], [], [], [], Short(texts, s), {})
    for rows in found:
        rows.sort()
        keys = np.array([r[0] for r in rows], np.uint64)
        mask = np.zeros(1 << FILTER_BITS, bool)
        mask[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        out.keys.append(keys)
        out.owners.append(np.array([r[1] for r in rows], np.int32))
        out.places.append(np.array([r[2] for r in rows], np.int32))
        out.filters.append(mask)
    return out


def search(column: pa.Array, items: Items, walks: Walks) -> dict[tuple[int, int], tuple[int, int]]:
    """(row, item index) -> (distance, end of the stretch in the normalised text), the nearest stretch of each pair."""
    s = items.settings
    codes, offsets = normalised(column)
    place, at = walks.anchors(codes)
    kept = codes[place]
    owner = np.searchsorted(offsets, place[at], side="right") - 1
    begin = place[at] - offsets[owner]
    hits = []
    for table in range(s.tables):
        if not len(items.keys[table]):
            continue
        keys, _ = walks.keys(kept, at, table)
        hit = np.flatnonzero(items.filters[table][(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        low = np.searchsorted(items.keys[table], keys[hit])
        n = np.searchsorted(items.keys[table], keys[hit], side="right") - low
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        a = np.repeat(hit, n)
        hits.append(np.stack([owner[a], items.owners[table][k], begin[a] - items.places[table][k]], 1))
    tried = np.unique(np.concatenate(hits), axis=0).tolist() if hits else []
    found: dict[tuple[int, int], tuple[int, int]] = {}

    def better(row: int, n: int, distance: int, end: int) -> None:
        if (row, n) not in found or (distance, end) < found[row, n]:
            found[row, n] = (distance, end)

    # The windows of one text and item that overlap are verified as one stretch.
    waiting = tried
    k = 0
    while k < len(waiting):
        row, n, begin = waiting[k]
        item = items.texts[n]
        allowed, size = int(s.edits * len(item)), offsets[row + 1] - 1 - offsets[row]
        low, high = max(0, begin - allowed), begin + len(item) + allowed
        k += 1
        while k < len(waiting) and waiting[k][:2] == (row, n) and waiting[k][2] - allowed <= high:
            high = waiting[k][2] + len(item) + allowed
            k += 1
        stretch = codes[offsets[row] + low : offsets[row] + min(high, size)]
        # An edit spoils at most q of the item's q-grams; those that the stretch lacks must all be spoilt.
        if any(lacking(stretch, q, own) > q * allowed for q, own in zip(GRAMS, items.bag(n), strict=True)):
            continue
        distance, end = edit_distance(item, stretch.tobytes().decode("utf-32-le"))
        if distance <= allowed:
            better(row, n, distance, int(low) + end)
    for row, n, distance, end in items.short.search(codes, offsets, items.texts):
        better(row, n, distance, end)
    return found


def blocks(benchmark: DataFrame, s: Settings, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of a bounded number; the benchmark is the stated query set and is read block by block."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    parts = -(-rows.count() // s.block)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, parts)))
    for k in range(parts):
        yield [(r[0], r[1]) for r in rows.where(block == k).sort("id", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, distance, item_chars, similarity) of every document and item of which it holds a near copy.

    Documents without text and items without text match nothing; repeated rows give repeated pairs; an empty table on
    either side gives no pairs. Lengths and distances are in characters of the normalised texts.
    """
    out = None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance int, item_chars int, similarity double"
    for block in chain(blocks(benchmark, s, item_col, "text"), [[]]):
        if not block and out is not None:
            continue
        shipped = docs.sparkSession.sparkContext.broadcast(index(block, s))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            items, walks = shipped.value, Walks(s)
            for batch in slices(batches):
                found = sorted(search(batch.column("text"), items, walks).items())
                ids = batch.column("doc_id").take(pa.array([row for (row, _), _ in found], pa.int64()))
                size = [len(items.texts[n]) for (_, n), _ in found]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([items.ids[n] for (_, n), _ in found], pa.int64()), pa.array([d for _, (d, _) in found], pa.int32()), pa.array(size, pa.int32()),
                     pa.array([1 - d / m for (_, (d, _)), m in zip(found, size, strict=True)], pa.float64())], names=["doc_id", "item_id", "distance", "item_chars", "similarity"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs, all columns, without the rows that hold a near copy of an item; decided where a row lies, nothing is joined."""
    for block in blocks(benchmark, s, item_col, "text"):
        shipped = docs.sparkSession.sparkContext.broadcast(index(block, s))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            walks = Walks(s)
            for batch in slices(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in search(batch.column(text_col), shipped.value, walks)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
