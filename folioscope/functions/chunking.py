"""Passages, fragments and volumes: the functions that make several rows of one, or carry state from row to row."""

from __future__ import annotations

import bisect
import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.shared import cut

# Sizes in characters, and the headings that name a page or a slide.
TARGET = 1200
OVERLAP = 150
HEADINGS = (("## Pagina ", "Pagina "), ("## Slide ", "Slide "))
PASSAGES = "document_id string, passage_id string, locator string, text string, char_count int, sha256 string"


@dataclass
class Piece:
    text: str
    place: str | None
    paragraph: int


def pieces(text: str) -> Iterator[Piece]:
    """Paragraphs, long ones cut after a sentence or else a space in the second half of the allowed length."""
    most, place = TARGET - OVERLAP, None
    for number, paragraph in enumerate((p for p in text.split("\n\n") if p.strip()), 1):
        head = paragraph.strip()
        for mark, name in HEADINGS:
            if head.startswith(mark):
                place = name + head[len(mark) :].strip()
        start = 0
        while start < len(paragraph):
            end = min(start + most, len(paragraph))
            if len(paragraph) - start > most:
                low = start + most // 2
                stop = max(paragraph.rfind(c, low, end + 1) for c in ".\n!?")
                stop = stop if stop >= 0 else paragraph.rfind(" ", low, end + 1)
                end = stop + 1 if stop >= 0 else end
            if paragraph[start:end].strip():
                yield Piece(paragraph[start:end], place, number)
            start = end


def passages(text: str | None) -> list[tuple[str, str]]:
    """(locator, text) of each passage; text that is blank has none. A passage repeats the end of the one before it in the same place."""
    out: list[tuple[str, str]] = []
    now, place, first, last = "", None, 1, 1

    def close() -> str:
        chunk = now.strip()
        out.append((place or (f"Paragrafo {first}" if first == last else f"Paragrafi {first}-{last}"), chunk))
        return chunk

    for piece in pieces(text or ""):
        if not now:
            place, first, last = piece.place, piece.paragraph, piece.paragraph
        moved = piece.place is not None and place is not None and piece.place != place
        if now and (moved or len(now) + len(piece.text) > TARGET):
            chunk = close()
            now = chunk[-OVERLAP:] if not moved and len(chunk) > OVERLAP else ""
            place, first = piece.place, piece.paragraph
        now = f"{now}\n\n{piece.text}" if now else piece.text
        last = piece.paragraph
    if now.strip():
        close()
    return out


def chunk_documents(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """A row per passage; each document is cut where it lies, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("document_id", pa.string()), ("passage_id", pa.string()), ("locator", pa.string()), ("text", pa.string()), ("char_count", pa.int32()), ("sha256", pa.string())])
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(low, 256).to_pylist():
                    for n, (locator, text) in enumerate(passages(row["text"])):
                        rows.append({"document_id": row["document_id"], "passage_id": f"{row['document_id']}_p{n}", "locator": locator, "text": text, "char_count": len(text), "sha256": hashlib.sha256(text.encode()).hexdigest()})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("text")).mapInArrow(run, PASSAGES)


def fragments(text: Column, size: int = 6000) -> Column:
    """Consecutive slices of at most ``size`` UTF-8 bytes that end between characters, without overlap; none for an empty text."""
    data = text.cast("binary")
    inside = lambda at: F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")

    def step(acc: Column, _: Column) -> Column:
        begin = acc["at"]
        end = begin + size
        for _back in range(3):
            end = F.when((end < F.octet_length(data)) & inside(end), end - 1).otherwise(end)
        piece = F.decode(F.substring(data, begin + 1, end - begin), "UTF-8")
        more = begin < F.octet_length(data)
        return F.struct(F.when(more, end).otherwise(begin).alias("at"), F.when(more, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    rounds = F.sequence(F.lit(0), F.floor(F.octet_length(data) / max(1, size - 3)).cast("int"))
    cut = F.aggregate(rounds, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)["out"]
    ascii_ = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(text) - 1) / size).cast("int")), lambda k: F.substring(text, k * size + 1, F.lit(size)))
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(F.char_length(text) == 0, F.array().cast("array<string>")).when(plain, ascii_).otherwise(cut)


@dataclass
class Run:
    """A stretch of one group's items in order, and where volumes that open at each of them would end."""

    sizes: np.ndarray
    most: int

    def __post_init__(self) -> None:
        s = self.sizes
        n = len(s)
        self.sums = np.concatenate([[0], np.cumsum(s)])
        filled = np.flatnonzero(s > 0)
        full = np.append(filled, n)[np.searchsorted(filled, np.arange(n))]  # the first item from each on that has a size
        after = np.searchsorted(self.sums[1:], self.sums[:-1] + self.most, side="right")
        self.next = np.minimum(np.maximum(after, full + 1), n)

    def first_break(self, filled: int) -> int:
        """The first item that doesn't fit a volume that holds ``filled`` already; the number of items if all do."""
        if not filled:
            return int(self.next[0]) if len(self.sizes) else 0
        return int(np.searchsorted(self.sums[1:], self.most - filled, side="right"))

    def breaks(self, filled: int) -> np.ndarray:
        """Which items open a volume."""
        out = np.zeros(len(self.sizes), np.int64)
        at = self.first_break(filled)
        while at < len(out):
            out[at] = 1
            at = int(self.next[at])
        return out

    def ends(self) -> list[tuple[int, int]]:
        """For each first break among the items that a volume could hold: (bytes in the last volume, volumes opened)."""
        n = len(self.sizes)
        filled, opened = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            k = int(self.next[i])
            filled[i], opened[i] = (filled[k], opened[k] + 1) if k < n else (self.sums[n] - self.sums[i], 1)
        last = min(n, int(self.next[0])) if n else 0
        return list(zip(filled[: last + 1].tolist(), opened[: last + 1].tolist(), strict=True))


def group_runs(batches: Iterator[pa.RecordBatch], group: list[str], size: str) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of sorted batches, a table for each group."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_pylist() for c in group]
        keys = list(zip(*columns, strict=True)) if group else [()] * batch.num_rows
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for low, high in zip(edges, edges[1:], strict=False):
            if held and keys[low] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield key, pa.Table.from_batches(held)


def volumes(items: DataFrame, group: list[str], order: str, size: str, most: int = 48_000) -> DataFrame:
    """(group, order, size, volume) of items: a new volume opens when the next item would not fit one that holds something.

    The greedy rule carries state along a group's order. Items are sorted into ranges; each range tells for every
    state in which it could be entered how it would be left, which is a list no longer than a volume's items; these
    are followed from range to range, and a second pass numbers the volumes. So a group of any size is spread over
    tasks. Only sizes and keys are moved.
    """
    rows = items.select(*group, order, F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias(size))
    ordered = cut(rows.repartitionByRange(*group, order).sortWithinPartitions(*group, order))
    kinds = dict(ordered.dtypes)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first, ends, single, last, tail = TaskContext.get().partitionId(), None, None, True, None, (0, 0)
        for key, table in group_runs(batches, group, size):
            run = Run(table.column(size).to_numpy(), most)
            if first is None:
                first, ends, sums = key, run.ends(), run.sums[1 : len(run.ends()) + 1].tolist()
            else:
                single, opened = False, run.breaks(0)
                at = int(np.flatnonzero(opened)[-1]) if opened.any() else 0
                tail = (int(run.sizes[at:].sum()), int(opened.sum()))
            last = key
            total = int(run.sizes.sum())
        if first is not None:
            whole = [] if not single else [total]
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "said": [pickle.dumps((first, last, single, sums, ends, whole, tail))]})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, volume, open_key = entered.value.get(TaskContext.get().partitionId(), (0, 0, None))
        for key, table in group_runs(batches, group, size):
            start, base = (filled, volume) if key == open_key else (0, 0)
            run = Run(table.column(size).to_numpy(), most)
            numbers = base + np.cumsum(run.breaks(start))
            yield from table.append_column("volume", pa.array(numbers, pa.int32())).to_batches()

    said = sorted((r["pid"], pickle.loads(r["said"])) for r in ordered.mapInArrow(describe, "pid int, said binary").collect())
    entries, state = {}, (0, 0, None)
    for pid, (first, last, single, sums, ends, whole, tail) in said:
        filled, volume, key = state if state[2] == first else (0, 0, first)
        entries[pid] = (filled, volume, key)
        if not single:
            state = (*tail, last)
            continue
        at = bisect.bisect_right(sums, most - filled) if filled else len(ends) - 1
        if filled and at < len(ends) and at < len(sums):
            left, opened = ends[at]
            state = (left, volume + opened, last)
        elif not filled and ends[-1][1]:
            left, opened = ends[-1]
            state = (left, volume + opened, last)
        else:
            state = (filled + whole[0], volume, last)
    entered = items.sparkSession.sparkContext.broadcast(entries)
    return ordered.mapInArrow(number, ", ".join(f"`{c}` {kinds[c]}" for c in (*group, order, size)) + ", volume int")


def running_budget(items: DataFrame, group: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """The items before the first that overflows the budget, in order, with what is used up to each; items of one place count together.

    What follows an overflow is out too. So each range of the order first drops what comes after the item that alone
    overflows it, and the running sum is over what is left: a budget's worth of items from each range and the one that
    ends it, which keeps later ranges out.
    """
    ordered = items.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used = None, 0
        for batch in batches:
            sizes, keys = pc.fill_null(batch.column(size), 0).to_numpy(), list(zip(*(batch.column(c).to_pylist() for c in group), strict=True)) if group else [()] * batch.num_rows
            keep = np.zeros(len(sizes), bool)
            for i, own in enumerate(keys):
                used = used if own == key else 0
                keep[i] = used <= most
                key, used = own, used + int(sizes[i])
            yield batch.filter(pa.array(keep))

    window = Window.partitionBy(*group).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return ordered.mapInArrow(drop, items.schema).withColumn("used", F.sum(size).over(window)).where(F.col("used") <= most)
