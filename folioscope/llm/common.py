"""Shared helpers: checkpoints in the cluster's shared folder, and text batches as byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.shared import cut, shared_dir

#: Text bytes that a task handles at once; the arrays over them, some 130 bytes a byte, stay within some 35 MB.
SLICE_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: compressed, for what is too large to checkpoint as it stands."""
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def joined_by_count(rows: DataFrame, keyed: DataFrame, key: str, count: str = "n", parts: int = 1000) -> DataFrame:
    """rows joined with keyed, which has a row for each key and in ``count`` how many of rows hold it.

    Keys of more than 1 / parts of the counted rows, fewer than ``parts`` of them, are broadcast; so no task of the
    other join, by shuffle, gets more than that of one key.
    """
    keyed = cut(keyed)
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = keyed.where(F.col(count) * parts > total).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(count) * parts <= total).drop(count), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none holds much more than limit bytes of text (one long text stands alone)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        start, done = 0, 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])
        pa.default_memory_pool().release_unused()


def rows_by_size(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes together, or one longer text alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    low, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > low and size + n > limit:
            yield low, k
            low, size = k, 0
        size += n
    if low < len(sizes):
        yield low, len(sizes)


def pieces_at(data: np.ndarray, allowed: np.ndarray, limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that cover data and begin at places that are allowed (rising); longer where there is none."""
    cuts, last = [0], 0
    while last + limit < len(data):
        k = int(np.searchsorted(allowed, last + limit))
        if k == len(allowed):
            break
        last = int(allowed[k])
        cuts.append(last)
    return list(zip(cuts, [*cuts[1:], len(data)], strict=True))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets of the texts in them; a null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold_of(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo modulus: the contract's held-out rule."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
