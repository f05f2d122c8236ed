"""Token counts: texts are cut at safe boundaries, distinct pieces are encoded in batches of equal bytes, lengths are added.

A boundary is safe if the tokenizer's pattern never matches across it, so counts equal those of the whole text. That
is decided for byte-level vocabularies with the usual pattern; a tokenizer of any other kind gets whole texts.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import slices, text_bytes

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Text bytes of which the distinct pieces are looked up together.
WINDOW_BYTES = 1 << 20
#: Bytes of pieces that the library encodes in one call; a longer piece goes alone.
BATCH_BYTES = 128 << 10
#: Lengths of pieces that a task remembers, of pieces of at most PIECE_BYTES.
REMEMBERED, PIECE_BYTES = 400_000, 64
LIMIT = 512
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_is = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
#: Byte classes: visible ASCII, ASCII letters, white space and marks that a letter's match never reaches over.
VISIBLE = (np.arange(256) > 32) & (np.arange(256) < 127)
LETTER = _is(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
SPACE = _is(b" \n\t\r")
MARK = _is(b".,;:!?\"()[]\n ")


def safe_boundaries(data: np.ndarray) -> np.ndarray:
    """For each byte, whether the text may be cut before it (never before the first).

    Cuts stand (1) between a character that is no white space and a space, tab or line end; (2) between a letter and one of the
    marks above, none of which occurs in a special token; (3) between a single line end and an ASCII letter; (4)
    between an ideograph and a full-width mark.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    if n < 2:
        return cut
    back = lambda k: np.concatenate([np.zeros(min(k, n), np.uint8), data[: max(n - k, 0)]])
    one, two, three = back(1), back(2), back(3)
    tail = (one >= 0x80) & (one < 0xC0)
    # Two bytes from U+00C0 on and three from U+3040 on hold no white space.
    visible = VISIBLE[one] | (tail & (two >= 0xC3) & (two < 0xE0)) | (tail & (three >= 0xE4) & (three < 0xF0)) | (tail & (three == 0xE3) & (two > 0x80))
    letter = LETTER[one] | (tail & (two == 0xC3) & (one != 0x97) & (one != 0xB7)) | (tail & ((two == 0xD0) | (two == 0xD1)))
    cut |= (visible & SPACE[data]) | (letter & MARK[data])
    before_end = np.concatenate([np.zeros(1, bool), cut[:-1]])
    cut |= (one == 10) & before_end & LETTER[data]
    ahead = lambda k: np.concatenate([data[k:], np.zeros(min(k, n), np.uint8)])[:n]
    next_, after = ahead(1), ahead(2)
    comma = ((data == 0xE3) & (next_ == 0x80) & ((after == 0x81) | (after == 0x82))) | ((data == 0xEF) & (next_ == 0xBC) & ((after == 0x81) | (after == 0x8C) | (after == 0x9F)))
    cut |= (three >= 0xE5) & (three <= 0xE9) & tail & comma
    cut[0] = False
    return cut


def may_split(spec: str) -> bool:
    """Whether the boundaries above are safe for a tokenizer's file."""
    told = json.loads(spec)
    before = told.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and told.get("normalizer") is None
    kept = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and not safe_boundaries(np.frombuffer(x["content"].encode(), np.uint8)).any() for x in told.get("added_tokens", []))
    return plain and kept and told.get("truncation") is None and told.get("padding") is None


@functools.cache
def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec)
    made.no_truncation()
    made.no_padding()
    return made


def lengths(pieces: list[str], spec: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Tokens of each piece; the library is called for pieces of about ``batch_bytes`` bytes together."""
    made, out, low, size = _tokenizer(spec), [], 0, 0
    for k, piece in enumerate(pieces):
        own = len(piece.encode())
        if k > low and size + own > batch_bytes:
            out += map(len, made.encode_batch(pieces[low:k], add_special_tokens=False))
            low, size = k, 0
        size += own
    if low < len(pieces):
        out += map(len, made.encode_batch(pieces[low:], add_special_tokens=False))
    return out


class Counter:
    """Counts tokens of columns of texts; remembers the lengths of short pieces."""

    def __init__(self, spec: str):
        self.spec, self.split, self.known = spec, may_split(spec), {}

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        new = [x for x in pieces if x not in self.known]
        found = dict(zip(new, lengths(new, self.spec), strict=True))
        counts = np.fromiter((found[x] if x in found else self.known[x] for x in pieces), np.int64, len(pieces))
        if len(self.known) + len(found) > REMEMBERED:
            self.known = {}
        self.known.update((x, n) for x, n in found.items() if len(x) <= PIECE_BYTES)
        return counts

    def of_texts(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        starts = safe_boundaries(data) if self.split else np.zeros(len(data), bool)
        starts[offsets[:-1][offsets[:-1] < len(data)]] = True
        ends = np.append(np.flatnonzero(starts), len(data))
        if len(ends) == 1:
            return np.zeros(len(column), np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        counts = self.of_pieces(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        return np.diff(before[np.searchsorted(ends, offsets)])


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, by the whole text, without special tokens added.

    A special token's string inside a text counts as that token, as is the library's default. Null and empty texts have no
    bytes and no tokens; repeated rows and null ids stay as they are, and other columns are not read. A text is one
    row of one task; of a long one only pieces reach the library.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shipped.value)
        for batch in slices(batches, limit=WINDOW_BYTES):
            n = counter.of_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, COUNTS)
