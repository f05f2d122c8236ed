"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, one document at a
time, on a bounded sample; document frequencies are counted over all rows that may be learned from; a temperature
fitted on rows kept out of the training turns scores into calibrated probabilities. A prediction is linear in the
n-grams of the whole text, so a long text needs no table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SLICE_BYTES, fold_of, joined_by_count, rows_by_size, slices, text_bytes

UNKNOWN = "und"
SIZES = (1, 2, 3)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    #: Documents of each language that the weights are fitted on, chosen by a hash of the id; a fifth sets the temperature.
    fit_rows: int = 1500
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    scale: float = 10.0


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(repr=False)  # buckets x languages
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    _table: np.ndarray | None = field(default=None, repr=False, compare=False)

    def table(self) -> np.ndarray:
        """What an n-gram of each bucket adds to the scores; the last row is for n-grams that don't count."""
        if self._table is None:
            table = (self.settings.scale * self.idf[:, None] * self.weights).astype(np.float32)
            self._table = np.vstack([table, np.zeros((1, table.shape[1]), np.float32)])
        return self._table


@cache
def folded() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter's code, or 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint32)
    for c in [*range(0xD800), *range(0xE000, 1 << 16)]:
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@cache
def folded_wide(code: int) -> int:
    """The same for a code point beyond the basic plane."""
    return ord(chr(code).lower()) if chr(code).isalpha() else 0


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts, two zeros after each text, and the n + 1 offsets of the texts in them."""
    data, offsets = text_bytes(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    at = starts[offsets] + 2 * np.arange(len(offsets))
    out = np.zeros(len(codes) + 2 * len(column), np.uint32)
    place = np.arange(len(codes)) + 2 * np.repeat(np.arange(len(column)), np.diff(starts[offsets]))
    found = folded()[codes & 0xFFFF]
    wide = np.flatnonzero(codes >= 1 << 16)
    if len(wide):
        distinct, which = np.unique(codes[wide], return_inverse=True)
        found[wide] = np.array([folded_wide(c) for c in distinct.tolist()], np.uint32)[which]
    out[place] = found
    return out, at


def grams(codes: np.ndarray, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram that starts at each code, and whether it holds a letter first or second."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.full(n, 2166136261 + size, np.uint32)
    for k in range(size):
        h = (h ^ codes[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    held = codes[:n] != 0
    if size > 1:
        held = held | (codes[1 : n + 1] != 0)
    return (h & np.uint32(buckets - 1)).astype(np.int64), held


def frequencies(docs: DataFrame, text_col: str, buckets: int) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts, counted over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(buckets, np.int64), 0
        for batch in slices(batches):
            codes, at = letters(batch.column("text"))
            n += batch.num_rows
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            for first in range(0, batch.num_rows, 128):
                last = min(first + 128, batch.num_rows)
                part, own = codes[at[first] : at[last]], owner[at[first] : at[last]] - first
                marks = np.zeros((last - first, buckets), bool)
                for size in SIZES:
                    b, held = grams(part, size, buckets)
                    marks[own[: len(b)][held], b[held]] = True
                seen += marks.sum(0)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(some, -1), "n": np.append(seen[some], n)})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(buckets, np.int64)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket < 0].sum())


def vectors(docs: DataFrame, text_col: str, lang_col: str, id_col: str, buckets: int) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """(language, kept for calibration, buckets, term frequencies) of each document of a bounded sample."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, at = letters(batch.column("text"))
            ids, tfs = [], []
            for i in range(batch.num_rows):
                own = [b[held] for b, held in (grams(codes[at[i] : at[i + 1]], s, buckets) for s in SIZES)]
                b, n = np.unique(np.concatenate(own), return_counts=True)
                ids.append(b.astype(np.int32))
                tfs.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("late"), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.float32()))], names=["lang", "late", "ids", "tfs"]
            )

    late = F.xxhash64(F.lit("calibrate"), F.col(id_col).cast("string")) % 5 == 0
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), late.alias("late"))
    found = rows.mapInArrow(extract, "lang string, late boolean, ids array<int>, tfs array<float>").toArrow()
    # What is returned are views of the lists where they lie: as copies or Python numbers they would take the driver's memory again.
    out = []
    for batch in found.to_batches():
        ids, tfs = batch.column("ids"), batch.column("tfs")
        ends, b, tf = np.asarray(ids.offsets), np.asarray(ids.values), np.asarray(tfs.values)
        out += [(lang, late, b[lo:hi], tf[lo:hi]) for lang, late, lo, hi in zip(batch.column("lang").to_pylist(), batch.column("late").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes) and bias; rows are (class, buckets, values). L1 leaves unused weights at exactly 0."""
    z, n = np.zeros((s.buckets, classes)), np.zeros((s.buckets, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= s.l1, 0.0, (np.sign(zi) * s.l1 - zi) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            y, b, x = rows[i]
            zi, ni = z[b], n[b]
            w = weights(zi, ni)
            scores = x @ w + bias
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha
            z[b] = zi + g - sigma * w
            n[b] = ni + g * g
            bias_n += p * p
            bias -= 0.1 * p / (1 + np.sqrt(bias_n))
    return weights(z, n), bias


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores under which the kept rows are likeliest."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        x = scores / t
        x = x - x.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(1)) - x[np.arange(len(y)), y]))

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in docs; rows without a language or text are passed over."""
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    df, total = frequencies(docs, text_col, settings.buckets)
    idf = np.log((1 + total) / (1 + df)) + 1
    if not languages:
        return Model(settings, [], idf, np.zeros((settings.buckets, 0)))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, settings.fit_rows / n), n) for lang, n in counts.items()], "lang string, share double, n long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col("id").cast("string"), "text"), F.lit(1_000_003)) / 1_000_003
    # Rows are drawn by id and text, and equal rows count once, so that neither a repeated id nor a repeated row fills the sample.
    sample = joined_by_count(rows, shares, "lang").where(draw < F.col("share")).select("id", "text", "lang").dropDuplicates()
    weight = (settings.scale * idf).astype(np.float32)
    rows = [(languages.index(lang), late, b, tf * weight[b]) for lang, late, b, tf in vectors(sample, "text", "lang", "id", settings.buckets)]
    weights, bias = ftrl([(y, b, x) for y, late, b, x in rows if not late], len(languages), settings)
    kept = [(y, x @ weights[b] + bias) for y, late, b, x in rows if late]
    t = temperature(np.array([s for _, s in kept]), np.array([y for y, _ in kept])) if kept else 1.0
    del rows
    pa.default_memory_pool().release_unused()
    return Model(settings, languages, idf, weights, bias, t)


def summed(model: Model, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the weights, number) of the n-grams that start in each of the stretches that begin at ``at``."""
    sums, totals, table = np.zeros((len(at), len(model.languages))), np.zeros(len(at)), model.table()
    for size in SIZES:
        b, held = grams(codes, size, model.settings.buckets)
        held = np.pad(held, (0, len(codes) - len(held)))
        b = np.where(held, np.pad(b, (0, len(codes) - len(b))), model.settings.buckets)
        sums += np.add.reduceat(table[b], at, axis=0, dtype=np.float64)
        totals += np.add.reduceat(held, at, dtype=np.int64)
    return sums, totals


def in_parts(column: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """The letter codes of one long text, some at a time, each with the two that follow it, and how many are its own."""
    data, _ = text_bytes(column)
    for low in range(0, len(data), SLICE_BYTES):
        # From the first character that begins at low to that at the next part, and two more.
        begin, end = (p + int(np.argmax((data[p : p + 4] & 0xC0) != 0x80)) if p < len(data) else len(data) for p in (low, low + SLICE_BYTES))
        stop = min(len(data), end + 12)
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        codes, _ = letters(pa.array([data[begin:stop].tobytes().decode("utf-8", "replace")], pa.large_string()))
        own = int(((data[begin:end] & 0xC0) != 0x80).sum())
        yield codes[: own + 2], own


def score(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities of each text, and whether it has a letter; a long text is read in parts."""
    sums, totals, lettered = np.zeros((len(column), len(model.languages))), np.zeros(len(column)), np.zeros(len(column), bool)
    for low, high in rows_by_size(column):
        rows = column.slice(low, high - low)
        if high - low > 1 or (pc.binary_length(rows)[0].as_py() or 0) <= SLICE_BYTES:
            codes, at = letters(rows)
            sums[low:high], totals[low:high] = summed(model, codes, at[:-1])
            lettered[low:high] = np.logical_or.reduceat(codes != 0, at[:-1])
            continue
        for codes, own in in_parts(rows):
            s, n = summed(model, codes, np.array([0, own]))
            sums[low] += s[0]
            totals[low] += n[0]
            lettered[low] |= bool(codes[:own].any())
    x = (sums / np.maximum(totals, 1)[:, None] + model.bias) / model.temperature
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), lettered


def named(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language, its probability) of each text; ``und`` with 0 where there is no letter or no language was learned."""
    if not model.languages or not len(column):
        return np.full(len(column), UNKNOWN, object), np.zeros(len(column))
    p, any_letter = score(model, column)
    names = np.array([*model.languages, UNKNOWN], object)
    return names[np.where(any_letter, p.argmax(1), len(model.languages))], np.where(any_letter, p.max(1), 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``und`` with score 0 where the text is null or has no letter.

    Repeated rows and null ids are predicted like any other; with no language learned every row is ``und``.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, top = named(shipped.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(top, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def remove_unidentified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that are ``und`` or whose language is less probable than ``least``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            lang, top = named(shipped.value, batch.column(text_col))
            yield batch.filter(pa.array((lang != UNKNOWN) & (top >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, mod 5, is 0 (a null id too)."""
    return F.coalesce(fold_of(id_col, 5) == 0, F.lit(True))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on the rows that aren't held out, predicted for all."""
    model = fit(docs.where(~held_out()), settings)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
