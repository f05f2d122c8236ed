"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of at most ``words`` words. Each passage is described by how its characters follow
each other and its words repeat, encoded by a learned layer, weighted by learned gated attention
(softmax of w . (tanh(V h) * sigmoid(U h))), and the weighted sum of the encodings is scored. Only documents carry
labels; the passages' weights are learned from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import SLICE_BYTES, cut, fold_of, mix, pieces_at, rows_by_size, slices, text_bytes


@dataclass(frozen=True)
class Settings:
    #: Words of a passage.
    words: int = 50
    hidden: int = 16
    attention: int = 8
    #: Labelled documents of each class that the weights are fitted on, chosen by a hash of the id.
    fit_rows: int = 1500
    #: Bytes of text of each class that the weights are fitted on at most, in the order of that hash; a text of more than
    #: a sixteenth of it is not fitted on. The features that reach the driver are about twice as large for words of usual
    #: length, and under seven times for words of one letter.
    fit_bytes: int = 32 << 20
    steps: int = 400
    rate: float = 0.02
    decay: float = 1e-4


#: Character classes: fixed values that describe the input, by first byte in UTF-8; continuation bytes have none.
CLASSES = ("space", "newline", "lower", "upper", "digit", "stop", "comma", "exclamation", "bar", "symbol", "bracket", "other letter")
N = len(CLASSES)
WIDTH = N + N * N + 6


def class_table() -> np.ndarray:
    out = np.full(256, N - 1, np.int64)
    out[0x80:0xC0] = -1
    for i in range(128):
        c = chr(i)
        name = (
            "newline" if c in "\n\r" else "space" if c.isspace() or i < 32 else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit()
            else "stop" if c in ".?:;" else "comma" if c in ",'\"-" else "exclamation" if c == "!" else "bar" if c == "|" else "bracket" if c in "()[]{}<>" else "symbol"
        )
        out[i] = CLASSES.index(name)
    return out


TABLE = class_table()
WHITE = np.isin(TABLE, [0, 1])


def passages(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages of each text); a text without words is one passage of zeros."""
    data, offsets = text_bytes(column)
    n = len(column)
    white = WHITE[data]
    fresh = np.zeros(len(data), bool)  # where a text begins
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    begins = ~white & (fresh | np.concatenate([[True], white[:-1]]) if len(data) else white)
    starts = np.flatnonzero(begins)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    per_text = np.bincount(owner[starts], minlength=n)
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    bags = np.maximum(1, -(-per_text // words))
    first = np.cumsum(bags) - bags
    of_word = first[owner[starts]] + nth // words
    total = int(bags.sum())
    # The passage of every byte: that of the last word begun, or the text's first.
    opens = np.zeros(len(data), np.int64)
    if len(starts):
        opens[starts] = 1
        begun = np.cumsum(opens)
        before = np.concatenate([[0], np.cumsum(per_text)])[owner]
        of_byte = np.where(begun > before, of_word[np.maximum(begun - 1, 0)], first[owner])
    else:
        of_byte = first[owner]
    kind = TABLE[data]
    keep = np.flatnonzero(kind >= 0)
    kind, bag = kind[keep], of_byte[keep]
    one = np.bincount(bag * N + kind, minlength=total * N).reshape(total, N).astype(np.float64)
    pair = kind[:-1] * N + kind[1:]
    same = bag[:-1] == bag[1:]
    two = np.bincount(bag[:-1][same] * (N * N) + pair[same], minlength=total * N * N).reshape(total, N * N)
    size = np.maximum(one.sum(1), 1)
    # Words: their number and length, and how often one equals the one or two before it.
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    powers = np.multiply.accumulate(np.full(len(data), 0x9E3779B97F4A7C15 | 1, np.uint64)) if len(data) else np.zeros(0, np.uint64)
    hashed = np.where(white, np.uint64(0), mix(data.astype(np.uint64) + np.uint64(1)))
    word = np.zeros(len(starts), np.uint64)
    if len(starts):
        at = np.arange(len(data)) - starts[np.maximum(np.cumsum(opens) - 1, 0)]
        word = np.add.reduceat(hashed * powers[np.clip(at, 0, None)], starts)
    count = np.bincount(of_word, minlength=total).astype(np.float64) if len(starts) else np.zeros(total)

    def rate(step: int) -> np.ndarray:
        hit = (word[step:] == word[:-step]) & (of_word[step:] == of_word[:-step]) if len(word) > step else np.zeros(0, bool)
        return np.bincount(of_word[step:][hit], minlength=total) / np.maximum(count, 1)

    length = np.bincount(of_word, weights=np.minimum(ends - starts, 40), minlength=total) / np.maximum(count, 1) if len(starts) else np.zeros(total)
    extra = np.stack([rate(1), rate(2), length / 10, np.log1p(count) / 4, one[:, 3] / np.maximum(one[:, 2] + one[:, 3], 1), np.log1p(size / np.maximum(count, 1)) / 3], 1)
    return np.hstack([one / size[:, None], two / size[:, None], extra]), bags


def features(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    x, bags = passages(column, words)
    x[:, : N + N * N] = np.sqrt(x[:, : N + N * N])
    return x, bags


def parts_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The features of one text's passages, some at a time: a long text is cut where a passage begins."""
    data, _ = text_bytes(column)
    white = WHITE[data]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]])) if len(data) else np.zeros(0, np.int64)
    for low, high in pieces_at(data, starts[words::words]):
        piece = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, high - low], np.int64)), pa.py_buffer(np.ascontiguousarray(data[low:high])))
        yield features(piece, words)[0]


@dataclass
class Model:
    settings: Settings
    p: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each bag."""
        return 1 / (1 + np.exp(-forward(self.p, (x - self.mean) / self.spread, bags)["logit"]))

    def score_texts(self, column: pa.Array) -> np.ndarray:
        """The same of each text. A long one is read in parts, whose attention sums are put on one scale and added."""
        out = np.zeros(len(column))
        for low, high in rows_by_size(column):
            rows = column.slice(low, high - low)
            if high - low > 1 or (pc.binary_length(rows)[0].as_py() or 0) <= SLICE_BYTES:
                out[low:high] = self.score(*features(rows, self.settings.words))
                continue
            top, weight, total = -np.inf, 0.0, np.zeros(self.settings.hidden)
            for x in parts_of(rows, self.settings.words):
                h, e = encoded(self.p, (x - self.mean) / self.spread)[:2]
                now = max(top, float(e.max()))
                own = np.exp(e - now)
                total, weight, top = total * np.exp(top - now) + own @ h, weight * np.exp(top - now) + own.sum(), now
            out[low] = 1 / (1 + np.exp(-np.clip(total / weight @ self.p["c"] + self.p["d"], -30, 30)))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def encoded(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(encodings, attention before the softmax, its two gates) of passages."""
    h = np.tanh(x @ p["W"].astype(x.dtype, copy=False) + p["b"])
    t, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    return h, (t * u) @ p["w"], t, u


def forward(p: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.cumsum(bags) - bags
    own = np.repeat(np.arange(len(bags)), bags)
    h, e, t, u = encoded(p, x)
    e = np.exp(e - np.maximum.reduceat(e, starts)[own])
    a = e / np.add.reduceat(e, starts)[own]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"starts": starts, "own": own, "h": h, "t": t, "u": u, "a": a, "z": z, "logit": np.clip(z @ p["c"] + p["d"], -30, 30)}


def backward(p: dict[str, np.ndarray], x: np.ndarray, f: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean loss; error: probability minus label, of each bag, over the number of bags."""
    own, h, t, u, a = f["own"], f["h"], f["t"], f["u"], f["a"]
    dz = error[:, None] * p["c"]
    da = (dz[own] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, f["starts"])[own])
    dt, du = de[:, None] * p["w"] * u * (1 - t * t), de[:, None] * p["w"] * t * u * (1 - u)
    dh = a[:, None] * dz[own] + dt @ p["V"].T + du @ p["U"].T
    dpre = dh * (1 - h * h)
    return {"W": x.T @ dpre.astype(x.dtype, copy=False), "b": dpre.sum(0), "V": h.T @ dt, "U": h.T @ du, "w": (t * u).T @ de, "c": f["z"].T @ error, "d": error.sum()}


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """Adam on all bags at once; classes weigh alike whatever their numbers."""
    rng = np.random.default_rng(11)
    mean, spread = x.mean(0), x.std(0) + 0.05
    # As four-byte floats throughout: products with longer ones would copy all features at every step.
    x = x.astype(np.float32)
    x -= mean
    x /= spread
    p = {
        "W": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], s.hidden)), "b": np.zeros(s.hidden), "V": rng.normal(0, 0.3, (s.hidden, s.attention)),
        "U": rng.normal(0, 0.3, (s.hidden, s.attention)), "w": rng.normal(0, 0.3, s.attention), "c": rng.normal(0, 0.3, s.hidden), "d": np.zeros(()),
    }
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, s.steps + 1):
        f = forward(p, x, bags)
        g = backward(p, x, f, (sigmoid(f["logit"]) - y) * share)
        for k in p:
            grad = g[k] + s.decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            p[k] = p[k] - s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(s, p, mean, spread)


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, label, text) that a model is fitted on: whole texts, at most fit_rows and fit_bytes of each class.

    They are drawn by a hash of their ids; an id that occurs several times is learned once, with its least text.
    Labels other than 0 and 1, or null, are passed over.
    """
    draw = F.xxhash64(F.lit("fit"), F.col(id_col).cast("string"))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"), draw.alias("draw"))
    chosen = None
    for k in (0, 1):
        part = known.where(F.col("label") == k).orderBy("draw", "doc_id").limit(s.fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.distinct()), "doc_id")
    rows = cut(rows.groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text")))
    # Ids and sizes of at most fit_rows documents a class pass through the window, not their texts.
    sizes = rows.select("doc_id", "label", "draw", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).where(F.col("size") * 16 <= s.fit_bytes)
    so_far = F.sum("size").over(Window.partitionBy("label").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= s.fit_bytes)
    return rows.join(F.broadcast(kept.select("doc_id", "label")), ["doc_id", "label"], "left_semi").select("doc_id", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the labels of docs, from training_rows(). Only the ids of these are broadcast, and only the features of
    their passages reach the driver; fit_bytes bounds them."""
    s = settings
    rows = training_rows(docs, labels, s, id_col, text_col, label_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, bags = features(batch.column("text"), s.words)
            flat = pa.array(x.astype(np.float32).ravel(), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(bags)]) * WIDTH, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], names=["doc_id", "label", "x"])

    def gathered() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        found = rows.mapInArrow(extract, "doc_id long, label int, x array<float>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
        # Features stay arrays of four-byte floats: as Python numbers they would take the driver's memory many times over.
        xs = [np.asarray(c.flatten()).reshape(-1, WIDTH) for c in found["x"].chunks if len(c)]
        sizes = np.array(pc.list_value_length(found["x"]).to_pylist(), np.int64) // WIDTH
        return [np.vstack(xs)] if xs else [], sizes, found["label"].to_numpy().astype(float)

    xs, sizes, y = gathered()
    pa.default_memory_pool().release_unused()
    if not xs:
        return Model(s, {"W": np.zeros((WIDTH, s.hidden)), "b": np.zeros(s.hidden), "V": np.zeros((s.hidden, s.attention)), "U": np.zeros((s.hidden, s.attention)), "w": np.zeros(s.attention), "c": np.zeros(s.hidden), "d": np.zeros(())}, np.zeros(WIDTH), np.ones(WIDTH))
    return train(xs.pop(), sizes, y, s)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row from its text alone; null and empty texts are scored as a blank passage."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in slices(batches):
            p = model.score_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def remove_poor(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score below ``least``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            p = shipped.value.score_texts(batch.column(text_col))
            yield batch.filter(pa.array(p >= least))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned: crc32 of the id as text, mod 3, is 1 (false for a null id, which has no label)."""
    return F.coalesce(fold_of(id_col, 3) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), learn_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs; learn_from: where the labelled texts are, docs itself by default."""
    model = fit(docs if learn_from is None else learn_from, labels.where(~held_out()), settings)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
