"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct segments of a batch of texts are concatenated and indexed by a suffix array (sorted to the depth of the
longest piece); every piece of the vocabulary is binary-searched for the range of its occurrences; the occurrences
are edges, sorted by where they end inside their segment, and relaxed in that order. Of the edges that end at a
position exactly one can be the last piece of the prefix's encoding: the one that may follow the piece before it,
which is so if merging the two pieces' characters by priority gives back these two pieces. No piece joins a
non-space to a following space, nor holds a character outside the vocabulary, so segments encode independently.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import pieces_at, slices, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
#: Text bytes whose distinct segments are encoded together, and bytes of these that one suffix array indexes.
WINDOW_BYTES = 8 << 20
INDEX_BYTES = 1 << 20
NONE, START = -1, -2


@dataclass
class Vocabulary:
    """A BPE model in the form that encoding needs; a token is a piece's place in the order of merging, single characters first."""

    pieces: list[str]
    ids: np.ndarray  # of each token
    strings: list[str]  # of each token, with a space for the word mark
    left: np.ndarray  # the two tokens whose merge made a token; itself for a single character
    right: np.ndarray
    pair_keys: np.ndarray  # sorted left * V + right of all pairs that may merge, and what they make
    pair_tokens: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece
    run_scores: dict[int, tuple[float, int]]  # length of a run of spaces: score and id of its piece
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0))
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0))  # code points of each token, padded with 0
    _bytes: pa.Array | None = field(default=None, repr=False, compare=False)

    @property
    def size(self) -> int:
        return len(self.strings)

    def bytes_of_ids(self) -> pa.Array:
        """What each id decodes to."""
        if self._bytes is None:
            value = dict.fromkeys(range(len(self.pieces)), b"")
            value |= {int(i): p.encode() for i, p in zip(self.ids, self.strings, strict=True)} | {i: b" " * n for n, (_, i) in self.run_scores.items()} | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
            self._bytes = pa.array([value[i] for i in range(len(self.pieces))], pa.large_binary())
        return self._bytes


def merge(chars: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """The pieces that merging leaves (best rank first, leftmost among equals), and the last pair merged."""
    out, last = list(chars), None
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(out, out[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            return out, last
        i = best[1]
        last = (out[i], out[i + 1])
        out[i : i + 2] = [out[i] + out[i + 1]]


@cache
def load(path: str = MODEL) -> Vocabulary:
    """Reads a model file on the driver; its tables, a few MB, are broadcast."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    plain = {p.replace(META, " "): i for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    runs = {len(p): (sp.get_score(i), i) for p, i in plain.items() if len(p) > 1 and not p.strip(" ")}
    plain = {p: i for p, i in plain.items() if len(p) == 1 or p.strip(" ")}
    if any(" " in p[1:] for p in plain):
        raise ValueError("a piece holds a space after another character: segments would not encode independently")
    order = sorted(plain, key=lambda p: (len(p) > 1, -sp.get_score(plain[p])))
    rank = {p: r for r, p in enumerate(order) if len(p) > 1}
    token: dict[str, int] = {}
    left, right = [], []
    for p in order:
        if len(p) == 1:
            token[p] = len(token)
            left.append(token[p])
            right.append(token[p])
            continue
        whole, pair = merge(list(p), rank)
        if whole == [p] and pair[0] in token and pair[1] in token:  # else it never comes out of encoding
            token[p] = len(token)
            left.append(token[pair[0]])
            right.append(token[pair[1]])
    size = len(token)
    codes = np.zeros((size, max(map(len, token))), np.int64)
    for t, p in enumerate(token):
        codes[t, : len(p)] = [ord(c) for c in p]
    made = sorted((token[p[:i]] * size + token[p[i:]], t) for p, t in token.items() for i in range(1, len(p)) if p[:i] in token and p[i:] in token)
    keys, tokens = np.array(made, np.int64).reshape(-1, 2).T
    return Vocabulary(
        pieces, np.array([plain[p] for p in token], np.int32), list(token), np.array(left), np.array(right), np.ascontiguousarray(keys), np.ascontiguousarray(tokens),
        np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32), runs, np.array([len(p) for p in token]), codes,
    )


class Follows:
    """Whether token b may follow token a in an encoding, remembered for the pairs seen last."""

    BITS = 20

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        if v.size**2 >= 1 << 31:
            raise ValueError("the vocabulary is too large for 32-bit pair keys")
        self.keys = np.full(1 << self.BITS, -1, np.int32)
        self.ok = np.zeros(1 << self.BITS, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * np.int32(self.v.size) + b
        slot = (key.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)
        out = self.ok[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            unknown, back = np.unique(key[miss], return_inverse=True)
            fresh = self.derive((unknown // self.v.size).astype(np.int64), (unknown % self.v.size).astype(np.int64))
            out[miss] = fresh[back]
            self.keys[slot[miss]] = key[miss]
            self.ok[slot[miss]] = out[miss]
        return out

    def derive(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the later of the two last merges, again and again; false once the parts at the seam would have merged sooner."""
        v, n = self.v, len(a)
        a, b, limit = a.copy(), b.copy(), np.full(len(a), v.size, np.int64)
        out, live = np.ones(n, bool), np.arange(n)
        while len(live):
            x, y = a[live], b[live]
            key = x * v.size + y
            at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
            wrong = (v.pair_keys[at] == key) & (v.pair_tokens[at] < limit[live])
            out[live[wrong]] = False
            live, x, y = live[~wrong], x[~wrong], y[~wrong]
            leaf_x, leaf_y = v.left[x] == x, v.left[y] == y
            go = ~(leaf_x & leaf_y)
            live, x, y, leaf_x, leaf_y = live[go], x[go], y[go], leaf_x[go], leaf_y[go]
            undo_x = ~leaf_x & (leaf_y | (x > y))
            # A merge on the left came before one of equal rank on the right.
            limit[live] = np.where(undo_x, x, y + 1)
            a[live] = np.where(undo_x, v.right[x], x)
            b[live] = np.where(undo_x, y, v.left[y])
        return out


def occurrences(codes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(token, start) of every place where a token's characters stand in codes; codes are code points, 0 between segments."""
    alphabet = np.flatnonzero(np.bincount(codes, minlength=1))
    alphabet = alphabet if alphabet[:1] == 0 else np.concatenate([[0], alphabet])
    width = max(1, int(len(alphabet)).bit_length())
    number = np.zeros(max(int(alphabet[-1]), int(v.codes.max())) + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    dense = number[codes]
    spelled = number[v.codes]
    tokens = np.flatnonzero(((spelled > 0) | (v.codes == 0)).all(1))
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spelled, size = spelled[tokens], v.lengths[tokens]
    depth = int(size.max())
    per = 64 // width
    words = -(-depth // per)
    n = len(dense)
    padded = np.concatenate([dense, np.zeros(words * per + per, dense.dtype)]).astype(np.uint64)
    word = np.zeros(n + words * per, np.uint64)
    for k in range(per):
        word = (word << np.uint64(width)) | padded[k : k + len(word)]
    order = np.argsort(word[:n])
    head = word[order]
    if words > 1:  # suffixes that agree in the first word are sorted by the following ones
        same = head[1:] == head[:-1]
        tie = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at = np.flatnonzero(tie)
        rows = order[at]
        order[at] = rows[np.lexsort([*(word[rows + k * per] for k in range(words - 1, 0, -1)), head[at]])]
    low, high = np.zeros((words, len(tokens)), np.uint64), np.zeros((words, len(tokens)), np.uint64)
    for k in range(words * per):
        code = spelled[:, k].astype(np.uint64) if k < spelled.shape[1] else np.zeros(len(tokens), np.uint64)
        low[k // per] = (low[k // per] << np.uint64(width)) | code
        high[k // per] = (high[k // per] << np.uint64(width)) | np.where(k < size, code, np.uint64((1 << width) - 1))
    first, last = np.searchsorted(head, low[0]), np.searchsorted(head, high[0], side="right")
    for k in range(1, words):
        deep = np.flatnonzero(size > k * per)
        first[deep] = bounds(word, order, first[deep], last[deep], low[: k + 1, deep], per, False)
        last[deep] = bounds(word, order, first[deep], last[deep], high[: k + 1, deep], per, True)
    count = last - first
    where = np.repeat((first - (np.cumsum(count) - count)).astype(np.int32), count) + np.arange(int(count.sum()), dtype=np.int32)
    return np.repeat(tokens.astype(np.int32), count), order.astype(np.int32)[where]


def bounds(word: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, per: int, after: bool) -> np.ndarray:
    """Binary search, for all columns of key at once, among suffixes that agree with it in all words but the last."""
    low, high, k = low.copy(), high.copy(), len(key) - 1
    while (open_ := low < high).any():
        mid = (low + high) // 2
        probe = word[order[np.minimum(mid, len(order) - 1)] + k * per]
        less = (probe <= key[k]) if after else (probe < key[k])
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def run_of_spaces(v: Vocabulary, n: int) -> list[int]:
    """Ids for n spaces that no other piece took: equal scores merge leftmost first."""
    space = v.strings.index(" ")
    size, after, before = [1] * n, [*range(1, n), NONE], [NONE, *range(n - 1)]
    heap: list[tuple[float, int, int, int]] = []

    def push(i: int) -> None:
        if i != NONE and after[i] != NONE and (found := v.run_scores.get(size[i] + size[after[i]])):
            heapq.heappush(heap, (-found[0], i, size[i], size[after[i]]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if size[i] != a or j == NONE or size[j] != b:
            continue
        size[i], size[j], after[i] = a + b, 0, after[j]
        if after[i] != NONE:
            before[after[i]] = i
        push(before[i])
        push(i)
    return [v.run_scores[s][1] if s > 1 else int(v.ids[space]) for s in size if s]


def encode_segments(segments: list[str], v: Vocabulary, follows: Follows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lists of ids in a row, number of ids in each list, the list of each segment)."""
    known = {p for p in v.strings if len(p) == 1}
    spaces = np.zeros(len(segments), np.int64)
    core = []
    for i, s in enumerate(segments):
        if s[:2] == "  ":
            bare = s.lstrip(" ")
            spaces[i] = len(s) - len(bare) - (1 if bare else 0)
            s = " " + bare if bare else ""
        core.append(s)
    odd = [i for i, s in enumerate(core) if len(s) == 1 and s not in known]
    special = {i: core[i] for i in odd}
    for i in odd:
        core[i] = ""
    codes = np.frombuffer(("\0".join(core) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, core), np.int64, len(core))
    start = np.cumsum(size + 1) - (size + 1)
    token, at = occurrences(codes, v)
    depth = np.arange(len(codes), dtype=np.int32) - np.repeat(start.astype(np.int32), size + 1)
    end = at + v.lengths.astype(np.int32)[token]
    reach = depth[end]
    order = np.argsort(reach.astype(np.uint16), kind="stable") if len(reach) and reach.max() < 1 << 16 else np.argsort(reach, kind="stable")
    token, at, end = token[order], at[order], end[order]
    last = np.full(len(codes), NONE, np.int32)
    last[start] = START
    steps = np.cumsum(np.bincount(reach, minlength=1)) if len(reach) else np.zeros(1, np.int64)
    for low, high in zip(steps, steps[1:], strict=False):
        t, e, before = token[low:high], end[low:high], last[at[low:high]]
        inner = np.flatnonzero(before >= 0)
        fits = inner[follows(before[inner], t[inner])]
        last[e[fits]] = t[fits]
        opening = before == START
        last[e[opening]] = t[opening]
    # Back from each segment's end.
    owners, tokens = [], []
    own = np.flatnonzero(size > 0)
    position = (start + size)[own]
    while len(own):
        t = last[position]
        owners.append(own)
        tokens.append(t)
        position = position - v.lengths[t]
        go = position > start[own]
        own, position = own[go], position[go]
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    back = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
    order = np.argsort(owner[::-1], kind="stable")
    ids, count = v.ids[back[::-1][order]], np.bincount(owner, minlength=len(segments))
    # Runs of spaces and characters outside the vocabulary: few distinct ones, put at the end.
    place, more, more_count = np.arange(len(segments)), [ids], [count]
    begin = np.cumsum(count) - count
    space = int(v.ids[v.strings.index(" ")])
    for i in sorted({*special, *np.flatnonzero(spaces).tolist()}):
        own = v.byte_ids[list(special[i].encode())] if i in special else ids[begin[i] : begin[i] + count[i]]
        if spaces[i]:
            lone = len(own) > 0 and own[0] == space
            own = np.concatenate([run_of_spaces(v, int(spaces[i]) + lone), own[1:] if lone else own]).astype(np.int32)
        place[i] = len(segments) + len(more) - 1
        more.append(own)
        more_count.append([len(own)])
    return np.concatenate(more), np.concatenate(more_count).astype(np.int64), place


def segment(column: pa.Array, v: Vocabulary) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the segments of all texts in a row, the n + 1 places where the texts begin in them); null and empty texts have none."""
    text = pc.replace_substring(pc.fill_null(column, "").cast(pa.large_string()), META, " ")
    text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
    data, offsets = text_bytes(text)
    if not len(data):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(len(column) + 1, np.int64)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = (data & 0xC0) != 0x80
    known = np.zeros(max(int(codes.max()) + 1, 33), bool)
    singles = v.codes[v.lengths == 1, 0]
    known[singles[singles < len(known)]] = True
    held, blank = known[codes], codes == 32
    opens = ~held
    opens[1:] |= ~held[:-1] | (blank[1:] & ~blank[:-1])
    opens[np.cumsum(leads)[offsets[:-1][np.diff(offsets) > 0]] - 1] = True
    first = np.flatnonzero(leads)[opens]
    ends = np.append(first, len(data)).astype(np.int32)
    segments = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return segments.dictionary_encode(), np.searchsorted(first, offsets)


def encode(columns: list[pa.Array], v: Vocabulary, follows: Follows | None = None) -> list[pa.ListArray]:
    """Token ids of the texts of each column; segments that several columns hold are encoded once."""
    cut = [segment(c, v) for c in columns]
    chunks = pa.chunked_array([d for d, _ in cut]).unify_dictionaries().chunks
    distinct = max((c.dictionary for c in chunks), key=len)
    follows = follows or Follows(v)
    ends = np.cumsum(np.asarray(pc.binary_length(distinct)).astype(np.int64)) if len(distinct) else np.zeros(0, np.int64)
    ids, count, place, low, lists = [], [], [], 0, 0
    while low < len(distinct):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + INDEX_BYTES, side="right")))
        i, c, p = encode_segments(distinct.slice(low, high - low).to_pylist(), v, follows)
        ids.append(i)
        count.append(c)
        place.append(p + lists)
        low, lists = high, lists + len(c)
    flat_ids, counts = np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([*count, np.zeros(0, np.int64)])
    where_of = np.concatenate([*place, np.zeros(0, np.int64)])
    table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat_ids, pa.int32()))
    out = []
    for chunk, (_, begins) in zip(chunks, cut, strict=True):
        where = where_of[chunk.indices.to_numpy()]
        tokens = np.concatenate([[0], np.cumsum(counts[where])])
        out.append(pa.ListArray.from_arrays(pa.array(tokens[begins], pa.int32()), pc.list_flatten(table.take(pa.array(where)))))
    return out


def encode_long(column: pa.Array, v: Vocabulary, follows: Follows) -> pa.ListArray:
    """Token ids of one long text, encoded in parts that begin at a single space between words, where segments do too."""
    data, _ = text_bytes(pc.replace_substring(column.cast(pa.large_string()), META, " "))
    space = data == 32
    alone = np.flatnonzero(space[1:-1] & ~space[:-2] & ~space[2:]) + 1
    ids = []
    for low, high in pieces_at(data, alone):
        begin = low + (low > 0)  # that space comes back as the one that opens a text
        ids.append(encode([pa.array([data[begin:high].tobytes().decode("utf-8")], pa.large_string())], v, follows)[0].values)
    flat = pa.concat_arrays(ids)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def decode(ids: pa.ListArray, v: Vocabulary) -> pa.Array:
    """The texts of lists of ids: pieces in a row, byte pieces as their bytes, without the first word's mark."""
    flat = v.bytes_of_ids().take(ids.flatten())
    if not len(flat):
        return pa.array([""] * len(ids), pa.large_string())
    data = flat.buffers()[2]
    ends = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1]
    bounds_ = ends[np.asarray(ids.offsets).astype(np.int64) - ids.offsets[0].as_py()]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    filled = np.flatnonzero(np.diff(bounds_) > 0)
    marks = filled[raw[bounds_[filled]] == 32]
    keep = np.ones(bounds_[-1], bool)
    keep[bounds_[marks]] = False
    gone = np.zeros(len(bounds_), np.int64)
    gone[marks + 1] = 1
    text = np.ascontiguousarray(raw[: bounds_[-1]][keep])
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds_ - np.cumsum(gone)), pa.py_buffer(text)])
    return whole.cast(pa.large_string())


def encode_documents(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row.

    round_trip says whether decoding gives the text back (the word mark itself comes back as a space). Null and empty
    texts have no tokens and are their own round trip; repeated rows, null ids and extra columns change nothing.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(load(model))

    def emit(window: list[pa.RecordBatch], v: Vocabulary, follows: Follows) -> Iterator[pa.RecordBatch]:
        long = len(window) == 1 and window[0].num_rows == 1 and window[0].column("text").nbytes > WINDOW_BYTES
        found = [encode_long(window[0].column("text"), v, follows)] if long else encode([b.column("text") for b in window], v, follows)
        for batch, ids in zip(window, found, strict=True):
            wanted = pc.replace_substring(pc.fill_null(batch.column("text"), "").cast(pa.large_string()), META, " ")
            same = pc.equal(decode(ids, v), wanted)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.list_value_length(ids), ids, same], names=["doc_id", "n_tokens", "ids", "round_trip"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.value
        follows, window, size = Follows(v), [], 0
        for batch in slices(batches):
            own = batch.column("text").nbytes
            if window and own > WINDOW_BYTES:
                yield from emit(window, v, follows)
                window, size = [], 0
            window.append(batch)
            size += own
            if size >= WINDOW_BYTES:
                yield from emit(window, v, follows)
                window, size = [], 0
        if window:
            yield from emit(window, v, follows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens int, ids array<int>, round_trip boolean")


def decode_documents(tokens: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with lists of ids; a null list is an empty text."""
    shipped = tokens.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([x or [] for x in batch.column("ids").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decode(lists, shipped.value).cast(pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
