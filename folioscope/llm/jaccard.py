"""N-gram Jaccard join: a size-aware heavy-light set similarity join over distinct word shingles.

Equal sets are one class; classes are joined. If two sets are similar enough, then in any common order of the
shingles their beginnings (of a length that follows from the size) share an element, and slightly longer beginnings
share c of them. Small (light) sets therefore emit all c-subsets of such a beginning as keys, which are rare; large
(heavy) sets post the single elements and scan the inverted lists of those. The boundary is the size at which a set's
subsets cost more than its lists, from the exact numbers of sets of each size and the measured length of lists.
Shingles that many documents hold come last in the order, so they become keys only of sets made of little else.

Candidates are verified exactly on the whole sets. In a first pass every set of a list is verified against one pivot
of the list; sets that this has joined need no further comparison among themselves, so a group of near copies costs
its size and not its square. A second pass verifies all pairs of a list that are still in different components and
that the sizes and positions allow. Shingles and classes are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import SLICE_BYTES, cut, joined_by_count, mix, pieces_at, slices, stored, text_bytes
from folioscope.llm.components import connected_components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Percent: linked if 100 * intersection >= percent * union.
    percent: int = 75
    #: Size of the subsets that light sets emit.
    subset: int = 2
    #: Shingles found in so many different sets among ``window`` shingles read in a row are counted; the ``frequent`` most found come last.
    often: int = 2
    frequent: int = 400_000
    window: int = 1 << 21
    #: Shingles that a task counts at once, the most frequent ones.
    counted: int = 1 << 20


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)


def inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in a row, number of words of each text)."""
    data, offsets = text_bytes(column)
    n = len(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    if n == 1 and len(data) > 2 * SLICE_BYTES:  # a long text, in parts that begin between words
        hashes = np.concatenate([hashes_of(data[low:high], np.array([0, high - low]))[0] for low, high in pieces_at(data, np.flatnonzero(WHITE[data]))])
        return hashes, np.array([len(hashes)])
    return hashes_of(data, offsets)


def hashes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    white = WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~white
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], white[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([white[1:], [True]]))) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data] + np.uint64(1)) * powers(int(BASE), len(data) - 1), out=sums[1:])
    back = powers(inverse(int(BASE)), len(data))
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=n)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in a row, number of each text); a text of fewer words is one shingle."""
    hashes, count = word_hashes(column)
    n = len(column)
    first = np.cumsum(count) - count
    number = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n), number)
    at = np.repeat(first, number) + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    size = np.minimum(count, words)[owner]
    h = np.full(len(at), 0x51ED270B, np.uint64) + size.astype(np.uint64)
    for k in range(words):
        h = np.where(k < size, mix(h * BASE + padded[at + k]), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, np.bincount(owner, minlength=n)


def class_keys(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + BASE))])
    ends = np.cumsum(number)
    return mix((sums[ends] - sums[ends - number]) + mix(number.astype(np.uint64) + np.uint64(1))).view(np.int64)


def describe(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, cls, shingle, often): a row per document, and rows with only shingle and often for frequent shingles."""

    names = ["doc_id", "n", "cls", "shingle", "often"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting, classes, size = [], [], 0

        def count() -> None:
            nonlocal value, times, waiting, classes, size
            h, cls = np.concatenate([w[0] for w in waiting]), np.concatenate(classes)
            number = np.concatenate([w[1] for w in waiting])
            # Copies of a text tell nothing about how many different sets hold a shingle.
            pick = np.zeros(len(cls), bool)
            pick[np.unique(cls, return_index=True)[1]] = True
            here, found = np.unique(h[np.repeat(pick, number)], return_counts=True)
            kept = found >= s.often
            value, back = np.unique(np.concatenate([value, here[kept]]), return_inverse=True)
            times = np.bincount(back, np.concatenate([times, found[kept]]), len(value)).astype(np.int64)
            if len(value) > s.counted:
                top = np.sort(np.argpartition(times, -s.counted // 2)[-s.counted // 2 :])
                value, times = value[top], times[top]
            waiting, classes, size = [], [], 0

        for batch in slices(batches):
            h, number = shingle_sets(batch.column("text"), s.words)
            cls = class_keys(h, number)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(number, pa.int64()), pa.array(cls, pa.int64()), none, none], names=names)
            waiting.append((h, number))
            classes.append(cls)
            size += len(h)
            if size >= s.window:
                count()
        if waiting:
            count()
        if len(value):
            none = pa.nulls(len(value), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(value.view(np.int64)), pa.array(times)], names=names)

    return docs.mapInArrow(run, "doc_id long, n long, cls long, shingle long, often long")


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The elements that a set of n must share with any set it is linked to."""
    return -(-percent * n // 100)


def boundary(sizes: dict[int, int], scan: float, s: Settings) -> int:
    """The largest light size: the one under which subsets of light sets and lists of heavy ones cost least together."""
    if not sizes:
        return 0
    n = np.array(sorted(sizes), np.int64)
    count = np.array([sizes[k] for k in n.tolist()], np.float64)
    free = n - least_overlap(n, s.percent)
    subsets = count * (free + s.subset) * (free + s.subset - 1) / 2
    lists = count * (free + 1) * (1 + scan)
    best, at = lists.sum(), 0
    for x in n[n <= 400].tolist():
        # Sets just below the boundary are also posted for the heavy sets above it.
        cost = subsets[n <= x].sum() + lists[n * 100 > x * s.percent].sum()
        if cost < best:
            best, at = cost, x
    return int(at)


def postings(docs: DataFrame, hot: np.ndarray, light: int, s: Settings) -> DataFrame:
    """(key, cls, nr): keys of every set, with its size n and the r elements left from the key on, as n << 32 | r."""
    shipped = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shipped.value  # by rising frequency
        by_value = np.argsort(hot)
        sorted_hot = hot[by_value]
        seen: set[int] = set()
        for batch in slices(batches):
            h, number = shingle_sets(batch.column("text"), s.words)
            cls = class_keys(h, number)
            new = np.array([c not in seen and not seen.add(c) for c in cls.tolist()], bool)
            if len(seen) > 1 << 17:
                seen.clear()
            h, cls, number = h[np.repeat(new, number)], cls[new], number[new]
            owner = np.repeat(np.arange(len(cls)), number)
            rank = h >> np.uint64(1)
            if len(hot):
                at = np.minimum(np.searchsorted(sorted_hot, h), len(hot) - 1)
                rank = np.where(sorted_hot[at] == h, np.uint64(1 << 63) + by_value[at].astype(np.uint64), rank)
            order = np.lexsort((h, rank, owner))
            h = h[order]
            first = np.cumsum(number) - number
            nth = np.arange(len(h)) - first[owner]
            n = number[owner]
            free = n - least_overlap(n, s.percent)
            single = (nth <= free) & (n * 100 > light * s.percent)
            out_key, out_own, out_left = [mix(h[single])], [owner[single]], [(n - nth)[single]]
            # Pairs of the beginning of a light set: element i with each later one.
            pairs = (n <= light) & (nth < free + s.subset) & (n >= s.subset)
            reach = np.minimum(free + s.subset, n)
            step = 1
            while True:
                pairs = pairs & (nth + step < reach)
                at = np.flatnonzero(pairs)
                if not len(at):
                    break
                out_key.append(mix(mix(h[at]) * BASE + h[at + step]))
                out_own.append(owner[at])
                out_left.append((n - nth)[at])
                step += 1
            key, own, left = np.concatenate(out_key), np.concatenate(out_own), np.concatenate(out_left)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls[own]), pa.array(number[own] << 32 | left)], names=["key", "cls", "nr"])

    return docs.mapInArrow(run, "key long, cls long, nr long")


def hopeless(opens: np.ndarray, nr: np.ndarray, percent: int, carried: bool) -> np.ndarray:
    """Postings of lists of two, whole in a batch, whose sets are too different in size ever to be linked."""
    number = np.cumsum(opens) - 1
    size, first = np.bincount(number), np.flatnonzero(opens)
    two = np.flatnonzero(size == 2)
    two = two[(two < len(size) - 1) & ((two > 0) | (not carried))]
    n, m = nr[first[two]] >> 32, nr[first[two] + 1] >> 32
    apart = first[two][100 * np.minimum(n, m) < percent * np.maximum(n, m)]
    out = np.zeros(len(nr), bool)
    out[apart] = out[apart + 1] = True
    return out


def shared_lists(posted: DataFrame, percent: int) -> DataFrame:
    """(key, cls, nr, pivot, pivot_nr) of the postings whose list holds at least two classes; the pivot is the set that
    others are likeliest to be copies of.

    A list is read as a stream: only its first posting and the one last read are held. Lists of two sets that their
    sizes keep apart are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last posting, with its list's pivot, and whether it is known to have company
        for batch in batches:
            key, cls, nr = (np.asarray(batch.column(c)) for c in ("key", "cls", "nr"))
            if not len(key):
                continue
            if held is not None:
                key, cls, nr = (np.concatenate([[x], y]) for x, y in zip(held[:3], (key, cls, nr), strict=True))
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, nr = key[fresh], cls[fresh], nr[fresh]
            opens = np.ones(len(key), bool)
            opens[1:] = key[1:] != key[:-1]
            at = np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))
            pivot, pivot_nr = cls[at], nr[at]
            if held is not None:
                same = at == 0
                pivot[same], pivot_nr[same] = held[3], held[4]
            company = ~opens
            company[:-1] |= ~opens[1:]
            if held is not None and held[5]:
                company[0] = True
            out = company & ~hopeless(opens, nr, percent, held is not None)
            out[-1] = False  # waits for the next batch
            held = (key[-1], cls[-1], nr[-1], pivot[-1], pivot_nr[-1], bool(company[-1]))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, cls, nr, pivot, pivot_nr)], names=["key", "cls", "nr", "pivot", "pivot_nr"])
        if held is not None and held[5]:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held[:5]], names=["key", "cls", "nr", "pivot", "pivot_nr"])

    # First the set for which the key comes earliest: one with few shingles of its own, such as the original of copies.
    place = F.expr("1 - (nr & 4294967295) / shiftright(nr, 32)")
    return posted.repartition("key").sortWithinPartitions("key", place, "cls").mapInArrow(run, "key long, cls long, nr long, pivot long, pivot_nr long")


def enough(shared, n, m, percent: int):
    """Whether that many shared elements link sets of n and m: their union is n + m - shared."""
    return shared * (100 + percent) >= percent * (n + m)


def in_place(nr: str, other: str, percent: int):
    """Whether a link is possible by sizes, and by what both sets have left if the key is the first that they share."""
    n, m = F.shiftright(nr, 32), F.shiftright(other, 32)
    left = F.least(F.col(nr).bitwiseAND(0xFFFFFFFF), F.col(other).bitwiseAND(0xFFFFFFFF))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & enough(left, n, m, percent)


def plausible(pairs: DataFrame, lists: DataFrame, light: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b, n, m) that the number of keys they share, counted in lists, allows.

    The set whose beginning ends earlier in the common order shares all it can before that end in posted keys, so the
    intersection is at most their number and what the set has after its beginning. That holds for heavy sets, which
    post single elements. A set's own keys are gathered, at most as many as it posted.
    """
    keys = lists.groupBy("cls").agg(F.collect_list("key").alias("keys"))
    both = pairs.join(keys.withColumnsRenamed({"cls": "a", "keys": "x"}), "a").join(keys.withColumnsRenamed({"cls": "b", "keys": "y"}), "b")
    after = F.expr(f"(greatest(n, m) * {percent} + 99) div 100 - 1")
    by_count = enough(F.size(F.array_intersect("x", "y")) + after, F.col("n"), F.col("m"), percent)
    return both.where((F.least("n", "m") <= light) | by_count).select("a", "b")


def membership_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit table of bounded size (8 MB at most) that holds all ids and lets others pass seldom."""
    words = 1 << int(np.clip(np.ceil(np.log2(max(1, ids.count()) / 4 + 1)), 10, 20))
    h = F.xxhash64(F.col(column))
    bits = ids.select(F.pmod(h, F.lit(words)).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({column}), 32), 64) as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(words, np.int64)
    for row in bits.collect():
        out[row["w"]] = row["bits"]
    return out


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """Those of the pairs (a, b) of classes that are linked, by the exact intersection of their whole sets."""
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    ids = cut(reps.join(wanted, "cls", "left_semi").select("doc_id"))
    shipped = docs.sparkSession.sparkContext.broadcast(membership_filter(ids, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            h = np.asarray(batch.column("h"))
            hit = (table[h % len(table)] >> ((h >> 32) % 64)) & 1
            for part in slices([batch.filter(pa.array(hit == 1))]):
                values, number = shingle_sets(part.column("text"), s.words)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(class_keys(values, number)), lists], names=["doc_id", "cls", "items"])

    sets = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "doc_id long, cls long, items array<long>")
    sets = sets.select("cls", "items")
    both = pairs.join(sets.withColumnsRenamed({"cls": "a", "items": "x"}), "a").join(sets.withColumnsRenamed({"cls": "b", "items": "y"}), "b")
    shared = F.size(F.array_intersect("x", "y"))
    # A text that the bit table let pass beside its class's first one gives the same pair again.
    return both.where(shared * (100 + s.percent) >= s.percent * (F.size("x") + F.size("y"))).select("a", "b").distinct()


def most_found(described: DataFrame, most: int) -> pa.Table:
    """(shingle, often), rising, of the shingles found most, as many as share a count and number ``most`` at most together."""
    counted = cut(described.where("shingle is not null").groupBy("shingle").agg(F.sum("often").alias("often")))
    total, least = 0, None
    for row in counted.groupBy("often").count().orderBy(F.desc("often")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["often"]
    return counted.where(F.col("often") >= least if least is not None else F.lit(False)).toArrow().sort_by([("often", "ascending"), ("shingle", "ascending")])


def similarity_components(documents: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    component_id is the least id that links lead to. Rows without words have size 0 and stand alone; so do rows with a
    null id, whose component is null. Repeated rows repeat; an empty table gives no rows.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = cut(describe(docs, s))
    rows = described.where("shingle is null").select("doc_id", "n", "cls")
    classes = cut(rows.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")))
    hot = most_found(described, s.frequent)
    sizes = {r["n"]: r["count"] for r in classes.groupBy("n").count().collect()}
    elements = sum(n * c for n, c in sizes.items())
    # Other sets that a posting meets: at most a few, as shingles with long lists come last.
    scan = min(3.0, float((hot["often"].to_numpy().astype(float) ** 2).sum() / max(1, elements)))
    light = boundary(sizes, scan, s)
    rising = hot["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    lists = stored(shared_lists(postings(docs.where("doc_id is not null"), rising, light, s), s.percent))
    size = lambda c: F.shiftright(c, 32)
    to_pivot = lists.where((F.col("cls") != F.col("pivot")) & in_place("nr", "pivot_nr", s.percent))
    to_pivot = to_pivot.select(F.col("cls").alias("a"), F.col("pivot").alias("b"), size("nr").alias("n"), size("pivot_nr").alias("m")).distinct()
    to_pivot = cut(plausible(to_pivot, lists, light, s.percent))
    found = cut(verified(docs, classes, to_pivot, s))
    labels = cut(connected_components(found))
    # Lists that still hold several components: their pairs across components.
    labelled = lists.select("key", "cls", "nr").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    one_list = Window.partitionBy("key")
    mixed = labelled.withColumns({"lo": F.min("label").over(one_list), "hi": F.max("label").over(one_list)}).where("lo <> hi")
    open_ = stored(mixed.select("key", "cls", "nr", "label"))
    x, y = open_.withColumnsRenamed({"cls": "a", "nr": "nr_a", "label": "label_a"}), open_.withColumnsRenamed({"cls": "b", "nr": "nr_b", "label": "label_b"})
    across = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & in_place("nr_a", "nr_b", s.percent))
    across = plausible(across.select("a", "b", size("nr_a").alias("n"), size("nr_b").alias("m")).distinct(), open_, light, s.percent)
    across = across.join(to_pivot.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    links = cut(found.unionByName(verified(docs, classes, across, s)))
    labels = connected_components(links).withColumnRenamed("node", "cls")
    placed = cut(classes.join(labels, "cls", "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label")))
    roots = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_class = joined_by_count(placed.select("cls", "label"), roots, "label").select("cls", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return rows.join(of_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), component)


def one_of_each_group(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group: that of the least id. Rows with a null id stand alone and stay."""
    groups = similarity_components(docs, s, id_col, text_col)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col)).distinct()
    return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
