"""Histogram sort into shards of near-equal bytes, with DataFrame functions only.

The order is (hash of the text, id, row), so equal texts lie together and a group of copies is split only where a
splitter has to fall inside it. Splitters are found by counting, over all rows, the exact bytes below candidate
boundaries and refining those intervals that still hold a target; what reaches the driver per round is at most
``probes`` counts for each open splitter. Rows move once, into ranges of that order, and are numbered by their place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut

#: The parts of a key: the text's hash, the id's upper and lower 32 bits, and the row, which tells repeated rows apart.
KEY = ("h", "upper", "lower", "row")
LEAST = -(1 << 63)
Key = tuple[int, ...]


@dataclass(frozen=True)
class Interval:
    """Keys whose parts before ``level`` equal lo's and whose part there lies in lo to hi; below: bytes of smaller keys."""

    lo: Key
    hi: Key
    below: int

    @property
    def level(self) -> int:
        """The first part that differs; len(KEY) where the interval is one key."""
        return next((i for i, (a, b) in enumerate(zip(self.lo, self.hi, strict=True)) if a != b), len(KEY))

    def holds(self) -> Column:
        at = self.level
        inside = F.col(KEY[at]).between(self.lo[at], self.hi[at])
        return reduce(lambda x, i: x & (F.col(KEY[i]) == self.lo[i]), range(at), inside)

    def probe(self, probes: int) -> Column:
        lo, hi = self.lo[self.level], self.hi[self.level]
        return F.expr(f"({KEY[self.level]} - {lo}L) div {(hi - lo) // probes + 1}L")


def splitters(keyed: DataFrame, shards: int, tolerance: float = 1e-4, probes: int = 1024, rounds: int = 40) -> list[Key]:
    """shards - 1 keys: a row belongs after a splitter if its key is not below it.

    Every cut misses its target by at most tolerance of a shard's bytes, or by one row where that is larger.
    """
    bounds = [f(c) for c in KEY for f in (F.min, F.max)]
    total, *ends = keyed.agg(F.sum("size"), *bounds).first()
    if total is None:
        return []
    goals = {j: j * total / shards for j in range(1, shards)}
    found: dict[int, Key] = {}
    whole = Interval(tuple(ends[::2]), tuple(ends[1::2]), 0)
    if whole.level == len(KEY):
        return [whole.lo] * (shards - 1)
    open_in = {whole: list(goals)}
    for _ in range(rounds):
        if not open_in:
            break
        which, probe = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, interval in enumerate(open_in):
            which = F.when(interval.holds(), i).otherwise(which)
            probe = F.when(interval.holds(), interval.probe(probes)).otherwise(probe)
        counted = keyed.select(which.alias("which"), probe.alias("probe"), *KEY, "size").where(F.col("which").isNotNull()).groupBy("which", "probe").agg(F.sum("size"), *bounds)
        histogram: dict[int, list] = {}
        for row in counted.collect():
            histogram.setdefault(row[0], []).append(tuple(row)[1:])
        deeper: dict[Interval, list[int]] = {}
        for i, (interval, wanted) in enumerate(open_in.items()):
            below, cells = interval.below, []
            for _, size, *ends in sorted(histogram[i]):
                cells.append(Interval(tuple(ends[::2]), tuple(ends[1::2]), below))
                below += size
            stops = [c.below for c in cells[1:]] + [below]
            first = lambda cell, n=interval.level + 1: cell.lo[:n] + (LEAST,) * (len(KEY) - n)
            for j in wanted:
                at = next(n for n, stop in enumerate(stops) if stop >= goals[j])
                cell, after = cells[at], cells[at + 1] if at + 1 < len(cells) else None
                before_miss, after_miss = goals[j] - cell.below, stops[at] - goals[j]
                if cell.level == len(KEY) or min(before_miss, after_miss if after else before_miss) <= tolerance * total / shards:
                    found[j] = first(cell if before_miss <= after_miss or after is None else after)
                else:
                    deeper.setdefault(cell, []).append(j)
        open_in = deeper
    else:
        if open_in:
            raise RuntimeError(f"splitters did not meet their tolerance in {rounds} rounds")
    return [found[j] for j in sorted(found)]


def not_below(key: Key) -> Column:
    out = F.col(KEY[-1]) >= F.lit(key[-1])
    for c, value in list(zip(KEY, key, strict=True))[-2::-1]:
        out = (F.col(c) > F.lit(value)) | ((F.col(c) == F.lit(value)) & out)
    return out


def histogram_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 1e-4) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    A null text counts as empty (size 1, crc32 0); a null id sorts as 0; ids may be any 64-bit number; repeated rows
    are rows of their own, told apart by their place in the table, and may go to several shards; an empty table gives
    no rows; further columns of docs are ignored. Slots run from 0 without gaps in each shard: rows are numbered
    inside ranges of the whole key, which no group of copies or repeats can fill, and only the ranges' row counts are
    added up.
    """
    text, number = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    keyed = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 2).alias("h"), F.shiftright(number, 32).alias("upper"), number.bitwiseAND(0xFFFFFFFF).alias("lower"), F.monotonically_increasing_id().alias("row"),
        )
    )
    shard = reduce(lambda x, key: x + F.when(not_below(key), 1).otherwise(0), splitters(keyed, shards, tolerance), F.lit(0)).cast("int")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ordered = keyed.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    ordered = cut(ordered.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.spark_partition_id().alias("part"), place.alias("place")))
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = ordered.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n")).select("part", "shard", (earlier("shard", "part") - earlier("part", "shard")).alias("first"))
    return ordered.join(F.broadcast(first), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
