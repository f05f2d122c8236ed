"""Retrieval quality: recall, first hits, ties, percentiles, word overlap and corpus diversity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.functions import text as T
from folioscope.sources.shared import cut


def recall(hits: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, relevant, found, recall): the share of relevant documents among the hits; 1 where none is relevant."""
    total = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    found = hits.join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    out = queries.select("query_id").join(total, "query_id", "left").join(found, "query_id", "left").fillna(0, ["relevant", "found"])
    return out.withColumn("recall", F.round(F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")).otherwise(1.0), 4))


def recall_by_path(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, relevant, found): of rows (query_id, target), how many a hit (query_id, id, path) has as its id or in its path."""
    matched = hits.join(relevant, "query_id").where((F.col("id") == F.col("target")) | F.contains("path", F.col("target")))
    found = matched.groupBy("query_id").agg(F.count_distinct("target").alias("found"))
    total = relevant.groupBy("query_id").agg(F.count_distinct("target").alias("relevant"))
    return total.join(found, "query_id", "left").fillna(0, ["found"])


#: Characters of items in one automaton, some 50 bytes of a task's memory each; more items are searched for in blocks.
AUTOMATON_CHARACTERS = 4_000_000


def containing(docs: DataFrame, items: DataFrame, most: int = AUTOMATON_CHARACTERS) -> DataFrame:
    """(query_id, doc_id) of documents (doc_id, text) that hold the text of an item (query_id, text); an empty item is in every text.

    An automaton over a block of items reads every document once. Blocks are dealt by hash to a bounded size and come to the
    driver one at a time. Null texts and null items hold nothing. The pairs are kept, so that no later step reads the documents again.
    """
    total = items.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // most) or 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return cut(reduce(DataFrame.unionByName, [_held(docs, items.where(block == k).select("query_id", "text")) for k in range(blocks)]))


def _held(docs: DataFrame, items: DataFrame) -> DataFrame:
    listed = items.toArrow()
    ids: dict[str, list] = {}
    for query, text in zip(listed.column("query_id").to_pylist(), listed.column("text").to_pylist(), strict=True):
        if text is not None:
            ids.setdefault(text, []).append(query)
    shipped = docs.sparkSession.sparkContext.broadcast(ids)
    schema = StructType([*items.select("query_id").schema.fields, *docs.select("doc_id").schema.fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        made, everywhere = ahocorasick.Automaton(), shipped.value.get("", [])
        for text in shipped.value:
            if text:
                made.add_word(text, text)
        if len(made):
            made.make_automaton()
        kinds = {f.name: f for f in listed.schema}
        for batch in batches:
            queries, numbers = [], []
            for number, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None:
                    continue
                held = everywhere + [q for item in {found for _, found in (made.iter(text) if len(made) else ())} for q in shipped.value[item]]
                queries += held
                numbers += [number] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array(queries, kinds["query_id"].type), pa.array(numbers, batch.column("doc_id").type)], names=["query_id", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(search, schema)


def first_hits(hits: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, first_rank, hit1, hit10): the rank of the first relevant hit, null without one."""
    ranks = hits.join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    out = queries.select("query_id").join(ranks, "query_id", "left")
    return out.withColumns({"hit1": F.coalesce((F.col("first_rank") == 1).cast("int"), F.lit(0)), "hit10": F.coalesce((F.col("first_rank") <= 10).cast("int"), F.lit(0))})


def ties_at_top(hits: DataFrame) -> DataFrame:
    """(query_id, tied): how many hits score what the first does, to within 1e-4."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    return hits.join(best, "query_id").groupBy("query_id").agg(F.count_if(F.abs(F.col("score") - F.col("top")) < 1e-4).alias("tied"))


def tie_statistics(hits: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries, hits at 1 (apparent precision), queries tied at 1, hits at 1 without a tie (net precision), the largest tie."""
    first = first_hits(hits, relevant, queries).select("query_id", "hit1")
    joined = first.join(ties_at_top(hits), "query_id", "left").fillna(0, ["tied"])
    strict = (F.col("hit1") == 1) & (F.col("tied") < 2)
    return joined.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("hit1").alias("hits_at_1"), F.count_if(F.col("tied") >= 2).alias("ties_at_1"), F.count_if(strict).alias("strict_hits_at_1"),
        F.max(F.when(F.col("tied") >= 2, F.col("tied")).otherwise(1)).alias("largest_tie"),
    )


def repeated_rows(hits: DataFrame, by: str, what: str) -> DataFrame:
    """(by, repeated): how many of a query's rows repeat another's value."""
    return hits.groupBy(by).agg((F.count(F.lit(1)) - F.count_distinct(what)).alias("repeated"))


def diversity(items: DataFrame, identifier: str, text: str, most: float = 0.3) -> DataFrame:
    """One row over all pairs of items: their number, mean and greatest Jaccard, and how many are over ``most``.

    Pairs that share no word count as 0 and are never formed.
    """
    n = items.agg(F.count(F.lit(1)).alias("n"))
    shared = jaccard_pairs(items, identifier, text).agg(F.coalesce(F.sum("jaccard"), F.lit(0.0)).alias("total"), F.coalesce(F.max("jaccard"), F.lit(0.0)).alias("greatest"), F.count_if(F.col("jaccard") > most).alias("violations"))
    pairs = F.expr("n * (n - 1) div 2")
    return n.crossJoin(shared).select(pairs.alias("pairs"), F.round(F.when(pairs > 0, F.col("total") / pairs).otherwise(0.0), 4).alias("mean"), "greatest", "violations")


def recalls_of_ways(both: DataFrame, ways: dict[str, tuple[str, float | None, Column]], relevant: DataFrame, queries: DataFrame, first: int = 10) -> DataFrame:
    """(config, kind, k, recall): the mean recall over queries of each way to score candidates.

    both: (query_id, doc_id, and what the ways read); ways: by name their kind, k and score. A query without a relevant
    document counts as 1. A query's candidates are ranked together; they are as many as its two sides give.
    """
    scores = F.explode(F.array(*(F.struct(F.lit(name).alias("config"), F.round(score, 6).alias("score")) for name, (_, _, score) in ways.items()))).alias("w")
    ranked = both.select("query_id", "doc_id", scores).select("query_id", "doc_id", "w.*")
    order = Window.partitionBy("config", "query_id").orderBy(F.desc("score"), "doc_id")
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    found = top.join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("config", "query_id").agg(F.count(F.lit(1)).alias("found"))
    total = queries.select("query_id").join(relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant")), "query_id", "left")
    named = queries.sparkSession.createDataFrame([(name, kind, k) for name, (kind, k, _) in ways.items()], "config string, kind string, k double")
    each = total.crossJoin(F.broadcast(named)).join(found, ["config", "query_id"], "left")
    share = F.when(F.col("relevant").isNull(), 1.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("relevant"))
    return each.groupBy("config", "kind", "k").agg(F.round(F.avg(share), 4).alias("recall"))


def winner(recalls: DataFrame) -> DataFrame:
    """The configuration (config, kind, k, recall) to take: a lone f1 at the top, else f2 with k = 0.3, 0.2 or the least k, else f3."""
    best = recalls.agg(F.max("recall").alias("best"))
    top = recalls.crossJoin(F.broadcast(best)).where("abs(recall - best) < 1e-6")
    alone = top.agg((F.count(F.lit(1)) == 1).alias("alone"))
    order = (
        F.when((F.col("kind") == "f1") & F.col("alone"), 0).when(F.col("kind") == "f2", F.when(F.col("k") == 0.3, 1).when(F.col("k") == 0.2, 2).otherwise(3))
        .when(F.col("kind") == "f3", 4).otherwise(5)
    )
    return top.crossJoin(F.broadcast(alone)).orderBy(order, "k", "config").limit(1).select("config", "recall")


#: Values among which a rank is found by sorting, and the parts that wider ranges are cut into.
SORTED_VALUES, SPLITS = 10_000, 64


def order_statistics(values: DataFrame, column: str, by: list[str], ranks: DataFrame, few: int = SORTED_VALUES) -> DataFrame:
    """(by, rank, value): the value at each of the ranks (by, rank), from 0, of a group's values in order; nulls are left out.

    Selection by counting: the range in which a rank must lie is cut at approximate quantiles of its values, and the rows between
    the cuts are counted where they lie; the part that holds the rank is the next range, so that the rounds grow with the logarithm
    of a group's size, however its values lie. A range of few values is sorted, one of equal values is done. So a group's values are never gathered, whatever its size, and the result is exact.
    """
    rows = values.select(*by, F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    ends = rows.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    ranges = cut(ranks.join(ends, by).select(*by, "rank", F.lit(0).cast("long").alias("below"), "low", "high", "n"))
    keys = [*by, "low", "high"]
    while ranges.where((F.col("low") < F.col("high")) & (F.col("n") > few)).limit(1).count():
        open_ = ranges.where((F.col("low") < F.col("high")) & (F.col("n") > few))
        inside = rows.join(open_.select(*keys).distinct(), by).where(F.col("x").between(F.col("low"), F.col("high")))
        cuts = inside.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("x", [k / SPLITS for k in range(1, SPLITS)], 20 * SPLITS)).alias("cuts"))
        inside = inside.join(cuts, keys)
        # Values that equal a cut have a cell of their own, so every round leaves fewer.
        cell = (F.size(F.filter("cuts", lambda c: c < F.col("x"))) * 2 + F.array_contains("cuts", F.col("x")).cast("int")).alias("cell")
        cells = inside.groupBy(*keys, cell).agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count(F.lit(1)).alias("size"))
        before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        held = open_.join(placed, keys).where((F.col("below") + F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("size")))
        closer = held.select(*by, "rank", (F.col("below") + F.col("before")).alias("below"), F.col("least").alias("low"), F.col("most").alias("high"), F.col("size").alias("n"))
        ranges = cut(closer.unionByName(ranges.where((F.col("low") >= F.col("high")) | (F.col("n") <= few))))
    done = ranges.where("low = high").select(*by, "rank", F.col("low").alias("value"))
    rest = ranges.where("low < high")
    sorted_ = rows.join(rest.select(*keys).distinct(), by).where(F.col("x").between(F.col("low"), F.col("high"))).groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    picked = rest.join(sorted_, keys).select(*by, "rank", F.element_at("xs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value"))
    return done.unionByName(picked)


def percentiles(values: DataFrame, column: str, by: list[str], few: int = SORTED_VALUES) -> DataFrame:
    """Linear-interpolated percentiles with least, greatest and mean, from exact order statistics."""
    x, wanted = F.col(column).cast("double"), (50, 90, 95, 99)
    # A group's key as one text, which joins match where a part of it is null too.
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    values = values.withColumn("_group", group)
    whole = cut(values.where(x.isNotNull()).groupBy("_group", *by).agg(F.count(F.lit(1)).alias("_n"), F.round(F.min(x), 4).alias("least"), F.round(F.max(x), 4).alias("greatest"), F.round(F.avg(x), 4).alias("mean")))
    place = lambda p: (F.col("_n") - 1) * (p / 100)
    ranks = whole.select("_group", F.explode(F.array_distinct(F.array(*(f(place(p)).cast("long") for p in wanted for f in (F.floor, F.ceil))))).alias("rank"))
    found = order_statistics(values, column, ["_group"], ranks, few).groupBy("_group").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    at = lambda r: F.element_at("_at", r.cast("long"))
    between = lambda p: at(F.floor(place(p))) + (at(F.ceil(place(p))) - at(F.floor(place(p)))) * (place(p) - F.floor(place(p)))
    return whole.join(found, "_group").select(*by, *(F.round(between(p), 4).alias(f"p{p}") for p in wanted), "least", "greatest", "mean")


def jaccard_pairs(items: DataFrame, identifier: str, text: str, least: float = 0.0) -> DataFrame:
    """(a, b, jaccard) of pairs that share a word; the pairs come from an equi-join on words."""
    sets = items.select(F.col(identifier).alias("id"), T.word_set(F.col(text)).alias("words")).withColumn("size", F.size("words"))
    words = sets.select("id", "size", F.explode("words").alias("word"))
    a, b = words.toDF("a", "size_a", "word"), words.toDF("b", "size_b", "word")
    shared = a.join(b, "word").where("a < b").groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("k"))
    value = F.round(F.col("k") / (F.col("size_a") + F.col("size_b") - F.col("k")), 4)
    return shared.select("a", "b", value.alias("jaccard")).where(F.col("jaccard") > least)


def gate(value: Column, least: float, count: Column, least_count: int) -> Column:
    return F.when((value >= least) & (count >= least_count), "PASS").otherwise("FAIL")


def latency_gate(p95: Column, documents: Column, passages: Column) -> Column:
    """Answers within a second, over enough documents and passages to mean something."""
    return F.when((documents >= 1000) & (passages >= 10_000) & (p95 <= 1000.0), "PASS").otherwise("FAIL")


def verdict(mean: Column) -> Column:
    """What the mean recall of the semantic side alone says."""
    return F.when(mean >= 0.85, "fusion").when(mean <= 0.7, "model").otherwise("mixed")


def compared(now: DataFrame, before: DataFrame, on: str, value: str) -> DataFrame:
    both = now.select(on, F.col(value).alias("now")).join(before.select(on, F.col(value).alias("before")), on)
    return both.withColumn("change", F.when(F.col("now") > F.col("before"), "IMPROVED").when(F.col("now") < F.col("before"), "DEGRADED").otherwise("SAME"))


def ranks(scored: DataFrame, by: str, score: str, tie: str) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)))
