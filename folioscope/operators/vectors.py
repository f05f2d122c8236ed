"""Dense vectors: cosine similarity, the best passage of a document, coverage of a cache, and fusion with lexical scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.sources.shared import with_rank

#: Similarities up to this don't count; weight of the weaker side in fusion; bonuses for a literal match.
THRESHOLD, K, CODE_BONUS, WORD_BONUS = 0.25, 0.2, 0.2, 0.05


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, or a norm is next to nothing."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 1e-7), dot(a, b) / norm).otherwise(0.0)


def similarities(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """vectors with their similarity to one query vector, rounded to four decimals."""
    return vectors.withColumn("similarity", F.round(cosine(F.col(column), F.array(*(F.lit(float(x)) for x in query))), 4))


def similarities_of_each(vectors: DataFrame, queries: DataFrame, column: str = "embedding") -> DataFrame:
    """(query_id, and vectors' columns, similarity) of every vector and each of a stated set of queries (query_id, vector); the queries, which
    a caller bounds, are broadcast, and pairs at or below the threshold go at once."""
    pairs = vectors.crossJoin(F.broadcast(queries.select("query_id", "vector")))
    return pairs.withColumn("similarity", F.round(cosine(F.col(column), F.col("vector")), 4)).drop("vector").where(F.col("similarity") > THRESHOLD)


def scaled_by(both: DataFrame, by: str) -> DataFrame:
    """both with l and s as scaled() has them, between the least and greatest of each ``by``."""
    lex, sem = (F.coalesce(c, F.lit(0.0)) for c in ("lex", "sem"))
    bounds = both.groupBy(by).agg(F.min(lex).alias("min_lex"), F.max(lex).alias("max_lex"), F.min(sem).alias("min_sem"), F.max(sem).alias("max_sem"))
    return both.join(bounds, by).withColumns({"l": normalised("lex", "min_lex", "max_lex"), "s": normalised("sem", "min_sem", "max_sem")}).drop("min_lex", "max_lex", "min_sem", "max_sem")


def fresh(passages: DataFrame, cache: DataFrame) -> DataFrame:
    """Passages with their cached vectors, where the text is still the one embedded."""
    return passages.join(cache, ["passage_id", "sha256"])


def coverage(passages: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: passages, those with a fresh vector, those without, the share (1 if there are none), and whether any is there."""
    flagged = passages.join(cache.select("passage_id", "sha256", F.lit(1).alias("hit")), ["passage_id", "sha256"], "left")
    total, cached = F.count(F.lit(1)), F.count("hit")
    return flagged.agg(
        total.alias("total"), cached.alias("cached"), (total - cached).alias("missing"), F.round(F.when(total > 0, cached / total).otherwise(1.0), 4).alias("ratio"), (cached > 0).alias("available"),
    )


def best_of_document(scored: DataFrame, document: str, passage: str) -> DataFrame:
    """(document, passage, similarity): the most similar passage, the first of equals; none at or below the threshold."""
    best = F.max_by(F.struct(passage, "similarity"), F.struct(F.col("similarity"), -F.col(passage))).alias("b")
    return scored.groupBy(document).agg(best).select(document, f"b.{passage}", "b.similarity").where(F.col("similarity") > THRESHOLD)


def coalesced(lexical: DataFrame, semantic: DataFrame, on: str) -> DataFrame:
    """Every candidate of either side once, with lex and sem, null where it has none."""
    return lexical.join(semantic, on, "full_outer")


def normalised(x: str, lo: str, hi: str) -> Column:
    """Between the least and the greatest; where these are one, 1 for what is over 0. A missing side counts as 0."""
    v = F.coalesce(F.col(x), F.lit(0.0))
    return F.when(F.col(hi) > F.col(lo), (v - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(F.when(v > 0, 1.0).otherwise(0.0))


def scaled(both: DataFrame) -> DataFrame:
    """both with l and s, its sides between their least and greatest, and max_lex and max_sem: one row of bounds is broadcast."""
    lex, sem = (F.coalesce(c, F.lit(0.0)) for c in ("lex", "sem"))
    bounds = both.agg(F.min(lex).alias("min_lex"), F.max(lex).alias("max_lex"), F.min(sem).alias("min_sem"), F.max(sem).alias("max_sem"))
    joined = both.crossJoin(F.broadcast(bounds))
    return joined.withColumns({"l": normalised("lex", "min_lex", "max_lex"), "s": normalised("sem", "min_sem", "max_sem")}).drop("min_lex", "min_sem")


def with_ranks(both: DataFrame, on: str) -> DataFrame:
    """both with rank_lex and rank_sem, the place on each side; null where it has none."""
    out = both
    for c in ("lex", "sem"):
        out = out.join(with_rank(both.where(F.col(c).isNotNull()).select(on, c), [F.desc(c), F.col(on)], f"rank_{c}").drop(c), on, "left")
    return out


def reciprocal(rank: str) -> Column:
    return F.coalesce(1 / (60 + F.col(rank)), F.lit(0.0))


def f2(k: float = K) -> Column:
    """The stronger side, and k of the weaker one."""
    return F.greatest("l", "s") + k * F.least("l", "s")


def f3() -> Column:
    """The one side that is there, or the mean of both."""
    return F.when(F.col("lex").isNull(), F.col("s")).when(F.col("sem").isNull(), F.col("l")).otherwise((F.col("l") + F.col("s")) / 2)


def fused(both: DataFrame, on: str) -> DataFrame:
    """both with its sides scaled, ranked and fused in the ways compared: f1 mean, f2 stronger plus K of weaker, f3 single or mean, rrf."""
    out = with_ranks(scaled(both), on)
    return out.withColumns({
        "f1": F.round((F.col("l") + F.col("s")) / 2, 6), "f2": F.round(f2(), 6), "f3": F.round(f3(), 6),
        "rrf": F.round(reciprocal("rank_lex") + reciprocal("rank_sem"), 6),
    })


def max_ratio() -> Column:
    """Half of each side's share of its greatest."""
    share = lambda x, most: F.when(F.col(most) > 0, F.coalesce(x, F.lit(0.0)) / F.col(most)).otherwise(0.0)
    return 0.5 * share("lex", "max_lex") + 0.5 * share("sem", "max_sem")


def literal_match(term: str, title: Column, snippet: Column) -> Column:
    """Whether title or snippet hold the term as typed, but for case; accents count."""
    found = F.contains(F.lower(title), F.lit(term.lower())) | F.contains(F.lower(snippet), F.lit(term.lower()))
    return F.coalesce(found, F.lit(False))


def literal_bonus(term: str, title: Column, snippet: Column, exact: bool) -> Column:
    """More for a code than for a word that title or snippet hold as typed."""
    return F.when(literal_match(term, title, snippet), CODE_BONUS if exact else WORD_BONUS).otherwise(0.0)


def hybrid(lexical: DataFrame, semantic: DataFrame | None, on: str, term: str, exact: bool, limit: int = 50, offset: int = 0) -> DataFrame:
    """A whole hybrid query: a page of (on, lex, sem, score) by fused score, then id.

    lexical: candidates (on, lex, title, snippet), at most a search's 200; semantic: (on, sem, title, snippet), those
    over the threshold, or None where there is no vector or no term, for which the lexical order stands.
    """
    if semantic is None or not term.strip():
        page = lexical.withColumns({"sem": F.lit(None).cast("double"), "score": F.col("lex")})
        return page.orderBy(F.desc("score"), on).offset(offset).limit(limit).select(on, "lex", "sem", "score")
    sides = lexical.withColumnsRenamed({"title": "title_l", "snippet": "snippet_l"}).join(semantic.withColumnsRenamed({"title": "title_s", "snippet": "snippet_s"}), on, "full_outer")
    title, snippet = F.coalesce("title_l", "title_s"), F.coalesce("snippet_l", "snippet_s")
    score = F.round(f2() + literal_bonus(term, F.col("title"), F.col("snippet"), exact), 6)
    out = scaled(sides.select(on, "lex", "sem", title.alias("title"), snippet.alias("snippet"))).withColumn("score", score)
    return out.orderBy(F.desc("score"), on).offset(offset).limit(limit).select(on, "lex", "sem", "score")


def to_embed(passages: DataFrame, cache: DataFrame, model: str, dimensions: int) -> DataFrame:
    """passage_id of passages whose vector is missing, or is of another text, model or size."""
    held = cache.where((F.col("model") == model) & (F.col("dimensions") == dimensions) & (F.size("vector") == dimensions))
    same = held.select("passage_id", "sha256", "embedded_text_sha256")
    return passages.join(same, ["passage_id", "sha256", "embedded_text_sha256"], "left_anti").select("passage_id")


#: Turns texts into as many vectors: a call to a local or remote model.
Embedder = Callable[[list[str]], list[list[float]]]


def synced(passages: DataFrame, cache: DataFrame, embed: Embedder, model: str, dimensions: int, size: int = 16) -> DataFrame:
    """The cache after a sync with passages (passage_id, sha256, embedded_text_sha256, embedded_text).

    Entries that are still right stay, those of passages that are gone fall away, and the other passages' texts go to
    ``embed``, ``size`` at a time, on the executors. cache is only read: write the result to a new table and let it
    take the old one's place when it is whole. To go on with a sync, or a change of model, that was cut off, give what it
    had written as cache.
    """
    keys = ["passage_id", "sha256", "embedded_text_sha256"]
    columns = [*keys, "model", "dimensions", "vector"]
    missing = passages.join(to_embed(passages, cache, model, dimensions), "passage_id", "left_semi").select(*keys, "embedded_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                found = embed(part.column("embedded_text").to_pylist())
                if len(found) != part.num_rows or any(len(v) != dimensions for v in found):
                    raise ValueError("vectors of another number or size than asked for")
                rest = [pa.array([model] * len(found)), pa.array([dimensions] * len(found), pa.int32()), pa.array(found, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *rest], names=columns)

    made = missing.mapInArrow(run, "passage_id string, sha256 string, embedded_text_sha256 string, model string, dimensions int, vector array<double>")
    right = cache.where((F.col("model") == model) & (F.col("dimensions") == dimensions) & (F.size("vector") == dimensions))
    kept = right.join(passages.select(*keys), keys, "left_semi").select(*columns[:-1], F.col("vector").cast("array<double>").alias("vector"))
    return kept.unionByName(made)


def stale_entries(cache: DataFrame, passages: DataFrame) -> DataFrame:
    """passage_id of cached vectors whose passage is gone."""
    return cache.select("passage_id").distinct().join(passages.select("passage_id"), "passage_id", "left_anti")


def provider_state(passages: DataFrame, cache: DataFrame, model: str, dimensions: int) -> DataFrame:
    """One row: passages, those with a usable vector, and whether any must be embedded again."""
    missing = to_embed(passages, cache, model, dimensions).withColumn("gone", F.lit(1))
    flagged = passages.join(missing, "passage_id", "left")
    return flagged.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - F.count("gone")).alias("matched"), (F.count("gone") > 0).alias("needs_reindex"))
