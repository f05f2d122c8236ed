"""Lexical search: corpus statistics, BM25 with field boosts, passages, filters, and the plain tf-idf variant."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

K1, B = 1.2, 0.75
TITLE_BOOST, TAG_BOOST, PHRASE_BONUS = 10.0, 5.0, 15.0


@dataclass(frozen=True)
class SearchQuery:
    term: str = ""
    category: str = ""
    client: str = ""
    project: str = ""
    status: str = ""
    tags: tuple[str, ...] = field(default=())
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.limit <= 200 or not 0 <= self.offset <= 1_000_000 or len(self.term.encode("utf-16-le")) // 2 > 2000:
            raise ValueError("invalid search query or pagination")


def query_terms(spark: SparkSession, term: str) -> list[str]:
    """The distinct tokens of a query, sorted."""
    # Over a literal row, so the planner folds it and no job runs.
    return spark.sql("SELECT * FROM VALUES (1)").select(F.array_sort(F.array_distinct(T.tokens(F.lit(term))))).collect()[0][0]


def index(docs: DataFrame) -> DataFrame:
    """docs with their tokens (title and text; title and tags also apart), the length and a hash of the text."""
    tokens = {"tokens": T.tokens(F.concat_ws(" ", "title", "text")), "title_tokens": T.tokens(F.col("title")), "tag_tokens": T.tokens(F.array_join("tags", " "))}
    return docs.withColumns({**tokens, "sha256": F.sha2("text", 256)}).withColumn("length", F.size("tokens"))


def corpus_stats(indexed: DataFrame) -> DataFrame:
    """n and avgdl, over all documents, whatever filters follow."""
    return indexed.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("avgdl"))


def document_frequencies(indexed: DataFrame) -> DataFrame:
    return indexed.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def occurrences(tokens: str, term: str) -> Column:
    return F.size(F.filter(F.col(tokens), lambda t: t == term)).cast("double")


def term_stats(indexed: DataFrame, terms: list[str]) -> DataFrame:
    """One row: n, avgdl and the document frequency of each term."""
    return indexed.agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("avgdl"),
        *(F.count_if(F.array_contains("tokens", t)).alias(f"df{i}") for i, t in enumerate(terms)),
    )


def idf(i: int) -> Column:
    return F.log((F.col("n") + 1) / (F.col(f"df{i}") + 1)) + 1


def filters(q: SearchQuery) -> Column:
    """The conditions of a query; an empty one holds for all documents, every tag must be there."""
    keep = F.lit(True)
    if q.category:
        keep = keep & (F.col("category") == q.category)
    for name, value in (("client", q.client), ("project", q.project), ("status", q.status)):
        if value:
            keep = keep & (T.fold(F.coalesce(F.col(name), F.lit(""))) == T.fold(F.lit(value)))
    for tag in q.tags:
        keep = keep & F.array_contains(F.transform("tags", T.fold), T.fold(F.lit(tag)))
    return keep


def bm25(indexed: DataFrame, q: SearchQuery, terms: list[str], boosts: bool = True) -> DataFrame:
    """Documents with a score over 0; statistics come from all of indexed, so filters don't move them."""
    score: Column = F.lit(0.0)
    norm = K1 * (1 - B + B * F.col("length") / F.col("avgdl"))
    for i, t in enumerate(terms):
        tf = occurrences("tokens", t)
        score = score + F.when(tf > 0, idf(i) * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
        if boosts:
            score = score + F.when(F.array_contains("title_tokens", t), TITLE_BOOST).otherwise(0.0)
            score = score + F.when(F.array_contains("tag_tokens", t), TAG_BOOST).otherwise(0.0)
    kept = indexed.where(filters(q)).crossJoin(F.broadcast(term_stats(indexed, terms)))
    return kept.withColumn("raw", score).where("raw > 0").withColumn("score", T.cents(F.col("raw")))


def top(scored: DataFrame, q: SearchQuery, *columns: str) -> DataFrame:
    """A page of results by score, then the newest where rows have updated_at, then path."""
    newest = [F.desc_nulls_last("updated_at")] if "updated_at" in scored.columns else []
    return scored.orderBy(F.desc("score"), *newest, "path").offset(q.offset).limit(q.limit).select(*columns, "score")


def first_of_each(scores: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, rank, score): the first ``limit`` of each query, by score and id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "doc_id", "rank", "score")


def search(indexed: DataFrame, q: SearchQuery, *columns: str) -> DataFrame:
    """Without a term all documents score 1; a term without tokens finds nothing."""
    terms = query_terms(indexed.sparkSession, q.term)
    if not q.term.strip():
        return top(indexed.where(filters(q)).withColumn("score", F.lit(1.0)), q, *columns)
    if not terms:
        return top(indexed.withColumn("score", F.lit(1.0)).limit(0), q, *columns)
    return top(bm25(indexed, q, terms), q, *columns)


def tfidf(indexed: DataFrame, q: SearchQuery, terms: list[str]) -> DataFrame:
    """Plain tf times idf, without length normalisation or boosts."""
    score: Column = F.lit(0.0)
    for i, t in enumerate(terms):
        score = score + occurrences("tokens", t) * idf(i)
    kept = indexed.where(filters(q)).crossJoin(F.broadcast(term_stats(indexed, terms)))
    return kept.withColumn("raw", score).where("raw > 0").withColumn("score", T.cents(F.col("raw")))


def score_passages(passages: DataFrame, term: str, terms: list[str]) -> DataFrame:
    """Passages with a score over 0: tf times the idf of documents, and a bonus where the whole term stands as words."""
    tokens = passages.withColumn("tokens", T.tokens(F.col("text")))
    stats = tokens.groupBy("document_id").agg(*(F.max(F.array_contains("tokens", t).cast("int")).alias(f"has{i}") for i, t in enumerate(terms)))
    stats = stats.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"has{i}").alias(f"df{i}") for i in range(len(terms))))
    score: Column = F.lit(0.0)
    for i, t in enumerate(terms):
        score = score + occurrences("tokens", t) * idf(i)
    score = score + F.when(T.contains_whole_words(T.fold(F.col("text")), T.fold(F.lit(term))), PHRASE_BONUS).otherwise(0.0)
    return tokens.crossJoin(F.broadcast(stats)).withColumn("raw", score).where("raw > 0").withColumn("score", T.cents(F.col("raw")))


def best_passage(scored: DataFrame) -> DataFrame:
    """The passage of each document that scores most; the first of equals."""
    best = F.max_by(F.struct("passage_id", "locator", "score"), F.struct(F.col("raw"), -F.col("position"))).alias("b")
    return scored.groupBy("document_id").agg(best).select("document_id", "b.passage_id", "b.locator", "b.score")


def ranked_passages(passages: DataFrame, term: str, terms: list[str], stats: DataFrame) -> DataFrame:
    """Per document: its matching passages by rounded score (equal ones in their order), and the best one by the unrounded score.

    stats is one row: n and the document frequency of each term. A passage scores tf times idf, and a bonus where the
    whole term stands as words. A document's own passages are gathered, those that match.
    """
    tokens = passages.withColumn("tokens", T.tokens(F.col("text"))).crossJoin(F.broadcast(stats))
    score: Column = F.lit(0.0)
    for i, t in enumerate(terms):
        score = score + occurrences("tokens", t) * idf(i)
    score = score + F.when(T.contains_whole_words(T.fold(F.col("text")), T.fold(F.lit(term))), PHRASE_BONUS).otherwise(0.0)
    hits = tokens.withColumn("raw", F.round(score, 9)).where("raw > 0").withColumns({"score": T.cents(F.col("raw")), "snippet": T.snippet(F.col("text"), terms)})
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "position", "passage_id", "locator", "snippet", "score")))
    best = F.max_by(F.struct("passage_id", "locator", "snippet", "raw"), F.struct(F.col("raw"), -F.col("position")))
    return hits.groupBy("document_id").agg(listed.alias("passages"), best.alias("best"))


def page(documents: DataFrame, passages: DataFrame, q: SearchQuery) -> DataFrame:
    """A whole lexical query over documents (index() of them) and their passages: filters, BM25 with boosts, the best
    passage's score where the document itself has none, the snippet of the best passage or else of the text, and a page
    by score, then the newest, then path."""
    terms = query_terms(documents.sparkSession, q.term)
    if q.term.strip() and not terms:
        return documents.limit(0).select("document_id", "path", "updated_at", F.lit(0.0).alias("score"), F.lit("").alias("snippet"), F.lit("").alias("matching_passage_id"), F.lit("").alias("matching_locator"), F.array().cast("array<string>").alias("passages"))
    stats = term_stats(documents, terms)
    if terms:
        raw: Column = F.lit(0.0)
        norm = K1 * (1 - B + B * F.col("length") / F.col("avgdl"))
        for i, t in enumerate(terms):
            tf = occurrences("tokens", t)
            raw = raw + F.when(tf > 0, idf(i) * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
            raw = raw + F.when(F.array_contains("title_tokens", t), TITLE_BOOST).otherwise(0.0) + F.when(F.array_contains("tag_tokens", t), TAG_BOOST).otherwise(0.0)
    else:
        raw = F.lit(1.0)
    kept = documents.where(filters(q)).crossJoin(F.broadcast(stats)).withColumn("raw", raw)
    found = kept.join(ranked_passages(passages, q.term, terms, stats), "document_id", "left")
    found = found.withColumn("raw", F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.coalesce("best.raw", F.lit(0.0)))).where("raw > 0")
    found = found.withColumns({"score": T.cents(F.round("raw", 9)), "snippet": F.coalesce("best.snippet", T.snippet(F.substring(F.col("text"), 1, 500), terms))})
    found = found.withColumns({"matching_passage_id": F.col("best.passage_id"), "matching_locator": F.col("best.locator"), "passages": F.coalesce(F.transform("passages", lambda p: p["passage_id"]), F.array().cast("array<string>"))})
    return top(found, q, "document_id", "path", "updated_at", "snippet", "matching_passage_id", "matching_locator", "passages")
