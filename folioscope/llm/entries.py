"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, dialogues, dialogues_sql, divergence, htmltext, jaccard, langid, quality, sentencepiece, sharding, tokencount, urlfilter, warc, webp
from folioscope.llm.common import shared_dir, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(table(spark, sf_dir, "documents"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.histogram_shards(table(spark, sf_dir, "documents"))


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.store_and_read(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


#: The rules that the query's contract states.
RULES = [
    urlfilter.Rule("org", "/", urlfilter.ALLOW),
    urlfilter.Rule("example.org", "/es/", urlfilter.BLOCK),
    urlfilter.Rule("example.org", "/en/1", urlfilter.BLOCK),
    urlfilter.Rule("com", "/fr/", urlfilter.ALLOW),
    urlfilter.Rule("com", "/de/", urlfilter.BLOCK),
]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages"))).write.parquet(folder)
    read = warc.read_archives(spark.read.parquet(folder), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair(dialogues.damaged(table(spark, sf_dir, "conversations")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_jaccard": op2_jaccard,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_histogram_sharding": op5_sharding,
    "op6_webp": op6_webp,
    "op7_html": op7_html,
    "op8_urls": op8_urls,
    "op9_warc": op9_warc,
    "op10_decontaminate": op10_decontaminate,
    "op11_dialogues": op11_dialogues,
    "op12_divergence": op12_divergence,
    "op13_token_counts": op13_token_counts,
}

ORACLES: dict[str, str] = {
    "op2_jaccard": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
             items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
             links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
                       GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id
        FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = sets.doc_id
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
             m AS (SELECT d, max(page_id) AS r FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id < r THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < r THEN r END AS refers_to
        FROM p LEFT JOIN m ON p.d = m.d
    """,
    "op11_dialogues": dialogues_sql.SQL,
    "op12_divergence": divergence.ORACLE_SQL,
}
