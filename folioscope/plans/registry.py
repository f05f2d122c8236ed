"""All queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import chunking as C
from folioscope.functions import text as T
from folioscope.operators import catalog, context, evaluate, release, search, store, vectors, workflow
from folioscope.plans import automation, curation, retrieval  # noqa: F401  (their queries register themselves)
from folioscope.plans import dialect as D
from folioscope.plans.base import ORACLES, QUERIES, TERM, TERMS, docs, files, index_of, labelled, query
from folioscope.sources import vault
from folioscope.sources.shared import cut, new_folder
from folioscope.streaming import ingest

def indexed(s: SparkSession, d: str) -> DataFrame:
    return search.index(docs(s, d))


# --- text ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({D.fold('text')}) AS folded FROM documents")
def fold_text(s, d):
    return docs(s, d).select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


@query(f"SELECT doc_id, sha256({D.strip_markdown('text')}) AS stripped FROM documents")
def strip_markdown(s, d):
    return docs(s, d).select("doc_id", F.sha2(T.strip_markdown(F.col("text")), 256).alias("stripped"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, sha256(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {D.tokens('text')} AS t FROM documents)")
def tokenize(s, d):
    return docs(s, d).select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


@query(rf"SELECT doc_id, regexp_matches({D.fold('text')}, '(^|[^\p{{L}}\p{{N}}])of the($|[^\p{{L}}\p{{N}}])') AS whole, contains({D.fold('text')}, 'of the') AS part FROM documents")
def phrase_whole_word(s, d):
    folded = T.fold(F.col("text"))
    return docs(s, d).select("doc_id", T.contains_whole_words(folded, F.lit("of the")).alias("whole"), F.contains(folded, F.lit("of the")).alias("part"))


@query(f"""WITH a AS (SELECT doc_id, {D.strip_markdown('text')} AS p FROM documents),
    b AS (SELECT doc_id, p, length(p) AS n, CASE WHEN instr({D.fold('p')}, 'thing') > 0 THEN instr({D.fold('p')}, 'thing') - 1 WHEN instr({D.fold('p')}, 'tionble') > 0 THEN instr({D.fold('p')}, 'tionble') - 1 ELSE 0 END AS hit FROM a),
    c AS (SELECT *, CASE WHEN n - greatest(0, hit - 90) < 180 THEN greatest(0, n - 180) ELSE greatest(0, hit - 90) END AS lo FROM b)
    SELECT doc_id, CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(p, lo + 1, 180) || CASE WHEN least(n, lo + 180) < n THEN '...' ELSE '' END AS snippet FROM c""")  # fmt: skip
def snippet(s, d):
    return docs(s, d).select("doc_id", T.snippet(F.col("text"), TERMS).alias("snippet"))


@query(f"WITH {D.DOCS} SELECT doc_id, document_id, substr('doc_' || sha256(path), 1, 20) AS short_id, path FROM docs")
def document_ids(s, d):
    long_id = F.concat(F.lit("doc_"), F.sha2("path", 256))
    return docs(s, d).select("doc_id", "document_id", T.normalize_id(long_id).alias("short_id"), "path")


@query("SELECT part_code AS code, regexp_matches(part_code, '^[A-Za-z0-9_-]{3,}$') AND regexp_matches(part_code, '[-_0-9]') AS exact FROM (SELECT DISTINCT p_brand AS part_code FROM part UNION SELECT DISTINCT lang FROM documents UNION SELECT DISTINCT 'a-' FROM documents)")
def exact_code(s, d):
    codes = vault.read_table(s, d, "part").select(F.col("p_brand").alias("code")).union(vault.read_table(s, d, "documents").select("lang")).union(s.createDataFrame([("a-",)], "code string")).distinct()
    return codes.select("code", T.is_exact_code(F.col("code")).alias("exact"))


@query(f"""WITH {D.DOCS}, c AS (SELECT doc_id, text, substr(array_to_string(list_filter([trim(title), trim(category), 'Paragrafo 1'], lambda x: x <> ''), chr(10)), 1, CAST(floor(length(text) * 0.2) AS INT)) AS context FROM docs)
    SELECT doc_id, sha256(CASE WHEN trim(text) = '' OR context = '' THEN text ELSE context || chr(10) || text END) AS embedded FROM c""")  # fmt: skip
def embed_text(s, d):
    return docs(s, d).select("doc_id", F.sha2(T.embedding_text(F.col("title"), F.col("category"), F.lit("Paragrafo 1"), F.col("text")), 256).alias("embedded"))


@query(r"""WITH x AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' sk-' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 9 + doc_id % 8) WHEN 1 THEN ' bearer  ' || md5(CAST(doc_id AS VARCHAR)) || '.x_y!' ELSE '' END AS t FROM documents)
    SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, 'sk-[A-Za-z0-9_-]{12,}', '[REDACTED_API_KEY]', 'g'), '(?i)bearer\s+[A-Za-z0-9._-]+', 'Bearer [REDACTED_TOKEN]', 'g'),
    'token = "[0-9a-f]{16,}"', 'token = "[REDACTED]"', 'g')) AS redacted FROM x""")  # fmt: skip
def redact_secrets(s, d):
    hashed, k = F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id") % 3
    secret = F.when(k == 0, F.concat(F.lit(" sk-"), F.substring(hashed, F.lit(1), (9 + F.col("doc_id") % 8).cast("int")))).when(k == 1, F.concat(F.lit(" bearer  "), hashed, F.lit(".x_y!"))).otherwise("")
    return docs(s, d).select("doc_id", F.sha2(T.redact(F.concat("text", secret)), 256).alias("redacted"))


@query(r"SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 30) AS slug FROM documents")
def slugs(s, d):
    return docs(s, d).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(r"""SELECT doc_id, CAST((length(f) - length(replace(f, 'the', ''))) / 3 AS BIGINT) AS n FROM (SELECT doc_id, lower(strip_accents(text)) AS f FROM documents)""")
def highlight_counts(s, d):
    return docs(s, d).select("doc_id", F.regexp_count(T.fold(F.col("text")), F.lit("the")).cast("long").alias("n"))


# --- chunks ----------------------------------------------------------------------------------------------------------


@query()
def chunk_passages(s, d):
    return C.chunk_documents(docs(s, d))


FRAGMENTS = """c AS (SELECT doc_id, text, list_transform(range(1, length(text) + 1), lambda k: strlen(substr(text, k, 1))) AS w FROM (SELECT doc_id, text FROM documents WHERE strlen(text) > 0) WHERE strlen(text) > length(text)),
    ends AS (SELECT doc_id, k, sum(b) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS b FROM c)),
    cut AS (SELECT doc_id, CAST(0 AS BIGINT) AS low, CAST(0 AS BIGINT) AS done, CAST(-1 AS INT) AS position FROM c
            UNION ALL SELECT cut.doc_id, max(ends.k), CAST(max(ends.e) AS BIGINT), any_value(cut.position) + 1 FROM cut JOIN ends ON ends.doc_id = cut.doc_id AND ends.e > cut.done AND ends.e <= cut.done + 6000 GROUP BY cut.doc_id, cut.done),
    wide AS (SELECT doc_id, position, substr(text, lag(low, 1, 0) OVER (PARTITION BY doc_id ORDER BY position) + 1, low - lag(low, 1, 0) OVER (PARTITION BY doc_id ORDER BY position)) AS f, position >= 0 AS real FROM cut JOIN c USING (doc_id)),
    fragments AS (SELECT doc_id, CAST(position AS INT) AS position, f FROM wide WHERE real
            UNION ALL SELECT doc_id, CAST(k AS INT), substr(text, k * 6000 + 1, 6000) FROM documents, unnest(range(0, CAST(ceil(length(text) / 6000.0) AS BIGINT))) AS r(k) WHERE strlen(text) = length(text))"""  # fmt: skip


@query(f"WITH RECURSIVE {FRAGMENTS} SELECT doc_id, position, sha256(f) AS fragment FROM fragments")
def fragments(s, d):
    return docs(s, d).select("doc_id", F.posexplode(C.fragments(F.col("text"))).alias("position", "f")).select("doc_id", "position", F.sha2("f", 256).alias("fragment"))


@query("""WITH RECURSIVE o AS (SELECT lang, source, doc_id, CAST(strlen(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents),
    v AS (SELECT lang, source, doc_id, size, k, size AS filled, 0 AS volume FROM o WHERE k = 1
          UNION ALL SELECT o.lang, o.source, o.doc_id, o.size, o.k, CASE WHEN filled > 0 AND filled + o.size > 48000 THEN o.size ELSE filled + o.size END,
                 volume + CASE WHEN filled > 0 AND filled + o.size > 48000 THEN 1 ELSE 0 END FROM v JOIN o ON o.lang = v.lang AND o.source = v.source AND o.k = v.k + 1)
    SELECT lang, source, doc_id, size, volume FROM v""")  # fmt: skip
def wiki_volumes(s, d):
    items = vault.read_table(s, d, "documents").withColumn("size", F.octet_length("text").cast("long"))
    return C.volumes(items, ["lang", "source"], "doc_id", "size")


@query("SELECT lang AS category, source AS client, CAST(count(*) AS BIGINT) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def wiki_groups(s, d):
    return docs(s, d).groupBy("category", "client").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("first_id"))


@query(f"WITH RECURSIVE {FRAGMENTS} SELECT doc_id, sha256(coalesce(string_agg(f, chr(10) ORDER BY position) FILTER (position < 4), '')) AS sample FROM documents LEFT JOIN fragments USING (doc_id) GROUP BY doc_id")
def classification_sample(s, d):
    return docs(s, d).select("doc_id", F.sha2(F.array_join(F.slice(C.fragments(F.col("text")), 1, 4), "\n"), 256).alias("sample"))


# --- index and lexical search ----------------------------------------------------------------------------------------


@query(f"WITH {D.INDEXED} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 4) AS avgdl FROM stats")
def corpus_stats(s, d):
    return index_of(s, d).table("stats").select("n", F.round("avgdl", 4).alias("avgdl"))


@query(f"WITH {D.INDEXED} SELECT t AS term, CAST(count(*) AS BIGINT) AS df FROM (SELECT unnest(list_distinct(tokens)) AS t FROM indexed) GROUP BY t")
def document_frequencies(s, d):
    return index_of(s, d).table("postings").where("tf > 0").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {D.INDEXED} SELECT doc_id, CAST(len(list_filter(tokens, lambda x: x = 'thing')) AS BIGINT) AS thing, CAST(len(list_filter(tokens, lambda x: x = 'of')) AS BIGINT) AS \"of\" FROM indexed")
def term_frequencies(s, d):
    return indexed(s, d).select("doc_id", *(search.occurrences("tokens", t).cast("long").alias(t) for t in ("thing", "of")))


@query("SELECT lang AS category, CAST(count(*) AS BIGINT) AS documents FROM documents GROUP BY lang")
def index_status(s, d):
    return docs(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("documents"))


@query(f"WITH {D.bm25(TERMS)} SELECT doc_id, path, score FROM scored ORDER BY score DESC, path LIMIT 10")
def bm25_top10(s, d):
    """The flagship: top ten of a query over all documents."""
    return store.search(index_of(s, d), search.SearchQuery(TERM, limit=10), "doc_id", "path")


@query(f"WITH {D.bm25(TERMS)} SELECT doc_id, score FROM scored")
def bm25_all(s, d):
    return store.scored(index_of(s, d), search.SearchQuery(TERM), TERMS).select("doc_id", "score")


@query(f"WITH {D.bm25(['of'], where='''category = 'en' ''')} SELECT doc_id, score FROM scored ORDER BY score DESC, path LIMIT 20")
def bm25_category(s, d):
    return store.search(index_of(s, d), search.SearchQuery("of", category="en", limit=20), "doc_id")


@query(f"WITH {D.bm25(['of'], where='''list_contains([category, client], 'en') AND list_contains([category, client], 'src1') ''')} SELECT doc_id, score FROM scored ORDER BY score DESC, path LIMIT 20")
def bm25_tags_all(s, d):
    return store.search(index_of(s, d), search.SearchQuery("of", tags=("en", "src1"), limit=20), "doc_id")


@query(f"WITH {D.bm25(['of'], where='''status = 'approved' ''')} SELECT doc_id, score FROM scored ORDER BY score DESC, path LIMIT 20 OFFSET 5")
def bm25_status(s, d):
    return store.search(index_of(s, d), search.SearchQuery("of", status="Approved", limit=20, offset=5), "doc_id")


@query(f"WITH {D.bm25(['src1', 'of'])} SELECT doc_id, score FROM scored ORDER BY score DESC, path LIMIT 50")
def title_tag_boost(s, d):
    return store.search(index_of(s, d), search.SearchQuery("src1 of"), "doc_id")


@query(f"WITH {D.DOCS} SELECT doc_id, 1.0 AS score FROM docs WHERE category = 'de' ORDER BY path LIMIT 50")
def browse_mode(s, d):
    return store.search(index_of(s, d), search.SearchQuery(category="de"), "doc_id")


@query(f"WITH {D.INDEXED} SELECT doc_id, 1.0 AS score FROM docs WHERE false")
def stop_word_query(s, d):
    return store.search(index_of(s, d), search.SearchQuery("the and"), "doc_id")


def _tfidf() -> str:
    return f"""WITH {D.INDEXED}, dfs AS (SELECT CAST(count(*) FILTER (list_contains(tokens, 'thing')) AS DOUBLE) AS a, CAST(count(*) FILTER (list_contains(tokens, 'tionble')) AS DOUBLE) AS b FROM indexed),
        r AS (SELECT doc_id, path, len(list_filter(tokens, lambda x: x = 'thing')) * (ln((n + 1) / (a + 1)) + 1) + len(list_filter(tokens, lambda x: x = 'tionble')) * (ln((n + 1) / (b + 1)) + 1) AS raw FROM indexed, stats, dfs)
        SELECT doc_id, {D.cents('raw')} AS score FROM r WHERE raw > 0 ORDER BY score DESC, path LIMIT 10"""  # fmt: skip


@query(_tfidf())
def tfidf_top10(s, d):
    return store.search(index_of(s, d), search.SearchQuery(TERM, limit=10), "doc_id", boosts=False, normed=False)


PASSAGES = f"""p AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(conv_id AS VARCHAR) || '_p' || CAST(turn AS VARCHAR) AS passage_id, CAST(turn AS BIGINT) AS position, 'Turno ' || CAST(turn AS VARCHAR) AS locator, text, {D.tokens('text')} AS tokens FROM conversations),
    st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(h0) AS DOUBLE) AS d0, CAST(sum(h1) AS DOUBLE) AS d1 FROM (SELECT max(CAST(list_contains(tokens, 'of') AS INT)) AS h0, max(CAST(list_contains(tokens, 'ther') AS INT)) AS h1 FROM p GROUP BY document_id)),
    q0 AS (SELECT p.*, len(list_filter(tokens, lambda x: x = 'of')) * (ln((n + 1) / (d0 + 1)) + 1) + len(list_filter(tokens, lambda x: x = 'ther')) * (ln((n + 1) / (d1 + 1)) + 1)
           + CASE WHEN regexp_matches({D.fold('text')}, '(^|[^\\p{{L}}\\p{{N}}])of ther($|[^\\p{{L}}\\p{{N}}])') THEN 15 ELSE 0 END AS raw FROM p, st),
    q AS (SELECT *, {D.cents('raw')} AS score FROM q0 WHERE raw > 0)"""  # fmt: skip


@query(f"WITH {PASSAGES} SELECT document_id, passage_id, locator, score FROM q")
def passage_scores(s, d):
    return search.score_passages(vault.transcripts(s, d), "of ther", ["of", "ther"]).select("document_id", "passage_id", "locator", "score")


@query(f"WITH {PASSAGES} SELECT document_id, passage_id, locator, score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY raw DESC, position) AS k FROM q) WHERE k = 1")
def best_passage(s, d):
    return search.best_passage(search.score_passages(vault.transcripts(s, d), "of ther", ["of", "ther"]))


@query("SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(count(*) AS BIGINT) AS passages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conversation_transcripts(s, d):
    return vault.transcripts(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.char_length("text")).alias("chars"))


# --- vectors and fusion ----------------------------------------------------------------------------------------------


def _vectors(s, d):
    table = vault.read_table(s, d, "embeddings")
    return vectors.similarities(table, table.where("vec_id = 0").first()["embedding"])


SIM = f"sim AS (SELECT e.vec_id, e.label, {D.cosine('e.embedding', 'q.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"WITH {SIM} SELECT vec_id, similarity FROM sim ORDER BY similarity DESC, vec_id LIMIT 10")
def cosine_top10(s, d):
    return _vectors(s, d).orderBy(F.desc("similarity"), "vec_id").limit(10).select("vec_id", "similarity")


@query(f"WITH {SIM} SELECT vec_id, similarity FROM sim WHERE similarity > 0.25")
def semantic_threshold(s, d):
    return _vectors(s, d).where(F.col("similarity") > vectors.THRESHOLD).select("vec_id", "similarity")


@query(f"WITH {SIM} SELECT label, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS k FROM sim) WHERE k = 1 AND similarity > 0.25")
def semantic_best(s, d):
    return vectors.best_of_document(_vectors(s, d), "label", "vec_id")


def _cache(s, d):
    p = vault.transcripts(s, d).select("passage_id", "position", F.sha2("text", 256).alias("sha256"))
    cache = p.where("position < 4").select("passage_id", F.when(F.col("position") == 2, F.lit("stale")).otherwise(F.col("sha256")).alias("sha256"))
    return p, cache


@query("SELECT count(*) AS total, count(*) FILTER (turn < 4 AND turn <> 2) AS cached, count(*) FILTER (turn >= 4 OR turn = 2) AS missing, round(count(*) FILTER (turn < 4 AND turn <> 2) / count(*), 4) AS ratio, count(*) FILTER (turn < 4 AND turn <> 2) > 0 AS available FROM conversations")
def vector_coverage(s, d):
    return vectors.coverage(*_cache(s, d))


@query("SELECT CAST(conv_id AS VARCHAR) || '_p' || CAST(turn AS VARCHAR) AS passage_id FROM conversations WHERE turn >= 4 OR turn = 2")
def needs_reindex(s, d):
    p, cache = _cache(s, d)
    return p.join(cache, ["passage_id", "sha256"], "left_anti").select("passage_id")


def _sides(s, d):
    lex = store.scored(index_of(s, d), search.SearchQuery(TERM), TERMS).orderBy(F.desc("score"), "path").limit(200).select(F.col("doc_id").alias("id"), F.col("score").alias("lex"))
    sem = _vectors(s, d).where(F.col("similarity") > vectors.THRESHOLD).select(F.col("vec_id").alias("id"), F.col("similarity").alias("sem"))
    return cut(vectors.coalesced(lex, sem, "id"))


BOTH = f"""{D.bm25(TERMS)}, {SIM}, a AS (SELECT doc_id AS id, score AS lex FROM scored ORDER BY score DESC, path LIMIT 200), b AS (SELECT vec_id AS id, similarity AS sem FROM sim WHERE similarity > 0.25),
    u AS (SELECT id, lex, sem FROM a FULL JOIN b USING (id)), m AS (SELECT *, coalesce(lex, 0) AS x, coalesce(sem, 0) AS y FROM u),
    w AS (SELECT *, CASE WHEN max(x) OVER () > min(x) OVER () THEN (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) WHEN x > 0 THEN 1.0 ELSE 0.0 END AS l,
          CASE WHEN max(y) OVER () > min(y) OVER () THEN (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) WHEN y > 0 THEN 1.0 ELSE 0.0 END AS s,
          CASE WHEN lex IS NOT NULL THEN 1.0 / (60 + row_number() OVER (ORDER BY lex DESC NULLS LAST, id)) ELSE 0 END AS rl, CASE WHEN sem IS NOT NULL THEN 1.0 / (60 + row_number() OVER (ORDER BY sem DESC NULLS LAST, id)) ELSE 0 END AS rs FROM m)"""  # fmt: skip


@query(f"WITH {BOTH} SELECT id, lex, sem FROM u")
def coalesce_full_outer(s, d):
    return _sides(s, d)


@query(f"WITH {BOTH} SELECT id, round(l, 6) AS l, round(s, 6) AS s FROM w")
def minmax(s, d):
    return vectors.scaled(_sides(s, d)).select("id", F.round("l", 6).alias("l"), F.round("s", 6).alias("s"))


for _name, _sql in {"f1": "(l + s) / 2", "f2": "greatest(l, s) + 0.2 * least(l, s)", "f3": "CASE WHEN lex IS NULL THEN s WHEN sem IS NULL THEN l ELSE (l + s) / 2 END", "rrf": "CAST(rl AS DOUBLE) + CAST(rs AS DOUBLE)"}.items():

    def _fusion(s, d, name=_name):
        return vectors.fused(_sides(s, d), "id").select("id", F.col(name).alias("score"))

    QUERIES[f"hybrid_{_name}"] = _fusion
    ORACLES[f"hybrid_{_name}"] = f"WITH {BOTH} SELECT id, round({_sql}, 6) AS score FROM w"


# --- evaluation ------------------------------------------------------------------------------------------------------


def _asked(s, d):
    return vault.read_table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _hits(s, d):
    return store.many(index_of(s, d), _asked(s, d))


def _relevant(s, d):
    """Documents that hold an item's text; the items are a stated query set, looked for in all documents."""
    return evaluate.containing(docs(s, d).select("doc_id", "text"), _asked(s, d))


HITS = f"""{D.INDEXED}, asked AS (SELECT item_id AS query_id, unnest(list_distinct({D.tokens('text')})) AS term FROM benchmark),
    post0 AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM indexed), post AS (SELECT doc_id, length, term, count(*) AS tf FROM post0 WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    dfq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    sc AS (SELECT query_id, doc_id, {D.cents('sum(CAST(round((ln((n + 1) / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl)), 6) AS DOUBLE))')} AS score FROM asked JOIN post USING (term) JOIN dfq USING (term), stats GROUP BY query_id, doc_id),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10),
    relevant AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
    ev AS (SELECT item_id AS query_id, (SELECT count(*) FROM relevant r WHERE r.query_id = item_id) AS relevant, (SELECT count(*) FROM relevant r JOIN hits h USING (query_id, doc_id) WHERE r.query_id = item_id) AS found,
           (SELECT min(rank) FROM relevant r JOIN hits h USING (query_id, doc_id) WHERE r.query_id = item_id) AS first_rank FROM benchmark)"""  # fmt: skip


@query(f"WITH {HITS} SELECT query_id, relevant, found, round(CASE WHEN relevant > 0 THEN found / relevant ELSE 1.0 END, 4) AS recall FROM ev")
def recall_at_10(s, d):
    return evaluate.recall(_hits(s, d), _relevant(s, d), _asked(s, d))


@query(f"WITH {HITS} SELECT query_id, first_rank, CAST(coalesce(first_rank = 1, false) AS INT) AS hit1, CAST(coalesce(first_rank <= 10, false) AS INT) AS hit10 FROM ev")
def hit_rank(s, d):
    return evaluate.first_hits(_hits(s, d), _relevant(s, d), _asked(s, d))


@query(f"WITH {HITS} SELECT query_id, count(*) FILTER (abs(score - top) < 1e-4) AS tied FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM hits) GROUP BY query_id")
def ties_at_1(s, d):
    return evaluate.ties_at_top(_hits(s, d))


@query(f"""WITH {HITS}, r AS (SELECT CASE WHEN relevant > 0 THEN found / relevant ELSE 1.0 END AS x FROM ev)
    SELECT round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(min(x), 4) AS least, count(*) FILTER (x = 0) AS zero, CASE WHEN avg(x) >= 0.9 AND (SELECT count(*) FROM documents) >= 100 THEN 'PASS' ELSE 'FAIL' END AS gate,
           CASE WHEN avg(x) >= 0.85 THEN 'fusion' WHEN avg(x) <= 0.7 THEN 'model' ELSE 'mixed' END AS verdict FROM r""")  # fmt: skip
def quality_gate(s, d):
    r = evaluate.recall(_hits(s, d), _relevant(s, d), _asked(s, d)).withColumn("x", F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")).otherwise(1.0))
    one = r.agg(F.avg("x").alias("m"), F.percentile("x", 0.5).alias("median"), F.min("x").alias("least"), F.count_if(F.col("x") == 0).alias("zero"))
    n = vault.read_table(s, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return one.crossJoin(n).select(F.round("m", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("least", 4).alias("least"), "zero", evaluate.gate(F.col("m"), 0.9, F.col("n"), 100).alias("gate"), evaluate.verdict(F.col("m")).alias("verdict"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(min(value), 4) AS least, round(max(value), 4) AS greatest, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def latency_percentiles(s, d):
    return evaluate.percentiles(vault.read_table(s, d, "events"), "value", ["event_type"])


@query(f"WITH w AS (SELECT item_id, {D.word_set('text')} AS words FROM benchmark) SELECT a.item_id, CAST(len(list_intersect(a.words, b.words)) AS BIGINT) AS shared FROM w a JOIN w b ON b.item_id = a.item_id + 1")
def overlap_words(s, d):
    words = vault.read_table(s, d, "benchmark").select("item_id", T.word_set(F.col("text")).alias("words"))
    after = words.select((F.col("item_id") - 1).alias("item_id"), F.col("words").alias("other"))
    return words.join(after, "item_id").select("item_id", F.size(F.array_intersect("words", "other")).cast("long").alias("shared"))


@query(f"""WITH w AS (SELECT item_id AS id, {D.word_set('text')} AS words FROM benchmark)
    SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 4) AS jaccard FROM w a JOIN w b ON a.id < b.id
    WHERE round(len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 4) > 0.0""")  # fmt: skip
def jaccard_pairs(s, d):
    return evaluate.jaccard_pairs(vault.read_table(s, d, "benchmark"), "item_id", "text")


@query("""WITH x AS (SELECT user_id, CAST(max(value) FILTER (event_id % 2 = 0) AS DOUBLE) AS a, CAST(max(value) FILTER (event_id % 2 = 1) AS DOUBLE) AS b FROM events GROUP BY user_id)
    SELECT user_id, a AS now, b AS before, CASE WHEN a > b THEN 'IMPROVED' WHEN a < b THEN 'DEGRADED' ELSE 'SAME' END AS change FROM x WHERE a IS NOT NULL AND b IS NOT NULL""")
def version_comparison(s, d):
    half = lambda k: vault.read_table(s, d, "events").where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("value").alias("v"))
    return evaluate.compared(half(0), half(1), "user_id", "v")


# --- catalog ---------------------------------------------------------------------------------------------------------


@query(f"WITH {D.DOCS} SELECT sha256, path, min(path) OVER (PARTITION BY sha256) AS canonical, count(*) OVER (PARTITION BY sha256) AS copies FROM docs")
def dedup_aliases(s, d):
    return catalog.deduplicated(files(s, d))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'error' WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'imported' ELSE 'duplicate' END AS status FROM documents")
def import_receipts(s, d):
    return catalog.receipts(files(s, d), "doc_id").select("doc_id", "status")


@query(f"""WITH {D.DOCS} SELECT doc_id, path, (SELECT count(*) FROM docs) AS total, (SELECT count(*) FROM docs WHERE contains(lower(path), 'src1') AND status = 'approved') AS filtered
    FROM docs WHERE contains(lower(path), 'src1') AND status = 'approved' ORDER BY doc_id DESC LIMIT 50""")
def catalog_list(s, d):
    rows = labelled(s, d)
    wanted = F.contains(F.lower("path"), F.lit("src1")) & (F.col("status") == "approved")
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(wanted).alias("filtered"))
    return rows.where(wanted).orderBy(F.desc("doc_id")).limit(50).crossJoin(F.broadcast(totals)).select("doc_id", "path", "total", "filtered")


@query(f"WITH {D.DOCS} SELECT count(*) AS total, count(*) FILTER (status = 'approved') AS ready, count(*) FILTER (status = 'auto') AS processing, count(*) FILTER (status = 'draft' OR toxic) AS attention, CAST(sum(n_chars) AS BIGINT) AS chars FROM docs")
def catalog_summary(s, d):
    st = F.col("status")
    return labelled(s, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(st == "approved").alias("ready"), F.count_if(st == "auto").alias("processing"), F.count_if((st == "draft") | F.col("toxic")).alias("attention"), F.sum("n_chars").alias("chars"))


@query("""SELECT page_id, CASE WHEN e = 'html' THEN 'text/html' ELSE 'application/octet-stream' END AS media, CASE WHEN e = 'html' THEN 'html' ELSE 'unsupported' END AS extractor
    FROM (SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)""".replace("\\\\", "\\"))  # fmt: skip
def mime_dispatch(s, d):
    return vault.read_table(s, d, "pages").select("page_id", vault.media_type(F.col("url")).alias("media"), vault.extractor(F.col("url")).alias("extractor"))


def _versions(s, d):
    rows = files(s, d)
    known = rows.where("doc_id % 10 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("sha256")).alias("sha256"), F.lit(1).cast("long").alias("revision"))
    return known, rows.where("doc_id % 10 <> 1").withColumn("revision", F.when(F.col("doc_id") % 11 == 0, 2).otherwise(1).cast("long"))


@query(f"""WITH {D.DOCS} SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'revised' ELSE 'unchanged' END AS change,
    CAST(CASE WHEN doc_id % 10 NOT IN (0, 1) AND doc_id % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS revision FROM docs""")
def reconcile_diff(s, d):
    return catalog.reconciled(*_versions(s, d))


@query(f"WITH {D.DOCS} SELECT path FROM docs WHERE doc_id % 10 <> 0 AND (doc_id % 10 <> 1 OR client <> 'src1')")
def prune_removed(s, d):
    known, found = _versions(s, d)
    return catalog.pruned(known, found, F.col("path").startswith("20_RAW_SOURCES/src1/")).select("path")


@query(f"""WITH {D.DOCS} SELECT path, CASE WHEN doc_id % 10 = 1 THEN 'missing_original' WHEN doc_id % 7 = 0 THEN 'tampered_original' WHEN doc_id % 11 = 0 THEN 'revision_mismatch' ELSE 'verified' END AS status FROM docs WHERE doc_id % 10 <> 0""")
def verify_cascade(s, d):
    return catalog.verified(*_versions(s, d))


@query(f"""WITH {D.DOCS}, wanted AS (SELECT path AS name FROM docs WHERE doc_id % 3 = 0 UNION SELECT CAST(doc_id AS VARCHAR) || '.txt' FROM docs WHERE doc_id % 3 = 1 UNION SELECT 'alias-' || CAST(doc_id AS VARCHAR) FROM docs WHERE doc_id % 3 = 2 UNION SELECT 'nothing')
    SELECT name, count(docs.path) AS matches, CASE WHEN count(docs.path) = 1 THEN min(docs.path) END AS path
    FROM wanted LEFT JOIN docs ON docs.path = name OR name = 'alias-' || CAST(doc_id AS VARCHAR) OR (NOT contains(name, '/') AND docs.path LIKE '%/' || name) GROUP BY name""")  # fmt: skip
def resolve_path(s, d):
    rows = docs(s, d).select("doc_id", "path")
    part = lambda k, c: rows.where(F.col("doc_id") % 3 == k).select(c.alias("name"))
    text_id = F.col("doc_id").cast("string")
    wanted = part(0, F.col("path")).union(part(1, F.concat(text_id, F.lit(".txt")))).union(part(2, F.concat(F.lit("alias-"), text_id))).union(s.createDataFrame([("nothing",)], "name string")).distinct()
    aliases = rows.select(F.concat(F.lit("alias-"), text_id).alias("alias"), "path")
    return catalog.resolved(wanted, rows.select("path"), aliases)


@query(f"""WITH {D.DOCS} SELECT category || '/' || client AS id, bool_and(doc_id % 10 <> 1 AND doc_id % 70 <> 7) AS current FROM docs WHERE doc_id % 10 <> 0 GROUP BY 1""")
def lineage_current(s, d):
    rows = docs(s, d).select("doc_id", "path", "category", "client", F.sha2("text", 256).alias("sha256"))
    recorded = rows.where("doc_id % 10 <> 0").select(F.concat_ws("/", "category", "client").alias("id"), "path", F.when(F.col("doc_id") % 70 == 7, F.lit("old")).otherwise(F.col("sha256")).alias("sha256"))
    return catalog.current(recorded, rows.where("doc_id % 10 <> 1"))


@query("""WITH p AS (SELECT 'Caf' || CASE doc_id % 3 WHEN 0 THEN 'e' || chr(769) WHEN 1 THEN chr(201) ELSE 'e' END || '/' || CAST(doc_id // 2 AS VARCHAR) AS path FROM documents)
    SELECT lower(nfc_normalize(path)) AS key, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1""")
def path_collisions(s, d):
    mark = F.when(F.col("doc_id") % 3 == 0, "e\u0301").when(F.col("doc_id") % 3 == 1, "\u00c9").otherwise("e")
    return catalog.path_collisions(docs(s, d).select(F.concat(F.lit("Caf"), mark, F.lit("/"), F.expr("cast(doc_id div 2 as string)")).alias("path")))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(s, d):
    return vault.read_table(s, d, "pages").select("page_id", vault.html_title(F.col("html")).alias("title"))


def _html() -> str:
    """Quoted parts are masked first, as no quote stands outside a tag or blocked element without ending there."""
    tag = r"<(?:[^<>\x22\x27]|\x22[^\x22]*\x22|\x27[^\x27]*\x27|<)*>"
    steps = f"list_filter(regexp_extract_all(html, '(?s){tag}|[^<]+|<.*'), lambda x: x <> '')"
    name = r"lower(regexp_extract(t, '^<\s*/?\s*([A-Za-z0-9]*)', 1))"
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT page_id, {steps} AS parts FROM (SELECT page_id, html || CASE WHEN page_id % 4 = 0 THEN '<p title="a>b">x & y</p><script>"<b>"</script>z<noscript>n<template>t</noscript>u</template>v</noscript>w' ELSE '' END AS html FROM pages)),
        k AS MATERIALIZED (SELECT page_id, i, t, starts_with(t, '<') AS is_tag, regexp_matches(t, '^<\\s*/') AS closing, {name} AS name FROM (SELECT page_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS t FROM p)),
        w AS (SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS open, '' AS put FROM p
              UNION ALL SELECT k.page_id, k.i, CASE WHEN is_tag AND name IN ('script', 'style', 'iframe', 'object', 'template', 'noscript') THEN CASE WHEN NOT closing THEN list_append(open, name) WHEN len(open) > 0 AND open[-1] = name THEN open[:-2] ELSE open END ELSE open END AS now,
                     CASE WHEN is_tag AND NOT regexp_matches(t, '(?s)^{tag}$') THEN chr(0) WHEN is_tag THEN CASE WHEN len(CASE WHEN name IN ('script', 'style', 'iframe', 'object', 'template', 'noscript') THEN CASE WHEN NOT closing THEN list_append(open, name) WHEN len(open) > 0 AND open[-1] = name THEN open[:-2] ELSE open END ELSE open END) = 0 THEN ' ' ELSE '' END
                          WHEN len(open) = 0 THEN t ELSE '' END FROM w JOIN k ON k.page_id = w.page_id AND k.i = w.i + 1)
        SELECT page_id, sha256({D.collapse("replace(replace(replace(string_agg(put, '' ORDER BY i), chr(0), ''), '&', '&amp;'), '>', '&gt;')")}) AS text FROM w GROUP BY page_id"""


@query(_html())
def html_text(s, d):
    tail = F.when(F.col("page_id") % 4 == 0, '<p title="a>b">x & y</p><script>"<b>"</script>z<noscript>n<template>t</noscript>u</template>v</noscript>w').otherwise("")
    return vault.read_table(s, d, "pages").select("page_id", F.sha2(vault.html_text(F.concat("html", tail)), 256).alias("text"))


# --- context and releases --------------------------------------------------------------------------------------------


@query(f"WITH {D.DOCS} SELECT doc_id, status <> 'draft' AS strict, true AS with_drafts FROM docs")
def eligibility(s, d):
    args = (F.col("path"), F.col("category"), F.col("status"))
    return labelled(s, d).select("doc_id", context.eligible(*args).alias("strict"), context.eligible(*args, drafts=True).alias("with_drafts"))


@query("SELECT lang, doc_id, used FROM (SELECT lang, doc_id, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE used <= 24000")
def context_budget_break(s, d):
    items = vault.read_table(s, d, "documents").select("lang", "doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    return C.running_budget(items, ["lang"], ["doc_id"], "n_chars", 24_000).select("lang", "doc_id", "used")


@query("""WITH RECURSIVE h AS (SELECT * FROM (SELECT source, doc_id, CAST(strlen(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 50),
    f AS (SELECT source, doc_id, size, k, size <= 24000 AS taken, CASE WHEN size <= 24000 THEN size ELSE 0 END AS used, CASE WHEN size <= 24000 THEN 1 ELSE 0 END AS n FROM h WHERE k = 1
          UNION ALL SELECT h.source, h.doc_id, h.size, h.k, used + h.size <= 24000 AND n < 10, CASE WHEN used + h.size <= 24000 AND n < 10 THEN used + h.size ELSE used END, CASE WHEN used + h.size <= 24000 AND n < 10 THEN n + 1 ELSE n END
          FROM f JOIN h ON h.source = f.source AND h.k = f.k + 1)
    SELECT source, doc_id, size FROM f WHERE taken""")  # fmt: skip
def context_budget_skip(s, d):
    items = vault.read_table(s, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    # A search page of fifty sources for each source, as the packing gets them.
    page = evaluate.ranks(items.withColumn("s", -F.col("doc_id")), "source", "s", "doc_id").where("rank <= 50")
    return context.packed_with_skips(page, ["source"], F.col("rank"), "doc_id", "size", 24_000)


@query("SELECT CAST(conv_id AS VARCHAR) || '_p' || CAST(turn AS VARCHAR) AS passage_id, '[[' || CAST(conv_id AS VARCHAR) || '#Turno ' || CAST(turn AS VARCHAR) || ']]' AS citation FROM conversations")
def citations(s, d):
    return vault.transcripts(s, d).select("passage_id", context.citation(F.col("document_id"), F.col("locator")).alias("citation"))


@query("SELECT conv_id AS answer_id, bool_and(turn < 5) AS valid FROM conversations GROUP BY conv_id")
def citation_check(s, d):
    turns = vault.read_table(s, d, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("source_id"))
    return context.cited(turns, turns.where("source_id < 5").select("source_id"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'research' END AS final_category, lang NOT IN ('en', 'de') AS fallback, CASE WHEN contains(lower(text), 'the') THEN 'the' END AS final_client, CASE WHEN length(text) BETWEEN 1 AND 300 THEN text ELSE source END AS final_title FROM documents")
def classification_cleanup(s, d):
    rows = vault.read_table(s, d, "documents").select("doc_id", F.col("lang").alias("category"), F.lit("the").alias("client"), "text", F.col("text").alias("title"), F.col("source").alias("stem"))
    return context.cleaned_classification(rows, ["en", "de"]).select("doc_id", "final_category", "fallback", "final_client", "final_title")


@query(f"WITH {D.DOCS} SELECT path, CASE WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'modified' ELSE 'verified' END AS state FROM docs")
def manifest_diff(s, d):
    return release.manifest_diff(*_versions(s, d))


@query("SELECT DISTINCT sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE doc_id % 10 <> 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0)")
def missing_objects(s, d):
    known, found = _versions(s, d)
    return release.missing_objects(found, known)


@query(f"""WITH {D.DOCS}, r AS (SELECT *, doc_id // 500 AS k, '{{"category":"' || category || '","id":"' || path || '","objectRef":"' || sha256 || '","relativePath":"' || path || '","sha256":"' || sha256 || '","sizeBytes":' || CAST(strlen(text) AS VARCHAR) || ',"status":"private"}}' AS j FROM docs)
    SELECT 'r' || CAST(k AS VARCHAR) AS release_id, sha256('{{"channel":"private","documents":[' || string_agg(j, ',' ORDER BY path) || '],"parentReleaseId":' || CASE WHEN k > 0 THEN '"r' || CAST(k - 1 AS VARCHAR) || '"' ELSE 'null' END || ',"releaseId":"r' || CAST(k AS VARCHAR) || '","schemaVersion":1}}') AS manifest_hash FROM r GROUP BY k""")  # fmt: skip
def manifest_hash(s, d):
    release_id = lambda back: F.concat(F.lit("r"), F.expr(f"cast(doc_id div 500 - {back} as string)"))
    rows = files(s, d)
    documents = rows.select(release_id(0).alias("release_id"), "category", F.col("path").alias("id"), F.col("sha256").alias("objectRef"), F.col("path").alias("relativePath"), "sha256", F.col("size").alias("sizeBytes"), F.lit("private").alias("status"))
    releases = rows.select(release_id(0).alias("release_id"), F.when(F.expr("doc_id div 500 > 0"), release_id(1)).alias("parent_id"), F.lit("private").alias("channel"), F.lit(1).alias("schemaVersion")).distinct()
    return release.manifest_hash(documents, releases)


@query("""WITH RECURSIVE r AS (SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS id, 'r' || CAST(o_orderkey - 1 AS VARCHAR) AS parent FROM orders),
    c AS (SELECT id, parent, 0 AS hop FROM r WHERE id = 'r40' UNION ALL SELECT r.id, r.parent, hop + 1 FROM c JOIN r ON r.id = c.parent) SELECT id AS release_id, min(hop) AS hop FROM c GROUP BY id""")
def release_chain(s, d):
    rows = vault.read_table(s, d, "orders")
    name = lambda k: F.concat(F.lit("r"), (F.col("o_orderkey") - k).cast("string"))
    return release.release_chain(rows.select(name(0).alias("release_id"), name(1).alias("parent_id")), "r40")


@query("SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) <= 1000 AND sum(strlen(text)) <= 268435456 AS ok FROM documents")
def release_limits(s, d):
    return release.within_limits(files(s, d))


@query(f"WITH {D.DOCS} SELECT doc_id, path FROM docs WHERE status = 'approved' AND NOT toxic AND (contains(lower(title), 'src1') OR contains(lower(path), 'src1')) AND starts_with(category, 'e') AND lower(client) = 'src1'")
def published_search(s, d):
    found = F.contains(F.lower("title"), F.lit("src1")) | F.contains(F.lower("path"), F.lit("src1"))
    return labelled(s, d).where((F.col("status") == "approved") & ~F.col("toxic") & found & F.col("category").startswith("e") & (F.lower("client") == "src1")).select("doc_id", "path")


# --- state and streams -----------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY user_id")
def job_state_fold(s, d):
    return workflow.latest_state(vault.read_table(s, d, "events"), "user_id", "ts", "event_id", "event_type")


@query("SELECT user_id, count(*) AS failures, count(*) >= 3 AS blocked FROM events WHERE event_type = 'error' GROUP BY user_id")
def attempts_exhausted(s, d):
    return workflow.exhausted(vault.read_table(s, d, "events"), "user_id", "event_type", "error")


@query("SELECT props AS operation, count(*) AS sent, min(event_type) <> max(event_type) AS conflict FROM events GROUP BY props")
def operation_ids(s, d):
    rows = vault.read_table(s, d, "events").select(F.col("props").alias("operation"), F.col("event_type").alias("payload"))
    return workflow.operations(rows, "operation", "payload")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_scalar(s, d):
    return vault.read_table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT count(*) AS contents FROM (SELECT DISTINCT sha256(text) FROM documents)")
def stream_ingest(s, d):
    stream = ingest.once_each(ingest.read_stream(s, f"{d}/documents.parquet", "*.parquet").select(F.sha2("text", 256).alias("sha256")))
    return ingest.run_once(stream, new_folder(s, "ingest")).agg(F.count(F.lit(1)).alias("contents"))


@query("SELECT user_id AS job, CASE WHEN count(*) FILTER (event_type = 'error') >= 3 THEN 'blocked' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'ready' ELSE 'waiting' END AS status, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY user_id")
def stream_job_states(s, d):
    events = ingest.read_stream(s, f"{d}/events.parquet", "*.parquet").select(F.col("user_id").alias("job"), F.col("event_type").alias("kind"))
    rows = ingest.run_once(ingest.job_states(events), new_folder(s, "jobs"), "update")
    last = rows.groupBy("job").agg(F.max_by(F.struct("done", "attempts"), "batch").alias("last"))
    return last.select("job", ingest.status(F.col("last.done"), F.col("last.attempts")).alias("status"), F.col("last.attempts").alias("attempts"))
