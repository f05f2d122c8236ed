"""Queries over whole searches: lexical and hybrid pages, upkeep of the index, context, and the measures of retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import context, evaluate, search, store, vectors
from folioscope.plans import dialect as D
from folioscope.plans.base import docs, index_of, kept_index, labelled, mod, query, with_project
from folioscope.sources import vault
from folioscope.sources.shared import cut, new_folder

# --- lexical pages ---------------------------------------------------------------------------------------------------


@query(f"WITH {D.bm25(['of'], where='''doc_id % 2 = 0 ''')} SELECT doc_id, score FROM scored ORDER BY score DESC, path LIMIT 20")
def bm25_predicate(s, d):
    """A caller's own condition: it chooses documents and moves no statistics."""
    return store.search(index_of(s, d), search.SearchQuery("of", limit=20), "doc_id", where=mod(2))


@query(f"WITH {D.bm25(['of'], where='''doc_id % 3 = 1 ''')} SELECT doc_id, score FROM scored ORDER BY score DESC, path LIMIT 20")
def bm25_project(s, d):
    return store.search(index_of(s, d), search.SearchQuery("of", project="P1", limit=20), "doc_id")


@query(f"WITH {D.bm25(['of'])} SELECT doc_id, score FROM (SELECT * FROM scored ORDER BY score DESC, path LIMIT 50) WHERE status <> 'draft' ORDER BY score DESC, path LIMIT 10")
def tool_page(s, d):
    """Ten eligible ones of the first fifty: what is not eligible leaves a gap that later hits don't fill."""
    fifty = store.search(index_of(s, d), search.SearchQuery("of"), "doc_id", "path", "category", "status")
    return fifty.where(context.eligible(F.col("path"), F.col("category"), F.col("status"))).orderBy(F.desc("score"), "path").limit(10).select("doc_id", "score")


def _talks(s: SparkSession, d: str) -> store.Store:
    """An index of conversations as documents whose first turn is their text, and all turns as their passages."""
    number = F.col("document_id").cast("long")
    turns = lambda: vault.transcripts(s, d)
    rows = lambda: turns().where("position = 0").select(
        number.alias("doc_id"), "document_id", F.concat(F.lit("talks/"), "document_id").alias("path"), F.concat(F.lit("Talk "), "document_id").alias("title"), F.lit("talk").alias("category"), F.lit("").alias("client"),
        F.array(F.lit("talk")).alias("tags"), F.concat(F.lit("2024-01-0"), (number % 4 + 1).cast("string")).alias("updated_at"), "text",
    )
    passages = lambda docs: turns().withColumn("doc_id", number).join(docs.select("doc_id"), "doc_id", "left_semi")
    return kept_index(s, d, "conversations", rows, passages)


def _talk_page(term: str, terms: list[str], where: str = "true", limit: int = 20) -> str:
    tf = lambda c, t: f"CAST(len(list_filter({c}, lambda x: x = '{t}')) AS DOUBLE)"
    dfs = ", ".join(f"CAST(count(*) FILTER (list_contains(tokens, '{t}')) AS DOUBLE) AS df{i}" for i, t in enumerate(terms))
    idf = lambda i: f"(ln((n + 1) / (df{i} + 1)) + 1)"
    own = " + ".join(f"CASE WHEN {tf('tokens', t)} > 0 THEN {idf(i)} * {tf('tokens', t)} * 2.2 / ({tf('tokens', t)} + 1.2 * (0.25 + 0.75 * len(tokens) / avgdl)) ELSE 0 END + CASE WHEN list_contains({D.tokens('title')}, '{t}') THEN 10 ELSE 0 END + CASE WHEN 'talk' = '{t}' THEN 5 ELSE 0 END" for i, t in enumerate(terms))
    part = " + ".join(f"{tf('ptokens', t)} * {idf(i)}" for i, t in enumerate(terms))
    snip = lambda n, x: f"CASE WHEN {n} <= 180 THEN {x} ELSE CASE WHEN lo > 0 THEN '...' ELSE '' END || substr({x}, lo + 1, 180) || CASE WHEN least({n}, lo + 180) < {n} THEN '...' ELSE '' END END"
    hit = " ".join(f"WHEN instr({D.fold('plain')}, '{t}') > 0 THEN instr({D.fold('plain')}, '{t}') - 1" for t in terms)
    shown = f"(SELECT {snip('length(plain)', 'plain')} FROM (SELECT plain, CASE WHEN length(plain) - greatest(0, h - 90) < 180 THEN greatest(0, length(plain) - 180) ELSE greatest(0, h - 90) END AS lo FROM (SELECT plain, CASE {hit} ELSE 0 END AS h FROM (SELECT {{}} AS plain))))"
    return f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, text, {D.tokens('text')} AS ptokens FROM conversations),
        x AS (SELECT document_id, 'talks/' || document_id AS path, 'Talk ' || document_id AS title, '2024-01-0' || CAST(CAST(document_id AS BIGINT) % 4 + 1 AS VARCHAR) AS updated_at, text FROM t WHERE turn = 0),
        i AS (SELECT *, {D.tokens("title || ' ' || text")} AS tokens FROM x), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, greatest(avg(len(tokens)), 1.0) AS avgdl, {dfs} FROM i),
        o AS (SELECT i.*, {own} AS own FROM i, st WHERE {where}),
        p AS (SELECT document_id, turn, text, {part} + CASE WHEN regexp_matches({D.fold('text')}, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])') THEN 15 ELSE 0 END AS raw FROM t, st),
        b AS (SELECT document_id, arg_max(turn, (round(raw, 9), -turn)) AS turn, arg_max(text, (round(raw, 9), -turn)) AS best, max(raw) AS raw, string_agg(document_id || '_p' || CAST(turn AS VARCHAR), ',' ORDER BY {D.cents('round(raw, 9)')} DESC, turn) AS passages FROM p WHERE raw > 0 GROUP BY document_id),
        f AS (SELECT o.*, b.turn, b.best, b.passages, CASE WHEN own > 0 THEN own ELSE coalesce(b.raw, 0) END AS raw FROM o LEFT JOIN b USING (document_id))
        SELECT document_id, updated_at, {D.cents('round(raw, 9)')} AS score, {shown.format(D.strip_markdown('coalesce(best, substr(text, 1, 500))'))} AS snippet, document_id || '_p' || CAST(turn AS VARCHAR) AS matching_passage_id, coalesce(passages, '') AS passages
        FROM f WHERE raw > 0 ORDER BY score DESC, updated_at DESC, path LIMIT {limit}"""  # fmt: skip


def _page(index: store.Store, q: search.SearchQuery) -> DataFrame:
    return store.page(index, q).select("document_id", "updated_at", "score", "snippet", "matching_passage_id", F.array_join("passages", ",").alias("passages"))


@query(_talk_page("thin ther", ["ther", "thin"]))
def lexical_page(s, d):
    """A whole query: documents that only their passages match come with the best passage's score."""
    return _page(_talks(s, d), search.SearchQuery("thin ther", limit=20))


@query(_talk_page("talk", ["talk"], limit=30))
def lexical_page_ties(s, d):
    """Every document matches by title and tag alike: the newest come first, then the least path."""
    return _page(_talks(s, d), search.SearchQuery("talk", limit=30))


#: Characters of a passage in the index of documents, so that SQL can state where each ends.
PASSAGE = 1000


def _library(s: SparkSession, d: str) -> store.Store:
    """An index of all documents with their passages, of equal size."""
    rows = lambda: docs(s, d).withColumn("updated_at", F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 4 + 1).cast("string")))

    def passages(chosen: DataFrame) -> DataFrame:
        starts = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / PASSAGE).cast("int"))
        cut = chosen.where("text <> ''").select("doc_id", "document_id", "text", F.explode(starts).alias("position"))
        return cut.select("doc_id", "position", F.concat("document_id", F.lit("_p"), F.col("position").cast("string")).alias("passage_id"), F.concat(F.lit("Pezzo "), F.col("position").cast("string")).alias("locator"), F.substring(F.col("text"), F.col("position") * PASSAGE + 1, F.lit(PASSAGE)).alias("text"))

    return kept_index(s, d, "documents", rows, passages)


def _library_page(term: str, terms: list[str], limit: int, where: str = "true") -> str:
    """The same whole query over documents and their passages."""
    body = _talk_page(term, terms, where, limit)
    head, tail = body.index("WITH t AS"), body.index("st AS (SELECT")
    made = f"""WITH {D.DOCS}, t AS (SELECT document_id, turn, substr(text, turn * {PASSAGE} + 1, {PASSAGE}) AS text, {D.tokens(f'substr(text, turn * {PASSAGE} + 1, {PASSAGE})')} AS ptokens
            FROM (SELECT document_id, text, unnest(range(0, (length(text) - 1) // {PASSAGE} + 1)) AS turn FROM docs WHERE text <> '')),
        x AS (SELECT document_id, path, title, category, client, '2024-01-0' || CAST(doc_id % 4 + 1 AS VARCHAR) AS updated_at, text FROM docs), i AS (SELECT *, {D.tokens("title || ' ' || text")} AS tokens FROM x), """
    body = body[:head] + made + body[tail:]
    for t in terms:
        body = body.replace(f"CASE WHEN 'talk' = '{t}' THEN 5", f"CASE WHEN list_contains([{D.fold('category')}, {D.fold('client')}], '{t}') THEN 5")
    return body


@query(_library_page("thing the", ["thing"], 20))
def document_page(s, d):
    """A whole query over documents and their passages, from the kept index; a stop word counts in the phrase only."""
    return _page(_library(s, d), search.SearchQuery("thing the", limit=20))


@query(_library_page("de src1", ["de", "src1"], 40, "category = 'en'"))
def document_page_filtered(s, d):
    """Titles and tags match where texts don't: such documents have no best passage and show their beginning."""
    return _page(_library(s, d), search.SearchQuery("de src1", category="en", limit=40))


# --- upkeep ----------------------------------------------------------------------------------------------------------


def _later(s: SparkSession, d: str) -> DataFrame:
    """The documents after a while: a seventh changed, a tenth removed, a tenth new (under higher ids)."""
    now = with_project(labelled(s, d))
    changed = now.withColumn("text", F.when(mod(7), F.concat(F.lit("changed thing "), "text")).otherwise(F.col("text")))
    added = changed.where(mod(10, 2)).withColumns({"doc_id": F.col("doc_id") + 10_000_000, "path": F.concat("path", F.lit(".new"))})
    return changed.where("doc_id % 10 <> 1").unionByName(added)


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents UNION ALL SELECT doc_id + 10000000, 'added' FROM documents WHERE doc_id % 10 = 2""")
def index_changes(s, d):
    return store.changes(index_of(s, d).table("documents"), _later(s, d))


def _later_twin() -> str:
    body = D.bm25(["thing"])
    body = body.replace("FROM documents LEFT JOIN labels USING (doc_id)", """FROM (
        SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed thing ' || text ELSE text END AS text, lang, source, n_chars, doc_id AS at, '' AS suffix FROM documents WHERE doc_id % 10 <> 1
        UNION ALL SELECT doc_id + 10000000, CASE WHEN doc_id % 7 = 0 THEN 'changed thing ' || text ELSE text END, lang, source, n_chars, doc_id, '.new' FROM documents WHERE doc_id % 10 = 2) z LEFT JOIN labels l ON l.doc_id = z.at""").replace("docs AS (SELECT doc_id,", "docs AS (SELECT z.doc_id,")  # fmt: skip
    body = body.replace(D.PATH, D.PATH.replace("CAST(doc_id AS VARCHAR)", "CAST(z.at AS VARCHAR)") + " || suffix")
    return f"WITH {body} SELECT doc_id, score FROM scored"


@query(_later_twin())
def index_update(s, d):
    """Scores over an index that was brought up to date: only changed and new documents were tokenised."""
    later = store.updated(index_of(s, d), _later(s, d), new_folder(s, "index"))
    return store.scored(later, search.SearchQuery("thing"), ["thing"]).select("doc_id", "score")


@query(f"WITH {D.bm25(['thing'])} SELECT doc_id FROM (SELECT * FROM scored ORDER BY score DESC, path LIMIT 50) WHERE doc_id % 7 = 0 OR doc_id % 10 = 1")
def stale_sources(s, d):
    """Hits whose bytes are no longer those indexed: a search that has any must be refused."""
    index = index_of(s, d)
    return store.stale(index, store.search(index, search.SearchQuery("thing"), "doc_id"), _later(s, d))


@query("SELECT 'ready' AS state, 3 AS version, lang AS category, count(*) AS documents, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY lang UNION ALL SELECT 'missing', NULL, NULL, 0, 0 UNION ALL SELECT 'outdated', 2, NULL, 0, (SELECT count(*) FROM documents)")
def index_state(s, d):
    index = index_of(s, d)
    counts = index.table("documents").groupBy("category").agg(F.count(F.lit(1)).alias("documents"))
    total = index.table("stats").select(F.col("n").alias("total"), "version")
    ready = counts.crossJoin(F.broadcast(total)).select(F.lit(index.status()).alias("state"), "version", "category", "documents", "total")
    absent = s.range(1).select(F.lit(store.Store(s, new_folder(s, "nothing")).status()).alias("state"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("string").alias("category"), F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("total"))
    earlier = store.publish(s, new_folder(s, "index"), 1, index.manifest["n"], 0, [], version=store.VERSION - 1)
    old = earlier.table("stats").select(F.lit(earlier.status()).alias("state"), "version", F.lit(None).cast("string").alias("category"), F.lit(0).cast("long").alias("documents"), F.col("n").alias("total"))
    return ready.unionByName(absent).unionByName(old)


# --- hybrid pages ----------------------------------------------------------------------------------------------------


def _near(s, d) -> DataFrame:
    table = vault.read_table(s, d, "embeddings")
    return vectors.similarities(table, table.where("vec_id = 0").first()["embedding"]).where(F.col("similarity") > vectors.THRESHOLD)


def _lexical(s, d, q: search.SearchQuery, terms: list[str]) -> DataFrame:
    """A search's first 200 with title and snippet; texts are read for these only."""
    found = store.search(index_of(s, d), search.SearchQuery(q.term, q.category, limit=200), "doc_id", "title")
    texts = docs(s, d).select("doc_id", "text").join(F.broadcast(found), "doc_id")
    return texts.select(F.col("doc_id").alias("id"), F.col("score").alias("lex"), "title", T.snippet(F.col("text"), terms).alias("snippet"))


def _semantic(s, d, category: str = "") -> DataFrame:
    rows = docs(s, d).select("doc_id", "title", "category", F.substring("text", 1, 240).alias("snippet"))
    near = rows.join(_near(s, d).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("sem")), "doc_id")
    return (near.where(F.col("category") == category) if category else near).select(F.col("doc_id").alias("id"), "sem", "title", "snippet")


def _hybrid(where: str, tail: str) -> str:
    snippet = f"""(SELECT CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(p, lo + 1, 180) || CASE WHEN least(length(p), lo + 180) < length(p) THEN '...' ELSE '' END FROM
        (SELECT p, CASE WHEN length(p) - greatest(0, h - 90) < 180 THEN greatest(0, length(p) - 180) ELSE greatest(0, h - 90) END AS lo FROM (SELECT p, greatest(0, instr({D.fold('p')}, 'thing') - 1) AS h FROM (SELECT {D.strip_markdown('text')} AS p))))"""
    return f"""WITH {D.bm25(['thing'], where=where)}, sim AS (SELECT e.vec_id, {D.cosine('e.embedding', 'q.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
        a AS (SELECT doc_id AS id, score AS lex, title, {snippet} AS snippet FROM (SELECT * FROM scored ORDER BY score DESC, path LIMIT 200)),
        b AS (SELECT doc_id AS id, similarity AS sem, title, substr(text, 1, 240) AS snippet FROM docs JOIN sim ON vec_id = doc_id WHERE similarity > 0.25 AND {where}),
        u AS (SELECT coalesce(a.id, b.id) AS id, lex, sem, coalesce(lex, 0) AS x, coalesce(sem, 0) AS y, contains(lower(coalesce(a.title, b.title)), 'thing') OR contains(lower(coalesce(a.snippet, b.snippet)), 'thing') AS m FROM a FULL JOIN b ON a.id = b.id),
        w AS (SELECT *, CASE WHEN max(x) OVER () > min(x) OVER () THEN (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) WHEN x > 0 THEN 1.0 ELSE 0.0 END AS l,
              CASE WHEN max(y) OVER () > min(y) OVER () THEN (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) WHEN y > 0 THEN 1.0 ELSE 0.0 END AS s FROM u)
        {tail}"""


BONUS = "CASE WHEN m THEN 0.05 ELSE 0.0 END"


@query(_hybrid("true", f"SELECT id, lex, sem, round(greatest(l, s) + 0.2 * least(l, s) + {BONUS}, 6) AS score FROM w ORDER BY score DESC, id LIMIT 20 OFFSET 5"))
def hybrid_page(s, d):
    """A whole hybrid query, second page: fused score with the bonus for a literal match, equal ones by id."""
    q = search.SearchQuery("thing", limit=20, offset=5)
    return vectors.hybrid(_lexical(s, d, q, ["thing"]), _semantic(s, d), "id", q.term, False, q.limit, q.offset)


@query(_hybrid("category = 'en'", f"SELECT id, lex, sem, round(greatest(l, s) + 0.2 * least(l, s) + {BONUS}, 6) AS score FROM w ORDER BY score DESC, id LIMIT 20"))
def hybrid_filtered(s, d):
    q = search.SearchQuery("thing", category="en", limit=20)
    return vectors.hybrid(_lexical(s, d, q, ["thing"]), _semantic(s, d, "en"), "id", q.term, False, q.limit, q.offset)


@query(f"WITH {D.bm25(['thing'])} SELECT doc_id AS id, score AS lex, CAST(NULL AS DOUBLE) AS sem, score FROM (SELECT * FROM scored ORDER BY score DESC, path LIMIT 200) ORDER BY score DESC, id LIMIT 20")
def hybrid_fallback(s, d):
    """Without a vector of the query the lexical side stands alone."""
    q = search.SearchQuery("thing", limit=20)
    return vectors.hybrid(_lexical(s, d, q, ["thing"]), None, "id", q.term, False, q.limit)


def _sides(s, d) -> DataFrame:
    q = search.SearchQuery("thing", limit=200)
    lexical, semantic = _lexical(s, d, q, ["thing"]), _semantic(s, d)
    both = lexical.withColumnsRenamed({"title": "tl", "snippet": "sl"}).join(semantic.withColumnsRenamed({"title": "ts", "snippet": "ss"}), "id", "full_outer")
    # Ranks and bounds read the candidates several times; the documents are read once.
    return cut(both.select("id", "lex", "sem", vectors.literal_match("thing", F.coalesce("tl", "ts"), F.coalesce("sl", "ss")).alias("m")))


#: The weights of the two sides that are compared, and the shares of the weaker side.
WEIGHTS = ((0.5, 0.5), (0.4, 0.6), (0.3, 0.7), (0.2, 0.8), (0.1, 0.9))
SHARES = (0.1, 0.2, 0.3, 0.4, 0.5)


def _alternatives_sql() -> dict[str, str]:
    rank = lambda c: f"CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 / (60 + row_number() OVER (ORDER BY {c} DESC NULLS LAST, id)) END"
    bonus = lambda x: f"CASE WHEN m THEN {x} ELSE 0.0 END"
    out = {f"rrf_{int(a * 10)}": f"{a} * {rank('lex')} + {b} * {rank('sem')} + {bonus(0.005)}" for a, b in WEIGHTS}
    out |= {f"norm_{int(a * 10)}": f"{a} * l + {b} * s + {bonus(0.05)}" for a, b in WEIGHTS}
    out["baseline"] = f"0.5 * {rank('lex')} + 0.5 * {rank('sem')} + {bonus(0.05)} + 0.01 * x"
    out |= {f"f2_{int(k * 10)}": f"greatest(l, s) + {k} * least(l, s)" for k in SHARES}
    return out | {"max_ratio": "0.5 * CASE WHEN max(x) OVER () > 0 THEN x / max(x) OVER () ELSE 0 END + 0.5 * CASE WHEN max(y) OVER () > 0 THEN y / max(y) OVER () ELSE 0 END"}


@query(_hybrid("true", "SELECT id, " + ", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {name}" for name, sql in _alternatives_sql().items()) + " FROM w"))
def fusion_alternatives(s, d):
    """Every candidate's score under each way of fusing that is compared."""
    lex, sem, bonus = vectors.reciprocal("rank_lex"), vectors.reciprocal("rank_sem"), lambda x: F.when(F.col("m"), x).otherwise(0.0)
    ways = {f"rrf_{int(a * 10)}": a * lex + b * sem + bonus(0.005) for a, b in WEIGHTS}
    ways |= {f"norm_{int(a * 10)}": a * F.col("l") + b * F.col("s") + bonus(0.05) for a, b in WEIGHTS}
    ways["baseline"] = 0.5 * lex + 0.5 * sem + bonus(0.05) + 0.01 * F.coalesce("lex", F.lit(0.0))
    ways |= {f"f2_{int(k * 10)}": vectors.f2(k) for k in SHARES} | {"max_ratio": vectors.max_ratio()}
    return vectors.with_ranks(vectors.scaled(_sides(s, d)), "id").select("id", *(F.round(way, 6).alias(name) for name, way in ways.items()))


# --- context ---------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {D.bm25(['thing'], where="status <> 'draft'")}, h AS (SELECT path, score, doc_id, text, row_number() OVER (ORDER BY score DESC, path) AS rank FROM scored),
    g AS (SELECT rank, path, CASE WHEN strlen(text) <= 3000 THEN text WHEN doc_id % 2 = 0 THEN '[Paragrafo 1] ' || substr(text, 1, 100)
            ELSE substr(text, 1, list_max(list_filter(range(0, 3001), lambda n: strlen(substr(text, 1, n)) <= 3000))) END AS content FROM h WHERE rank <= 200),
    f AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, 0 AS n, false AS taken
        UNION ALL SELECT g.rank, CASE WHEN used + strlen(content) <= 24000 AND n < 10 THEN used + strlen(content) ELSE used END, CASE WHEN used + strlen(content) <= 24000 AND n < 10 THEN n + 1 ELSE n END, used + strlen(content) <= 24000 AND n < 10 FROM f JOIN g ON g.rank = f.rank + 1)
    SELECT g.rank, g.path, sha256(g.content) AS content FROM g JOIN f USING (rank) WHERE taken""")  # fmt: skip
def context_pack(s, d):
    """Eligible documents first, then a search's page, then long texts cut to their passage, then what fits the budget."""
    where = context.eligible(F.col("path"), F.col("category"), F.col("status"))
    found = store.search(index_of(s, d), search.SearchQuery("thing", limit=200), "doc_id", "path", where=where)
    ranked = evaluate.ranks(found.withColumn("all", F.lit(1)), "all", "score", "path")
    texts = docs(s, d).select("path", "doc_id", "text")
    passage = F.when(mod(2), F.substring("text", 1, 100))
    chosen = texts.join(F.broadcast(ranked.select("path", "rank")), "path").select("path", "rank", F.when(mod(2), "p").alias("matching_passage_id"), F.when(mod(2), "Paragrafo 1").alias("matching_locator"), passage.alias("passage"))
    return context.packed_context(chosen, texts.select("path", "text")).select("rank", "path", F.sha2("content", 256).alias("content"))


# --- measures --------------------------------------------------------------------------------------------------------


def _asked(s, d) -> DataFrame:
    return vault.read_table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _hits(s, d, limit: int) -> DataFrame:
    return store.many(index_of(s, d), _asked(s, d), limit)


def _relevant(s, d) -> DataFrame:
    return evaluate.containing(docs(s, d).select("doc_id", "text"), _asked(s, d))


HITS = f"""{D.INDEXED}, asked AS (SELECT item_id AS query_id, unnest(list_distinct({D.tokens('text')})) AS term FROM benchmark),
    post AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM indexed) WHERE term IN (SELECT term FROM asked) GROUP BY ALL), dfq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    sc AS (SELECT query_id, doc_id, {D.cents('sum(CAST(round((ln((n + 1) / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl)), 6) AS DOUBLE))')} AS score FROM asked JOIN post USING (term) JOIN dfq USING (term), stats GROUP BY query_id, doc_id),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 50),
    relevant AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""  # fmt: skip


@query(f"WITH {HITS} SELECT item_id AS query_id, min(rank) AS first_rank, CAST(coalesce(min(rank) = 1, false) AS INT) AS hit1, CAST(coalesce(min(rank) <= 10, false) AS INT) AS hit10 FROM benchmark LEFT JOIN (SELECT query_id, rank FROM hits JOIN relevant USING (query_id, doc_id)) ON query_id = item_id GROUP BY item_id")
def first_rank_50(s, d):
    return evaluate.first_hits(_hits(s, d, 50), _relevant(s, d), _asked(s, d))


@query(f"""WITH {HITS}, f AS (SELECT item_id AS q, (SELECT min(rank) FROM hits JOIN relevant USING (query_id, doc_id) WHERE query_id = item_id) AS r, (SELECT count(*) FROM hits WHERE query_id = item_id AND rank <= 10 AND abs(score - (SELECT max(score) FROM hits h WHERE h.query_id = item_id)) < 1e-4) AS tied FROM benchmark)
    SELECT count(*) AS queries, count(*) FILTER (r = 1) AS hits_at_1, count(*) FILTER (tied >= 2) AS ties_at_1, count(*) FILTER (r = 1 AND tied < 2) AS strict_hits_at_1, max(CASE WHEN tied >= 2 THEN tied ELSE 1 END) AS largest_tie FROM f""")
def tie_statistics(s, d):
    return evaluate.tie_statistics(_hits(s, d, 10), _relevant(s, d), _asked(s, d))


@query(f"WITH {HITS} SELECT query_id, count(*) - count(DISTINCT sha256) AS repeated FROM hits JOIN docs USING (doc_id) WHERE rank <= 10 GROUP BY query_id")
def repeated_rows(s, d):
    """How many of a query's first ten have the content of another of them."""
    contents = index_of(s, d).table("documents").select("doc_id", "sha256")
    return evaluate.repeated_rows(_hits(s, d, 10).join(contents, "doc_id"), "query_id", "sha256")


@query(f"""WITH {HITS}, target AS (SELECT query_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '/' || CAST(doc_id AS VARCHAR) || '.' END AS target, doc_id FROM relevant)
    SELECT query_id, count(DISTINCT target) AS relevant, count(DISTINCT target) FILTER (EXISTS (SELECT 1 FROM hits h JOIN docs USING (doc_id) WHERE h.query_id = target.query_id AND h.rank <= 10 AND (CAST(h.doc_id AS VARCHAR) = target OR contains(path, target)))) AS found FROM target GROUP BY query_id""")
def recall_by_path(s, d):
    """A relevant document is named by its id, or by a part of its path."""
    paths = index_of(s, d).table("documents").select("doc_id", "path")
    hits = _hits(s, d, 10).join(paths, "doc_id").select("query_id", F.col("doc_id").cast("string").alias("id"), "path")
    number = F.col("doc_id").cast("string")
    targets = _relevant(s, d).select("query_id", F.when(mod(2), number).otherwise(F.concat(F.lit("/"), number, F.lit("."))).alias("target"))
    return evaluate.recall_by_path(hits, targets)


_WAYS = {"f1": "(l + s) / 2", **{f"f2_{int(k * 10)}": f"greatest(l, s) + {k} * least(l, s)" for k in SHARES}, "f3": "CASE WHEN lex IS NULL THEN s WHEN sem IS NULL THEN l ELSE (l + s) / 2 END"}
_RECALLS = f"""WITH {HITS}, sim AS (SELECT item_id AS query_id, e.vec_id AS doc_id, {D.cosine('e.embedding', 'q.embedding')} AS sem FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e),
    u AS (SELECT coalesce(h.query_id, s.query_id) AS query_id, coalesce(h.doc_id, s.doc_id) AS doc_id, score AS lex, sem, coalesce(score, 0) AS x, coalesce(sem, 0) AS y FROM hits h FULL JOIN (SELECT * FROM sim WHERE sem > 0.25) s ON s.query_id = h.query_id AND s.doc_id = h.doc_id),
    v AS (SELECT *, CASE WHEN max(x) OVER q > min(x) OVER q THEN (x - min(x) OVER q) / (max(x) OVER q - min(x) OVER q) WHEN x > 0 THEN 1.0 ELSE 0.0 END AS l,
        CASE WHEN max(y) OVER q > min(y) OVER q THEN (y - min(y) OVER q) / (max(y) OVER q - min(y) OVER q) WHEN y > 0 THEN 1.0 ELSE 0.0 END AS s FROM u WINDOW q AS (PARTITION BY query_id)),
    w AS ({' UNION ALL '.join(f"SELECT '{name}' AS config, query_id, doc_id, round(CAST({sql} AS DOUBLE), 6) AS f FROM v" for name, sql in _WAYS.items())}),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY f DESC, doc_id) AS place FROM w) WHERE place <= 10),
    e AS (SELECT config, item_id, (SELECT count(*) FROM relevant r WHERE r.query_id = item_id) AS total, (SELECT count(*) FROM t JOIN relevant r ON r.query_id = t.query_id AND r.doc_id = t.doc_id WHERE t.config = c.config AND t.query_id = item_id) AS found FROM benchmark, (SELECT DISTINCT config FROM w) c),
    m AS (SELECT config, round(avg(CASE WHEN total = 0 THEN 1.0 ELSE found / total END), 4) AS recall FROM e GROUP BY config)"""


def _recalls(s, d) -> DataFrame:
    """The mean recall of each way of fusing over all items; an item's vector is that of its own number, as there is no model."""
    asked, table = _asked(s, d), vault.read_table(s, d, "embeddings")
    queries = table.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = vectors.similarities_of_each(table.select("vec_id", "embedding"), queries).select("query_id", F.col("vec_id").alias("doc_id"), F.col("similarity").alias("sem"))
    both = vectors.scaled_by(_hits(s, d, 50).select("query_id", "doc_id", F.col("score").alias("lex")).join(near, ["query_id", "doc_id"], "full_outer"), "query_id")
    ways = {"f1": ("f1", None, (F.col("l") + F.col("s")) / 2), **{f"f2_{int(k * 10)}": ("f2", k, vectors.f2(k)) for k in SHARES}, "f3": ("f3", None, vectors.f3())}
    return evaluate.recalls_of_ways(both, ways, _relevant(s, d), asked)


@query(_RECALLS + " SELECT config, recall FROM m")
def fusion_recalls(s, d):
    return _recalls(s, d).select("config", "recall")


@query(_RECALLS + """, b AS (SELECT * FROM m WHERE abs(recall - (SELECT max(recall) FROM m)) < 1e-6)
    SELECT config, recall FROM b ORDER BY CASE WHEN config = 'f1' AND (SELECT count(*) FROM b) = 1 THEN 0 WHEN config = 'f2_3' THEN 1 WHEN config = 'f2_2' THEN 2 WHEN starts_with(config, 'f2') THEN 3 WHEN config = 'f3' THEN 4 ELSE 5 END, config LIMIT 1""")
def fusion_winner(s, d):
    """Of the ways that find most, measured over all items, a lone mean, else the stronger side with a middle share of the weaker."""
    return evaluate.winner(_recalls(s, d))


@query(f"""WITH w AS (SELECT item_id AS id, {D.word_set('text')} AS words FROM benchmark), p AS (SELECT CASE WHEN len(list_distinct(list_concat(a.words, b.words))) > 0 THEN round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))), 4) ELSE 0 END AS j FROM w a JOIN w b ON a.id < b.id)
    SELECT count(*) AS pairs, round(sum(j) / count(*), 4) AS mean, max(j) AS greatest, count(*) FILTER (j > 0.3) AS violations FROM p""")
def corpus_diversity(s, d):
    return evaluate.diversity(vault.read_table(s, d, "benchmark"), "item_id", "text")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, CASE WHEN p95 <= 1000 AND (SELECT count(*) FROM documents) >= 1000 AND (SELECT sum(length(text)) // 1000 FROM documents) >= 10000 THEN 'PASS' ELSE 'FAIL' END AS gate FROM q""")
def latency_gate(s, d):
    """Passes where 95 of 100 answers took a second at most, over at least 1,000 documents and 10,000 passages (of 1,000 characters here)."""
    p = evaluate.percentiles(vault.read_table(s, d, "events"), "value", ["event_type"])
    n = docs(s, d).agg(F.count(F.lit(1)).alias("documents"), F.expr("sum(char_length(text)) div 1000").alias("passages"))
    return p.crossJoin(F.broadcast(n)).select("event_type", evaluate.latency_gate(F.col("p95"), F.col("documents"), F.col("passages")).alias("gate"))
