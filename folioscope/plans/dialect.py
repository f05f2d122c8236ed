"""Fragments of the SQL twins that several queries share, in DuckDB's dialect."""

from __future__ import annotations

from folioscope.functions.text import STOP_WORDS, WORD_STOPS

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def strip_markdown(x: str) -> str:
    for pattern, put in ((r"(?s)^---\n.*?\n---(\n|$)", ""), (r"(?s)```.*?```", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"(?m)^>[ \t]*", ""), ("[`*_]", "")):
        flags = "" if pattern.startswith("(?s)^") else ", 'g'"
        x = f"regexp_replace({x}, '{pattern}', '{put}'{flags})"
    return collapse(x)


def tokens(x: str) -> str:
    words = rf"string_split_regex({fold(strip_markdown(x))}, '[^\p{{L}}\p{{N}}]+')"
    return f"list_filter({words}, lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w))"


def content_words(x: str) -> str:
    words = rf"string_split_regex(regexp_replace({fold(x)}, '[^a-z0-9\s]', ' ', 'g'), '\s+')"
    return f"list_distinct(list_filter({words}, lambda w: length(w) >= 3 AND NOT list_contains([{', '.join(repr(w) for w in WORD_STOPS)}], w)))"


def word_set(x: str) -> str:
    return f"list_filter({content_words(x)}, lambda w: NOT regexp_matches(w, '^[0-9]+$'))"


def cents(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


PATH = "'20_RAW_SOURCES/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
DOCS = f"""docs AS (SELECT doc_id, {PATH} AS path, 'doc_' || substr(sha256({PATH}), 1, 16) AS document_id, source || ' ' || lang AS title, lang AS category, source AS client,
           text, CAST(n_chars AS BIGINT) AS n_chars, sha256(text) AS sha256,
           CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'draft' ELSE 'auto' END AS status, coalesce(toxic = 1, false) AS toxic FROM documents LEFT JOIN labels USING (doc_id))"""
INDEXED = f"{DOCS}, indexed AS (SELECT *, {tokens("title || ' ' || text")} AS tokens FROM docs), stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, greatest(avg(len(tokens)), 1.0) AS avgdl FROM indexed)"


def bm25(terms: list[str], where: str = "true", boosts: bool = True) -> str:
    """CTEs up to scored (doc_id, path, ..., raw, score) for a list of terms."""
    df = ", ".join(f"CAST(count(*) FILTER (list_contains(tokens, '{t}')) AS DOUBLE) AS df{i}" for i, t in enumerate(terms))
    parts = []
    for i, t in enumerate(terms):
        tf = f"CAST(len(list_filter(tokens, lambda x: x = '{t}')) AS DOUBLE)"
        parts.append(f"CASE WHEN {tf} > 0 THEN (ln((n + 1) / (df{i} + 1)) + 1) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len(tokens) / avgdl)) ELSE 0 END")
        if boosts:
            parts.append(f"CASE WHEN list_contains({tokens('title')}, '{t}') THEN 10 ELSE 0 END + CASE WHEN list_contains([{fold('category')}, {fold('client')}], '{t}') THEN 5 ELSE 0 END")
    raw = " + ".join(parts)
    return f"{INDEXED}, dfs AS (SELECT {df} FROM indexed), scored0 AS (SELECT indexed.*, {raw} AS raw FROM indexed, stats, dfs WHERE {where}), scored AS (SELECT *, {cents('raw')} AS score FROM scored0 WHERE raw > 0)"


def cosine(a: str, b: str) -> str:
    one, two = (f"list_transform({x}, lambda v: CAST(v AS DOUBLE))" for x in (a, b))
    return f"round(list_sum(list_transform(list_zip({one}, {two}), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform({one}, lambda v: v * v))) * sqrt(list_sum(list_transform({two}, lambda v: v * v)))), 4)"
