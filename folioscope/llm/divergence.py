"""Source divergence audit: how far the words of each source of a language stray from those of the others.

Pass one counts exactly in how many of a language's documents each term occurs. Pass two builds automata (pyahocorasick) of the
kept terms, each padded by a delimiter, and counts their occurrences over all texts. What was counted are sparse
postings (language, source, term, count); terms that a source lacks enter the sums in closed form. A kept term is known by its place
among all in order, so neither counts nor pairs move words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut, slices, stored, text_bytes
from folioscope.sources.shared import with_rank

LEAST_DOCUMENTS = 3
TERM_RANKS = 200
#: Terms in automata, over all languages: some 180 bytes of a worker's memory each. The others take another way.
AUTOMATA_TERMS = 1_000_000
#: Terms in one automaton; a language with more has several, and its texts are scanned by each.
AUTOMATON_TERMS = 250_000
#: Text bytes of a batch, and counts that a task holds before it passes them on.
WINDOW_BYTES, HELD = 2 << 20, 1_000_000
SCALE, MOST = 1_000_000_000, (1 << 63) - 1
#: Every ASCII byte that is no letter becomes a space, and A-Z becomes a-z; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def folded(column: pa.Array) -> pa.LargeStringArray:
    """The texts with terms in lower case, separated by spaces."""
    data, offsets = text_bytes(column)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data.tobytes().translate(FOLD)))


def corpus(docs: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(lang, source, text) without nulls; ``columns`` names those of docs that hold them."""
    names = columns or {}
    return docs.select(*(F.coalesce(F.col(names.get(c, c)).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, df) of every term. A task counts what it reads before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in slices(batches, limit=WINDOW_BYTES):
            langs = batch.column("lang").dictionary_encode()
            texts = folded(batch.column("text"))
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                counter = held.setdefault(lang, Counter())
                for text in texts.filter(pa.array(langs.indices.to_numpy() == k)).to_pylist():
                    counter.update(set(text.split(" ")))
            if sum(map(len, held.values())) > HELD:
                yield from flushed(held)
                held = {}
        yield from flushed(held)

    def flushed(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            counter.pop("", None)
            if counter:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter)), pa.array(list(counter)), pa.array(list(counter.values()), pa.int64())], names=["lang", "term", "df"])

    return rows.select("lang", "text").mapInArrow(count, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


def automaton(terms: list[str]):
    """An automaton of the padded terms; each gives its place in the list."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        made.add_word(f" {term} ", k)
    if terms:
        made.make_automaton()
    return made


def occurrences(made, text: str) -> np.ndarray:
    """The places in the list of all terms that text holds, in order; text begins and ends with a space."""
    return np.fromiter((k for _, k in made.iter(text)), np.int32) if len(made) else np.zeros(0, np.int32)


class Tally:
    """Occurrences of one automaton's terms by source; its size is that of what was found, not of the vocabulary."""

    def __init__(self):
        self.sources, self.keys, self.counts, self.size = {}, [], [], 0

    def add(self, source: str, found: np.ndarray) -> None:
        places, counts = np.unique(found, return_counts=True)
        own = self.sources.setdefault(source, len(self.sources))
        self.keys.append(places.astype(np.int64) | (own << 32))
        self.counts.append(counts)
        self.size += len(places)

    def merge(self) -> None:
        keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.counts = [np.bincount(inverse, np.concatenate(self.counts), len(keys)).astype(np.int64)]
        self.keys, self.size = [keys], len(keys)

    def rows(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        self.merge()
        names = list(self.sources)
        owners, starts = np.unique(self.keys[0] >> 32, return_index=True)
        for owner, low, high in zip(owners.tolist(), starts.tolist(), [*starts.tolist()[1:], self.size], strict=True):
            yield names[owner], self.keys[0][low:high] & 0xFFFFFFFF, self.counts[0][low:high]


#: Terms as Arrow strings: as Python strings every worker would hold them at eight times the size.
Head = dict[str, list[tuple[pa.Array, np.ndarray]]]
POSTINGS = "lang string, source string, id long, n long, term string"


def counted(rows: DataFrame, head: Head, all_terms: bool) -> DataFrame:
    """(lang, source, id, n, term): occurrences of the head's terms, and where ``all_terms`` is set those of all other words, without an id.

    head: for each language its terms and their ids, in lists of one automaton each. Only words without an id carry the term.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, known, tallies = {}, {}, {}
        for batch in slices(batches, limit=WINDOW_BYTES):
            groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
            texts = folded(batch.column("text"))
            places: dict[tuple[str, str], list[int]] = {}
            for k, group in enumerate(groups.to_pylist()):
                places.setdefault((group["lang"], group["source"]), []).append(k)
            for (lang, source), rows_ in places.items():
                if lang not in automata:
                    automata[lang] = [automaton(terms.to_pylist()) for terms, _ in shipped.value.get(lang, [])]
                text = f" {' '.join(texts.take(pa.array(rows_)).to_pylist())} "
                for k, made in enumerate(automata[lang]):
                    tallies.setdefault((lang, k), Tally()).add(source, occurrences(made, text))
                if all_terms:
                    if lang not in known:
                        known[lang] = {t for terms, _ in shipped.value.get(lang, []) for t in terms.to_pylist()}
                    rest = Counter(t for t in text.split(" ") if t and t not in known[lang])
                    yield made_batch(lang, source, pa.nulls(len(rest), pa.int64()), list(rest.values()), pa.array(list(rest), pa.string()))
            if sum(t.size for t in tallies.values()) > HELD:
                for tally in tallies.values():
                    tally.merge()
                if sum(t.size for t in tallies.values()) > HELD // 2:
                    yield from flushed(tallies)
                    tallies = {}
        yield from flushed(tallies)

    def flushed(tallies: dict) -> Iterator[pa.RecordBatch]:
        for (lang, k), tally in tallies.items():
            ids = shipped.value[lang][k][1]
            for source, found, n in tally.rows():
                yield made_batch(lang, source, ids[found], n, pa.nulls(len(found), pa.string()))

    def made_batch(lang: str, source: str, ids, n, terms: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), terms], names=["lang", "source", "id", "n", "term"])

    return rows.mapInArrow(count, POSTINGS).groupBy("lang", "source", "id", "term").agg(F.sum("n").alias("n"))


def head_of(kept: DataFrame, most: int = AUTOMATA_TERMS, each: int = AUTOMATON_TERMS) -> tuple[Head, bool]:
    """The terms for automata, and whether they are all.

    At most ``most`` terms come to the driver: a histogram of df by powers of two says which powers fit.
    """
    power = F.floor(F.log2("df")).cast("int")
    sizes = {r["power"]: r["n"] for r in kept.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = max(sizes, default=0) + 1, 0
    for p in sorted(sizes, reverse=True):
        if total + sizes[p] > most:
            break
        least, total = p, total + sizes[p]
    terms = kept.where(power >= least).select("lang", "term", "id").toArrow()
    head: Head = {}
    for lang in terms.column("lang").unique().to_pylist():
        own = terms.filter(pc.equal(terms.column("lang"), lang))
        words, ids = own.column("term").combine_chunks(), own.column("id").to_numpy()
        head[lang] = [(pa.concat_arrays([words.slice(k, each)]), ids[k : k + each]) for k in range(0, len(ids), each)]
    return head, total == sum(sizes.values())


def postings(rows: DataFrame, kept: DataFrame, most: int = AUTOMATA_TERMS, each: int = AUTOMATON_TERMS) -> DataFrame:
    """(lang, source, id, n) of the kept terms, n above 0.

    Beyond ``most`` terms the rarest have no automaton: tasks count the words that automata leave over, and a join by shuffle
    picks the kept terms among them. So what is broadcast is bounded, and no term is lost.
    """
    head, whole = head_of(kept, most, each)
    if whole:
        return counted(rows, head, False).select("lang", "source", "id", "n")
    found = cut(counted(rows, head, True))
    rare = found.where("id IS NULL").drop("id").join(kept.select("lang", "term", "id"), ["lang", "term"])
    return found.where("id IS NOT NULL").select("lang", "source", "id", "n").unionByName(rare.select("lang", "source", "id", "n"))


def share(count: Column | str, total: Column | str, size: Column | str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + size)), exact for any long; where there are no terms, nothing uses it."""
    count, total, size = (F.col(x) if isinstance(x, str) else x for x in (count, total, size))
    divided = lambda count, total, size, kind: F.call_function("div", F.lit(SCALE).cast(kind) * (count + 1), F.greatest(total + size, F.lit(1).cast(kind)))
    small = (count < SCALE) & (total < MOST // 2) & (size < MOST // 2)
    exact = divided(*(x.cast("decimal(19,0)") for x in (count, total, size)), "decimal(19,0)")
    return F.when(small, divided(count, total, size, "long")).otherwise(exact) + F.lit(1)


def gap(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so a long holds the square."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def pair_values(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of a language's sources.

    The sum over all V kept terms is V times the gap of two absent terms, and what each posting of either source, and each term that
    both have, changes in it. What one source's postings change depends on their counts alone, so these are tallied
    first; only terms of both sources are joined.
    """
    spread = groups.select("lang", "source", "v", "total", share(F.lit(0), "total", "v").alias("none"))
    tallies = found.groupBy("lang", "source", "n", "p").agg(F.count(F.lit(1)).alias("times"))
    other = spread.select("lang", F.col("source").alias("item"), F.col("none").alias("none_o"))
    own = spread.select("lang", "source", F.col("none").alias("none_s"))
    # One row a tally and source: a term's count says all, however many terms have it.
    one = tallies.join(own, ["lang", "source"]).join(other, "lang").where("source <> item")
    first = one.select("lang", "source", "item", ((gap("p", "none_o") - gap("none_s", "none_o")) * F.col("times")).alias("value"))
    second = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), ((gap("none_o", "p") - gap("none_o", "none_s")) * F.col("times")).alias("value"))
    left = found.join(own, ["lang", "source"]).select("id", "lang", "source", "p", "none_s")
    right = left.select("id", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none_s").alias("none_o"))
    both = left.join(right, "id").where("source <> item")
    change = gap("p", "q") - gap("p", "none_o") - gap("none_s", "q") + gap("none_s", "none_o")
    third = both.groupBy("lang", "source", "item").agg(F.sum(change).alias("value"))
    changes = first.unionByName(second).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(third).groupBy("lang", "source", "item").agg(F.sum("value").alias("change"))
    pairs = spread.select("lang", "source", "v", F.col("none").alias("none_s")).join(other, "lang").where("source <> item")
    base = F.when(F.col("v") > 0, gap("none_s", "none_o") * F.col("v")).otherwise(0)
    return pairs.join(changes, ["lang", "source", "item"], "left").select("lang", "source", "item", (base + F.coalesce("change", F.lit(0))).alias("value"))


def ranked(rows: DataFrame, tie: str) -> DataFrame:
    """rows with rank: by value, largest first, then by ``tie``, inside each (lang, source)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col(tie))))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, columns: dict[str, str] | None = None, most: int = AUTOMATA_TERMS, each: int = AUTOMATON_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): the report of all pairs of sources and of each source's own terms.

    Nulls count as empty strings, in texts, languages and sources; every row is a document, repeated ones too. A source
    without terms has every pair; a language without kept terms has pairs of value 0 and no terms; an empty table has no rows. Other
    columns are not read. Ties go by the item's UTF-8 bytes.
    """
    rows = corpus(docs, columns)
    kept = stored(with_rank(document_frequencies(rows).where(F.col("df") >= least), [F.col("lang"), F.col("term")], "id"))
    found = cut(postings(rows, kept, most, each))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    joined = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = cut(joined.select("lang", "source", zero("total"), zero("v")))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.max("v").alias("size"))
    common = found.groupBy("lang", "id").agg(F.sum("n").alias("m")).join(langs, "lang").select("id", share("m", "whole", "size").alias("q"))
    shares = stored(found.join(groups, ["lang", "source"]).select("lang", "source", "id", "n", share("n", "total", "v").alias("p")).join(common, "id"))
    pairs = ranked(pair_values(groups, shares), "item")
    high = ranked(shares.where("p > q").select("lang", "source", "id", gap("p", "q").alias("value")), "id").where(F.col("rank") <= ranks)
    terms = high.join(kept.select("id", F.col("term").alias("item")), "id")
    columns_ = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns_).unionByName(terms.withColumn("part", F.lit("term")).select(columns_))


ORACLE_SQL = r"""
    WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
    counts AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
    sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(max(s.v), 0) AS v, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g
        LEFT JOIN sizes s ON s.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
    shares AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p
        FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    langs AS (SELECT k.lang, k.term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c.n) + 1)) // (t.total + t.v) AS q FROM kept k JOIN counts c ON c.lang = k.lang AND c.term = k.term
        JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM groups GROUP BY lang) t ON t.lang = k.lang GROUP BY k.lang, k.term, t.total, t.v),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(max(s.value), 0) AS value FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
        LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL) s
        ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY a.lang, a.source, b.source),
    terms AS (SELECT x.lang, x.source, x.term AS item, ((x.p - l.q) * (x.p - l.q)) // l.q AS value FROM shares x JOIN langs l ON l.lang = x.lang AND l.term = x.term WHERE x.n > 0 AND x.p > l.q),
    report AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
        UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM report WHERE part = 'pair' OR rank <= 200
"""
