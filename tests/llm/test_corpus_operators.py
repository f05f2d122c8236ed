"""Each operator against brute force, an exact round trip, or held-out accuracy, and the edge cases its docstring states."""

from __future__ import annotations

import hashlib
import html as entities
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import components, decontaminate, entries, htmltext, jaccard, langid, quality, sentencepiece, sharding, urlfilter, warc
from folioscope.llm.common import fold_of

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "  \n\t "), (5, "x " * 30_000), (6, "é漢😀\0"), (7, "one two three four five six"), (8, "One two three four five six")]


@pytest.fixture(scope="module")
def edge(spark):
    rows = spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in EDGE], "doc_id long, text string, lang string, source string, n_chars int, size string")
    return rows.withColumns({c: F.lit("extra") for c in ("score", "shard", "cls", "h", "n", "label")})


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def table(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- 1 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=sentencepiece.MODEL)


def test_tokens_equal_the_library(spark, library):
    texts = [r["text"] for r in table(spark, "documents").select("text").collect()]
    texts += ["", " ", "   ", "a  b   c    d", " lead", "trail  ", "\n\n x\t▁y 漢😀 the", " " * 40 + "x", "9  9", "<s></s><0x0A>", "x" * 3000, "the" * 99, "\u2581\u2581a", "Ａé́ ß"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab  the$\nü漢") for _ in range(60)) for _ in range(300)]
    got = sentencepiece.encode([pa.array(texts[:50]), pa.array(texts[50:])], sentencepiece.load())
    ids = got[0].to_pylist() + got[1].to_pylist()
    assert ids == [library.encode(t) for t in texts]
    back = sentencepiece.decode(pa.array(ids, pa.list_(pa.int32())), sentencepiece.load()).to_pylist()
    assert back == [t.replace("▁", " ") for t in texts]


def test_sentencepiece_edges(edge, empty, library):
    rows = sentencepiece.encode_documents(edge).collect()
    assert len(rows) == len(EDGE) and all(r["round_trip"] for r in rows)
    assert sorted(map(tuple, (r["ids"] for r in rows))) == sorted(tuple(library.encode(t or "")) for _, t in EDGE)
    assert sentencepiece.encode_documents(empty).count() == 0
    texts = sentencepiece.decode_documents(sentencepiece.encode_documents(edge)).collect()
    assert sorted(r["text"] for r in texts) == sorted(t or "" for _, t in EDGE)


# --- 2 ---------------------------------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} if words else set()


def brute_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def copies(seed, n=160):
    """Copies with few and with many edits, parts, boilerplate that all share, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    common = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.choice([3, 6, 9, 14, 30, 90]))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w + common
        if rng.random() < 0.2:
            w = w[: rng.randint(1, len(w))]
        out.append((i * 3 + 1, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    docs = copies(seed)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.similarity_components(rows).collect())
    assert got == brute_components(docs)


def test_components_of_edges(spark, edge, empty):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard.similarity_components(edge).collect())
    assert got == [(-1, 1, -1), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 0, 4), (5, 1, 5), (6, 1, 6), (7, 2, 7), (8, 2, 7)]
    assert jaccard.similarity_components(empty).count() == 0
    kept = jaccard.one_of_each_group(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7]


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_boundary_follows_cost():
    s = jaccard.Settings()
    assert jaccard.boundary({}, 1, s) == 0
    assert jaccard.boundary({5: 10, 2000: 10}, 0, s) <= jaccard.boundary({5: 10, 20: 10, 2000: 10}, 50, s)


# --- 3 and 4 ---------------------------------------------------------------------------------------------------------


def test_quality_is_learned(spark):
    got = entries.QUERIES["op3_quality"](spark, MEDIUM).join(table(spark, "labels", MEDIUM), "doc_id").toPandas()
    held = got[got.held_out]
    recall = held.groupby("quality").predicted.mean()
    assert recall[1] > 0.97 and recall[0] < 0.15
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, bags, y = rng.normal(size=(7, 5)), np.array([2, 1, 4]), np.array([1.0, 0, 1])
    p = {"W": rng.normal(size=(5, 3)), "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "c": rng.normal(size=3), "d": np.array(0.1)}

    def loss():
        z = quality.forward(p, x, bags)["logit"]
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    f = quality.forward(p, x, bags)
    g = quality.backward(p, x, f, (quality.sigmoid(f["logit"]) - y) / 3)
    for k in p:
        for at in np.ndindex(p[k].shape):
            old = float(p[k][at])
            p[k][at] = old + 1e-6
            up = loss()
            p[k][at] = old - 1e-6
            down = loss()
            p[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_quality_is_fitted_on_a_bounded_sample(spark):
    rows = [(k, "word " * (k % 7 + 1)) for k in range(400)] + [(400, "long " * 2000), (401, None), (3, "a repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(410)] + [(5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    whole = quality.training_rows(docs, labels, quality.Settings()).collect()
    assert sorted((r["doc_id"], r["label"]) for r in whole) == [(k, k % 2) for k in range(402)]
    assert {r["text"] for r in whole if r["doc_id"] == 3} == {min("a repeated id", rows[3][1])}
    most = 480
    part = quality.training_rows(docs, labels, quality.Settings(fit_bytes=most)).collect()
    for k in (0, 1):
        sizes = [len((r["text"] or "").encode()) for r in part if r["label"] == k]
        assert most - 30 < sum(sizes) <= most and max(sizes) <= most / 16
    assert len(quality.training_rows(docs, labels, quality.Settings(fit_rows=4)).collect()) == 8


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(7, 1), (8, 0), (99, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(edge, labels)
    assert got.count() == len(EDGE) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(empty, labels).count() == 0 and quality.classify(edge, labels.limit(0)).count() == len(EDGE)
    model = quality.fit(edge, labels)
    assert quality.remove_poor(edge, model).columns == edge.columns


def test_language_is_learned(spark):
    got = entries.QUERIES["op4_language"](spark, MEDIUM).join(table(spark, "documents", MEDIUM).select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98
    assert held.score.mean() == pytest.approx((held.lang_pred == held.lang).mean(), abs=0.03)
    assert set(got.held_out.unique()) == {True, False}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for h, i in zip(got.held_out, got.doc_id, strict=True))


def test_languages_of_any_number_and_repeated_rows(spark):
    """A thousand languages are as many classes; a row repeated ten thousand times is one of the sample."""
    words = ["alpha beta", "gamma delta", "omega rho"]
    rows = [(k, f"{words[k % 3]} {k}", f"l{k % 1000}") for k in range(3000)] + [(1, "alpha beta 1", "l1")] * 10_000
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Settings(buckets=256, fit_rows=3))
    assert len(model.languages) == 1000 and model.weights.shape == (256, 1000)


def test_language_weights_are_sparse_and_temperature_fits():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        y = k % 2
        rows.append((y, np.array([y, *rng.integers(2, 200, 5)]), np.full(6, 0.5)))
    w, bias = langid.ftrl(rows, 2, langid.Settings(buckets=256, l1=1.0))
    assert (w == 0).mean() > 0.5 and w[0, 0] > 0 > w[0, 1]
    assert langid.temperature(np.array([[8.0, 0], [8, 0], [8, 0], [8, 0]]), np.array([0, 0, 0, 1])) > 4


def test_language_edges(edge, empty):
    got = {(r["doc_id"] or -1): (r["lang_pred"], r["score"]) for r in langid.identify(edge).collect()}
    assert got[1] == got[2] == got[4] == ("und", 0.0) and got[7][0] == "en"
    assert langid.identify(empty).count() == 0
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(edge, nothing).collect()} == {"und"}
    assert sorted(r["doc_id"] or -1 for r in langid.remove_unidentified(edge, langid.fit(edge)).collect()) == [-1, 3, 3, 5, 6, 7, 8]


def test_language_of_astral_symbols(spark, edge):
    texts = ["😀🚀 🎉", "\U0001d7d8", "𐐀", "𠀀😀", "a😀"]
    codes, at = langid.letters(pa.array(texts))
    assert [codes[a:b][codes[a:b] != 0].tolist() for a, b in zip(at, at[1:])] == [[], [], [ord("𐐨")], [ord("𠀀")], [ord("a")]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(rows, langid.fit(edge)).collect()}
    assert got[0] == got[1] == ("und", 0.0) and got[2][0] == got[3][0] == got[4][0] == "en"


def test_folds(spark):
    rows = spark.range(50).select("id", fold_of("id", 3).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in rows)


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_keep_copies_together(spark):
    docs = table(spark, "documents", MEDIUM)
    hot = spark.range(10_000, 10_900).select(F.col("id").alias("doc_id"), F.lit("copy " * 300).alias("text"))
    docs = docs.select("doc_id", "text").unionByName(hot)
    got = sharding.histogram_shards(docs).toPandas()
    text = docs.toPandas().set_index("doc_id").text
    assert len(got) == len(text) and got.doc_id.is_unique
    text = text.sort_index()
    size, by_id = text.map(lambda t: len(t.encode()) + 1), got.set_index("doc_id").sort_index()
    assert (by_id["size"] == size).all()
    assert (by_id.text_crc32 == text.map(lambda t: zlib.crc32(t.encode()))).all()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and (sums - sums.sum() / 16).abs().max() <= size.max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    groups = got.assign(text=got.doc_id.map(text)).groupby("text").shard.agg(["min", "max", "nunique"])
    assert (groups["nunique"] == groups["max"] - groups["min"] + 1).all()


@pytest.mark.parametrize("rows", [
    [(k if k % 2 else (1 << 63) - 1 - k, "same text") for k in range(20)] + [(-(1 << 63) + k, "same text") for k in range(20)],
    [(7, "repeated")] * 400 + [(k, f"t{k}") for k in range(100)],
    [(None, "repeated")] * 300 + [(None, None)] * 100,
])
def test_shards_split_any_ids_and_repeated_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.histogram_shards(docs, 4).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(sums) == 4 and sums.max() - sums.min() <= 2 * got["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    # Brute force: shards follow the order of (hash, id), cut where the bytes before a row reach a share.
    text = F.coalesce("text", F.lit(""))
    order = docs.select(F.shiftrightunsigned(F.xxhash64(text), 2).alias("h"), F.coalesce("doc_id", F.lit(0)).alias("k"), (F.length(text) + 1).alias("n")).toPandas().sort_values(["h", "k"])
    ideal = ((order.n.cumsum() - order.n) * 4 / order.n.sum()).astype(int).value_counts()
    assert all(abs(ideal.get(k, 0) - n) <= 2 for k, n in got["shard"].value_counts().items())


def test_shard_edges(edge, empty):
    got = sharding.histogram_shards(edge).toPandas()
    assert len(got) == len(EDGE) and got[got.doc_id == 1]["size"].item() == 1 and got[got.doc_id == 1].text_crc32.item() == 0
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.histogram_shards(empty).count() == 0


# --- 7 and 8 ---------------------------------------------------------------------------------------------------------


def article_text(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
    return "\n".join(b for b in blocks if b)


def test_pages_keep_their_article(spark):
    got = entries.QUERIES["op7_html"](spark, SMALL).join(table(spark, "pages").select("page_id", "html"), "page_id").toPandas()
    assert [article_text(page) for page in got.html] == list(got.text)
    assert (got.n_chars == got.text.str.len()).all()


def test_furniture_goes_and_shared_lines_go():
    page = """<html><body><header>Site</header><div id="main-content"><div>Menu text on all pages</div><p>Own &eacute; text&nbsp;here<br>on</p><form>Search</form>
        <div class="cookie-notice">Cookies</div><div class=comments><p>Nice!</p></div><aside>Side</aside><div class="ad">Buy</div><p>Last<script>x()</script></p></div><footer>End</footer></body></html>"""
    lines = htmltext.lines_of(page)
    assert htmltext.main_text(lines, ["Menu text on all pages", "Other"]) == "Own é text here on\nLast"
    article = htmltext.lines_of("<nav>a</nav><article><header><h1>T</h1></header><p>shared</p></article><p>outside</p>")
    assert htmltext.main_text(article, ["shared", "outside"]) == "T\nshared"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><div class="entry-header"><h1>Headline</h1></div><p>Body</p></article>', "Headline\nBody"),
        ('<article><div class="social-history"><p>Body</p></div></article>', "Body"),
        ('<article><section id="notification-protocols"><p>Body</p></section></article>', "Body"),
        ('<div class="main ad-free"><p>Body</p></div>', "Body"),
        ('<article><p>Body</p></article><div class="user-reviews"><p>Good</p></div>', "Body"),
        ('<article><p>Body</p><div class="related-links box">More</div></article><div id="cookie-notice">OK</div><div class="Site-Header">S</div>', "Body"),
    ],
)
def test_class_words_delete_furniture_and_no_article(html, text):
    assert htmltext.main_text(htmltext.lines_of(html), None) == text


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(htmltext.common_lines(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[k] in rest for k in found)


def character_rates(got, wanted):
    """Precision and recall of lines, by characters."""
    hit = found = all_ = 0
    for k, text in wanted.items():
        a, b = Counter(got[k].split("\n")), Counter(text.split("\n"))
        hit += sum(len(line) * n for line, n in (a & b).items())
        found += sum(len(line) * n for line, n in a.items())
        all_ += sum(len(line) * n for line, n in b.items())
    return hit / found, hit / all_


def test_differencing_alone_finds_the_articles(spark):
    """Without lists of kinds pages come out by differencing; without the alignment of regions most pages would change."""
    pages = table(spark, "pages", MEDIUM)
    wanted = {r["page_id"]: article_text(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages, kinds=False).collect()}
    paired_ = pages.groupBy(urlfilter.host_of(F.col("url")).alias("host")).agg(F.collect_list("page_id").alias("ids")).where(F.size("ids") > 1).collect()
    ids = [i for r in paired_ for i in r["ids"]]
    precision, recall = character_rates({i: got[i] for i in ids}, {i: wanted[i] for i in ids})
    assert min(precision, recall) >= 0.95
    # The same pages with no region ever aligned, read here as the workers would.
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    changed = 0
    for i in ids:
        page = htmltext.page_of(html[i], kinds=False)
        regions = htmltext.regions_of(page)
        columns = [list(c) for c in zip(*page.lines, strict=True)]
        bare = htmltext.kept(columns[0], columns[2], columns[1], regions, set(), set(), [])
        changed += bare != got[i]
    assert changed > 0.7 * len(ids)


@pytest.mark.parametrize(
    ("own", "other", "text"),
    [
        # A menu of other words and another length goes by its shape; a box that the other page lacks stays.
        ("<ul class=m><li>a<li>b</ul><div class=t><p>Long story here<p>and more of it</div><div class=x>Only here</div>", "<ul class=m><li>c<li>d<li>e</ul><div class=t><p>Other long text<p>and its end</div>", "Long story here\nand more of it\nOnly here"),
        # Regions in another order still align.
        ("<div class=n1>q</div><div class=ad>r</div><div class=t><p>Long story here<p>and more of it</div>", "<div class=ad>s</div><div class=n9>u</div><div class=t><p>Other long text<p>and its end</div>", "Long story here\nand more of it"),
        # Headings and paragraphs beside the main region are text.
        ("<h1>Head</h1><p>Lead</p><div class=t><p>Long story here<p>and more of it</div>", "<h1>Tail</h1><p>Load</p><div class=t><p>Other long text<p>and its end</div>", "Head\nLead\nLong story here\nand more of it"),
        # No element holds most of the text: nothing goes by shape.
        ("<div class=a>one</div><div class=b>two</div>", "<div class=a>uno</div><div class=b>due</div>", "one\ntwo"),
        ("<span role=navigation><div>x</div></span><article><p>Text</p><span role=menu>In<p>More</p></span></article>", "", "Text"),
        ("<div>" * 3000 + "deep", "<div>other", "deep"),
    ],
)
def test_regions_align_by_shape(own, other, text):
    page, beside = htmltext.page_of(own), htmltext.page_of(other)
    lines, furniture, main = ([line[n] for line in page.lines] for n in range(3))
    assert htmltext.kept(lines, main, furniture, htmltext.regions_of(page), set(), set(), [r for r in htmltext.regions_of(beside) if r]) == text


def test_html_edges(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/b", "<p>unclosed <b>x"), (3, "http://h/b", "<p>unclosed <b>x"), (None, "h", "<div>&lt;&#x41;&bogus;</div>"), (4, "http://h/c", "<p>" * 3000 + "deep")]
    got = {(r["page_id"] or -1): r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "", 2: "", 3: "unclosed x", -1: "<A&bogus;", 4: "deep"}


def test_differencing_decides_inside_and_outside_an_article(spark):
    html = lambda k: f"<p>Site line</p><p>Lead {k}</p><article><p>Read on our site</p><p>Story {k}</p><p>{'Quoted' if k < 2 else f'Said {k}'}</p></article>"
    rows = spark.createDataFrame([(k, f"http://h/{k}", html(k)) for k in range(8)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(rows).collect()}
    assert got == {k: f"Lead {k}\nStory {k}\n{'Quoted' if k < 2 else f'Said {k}'}" for k in range(8)}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_copies_are_paired_alike_in_any_partitions(spark, parts):
    html = lambda k: f"<div>Menu</div><p>Own {k}</p>"
    rows = [(k, f"http://h{k % 2}/{k:03d}", html(k if k < 20 or k > 40 else k % 2)) for k in range(60)] + [(99, "http://h0/021", "")]
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)
    assert got == {k: f"Own {k if k < 20 or k > 40 else k % 2}" for k in range(60)} | {99: ""}


def test_a_very_common_host_is_paired_like_any(spark):
    """Brute force over the order of a site: hosts above and below the bound of the broadcast get the same lines."""
    html = lambda h, k: f"<p>Menu {h}</p><p>Own {h} {k}</p><article><p>Often {h}</p><p>Story {k}</p></article>"
    rows = [(h * 10_000 + k, f"http://h{h}/{k:04d}", html(h, k)) for h, n in ((0, 1200), (1, 6), (2, 1)) for k in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    assert got == {h * 10_000 + k: f"Own {h} {k}\nStory {k}" for h, n in ((0, 1200), (1, 6)) for k in range(n)} | {20_000: "Menu 2\nOwn 2 0\nOften 2\nStory 0"}


def test_url_rules(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12", "https://example.org/en/2", "https://x.org", "http://b.com/fr/9?q#f", "http://b.com/de/", "http://notorg/", None, "no scheme", "x://com/fr/://org/es/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [tuple(r) for r in urlfilter.judge(rows, entries.RULES).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert [g[:3] for g in got] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("x.org", "", None), ("b.com", "/fr/9", "com/fr/"),
        ("b.com", "/de/", "com/de/"), ("notorg", "/", None), ("", "", None), ("", "", None), ("com", "/fr/://org/es/", "com/fr/"),
    ]
    assert [g[3] for g in got if g[2]] == ["block", "block", "allow", "allow", "block", "allow"] and all(g[3] in ("allow", "block") for g in got)
    assert urlfilter.judge(rows.limit(0), entries.RULES).count() == 0


def test_every_suffix_keeps_its_statistics(spark):
    hosts = [f"a.d{k:04d}.net" for k in range(1500)]
    rows = spark.createDataFrame([(f"http://{h}/", h, "/", k % 2) for k, h in enumerate(hosts) for _ in range(1 + (k < 1200))], "url string, host string, path string, blocked int")
    got = {r["host"]: r for r in urlfilter.with_suffixes(rows.select("host").union(spark.createDataFrame([("new.org",), ("",)], "host string")).distinct(), rows).collect()}
    prior = (1350 + 0.5) / 2701
    assert len(got) == 1502 and all(got[h]["wide_share"] == pytest.approx((1 + (k < 1200)) / 2700) for k, h in enumerate(hosts))
    assert got[hosts[1499]]["wide_rate"] == pytest.approx((1 + 10 * prior) / 11) and got[hosts[0]]["narrow_share"] == 1
    assert got["new.org"]["wide_rate"] == got[""]["wide_rate"] == pytest.approx(prior) and got["new.org"]["wide_share"] == 0


def test_boosting_learns_and_generalises():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = urlfilter.boost(x[:3000], y[:3000])
    assert ((trees.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert urlfilter.boost(x[:10], np.zeros(10)).probability(x[:2]).max() < 0.01


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big = "z" * 2000
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 200), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    archives = warc.write_archives(warc.with_revisits(pages), 500)
    got = warc.read_archives(archives).toPandas()
    assert len(got) == len(rows)
    found = {(None if pd.isna(r.page_id) else int(r.page_id)): r for r in got.itertuples()}
    for i, _, html in rows:
        r, payload = found[i], (html or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        expected = 9 if html == big and i in (1, 2) else None
        assert (None if pd.isna(r.refers_to) else r.refers_to) == expected and r.record_type == ("revisit" if expected else "response")
        assert r.payload is None if expected else r.payload == payload
    assert warc.read_archives(warc.write_archives(warc.with_revisits(pages.limit(0)))).count() == 0


def test_damaged_archives_are_refused():
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert [warc.parse(m)["payload"] for m in warc.members(good + good)] == [b"payload"] * 2
    with pytest.raises(warc.BadRecord):
        list(warc.members(good[:-9]))
    bad = warc.record(1, "u", b"payload", "0" * 40, None)
    with pytest.raises(warc.BadRecord):
        [warc.parse(m) for m in warc.members(bad)]


# --- 10 --------------------------------------------------------------------------------------------------------------


def edit_brute(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edit_distance_is_exact():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in range(2))
        assert decontaminate.edit_distance(a, b)[0] == edit_brute(a, b)


def test_leaks_are_found_and_nothing_else(spark):
    docs, items = table(spark, "documents", MEDIUM), table(spark, "benchmark", MEDIUM)
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find(docs, items).collect()}
    plain = lambda t: " ".join(t.lower().split())
    texts = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    wanted = {r["item_id"]: plain(r["text"]) for r in items.collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in wanted.items() if x in t}
    assert exact and all(got.get(k) == 0 for k in exact)
    for (d, i), distance in got.items():
        assert distance <= 0.2 * len(wanted[i]) and ((d, i) in exact or distance == edit_brute(wanted[i], texts[d]))
    kept = decontaminate.remove(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(texts) - {d for d, _ in got}


@pytest.mark.parametrize(("rate", "least"), [(0.05, 0.99), (0.1, 0.95)])
def test_recall_under_edits(spark, rate, least):
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark", "/root/testdata/sf0.1").collect()]
    rng, texts = random.Random(6), []
    for _, t in items:
        c = list(" ".join(t.lower().split()))
        for _ in range(int(rate * len(c))):
            k, how = rng.randrange(len(c)), rng.random()
            c[k : k + (how < 0.7)] = [] if how < 0.3 else [rng.choice("abcdefgh ")]
        texts.append("some words before " + "".join(c) + " and after")
    index = decontaminate.index(items)
    found = decontaminate.search(pa.array(texts), index, decontaminate.Walks(index.settings))
    assert sum((k, k) in found for k in range(len(items))) / len(items) >= least


@pytest.mark.parametrize("rate", [0.15, 0.2])
def test_recall_up_to_the_edits_allowed(spark, rate):
    test_recall_under_edits(spark, rate, 0.9)


# Shares of edits that replace, delete and insert a character.
MIXES = {"equal": (1 / 3, 1 / 3, 1 / 3), "replacing": (1, 0, 0), "moving": (0, 0.5, 0.5)}


def damaged(text, rate, mix, rng):
    c = list(" ".join(text.lower().split()))
    for _ in range(int(rate * len(c))):
        k, how = rng.randrange(len(c)), rng.choices(("replace", "delete", "insert"), mix)[0]
        c[k : k + (how != "insert")] = [] if how == "delete" else [rng.choice("abcdefgh ")]
    return "".join(c)


@pytest.mark.parametrize("mix", MIXES)
@pytest.mark.parametrize(("rate", "least"), [(0.1, 0.99), (0.15, 0.97), (0.2, 0.92)])
def test_recall_of_every_mix_against_brute_force(spark, mix, rate, least):
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark", "/root/testdata/sf0.1").collect()]
    rng = random.Random(7)
    texts = ["some words before " + damaged(t, rate, MIXES[mix], rng) + " and after" for _, t in items]
    index = decontaminate.index(items)
    near = [k for k in range(len(items)) if decontaminate.edit_distance(index.texts[k], re.sub(" +", " ", texts[k]))[0] <= int(0.2 * len(index.texts[k]))]
    found = decontaminate.search(pa.array(texts), index, decontaminate.Walks(index.settings))
    assert len(near) > 0.9 * len(items)
    assert sum((k, k) in found for k in near) / len(near) >= least


def test_items_are_found_in_text_without_spaces():
    rng = random.Random(10)
    write = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(n))
    items = [write(rng.randrange(33, 120)) for _ in range(40)]
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    items += [" ".join(rng.sample(words, 14)) for _ in range(40)] + ["a_b_c_d" * 12, "_" * 70, "-_" * 40]
    index = decontaminate.index(list(enumerate(items)))
    walks = decontaminate.Walks(index.settings)

    def hold(texts):
        found = decontaminate.search(pa.array(texts), index, walks)
        return [(k, k) in found for k in range(len(texts))]

    assert all(hold([write(50) + t + write(50) for t in items]))
    assert all(hold(["x" + t + "y" for t in items]))
    for by in ("_", "-", "", "  "):
        assert all(hold([write(9) if k < 40 else "some words " + t.replace(" ", by) + " go on" for k, t in enumerate(items)])[40:80]), by
    assert all(hold([write(30) + t[: len(t) // 2] + write(2) + t[len(t) // 2 + 2 :] + write(30) for t in items[:40]]))


def test_short_items_are_found_with_edits():
    rng = random.Random(8)
    items = ["".join(rng.choice("abcd é") for _ in range(rng.randint(5, 39))).strip().replace("  ", " a") for _ in range(60)]
    texts = ["".join(rng.choice("abcd é,") for _ in range(rng.randint(0, 70))) for _ in range(60)] + [f'"{x[:3]}{x[4:]}".' for x in items] + [None, ""]
    index = decontaminate.index(list(enumerate(items)))
    found = decontaminate.search(pa.array(texts), index, decontaminate.Walks(index.settings))
    for row, text in enumerate(texts):
        for n, item in zip(index.ids, index.texts, strict=True):
            distance = edit_brute(item, re.sub(" +", " ", text or ""))
            assert found.get((row, n), (None,))[0] == (distance if distance <= int(0.2 * len(item)) else None)
    assert all((60 + n, n) in found for n in range(60))
    tiny = decontaminate.index([(1, "cat"), (2, "漢字")])
    rows = pa.array(["a (Cat), here", "concatenate", "cat", "這漢字是", "cat" * 2])
    assert sorted(decontaminate.search(rows, tiny, decontaminate.Walks(tiny.settings))) == [(0, 0), (2, 0), (3, 1)]


def test_decontamination_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (4, "x " * 40)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(edge, items).collect()}
    assert got == {(7, 3), (8, 3), (5, 4)}
    assert decontaminate.find(empty, items).count() == 0 and decontaminate.find(edge, items.limit(0)).count() == 0
    assert decontaminate.remove(edge, items.limit(0)).count() == len(EDGE)


def long_text(size: int) -> str:
    rng = random.Random(9)
    words = ["alpha", "BETA,", "gamma", "d\u00e9lta", "\u20ac5", "\U0001f600", "x", "  ", "\n", "42", "the end."]
    out, n = [], 0
    while n < size:
        out.append(rng.choice(words))
        n += len(out[-1].encode()) + 1
    return " ".join(out)


def test_long_texts_in_parts_give_what_they_give_whole(monkeypatch):
    text = long_text(60_000)
    column = pa.array([text], pa.string())
    rng = np.random.default_rng(3)
    s = langid.Settings()
    lang = langid.Model(s, ["a", "b", "c"], rng.random(s.buckets), rng.normal(size=(s.buckets, 3)), np.zeros(3), 1.0)
    q = quality.Settings()
    x, bags = quality.features(column, q.words)
    model = quality.train(np.vstack([x, x[:1] + 1]), np.array([*bags, 1]), np.array([1.0, 0.0]), quality.Settings(steps=3))
    v = sentencepiece.load()
    whole = langid.score(lang, column), model.score_texts(column), jaccard.word_hashes(column), sentencepiece.encode([column], v)[0]
    for module in (langid, quality, jaccard):
        monkeypatch.setattr(module, "SLICE_BYTES", 7_001)
    monkeypatch.setattr("folioscope.llm.common.rows_by_size.__defaults__", (7_001,))
    monkeypatch.setattr("folioscope.llm.common.pieces_at.__defaults__", (7_001,))
    assert np.allclose(whole[0][0], langid.score(lang, column)[0]) and langid.score(lang, column)[1].all()
    assert np.allclose(whole[1], model.score_texts(column))
    assert (whole[2][0] == jaccard.word_hashes(column)[0]).all()
    assert whole[3].to_pylist() == sentencepiece.encode_long(column, v, sentencepiece.Follows(v)).to_pylist()


def test_sites_edges(spark):
    """Clashing columns, repeated rows and an empty table change nothing for pages and their URLs."""
    html = lambda k: f"<p>Menu</p><article><p>Own {k}</p></article>"
    rows = [(1, "http://h/a?x#y", html(1)), (2, "http://h/b", html(2)), (2, "http://h/b", html(2)), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = pages.withColumns({c: F.lit("extra") for c in ("host", "path", "text", "digest", "keys", "lines", "main", "rule", "score", "blocked", "suffix", "shared", "often", "n")})
    for table_ in (pages, clash):
        got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in htmltext.extract(table_).collect())
        assert got == [(0, "", 0), (1, "Own 1", 5), (2, "Own 2", 5), (2, "Own 2", 5)]
        judged = [(r["page_id"], r["host"], r["path"]) for r in urlfilter.judge(table_, entries.RULES).collect()]
        assert sorted(judged, key=str) == sorted([(1, "h", "/a"), (2, "h", "/b"), (2, "h", "/b"), (None, "", "")], key=str)
    assert htmltext.extract(pages.limit(0)).count() == 0 and urlfilter.judge(pages.limit(0), entries.RULES).count() == 0


def test_urls_of_hosts_not_learned_from(spark):
    """The trees give what the rules say of URLs whose hosts they have not seen."""
    rng = random.Random(4)
    hosts = [f"{w}{k}.{t}" for k in range(40) for w, t in ((("shop", "com")), ("wiki", "org"))]
    rows = [(k, f"http://{(h := hosts[k % 80])}/{'de/deal' if h.endswith('com') and k % 3 else 'page'}/{rng.randint(1, 9999)}") for k in range(4000)]
    rules = [urlfilter.Rule("org", "/", urlfilter.ALLOW), urlfilter.Rule("com", "/de/", urlfilter.BLOCK), urlfilter.Rule("com", "/page/", urlfilter.ALLOW)]
    held = [urlfilter.Rule(f"{h}", "/", urlfilter.BLOCK) for h in hosts[60:]]
    urls = spark.createDataFrame(rows, "page_id long, url string")
    truth = {r["page_id"]: r["verdict"] for r in urlfilter.judge(urls, rules).collect()}
    unseen = urls.where(~F.col("url").rlike("|".join(re.escape(r.host) + "/" for r in held)))
    hidden = urls.join(unseen, "page_id", "left_anti").withColumn("url", F.regexp_replace("url", "^http://([^./]+)[.](com|org)", "http://$1.$2.example"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(unseen.unionByName(hidden), rules).collect()}
    judged = [k for k, (rule, _) in got.items() if rule is None]
    assert len(judged) == hidden.count() and np.mean([got[k][1] == truth[k] for k in judged]) > 0.9
