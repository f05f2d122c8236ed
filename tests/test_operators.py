from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalog, context, evaluate, release, search, vectors, workflow
from folioscope.sources import vault
from folioscope.sources.shared import with_rank


def indexed(spark, texts, titles=None):
    rows = [(i, f"p/{i:03d}", (titles or {}).get(i, "none"), "cat", "cl", ["t"], t) for i, t in enumerate(texts)]
    return search.index(spark.createDataFrame(rows, "doc_id int, path string, title string, category string, client string, tags array<string>, text string"))


def order(df):
    return [r["doc_id"] for r in df.collect()]


def test_repeated_terms_rank_first_and_substrings_do_not_count(spark):
    docs = indexed(spark, ["one box here with words", "box box box box box", "boxes only"])
    assert order(search.search(docs, search.SearchQuery("box"), "doc_id")) == [1, 0]


def test_a_short_exact_text_beats_a_long_repetitive_one(spark):
    docs = indexed(spark, ["rare phrase", "common " * 500 + "phrase"])
    assert order(search.search(docs, search.SearchQuery("rare phrase"), "doc_id"))[0] == 0


def test_filters_do_not_move_the_statistics(spark):
    docs = indexed(spark, ["box", "box", "other"])
    alone = search.bm25(docs.where("doc_id = 0"), search.SearchQuery("box"), ["box"]).first()["raw"]
    part = search.bm25(docs, search.SearchQuery("box", category="cat"), ["box"]).where("doc_id = 0").first()["raw"]
    assert alone != pytest.approx(part)


def test_boosts_browse_and_stop_words(spark):
    docs = indexed(spark, ["box", "box"], {1: "box"})
    assert order(search.search(docs, search.SearchQuery("box"), "doc_id")) == [1, 0]
    assert order(search.search(docs, search.SearchQuery(), "doc_id")) == [0, 1]
    assert order(search.search(docs, search.SearchQuery("the"), "doc_id")) == []
    assert order(search.search(docs, search.SearchQuery("box", tags=("T", "missing")), "doc_id")) == []


def test_query_limits():
    for bad in ({"limit": 201}, {"offset": 1_000_001}, {"term": "x" * 2001}):
        with pytest.raises(ValueError):
            search.SearchQuery(**bad)


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 5) for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1, 0, -1, 0, 0]


def test_fusion_keeps_one_row_and_both_beat_one_at_parity(spark):
    lex = spark.createDataFrame([(1, 10.0), (2, 10.0), (4, 1.0)], "id int, lex double")
    sem = spark.createDataFrame([(1, 0.9), (3, 0.9), (5, 0.3)], "id int, sem double")
    rows = {r["id"]: r["f2"] for r in vectors.fused(vectors.coalesced(lex, sem, "id"), "id").collect()}
    assert len(rows) == 5 and rows[1] > rows[2] == rows[3] > rows[4]


def test_coverage_without_passages(spark):
    p = spark.createDataFrame([], "passage_id string, sha256 string")
    assert vectors.coverage(p, p).first().asDict() == {"total": 0, "cached": 0, "missing": 0, "ratio": 1.0, "available": False}


def test_recall_counts_queries_without_relevant_documents_as_found(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, 7, 1, 2.0), (1, 8, 2, 2.0), (2, 9, 1, 1.0)], "query_id int, doc_id int, rank int, score double")
    rel = spark.createDataFrame([(1, 8), (1, 5), (2, 4)], "query_id int, doc_id int")
    assert {r["query_id"]: r["recall"] for r in evaluate.recall(hits, rel, q).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
    assert {r["query_id"]: r["first_rank"] for r in evaluate.first_hits(hits, rel, q).collect()} == {1: 2, 2: None, 3: None}
    assert {r["query_id"]: r["tied"] for r in evaluate.ties_at_top(hits).collect()} == {1: 2, 2: 1}


def test_percentiles_interpolate(spark):
    v = spark.createDataFrame([(x,) for x in (1, 2, 4, 10)], "v int").withColumn("g", F.lit(0))
    assert evaluate.percentiles(v, "v", ["g"]).first()["p95"] == pytest.approx(9.1)


def test_catalog(spark):
    files = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "path string, sha256 string")
    assert {(r["path"], r["canonical"], r["copies"]) for r in catalog.deduplicated(files).collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "c", 1)}
    known = spark.createDataFrame([("a", "x", 1), ("b", "y", 3), ("z", "q", 1)], "path string, sha256 string, revision long")
    got = {r["path"]: (r["change"], r["revision"]) for r in catalog.reconciled(known, files).collect()}
    assert got == {"a": ("unchanged", 1), "b": ("revised", 4), "c": ("added", 1), "z": ("removed", 1)}
    assert {r["path"] for r in catalog.pruned(known, files, F.lit(True)).collect()} == {"a", "b"}


def test_path_resolution_reports_homonyms(spark):
    cat = spark.createDataFrame([("x/n.md",), ("y/n.md",), ("x/m.md",)], "path string")
    alias = spark.createDataFrame([("old.md", "x/m.md")], "alias string, path string")
    wanted = spark.createDataFrame([("n.md",), ("m.md",), ("old.md",), ("x/n.md",), ("none",)], "name string")
    got = {r["name"]: (r["matches"], r["path"]) for r in catalog.resolved(wanted, cat, alias).collect()}
    assert got == {"n.md": (2, None), "m.md": (1, "x/m.md"), "old.md": (1, "x/m.md"), "x/n.md": (1, "x/n.md"), "none": (0, None)}


def test_eligibility_and_packing(spark):
    rows = [("20_RAW_SOURCES/a.txt", "c", "auto"), ("20_RAW_SOURCES/secrets/a.txt", "c", "auto"), ("01/a.md", "c", "approved"), ("01/a.md", "proposal", "approved"), ("01/a.md", "c", "draft")]
    df = spark.createDataFrame(rows, "p string, c string, s string")
    assert [r[0] for r in df.select(context.eligible(F.col("p"), F.col("c"), F.col("s"))).collect()] == [True, False, True, False, False]
    items = spark.createDataFrame([(i, s) for i, s in enumerate([10, 20, 5, 4])], "id int, size long").withColumn("g", F.lit(0))
    assert sorted(r["id"] for r in context.packed_with_skips(items, ["g"], F.col("id"), "id", "size", 19).collect()) == [0, 2, 3]


def test_release_chain_refuses_a_cycle(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", None)], "release_id string, parent_id string")
    assert {r["release_id"]: r["hop"] for r in release.release_chain(rows, "d", 6).collect()} == {"d": 0, "e": 1}
    with pytest.raises(Exception, match="cycle"):
        release.release_chain(rows, "a", 6).collect()


def test_large_releases_and_folders_are_refused(spark):
    files = spark.range(4).select(F.lit("r").alias("release_id"), F.concat(F.lit("01_CLIENTS/"), F.col("id").cast("string"), F.lit(".md")).alias("relativePath"))
    releases = spark.createDataFrame([("r", None)], "release_id string, parent_id string")
    with pytest.raises(Exception, match="too many documents"):
        release.manifest_hash(files, releases, most=3).collect()
    listed = files.select(F.col("relativePath").alias("path"), F.lit("t").alias("title"), F.lit("draft").alias("status"), F.lit(9).alias("size"))
    assert release.browsed(listed).count() == 4
    with pytest.raises(Exception, match="too large"):
        release.browsed(listed, most=3).collect()
    with pytest.raises(ValueError):
        release.browsed(listed, "elsewhere")


def test_changed_passages_are_refused(spark):
    rows = spark.createDataFrame([("d", "p1", "l", "text", "no hash of it")], "document_id string, passage_id string, locator string, text string, sha256 string")
    with pytest.raises(Exception, match="changed"):
        catalog.read_passage(rows, "d", "p1").collect()


def test_ranks_over_many_partitions(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7 % 10).alias("x")).repartition(9)
    got = [r["id"] for r in with_rank(rows, [F.desc("x"), F.col("id")]).orderBy("rank").collect()]
    assert got == sorted(range(1000), key=lambda i: (-(i * 7 % 10), i))


def test_gold_queries(spark, tmp_path):
    (tmp_path / "g.json").write_text('[\n{"queryId": "q1", "text": "a", "relevantDocumentIds": ["x", "y"]},\n{"queryId": "q2", "text": "b", "relevantDocumentIds": []}]')
    assert {tuple(r) for r in vault.read_gold(spark, str(tmp_path / "g.json")).collect()} == {("q1", "a", "x"), ("q1", "a", "y"), ("q2", "b", None)}


def test_operation_ids_with_two_payloads_conflict(spark):
    rows = spark.createDataFrame([("o1", "x"), ("o1", "x"), ("o2", "x"), ("o2", "y")], "o string, p string")
    assert {r["o"]: r["conflict"] for r in workflow.operations(rows, "o", "p").collect()} == {"o1": False, "o2": True}


def test_office_files(spark):
    def archive(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in files.items():
                z.writestr(name, content)
        return out.getvalue()

    w = 'xmlns:w="http://w"'
    docx = archive({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>"})
    m = 'xmlns="http://m"'
    xlsx = archive({
        "xl/workbook.xml": f'<workbook {m}><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {m}><si><t>shared</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>',
    })
    r = 'xmlns:r="http://r"'
    rels = "<R><Relationship Id='a' Target='slides/slide2.xml'/><Relationship Id='b' Target='slides/slide1.xml'/></R>"
    slide = lambda x: f"<s {w}><w:p><w:t>{x}</w:t></w:p></s>"
    pptx = archive({"ppt/presentation.xml": f"<p {r}><sldId r:id='a'/><sldId r:id='b'/></p>", "ppt/_rels/presentation.xml.rels": rels, "ppt/slides/slide1.xml": slide("last"), "ppt/slides/slide2.xml": slide("first")})
    bomb = archive({"word/document.xml": "<!DOCTYPE x><a/>"})
    rows = spark.createDataFrame([("a.docx", docx), ("b.xlsx", xlsx), ("c.docx", b"no zip"), ("d.docx", bomb), ("e.pptx", pptx)], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"] is None) for r in vault.extract_office(rows).collect()}
    assert got["a.docx"] == ("Hello\n\nWorld", True)
    assert got["e.pptx"] == ("## Slide 1\n\nfirst\n\n## Slide 2\n\nlast", True)
    assert got["b.xlsx"] == ("## Foglio: S\n- Riga 1, colonna 1: shared\n- Riga 2, colonna 3: 7", True)
    assert not got["c.docx"][1] and not got["d.docx"][1]


def test_open_and_binary_spreadsheets():
    def ods(rows):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("content.xml", f"<d xmlns:t='http://t' xmlns:p='http://p' xmlns:o='http://o'><t:table t:name='S'>{rows}</t:table></d>")
        return out.getvalue()

    full = "<t:table-cell{}><p:p>a</p:p><p:p>b</p:p></t:table-cell>".format
    text = vault.office_text(ods(f"<t:table-row t:number-rows-repeated='2'>{full('')}<t:table-cell t:formula='of:=1'/></t:table-row><t:table-row>{full(' o:value=' + repr('3'))}</t:table-row>"), "ods")
    assert text == "## Foglio: S\n- Riga 1, colonna 1: a\nb\n- Riga 2, colonna 1: a\nb\n- Riga 3, colonna 1: 3\n- Formula riga 1, colonna 2: `of:=1`\n- Formula riga 2, colonna 2: `of:=1`"
    for rows in (f"<t:table-row>{full(' t:number-columns-repeated=' + repr('9999999'))}</t:table-row>", f"<t:table-row t:number-rows-repeated='9999999'>{full('')}</t:table-row>"):
        with pytest.raises(ValueError, match="too many cells"):
            vault.office_text(ods(rows), "ods")
    with pytest.raises(ValueError, match="unsupported"):
        vault.office_text(b"\xd0\xcf\x11\xe0", "xls")


def test_a_folder_too_large_to_browse_is_an_error(spark):
    rows = spark.createDataFrame([(f"01_CLIENTS/{k}.md", None, None, 100) for k in range(4)], "path string, title string, status string, size long")
    assert release.browsed(rows, "01_CLIENTS", most=4).count() == 4
    for bounds in ({"most": 3}, {"total": 399}, {"largest": 99}):
        with pytest.raises(Exception, match="too large to browse"):
            release.browsed(rows, "01_CLIENTS", **bounds).collect()


def test_folders_skip_hidden_and_large_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hid").mkdir()
    for name in ("a.md", "sub/b.markdown", ".hid/c.md", "d.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "big.md").write_text("x" * 100)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in vault.read_folder(spark, str(tmp_path), most=50).collect()) == ["a.md", "b.markdown"]


def test_a_tick_counts_calls_and_keeps_order(spark):
    sources = spark.createDataFrame([(f"s{k}", f"h{k}") for k in range(6)], "path string, sha256 string")
    none = spark.createDataFrame([], "path string, fingerprint string, status string, attempts int, current boolean")
    first = workflow.ticked(sources, none, "v", "m")
    assert {r["path"] for r in first.where("called").collect()} == {"s0", "s1", "s2"} and first.where("status = 'pending'").count() == 3
    # A call that never came back has used an attempt; after three of them a job is left alone.
    jobs = first.drop("called").withColumn("current", F.lit(False))
    for _ in range(2):
        jobs = workflow.ticked(sources, jobs, "v", "m").drop("called").withColumn("current", F.lit(False))
    then = workflow.ticked(sources, jobs, "v", "m")
    assert {r["path"] for r in then.where("called").collect()} == {"s3", "s4", "s5"}
    assert workflow.ticked(sources, jobs, "v", "other").where("attempts = 0").count() == 3
    assert {r["status"] for r in workflow.ticked(sources.limit(0), jobs, "v", "m").collect()} == {"removed"}


def test_a_sync_embeds_once_and_refuses_other_sizes(spark):
    passages = spark.createDataFrame([(f"p{k}", f"h{k}", f"e{k}", "x" * k) for k in range(40)], "passage_id string, sha256 string, embedded_text_sha256 string, embedded_text string")
    none = spark.createDataFrame([], "passage_id string, sha256 string, embedded_text_sha256 string, model string, dimensions int, vector array<double>")

    def embed(texts):
        assert len(texts) <= 16
        return [[float(len(t))] for t in texts]

    made = vectors.synced(passages, none, embed, "m", 1)
    assert sorted(r["vector"][0] for r in made.collect()) == list(range(40))
    again = vectors.synced(passages.where("passage_id <> 'p7'"), made, lambda texts: 1 / 0, "m", 1)
    assert again.count() == 39
    with pytest.raises(Exception, match="vectors of another number or size"):
        vectors.synced(passages, none, embed, "m", 2).count()
