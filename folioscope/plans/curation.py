"""Queries over the life of a knowledge base: files, catalog, embeddings, passages, wikis, releases, proposals.

States that the driver's tables do not hold are made from doc_id by arithmetic; the SQL twins state what must come
out for each remainder, they do not repeat the operator.
"""

from __future__ import annotations

import contextlib
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import catalog, context, migration, release, vectors, workflow
from folioscope.plans import dialect as D
from folioscope.plans.base import ORACLES, docs, files, mod, query
from folioscope.sources import vault
from folioscope.sources.shared import new_folder

def ident() -> Column:
    return F.col("doc_id").cast("string")


def case(n: int, values: list, otherwise=None) -> Column:
    """values[doc_id % n], for the remainders there are values for."""
    out = F.lit(otherwise)
    for k, v in enumerate(values):
        out = F.when(mod(n, k), v).otherwise(out)
    return out


# --- text and sources ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN trim(text) <> '' THEN sha256('x' || chr(10) || replace(text, chr(13) || chr(10), chr(10))) END AS decoded FROM documents WHERE doc_id % 4 < 3 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 4 = 3")
def plain_decode(s, d):
    text = F.concat(F.lit("x\r\n"), "text")
    utf8, little, big = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")), F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")), F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))
    content = F.when(mod(4), utf8).when(mod(4, 1), little).when(mod(4, 2), big).otherwise(F.encode(F.lit(" \r\n "), "UTF-8"))
    return docs(s, d).select("doc_id", F.sha2(vault.decode_text(content), 256).alias("decoded"))


def _notes(s: SparkSession, d: str) -> DataFrame:
    """documents as Markdown notes, with and without front matter and headings."""
    head = case(5, [
        F.concat(F.lit('---\ntitle: "Note '), ident(), F.lit('"\nstatus: draft\nclient: acme\n---\n# Other\n')), F.concat(F.lit("# Heading "), ident(), F.lit("\n")), F.lit("---\nstatus: unheard\n---\n"),
        F.lit("---\ntitle: never closed\n"), F.lit("---\r\nclient: 'beta'\r\n---\r\n"),
    ], "")
    body = F.regexp_replace("text", "(?m)^(#|---)", "x")
    return docs(s, d).select("doc_id", F.concat(F.lit("01_CLIENTS/some-client_"), ident(), F.lit(".md")).alias("path"), F.concat(head, body).alias("text"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Note ' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'Heading ' || CAST(doc_id AS VARCHAR) ELSE 'some client ' || CAST(doc_id AS VARCHAR) END AS title FROM documents")
def note_titles(s, d):
    return _notes(s, d).select("doc_id", vault.title_of(F.col("text"), F.col("path")).alias("title"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 IN (2, 3) THEN 'INVALID' ELSE 'READY' END AS state, CASE doc_id % 5 WHEN 0 THEN 'Note ' || CAST(doc_id AS VARCHAR) END AS title,
    CASE doc_id % 5 WHEN 0 THEN 'draft' WHEN 2 THEN 'unheard' ELSE 'approved' END AS status, CASE doc_id % 5 WHEN 0 THEN 'acme' WHEN 4 THEN 'beta' END AS client FROM documents""")
def front_matter(s, d):
    return _notes(s, d).select("doc_id", vault.front_matter(F.col("text")).alias("f")).select("doc_id", "f.*")


PATHS = ["01_CLIENTS/a.md", "a.md", "01_CLIENTS/../a.md", "77_OTHER/a.md", "01_CLIENTS//a.md", "01_CLIENTS/.hidden/a.md", "01_CLIENTS/a\\b.md", "02_PROJECTS/" + "x/" * 40 + "a.md"]


@query("SELECT doc_id, doc_id % 8 IN (0, 2, 3, 5, 7) AND doc_id % 8 <> 2 AS safe, doc_id % 8 IN (0, 5, 7) AS note, doc_id % 8 IN (0, 1, 3) AS sync FROM documents")
def path_safety(s, d):
    rows = docs(s, d).select("doc_id", case(8, PATHS).alias("p"))
    return rows.select("doc_id", T.is_safe_path(F.col("p")).alias("safe"), T.is_note_path(F.col("p")).alias("note"), T.is_sync_path(F.col("p")).alias("sync"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS at FROM events")
def event_times(s, d):
    return vault.read_table(s, d, "events").select("event_id", T.rfc3339(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"))


@query("SELECT item_id, doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared FROM (SELECT item_id, " + D.content_words("text") + " AS a FROM benchmark) q, (SELECT doc_id, " + D.content_words("text") + " AS b FROM documents) p WHERE len(list_intersect(a, b)) > 0 AND (item_id + doc_id) % 7 = 0")
def overlap_passages(s, d):
    """Words that a query shares with the passage it is to find; the gold pairs are a seventh of all, those whose ids add up to a multiple of seven."""
    asked = vault.read_table(s, d, "benchmark").select("item_id", F.explode(T.content_words(F.col("text"))).alias("word"))
    held = docs(s, d).select("doc_id", F.explode(T.content_words(F.col("text"))).alias("word"))
    pairs = asked.join(held, "word").where((F.col("item_id") + F.col("doc_id")) % 7 == 0)
    return pairs.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))


# --- files -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(i - 1 AS INT) AS position, sha256(p[i]) AS paragraph FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))")
def paragraph_explosion(s, d):
    return docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "p")).select("doc_id", "position", F.sha2("p", 256).alias("paragraph"))


@query("SELECT text, count(*) AS n FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark) WHERE text <> '' GROUP BY text".replace("\\\\", "\\"))
def folder_walk(s, d):
    """Text files written to a folder are found again, read and decoded."""
    folder = new_folder(s, "walk")
    vault.read_table(s, d, "benchmark").select(T.collapse(F.col("text")).alias("value")).where("value <> ''").repartition(3).write.text(f"{folder}/deep/er")
    text = vault.read_folder(s, folder, ("txt",)).select(vault.decode_text(F.col("content")).alias("text"))
    return text.select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(item_id AS VARCHAR) AS query_id, sha256(text) AS text, CASE WHEN item_id % 3 > 0 THEN 'd' || CAST(item_id + k AS VARCHAR) END AS document_id FROM benchmark, (SELECT unnest([0, 1]) AS k) WHERE k < greatest(1, item_id % 3)")
def gold_queries(s, d):
    """The gold set, a bounded list of queries, as one JSON array in a file."""
    n = F.col("item_id") % 3
    ids = F.transform(F.when(n == 0, F.array().cast("array<bigint>")).when(n == 1, F.array("item_id")).otherwise(F.array("item_id", F.col("item_id") + 1)), lambda x: F.concat(F.lit("d"), x.cast("string")))
    rows = vault.read_table(s, d, "benchmark").select(F.struct(F.col("item_id").cast("string").alias("queryId"), "text", ids.alias("relevantDocumentIds")).alias("q"))
    folder = new_folder(s, "gold")
    rows.agg(F.to_json(F.collect_list("q")).alias("value")).coalesce(1).write.text(folder)
    return vault.read_gold(s, folder).select("query_id", F.sha2("text", 256).alias("text"), "document_id")


def _archive(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def _office_file(kind: str, text: str) -> bytes:
    """A small office file of a kind that holds a text, or no archive at all."""
    text, w, r = escape(text), 'xmlns:w="http://w"', 'xmlns:r="http://r"'
    paragraph = f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"
    if kind == "docx":
        return _archive({"word/document.xml": f"<w:document {w}>{paragraph}</w:document>", "word/header1.xml": f"<w:hdr {w}><w:p><w:t>Header</w:t></w:p></w:hdr>"})
    if kind == "pptx":
        links = "".join(f"<Relationship Id='{i}' Target='slides/slide{n}.xml'/>" for i, n in (("a", 2), ("b", 1)))
        return _archive({
            "ppt/presentation.xml": f"<p {r}><sldId r:id='a'/><sldId r:id='b'/></p>", "ppt/_rels/presentation.xml.rels": f"<R>{links}</R>",
            "ppt/slides/slide1.xml": f"<s {w}><w:p><w:t>Last</w:t></w:p></s>", "ppt/slides/slide2.xml": f"<s {w}>{paragraph}</s>",
        })
    if kind == "xlsx":
        return _archive({
            "xl/workbook.xml": f"<workbook {r}><sheets><sheet name='One' r:id='x'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": "<R><Relationship Id='x' Target='worksheets/sheet7.xml'/></R>",
            "xl/sharedStrings.xml": f"<sst xmlns='http://m'><si><t>{text}</t></si></sst>",
            "xl/worksheets/sheet7.xml": "<worksheet xmlns='http://m'><row><c r='A1' t='s'><v>0</v></c><c r='AB2'><f>3+4</f><v>7</v></c><c r='C3'/></row></worksheet>",
        })
    if kind == "odt":
        return _archive({"content.xml": f"<d xmlns:text='http://t'><text:p>{text}</text:p><text:p>Last</text:p></d>"})
    if kind == "ods":
        t = "xmlns:table='http://t' xmlns:text='http://p' xmlns:office='http://o'"
        cell = f"<table:table-cell table:number-columns-repeated='2'><text:p>{text}</text:p></table:table-cell>"
        last = "<table:table-row><table:table-cell table:formula='of:=3+4' office:value='7'><text:p>7.0</text:p></table:table-cell></table:table-row>"
        empty = "<table:table-row table:number-rows-repeated='1048000'><table:table-cell table:number-columns-repeated='16384'/></table:table-row>"
        rows = f"<table:table-row table:number-rows-repeated='2'/><table:table-row><table:table-cell/>{cell}</table:table-row>{last}{empty}"
        return _archive({"content.xml": f"<d {t}><table:table table:name='One'>{rows}</table:table></d>"})
    return b"no archive"


KINDS = ("docx", "pptx", "xlsx", "odt", "ods", "doc")


@query("""SELECT item_id, CASE item_id % 6 WHEN 0 THEN text || chr(10) || chr(10) || 'Header' WHEN 1 THEN '## Slide 1' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Slide 2' || chr(10) || chr(10) || 'Last'
    WHEN 2 THEN '## Foglio: One' || chr(10) || '- Riga 1, colonna 1: ' || text || chr(10) || '- Riga 2, colonna 28: 7' || chr(10) || '- Formula riga 2, colonna 28: `3+4`' WHEN 3 THEN text || chr(10) || chr(10) || 'Last'
    WHEN 4 THEN '## Foglio: One' || chr(10) || '- Riga 3, colonna 2: ' || text || chr(10) || '- Riga 3, colonna 3: ' || text || chr(10) || '- Riga 4, colonna 1: 7' || chr(10) || '- Formula riga 4, colonna 1: `of:=3+4`' END AS text,
    CASE item_id % 6 WHEN 5 THEN 'failed' ELSE 'ready' END AS status FROM benchmark""")
def office_files(s, d):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f"{r['item_id']}.{(kind := KINDS[r['item_id'] % 6])}", _office_file(kind, r["text"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], names=["path", "content"])

    made = vault.read_table(s, d, "benchmark").select("item_id", "text").mapInArrow(make, "path string, content binary")
    return vault.extract_office(made).select(F.substring_index("path", ".", 1).cast("long").alias("item_id"), "text", vault.extraction_status(F.col("error")).alias("status"))


@query(f"""WITH {D.DOCS} SELECT path, '20_RAW_SOURCES/' || substr(sha256(text), 1, 16) || '-' || CAST(doc_id AS VARCHAR) || '.txt' AS target, CASE doc_id % 4 WHEN 1 THEN 'there' WHEN 2 THEN 'conflict' WHEN 3 THEN 'error' ELSE 'copy' END AS status FROM docs""")
def import_copies(s, d):
    rows = files(s, d).withColumn("size", F.when(mod(4, 3), (32 << 20) + 1).otherwise(F.col("size")))
    name = F.concat(F.lit("20_RAW_SOURCES/"), F.substring("sha256", 1, 16), F.lit("-"), ident(), F.lit(".txt"))
    held = rows.where("doc_id % 4 in (1, 2)").select(name.alias("path"), F.when(mod(4, 2), "other").otherwise(F.col("sha256")).alias("sha256"))
    return catalog.import_copies(rows, held)


# --- catalog ---------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, doc_id % 6 IN (0, 1) AS strict, doc_id % 6 IN (0, 1, 2, 3) AS with_drafts FROM documents""")
def eligible_paths(s, d):
    path = case(6, ["20_RAW_SOURCES/a.txt", "01_CLIENTS/a.md", "20_RAW_SOURCES/b.txt", "90_PROPOSALS/p.md", "20_RAW_SOURCES/Secrets/a.txt", "01_CLIENTS/passwords.txt"])
    category, status = case(6, ["raw", "client", "raw", "proposal"], "raw"), case(6, ["auto", "approved", "draft", "approved"], "approved")
    rows = docs(s, d).select("doc_id", path.alias("path"), category.alias("category"), status.alias("status"))
    args = (F.col("path"), F.col("category"), F.col("status"))
    return rows.select("doc_id", context.eligible(*args).alias("strict"), context.eligible(*args, drafts=True).alias("with_drafts"))


def _scan(s, d):
    """A catalog and a later scan: doc_id % 10 says what happened to each file."""
    rows = files(s, d).select("doc_id", "document_id", "path", F.concat_ws("-", ident(), "sha256").alias("sha256"))
    known = rows.where("doc_id % 10 <> 0").select("document_id", "path", "sha256", (F.col("doc_id") % 3 + 1).cast("long").alias("revision"), F.lit("ready").alias("extraction"))
    moved = F.when(mod(10, 3), F.concat(F.lit("20_RAW_SOURCES/moved/"), ident())).otherwise(F.col("path"))
    found = rows.where("doc_id % 10 <> 1").select(
        moved.alias("path"), F.when(mod(10, 3), T.document_id(moved)).otherwise(F.col("document_id")).alias("document_id"), F.when(mod(10, 2), F.lit("new")).otherwise(F.col("sha256")).alias("sha256"),
    )
    return known, found


@query(f"""WITH {D.DOCS}, m AS (SELECT *, doc_id % 10 AS k, '20_RAW_SOURCES/moved/' || CAST(doc_id AS VARCHAR) AS moved FROM docs WHERE doc_id % 10 <> 1)
    SELECT CASE k WHEN 3 THEN moved ELSE path END AS path, CASE k WHEN 0 THEN 'added' WHEN 2 THEN 'revised' WHEN 3 THEN 'alias' ELSE 'unchanged' END AS change, document_id,
        CAST(CASE k WHEN 0 THEN 1 WHEN 2 THEN doc_id % 3 + 2 ELSE doc_id % 3 + 1 END AS BIGINT) AS revision, CASE WHEN k IN (0, 2) THEN 'pending' ELSE 'ready' END AS extraction, CASE k WHEN 3 THEN path END AS alias_of FROM m""")
def reconcile_full(s, d):
    return catalog.matched(*_scan(s, d))


@query(f"""WITH {D.DOCS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'wiki' ELSE category END AS category, CASE doc_id % 3 WHEN 0 THEN 'acme' ELSE client END AS client, CASE doc_id % 3 WHEN 2 THEN NULL ELSE 'p' || CAST(doc_id AS VARCHAR) END AS project FROM docs""")
def jobs_into_catalog(s, d):
    rows = docs(s, d).select("doc_id", "path", "category", "client", F.lit(None).cast("string").alias("project"))
    jobs = rows.where("doc_id % 3 <> 2").select("path", F.when(mod(3), "wiki").otherwise(" ").alias("category"), F.when(mod(3), "acme").alias("client"), F.concat(F.lit("p"), ident()).alias("project"))
    return catalog.with_jobs(rows, jobs).select("doc_id", "category", "client", "project")


@query("SELECT doc_id, 'chosen' AS which FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'all' FROM documents")
def source_restriction(s, d):
    rows = docs(s, d).select("doc_id")
    chosen = catalog.restricted(rows, rows.where(mod(5)).select(F.col("doc_id").alias("source_id")), "doc_id")
    every = catalog.restricted(rows, rows.where("doc_id < 0").select(F.col("doc_id").alias("source_id")), "doc_id")
    return chosen.withColumn("which", F.lit("chosen")).unionByName(every.withColumn("which", F.lit("all")))


@query("""WITH c AS (SELECT conv_id, list(lower(text)) AS p FROM conversations GROUP BY conv_id)
    SELECT conv_id AS doc_id FROM c WHERE (contains(CAST(conv_id AS VARCHAR), '7') OR len(list_filter(p, lambda x: contains(x, 'thin'))) > 0) AND conv_id % 4 = 1 AND conv_id % 2 = 1""")
def catalog_filters(s, d):
    conv = vault.read_table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.collect_list("text").alias("passages"))
    rows = conv.withColumns({
        "file_name": ident(), "path": F.concat(F.lit("20_RAW_SOURCES/"), ident()), "category": F.when(mod(4, 1), "talk").otherwise("other"), "extraction": F.when(mod(2, 1), "ready").otherwise("failed"),
        "extension": F.lit("txt"), "client": F.when(mod(2, 1), "ACME"), "project": F.lit(""),
    })
    return rows.where(catalog.listed(rows, "Thin", category="talk", status="ready", client="acme") | catalog.listed(rows, "7", category="talk", client="acme")).select("doc_id")


@query("""WITH p AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT count(*) AS total, count(*) FILTER (conv_id % 6 = 0) AS ready, count(*) FILTER (conv_id % 6 IN (1, 2)) AS processing,
    count(*) FILTER (conv_id % 6 > 2) AS attention, CAST(sum(n) AS BIGINT) AS total_passages FROM p""")
def catalog_totals(s, d):
    rows = vault.read_table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("passages"))
    return catalog.summary(rows.withColumn("extraction", case(6, ["ready", "processing", "pending", "unsupported", "protected", "failed"])))


@query("SELECT 'auto-wiki-' || CAST(k AS VARCHAR) AS output, k % 5 = 0 AS current FROM (SELECT DISTINCT doc_id // 10 AS k FROM documents)")
def managed_artifacts(s, d):
    rows = files(s, d).select("doc_id", "path", "sha256", F.expr("doc_id div 10").alias("k"))
    name = F.concat(F.lit("auto-wiki-"), F.col("k").cast("string"))
    outputs = rows.select(name.alias("output"), "k").distinct()
    jobs = outputs.select("output", F.lit("h").alias("output_hash"), F.when(F.col("k") % 5 == 1, "waiting").otherwise("ready").alias("status"))
    parts = rows.where("k % 5 <> 3").select(name.alias("output"), "path", F.when((F.col("k") % 5 == 2) & mod(10, 4), F.lit("old")).otherwise(F.col("sha256")).alias("sha256"))
    now = rows.select("path", "sha256").unionByName(outputs.select(F.col("output").alias("path"), F.when(F.col("k") % 5 == 4, "edited").otherwise("h").alias("sha256")))
    return catalog.managed(jobs, parts, now)


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'protected' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'protected' ELSE 'failed' END AS status FROM documents""")
def extraction_states(s, d):
    return docs(s, d).select("doc_id", vault.extraction_status(case(5, [None, "file is Protected", "Unsupported format: x", "needs a password", "broken zip"])).alias("status"))


# --- passages and embeddings -----------------------------------------------------------------------------------------


@query("""SELECT CAST(conv_id AS VARCHAR) AS document_id, CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) || '_p1' END AS passage_id,
        CASE conv_id % 14 WHEN 1 THEN 'missing_document' WHEN 3 THEN 'missing_original' WHEN 4 THEN 'tampered_original' WHEN 5 THEN 'revision_mismatch' WHEN 6 THEN 'missing_passage' WHEN 8 THEN 'tampered_passage' WHEN 9 THEN 'tampered_passage' ELSE 'verified' END AS status,
        CASE WHEN conv_id % 14 NOT IN (1, 3, 4, 5, 6, 8, 9) THEN CASE WHEN conv_id % 2 = 0 THEN max(text) FILTER (turn = 1) ELSE string_agg(text, chr(10) || chr(10) ORDER BY turn) END END AS text
    FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 1) GROUP BY conv_id""")
def verify_passages(s, d):
    p = vault.transcripts(s, d).withColumn("doc_id", F.col("document_id").cast("long"))
    own = p.withColumn("sha256", F.when(F.col("doc_id").cast("int").isNotNull() & ((F.col("doc_id") % 14 == 8) | (F.col("doc_id") % 14 == 9)) & (F.col("position") == 1), F.lit("old")).otherwise(F.sha2("text", 256)))
    known = p.where("position = 1").select("doc_id", "document_id", F.concat(F.lit("c/"), "document_id").alias("path"), F.lit("h").alias("sha256"), F.lit(1).alias("revision"))
    wanted = known.select("document_id", F.when(mod(14, 5), 2).otherwise(1).alias("revision"), F.when(mod(2), F.concat("document_id", F.lit("_p1"))).alias("passage_id"))
    found = known.where("doc_id % 14 <> 3").select("path", F.when(mod(14, 4), "x").otherwise("h").alias("sha256"))
    return catalog.verified_passages(wanted, known.where("doc_id % 14 <> 1"), found, own.where("not (doc_id % 14 = 6 and position = 1)"))


@query("SELECT '3_p1' AS passage_id, 'Turno 1' AS locator, text FROM conversations WHERE conv_id = 3 AND turn = 1")
def read_passage(s, d):
    return catalog.read_passage(vault.transcripts(s, d).withColumn("sha256", F.sha2("text", 256)), "3", "3_p1")


def _cache(s, d):
    """Passages with the text that is embedded and its hash, and a cache in which turns 1 to 4 have vectors that are each wrong in one way."""
    embedded = T.embedding_text(F.lit("t"), F.lit("c"), F.col("locator"), F.col("text"))
    p = vault.transcripts(s, d).select("passage_id", "position", F.sha2("text", 256).alias("sha256"), embedded.alias("embedded_text"))
    p = p.withColumn("embedded_text_sha256", F.sha2("embedded_text", 256))
    at = F.col("position")
    cache = p.where("position < 6").select(
        F.when(at == 5, F.concat(F.lit("gone_"), "passage_id")).otherwise(F.col("passage_id")).alias("passage_id"), F.when(at == 1, "old").otherwise(F.col("sha256")).alias("sha256"),
        F.when(at == 2, "old").otherwise(F.col("embedded_text_sha256")).alias("embedded_text_sha256"), F.when(at == 3, "other").otherwise("model").alias("model"), F.lit(2).alias("dimensions"),
        F.when(at == 4, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.5))).alias("vector"),
    )
    return p, cache


@query("SELECT CAST(conv_id AS VARCHAR) || '_p' || CAST(turn AS VARCHAR) AS passage_id FROM conversations WHERE turn > 0")
def to_embed(s, d):
    return vectors.to_embed(*_cache(s, d), "model", 2)


@query("""WITH c AS (SELECT conv_id, turn, text, substr(concat_ws(chr(10), 't', 'c', 'Turno ' || CAST(turn AS VARCHAR)), 1, CAST(floor(length(text) * 0.2) AS INT)) AS context FROM conversations),
    e AS (SELECT *, CASE WHEN trim(text) = '' OR context = '' THEN text ELSE context || chr(10) || text END AS t FROM c)
    SELECT CAST(conv_id AS VARCHAR) || '_p' || CAST(turn AS VARCHAR) AS passage_id, CASE WHEN turn = 0 THEN 1.0 ELSE CAST(length(t) AS DOUBLE) END AS x,
        CASE WHEN turn = 0 THEN 0.5 ELSE CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) END AS y FROM e""")
def embedding_sync(s, d):
    """What is missing is embedded by a stand-in: a text's length and its letters e."""
    made = vectors.synced(*_cache(s, d), lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts], "model", 2)
    return made.select("passage_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@query(ORACLES["embedding_sync"])
def embedding_migration(s, d):
    """The same by a migration that is cut off after a step and goes on: what is staged takes the cache's place when it is whole."""
    home, stage = new_folder(s, "cache"), new_folder(s, "stage")
    p, cache = _cache(s, d)
    cache.select("passage_id", "sha256", "embedded_text_sha256", "model", F.col("dimensions").cast("int"), F.col("vector").cast("array<double>")).write.parquet(f"{home}/first")
    s.createDataFrame([(1, f"{home}/first", "model", 2)], migration.POINTER).write.parquet(f"{home}/pointer")
    embed = lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]
    with contextlib.suppress(migration.Cancelled):
        migration.migrate(p, home, stage, embed, "model", 2, stop=lambda so_far: so_far.done > 0, step_files=1)
    migration.migrate(p, home, stage, embed, "model", 2)
    return migration.current(s, home).select("passage_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@query("SELECT 'gone_' || CAST(conv_id AS VARCHAR) || '_p5' AS passage_id FROM conversations WHERE turn = 5")
def stale_cache(s, d):
    p, cache = _cache(s, d)
    return vectors.stale_entries(cache, p)


@query("SELECT count(*) AS total, count(*) FILTER (turn = 0) AS matched, count(*) FILTER (turn > 0) > 0 AS needs_reindex FROM conversations")
def provider_state(s, d):
    return vectors.provider_state(*_cache(s, d), "model", 2)


@query("SELECT count(*) AS both FROM conversations WHERE turn < 5")
def ids_in_cache(s, d):
    p, cache = _cache(s, d)
    return p.select("passage_id").intersect(cache.select("passage_id")).agg(F.count(F.lit(1)).alias("both"))


@query("SELECT CAST(conv_id AS VARCHAR) || '_p' || CAST(turn AS VARCHAR) AS passage_id, 1.0 AS x FROM conversations WHERE turn IN (0, 2, 3) UNION ALL SELECT CAST(conv_id AS VARCHAR) || '_p4', 1.0 FROM conversations WHERE turn = 4")
def fresh_vectors(s, d):
    p, cache = _cache(s, d)
    return vectors.fresh(p.select("passage_id", "sha256"), cache.select("passage_id", "sha256", "vector")).select("passage_id", F.col("vector")[0].alias("x"))


SIMILAR = f"(SELECT e.vec_id, e.label, {D.cosine('e.embedding', 'q.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"SELECT label, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS k FROM {SIMILAR} WHERE vec_id % 4 <> 1) WHERE k = 1 AND similarity > 0.25")
def semantic_fresh(s, d):
    """The best passage of each document among those whose vector is still of its text."""
    table = vault.read_table(s, d, "embeddings")
    passages = table.select(F.col("vec_id").alias("passage_id"), "label", F.col("vec_id").cast("string").alias("sha256"))
    cache = table.select(F.col("vec_id").alias("passage_id"), F.when(F.col("vec_id") % 4 == 1, "old").otherwise(F.col("vec_id").cast("string")).alias("sha256"), "embedding")
    near = vectors.similarities(vectors.fresh(passages, cache).withColumnRenamed("passage_id", "vec_id"), table.where("vec_id = 0").first()["embedding"])
    return vectors.best_of_document(near, "label", "vec_id")


# --- artifacts -------------------------------------------------------------------------------------------------------


@query(f"WITH {D.DOCS} SELECT client AS source, sha256('wiki-v1:model:{{' || string_agg('\"' || path || '\":\"' || sha256 || '\"', ',' ORDER BY path) || '}}') AS fingerprint FROM docs GROUP BY client")
def dependency_fingerprint(s, d):
    return context.fingerprint(files(s, d).select(F.col("client").alias("source"), "path", "sha256"), "source", "wiki-v1", "model")


@query("SELECT count(*) AS sources, count(*) FILTER (doc_id % 4 = 0) AS ready, count(*) FILTER (doc_id % 4 IN (1, 2)) AS blocked, (SELECT count(DISTINCT lang) FROM documents WHERE lang > 'd') AS wikis FROM documents")
def automation_report(s, d):
    rows = docs(s, d)
    jobs = rows.where("doc_id % 4 <> 3").select("path", case(4, ["ready", "error", "unsupported"]).alias("status"), mod(4).alias("current"))
    wikis = rows.select("category").distinct().select(F.concat(F.lit("wiki:"), "category").alias("path"), F.lit("ready").alias("status"), (F.col("category") > "d").alias("current"))
    return workflow.automation_report(rows, jobs.unionByName(wikis))


@query("SELECT conv_id AS wiki_id, conv_id % 6 NOT IN (1, 2, 3, 4) AND sum(strlen(text)) FILTER (turn = 0) > 0 AS valid FROM conversations GROUP BY conv_id")
def wiki_validation(s, d):
    turns = vault.read_table(s, d, "conversations").withColumn("doc_id", F.col("conv_id"))
    ids = F.when(mod(6, 1) & (F.col("turn") == 0), F.array(F.lit("invented"))).when(mod(6, 2) & (F.col("turn") == 0), F.array().cast("array<string>")).otherwise(F.array(F.col("turn").cast("string")))
    text = F.when(mod(6, 3) & (F.col("turn") == 0), " ").otherwise(F.col("text"))
    pages = turns.groupBy(F.col("conv_id").alias("wiki_id")).agg(F.collect_list(F.struct(text.alias("text"), ids.alias("source_ids"))).alias("sections"))
    titled = pages.withColumn("title", F.when(F.col("wiki_id") % 6 == 4, F.repeat(F.lit("x"), 301)).otherwise("Title"))
    return context.valid_wiki(titled, turns.select(F.col("conv_id").alias("wiki_id"), F.col("turn").cast("string").alias("source_id")))


def _compiler(s, d):
    rows = files(s, d).withColumn("path", F.concat(F.lit("20_RAW_SOURCES/"), ident(), F.when(mod(6, 5), ".pdf").otherwise(".txt")))
    sources = rows.select("doc_id", "path", F.when(~mod(6, 4), F.col("sha256")).alias("sha256"), F.lit("Title").alias("title"), F.col("text").alias("body"))
    draft = F.concat(F.lit("90_PROPOSALS/"), ident())
    past = rows.where("doc_id % 6 in (1, 2, 3)").select("path", F.when(mod(6, 2), "old").otherwise(F.col("sha256")).alias("sha256"), F.lit("0.2.0").alias("version"), draft.alias("draft"), "doc_id")
    return sources, past, past.where("doc_id % 6 <> 3").select(F.col("draft").alias("path"))


RAW = "'20_RAW_SOURCES/' || CAST(doc_id AS VARCHAR) || CASE doc_id % 6 WHEN 5 THEN '.pdf' ELSE '.txt' END"


@query(f"SELECT {RAW} AS path, CASE doc_id % 6 WHEN 1 THEN 'COMPILED' WHEN 2 THEN 'CHANGED' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'ERROR' ELSE 'UNCOMPILED' END AS status FROM documents")
def compile_status(s, d):
    return release.compile_status(*_compiler(s, d))


@query(f"""SELECT {RAW} AS path, CASE doc_id % 6 WHEN 1 THEN 'unchanged' WHEN 4 THEN 'error' WHEN 5 THEN 'unsupported' ELSE 'compiled' END AS status, 'src_' || sha256({RAW}) AS source_id,
    CASE WHEN doc_id % 6 IN (0, 2, 3) THEN sha256('# Title' || chr(10) || chr(10) || '> Source: ' || {RAW} || chr(10) || '> SHA-256: ' || sha256(text) || chr(10) || '> Compiler: 0.2.0' || chr(10) || chr(10) || text || chr(10)) END AS draft FROM documents""")
def compile_drafts(s, d):
    return release.compiled(*_compiler(s, d)).withColumn("draft", F.sha2("draft", 256))


@query("SELECT count(*) FILTER (doc_id % 6 IN (0, 2, 3)) AS compiled, count(*) FILTER (doc_id % 6 = 1) AS unchanged, count(*) FILTER (doc_id % 6 = 5) AS unsupported, count(*) FILTER (doc_id % 6 = 4) AS error FROM documents")
def compile_report(s, d):
    return release.status_counts(release.compiled(*_compiler(s, d)), ("compiled", "unchanged", "unsupported", "error"))


@query(f"WITH {D.DOCS} SELECT doc_id, '[' || title || '] (' || path || '#' || substr(sha256(text), 1, 8) || ')' AS citation FROM docs")
def titled_citations(s, d):
    return docs(s, d).select("doc_id", context.titled_citation(F.col("title"), F.col("path"), F.sha2("text", 256)).alias("citation"))


# --- releases and vaults ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, doc_id % 6 IN (1, 2, 3) AS excluded FROM documents")
def snapshot_exclusions(s, d):
    path = case(6, ["01_CLIENTS/a.md", "00_SYSTEM/SNAPSHOTS/s1/a.md", "01_CLIENTS/.git/config", "00_SYSTEM/SNAPSHOTS", "00_SYSTEM/SNAPSHOTS_OLD", "01_CLIENTS/x.DS_Store"])
    return docs(s, d).select("doc_id", release.excluded(path).alias("excluded"))


@query("SELECT doc_id, doc_id % 6 = 0 AS published, doc_id % 6 NOT IN (1, 2) AS private FROM documents")
def release_inspection(s, d):
    path = case(6, ["01_CLIENTS/a.md", "01_CLIENTS/.b.md", "00_SYSTEM/LOCK", "20_RAW_SOURCES/a.md", "01_CLIENTS/c.md", "01_CLIENTS/d.txt"])
    rows = docs(s, d).select("doc_id", path.alias("path"), F.when(mod(6, 4), "draft").otherwise("approved").alias("status"), F.lit(True).alias("valid"))
    published, private = (release.inspected(rows, p).select("doc_id", F.col("released").alias(n)) for p, n in ((True, "published"), (False, "private")))
    return published.join(private, "doc_id")


@query("SELECT 'r' || CAST(k AS VARCHAR) AS release_id, CASE k % 5 WHEN 1 THEN 'path' WHEN 2 THEN 'collision' WHEN 3 THEN 'limit' WHEN 4 THEN 'path' ELSE 'ok' END AS problem FROM (SELECT DISTINCT doc_id // 20 AS k FROM documents)")
def release_validation(s, d):
    rows = files(s, d).select("doc_id", "sha256", F.expr("doc_id div 20").alias("k"))
    k, first, second = F.col("k") % 5, mod(20), mod(20, 1)
    path = F.when((k == 1) & first, "01_CLIENTS/../x").when((k == 2) & first, "01_CLIENTS/Café").when((k == 2) & second, "01_clients/café").otherwise(F.concat(F.lit("01_CLIENTS/"), ident()))
    size = F.when(k == 3, 8 << 20).when((k == 4) & first, (8 << 20) + 1).otherwise(100)
    padded = rows.select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("release_id"), path.alias("path"), "sha256", size.cast("long").alias("size"))
    more = rows.where((k == 3) & first).select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("release_id"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("n"), "sha256")
    return release.validated(padded.unionByName(more.select("release_id", F.concat(F.lit("02_PROJECTS/"), F.col("n").cast("string")).alias("path"), "sha256", F.lit(8 << 20).cast("long").alias("size"))))


@query("""SELECT 'v' || CAST(k AS VARCHAR) AS vault_id, CASE k % 5 WHEN 1 THEN 14 WHEN 4 THEN 0 ELSE 15 END AS folders, CASE k % 5 WHEN 4 THEN 0 WHEN 1 THEN 15 ELSE 16 END AS pages, CASE k % 5 WHEN 4 THEN 0 ELSE 1 END AS sources, CASE WHEN k % 5 IN (1, 4) THEN 0 ELSE 1 END AS proposals,
    CASE k % 5 WHEN 1 THEN 'INCOMPLETE' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'INVALID' WHEN 4 THEN 'NOT_ACCESSIBLE' ELSE 'READY' END AS state FROM (SELECT DISTINCT doc_id // 10 AS k FROM documents)""")
def vault_states(s, d):
    k = F.expr("doc_id div 10").alias("k")
    vaults = docs(s, d).select(k).distinct().withColumn("vault_id", F.concat(F.lit("v"), F.col("k").cast("string")))
    pages = [*(f"{folder}/a.md" for folder in T.FOLDERS[1:]), *release.SYSTEM_FILES]
    there = vaults.where("k % 5 <> 4").select("vault_id", "k", F.explode(F.array(*map(F.lit, pages))).alias("path")).where("not (k % 5 = 1 and path like '90_PROPOSALS/%')")
    rows = there.select("vault_id", "path", F.when((F.col("k") % 5 == 2) & (F.col("path") == "01_CLIENTS/a.md"), "not UTF-8").alias("error"))
    return release.vault_state(vaults.select("vault_id", (F.col("k") % 5 != 4).alias("accessible"), (F.col("k") % 5 != 3).alias("valid_manifest")), rows)


@query("SELECT '01_CLIENTS/' || CAST(doc_id AS VARCHAR) || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 'T' ELSE CAST(doc_id AS VARCHAR) || '.md' END AS title, CASE doc_id % 3 WHEN 0 THEN 'approved' ELSE 'unspecified' END AS status FROM documents WHERE doc_id % 5 = 0")
def browse_folder(s, d):
    """A folder's listing, a fifth of all documents, with bounds that a table of any size keeps."""
    name = F.concat(ident(), F.lit(".md"))
    folder = F.when(mod(5), "01_CLIENTS/").when(mod(5, 1), "01_CLIENTS/.").otherwise("02_PROJECTS/")
    rows = docs(s, d).select(F.concat(folder, name).alias("path"), F.when(mod(2), "T").alias("title"), F.when(mod(3), "approved").alias("status"), F.lit(100).alias("size"))
    return release.browsed(rows, "01_CLIENTS", most=1 << 40, total=1 << 50)


@query("SELECT o_orderkey AS snapshot_id, o_orderdate AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def snapshots_newest(s, d):
    rows = vault.read_table(s, d, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created"))
    return release.newest_first(rows).limit(100)


@query("SELECT user_id AS proposal_id, event_type AS status, category, ts AS updated_at FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS category, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type = 'purchase' AND category = 'a'")
def proposal_list(s, d):
    rows = vault.read_table(s, d, "events").select(F.col("user_id").alias("proposal_id"), "event_id", F.col("event_type").alias("status"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("category"), F.col("ts").alias("updated_at"))
    return workflow.proposals(rows, "purchase", "a")


@query("""WITH RECURSIVE e AS (SELECT user_id // 1 AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_id % 5 WHEN 0 THEN 'save' WHEN 1 THEN 'revise' WHEN 2 THEN 'approve' WHEN 3 THEN 'reject' ELSE 'unknown' END AS a, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS r FROM events),
    f AS (SELECT DISTINCT p, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS status, 0 AS revision, 0 AS refused FROM e
          UNION ALL SELECT p, k, CASE WHEN NOT ok THEN status WHEN a = 'approve' THEN 'approved' WHEN a = 'reject' THEN 'rejected' ELSE 'pending' END, revision + CASE WHEN ok AND a IN ('save', 'revise') THEN 1 ELSE 0 END, refused + CASE WHEN ok THEN 0 ELSE 1 END
          FROM (SELECT e.p, e.k, a, status, revision, refused, CASE WHEN a = 'save' THEN status IS NULL OR status = 'pending' ELSE a <> 'unknown' AND status IS NOT NULL AND status = 'pending' AND (r IS NULL OR r = revision) END AS ok FROM f JOIN e ON e.p = f.p AND e.k = f.k + 1))
    SELECT p AS proposal_id, arg_max(coalesce(status, ''), k) AS status, arg_max(revision, k) AS revision, arg_max(refused, k) AS refused FROM f GROUP BY p""")
def proposal_history(s, d):
    rows = vault.read_table(s, d, "events").withColumn("doc_id", F.col("event_id")).select(F.col("user_id").alias("proposal_id"), "ts", "event_id", case(5, ["save", "revise", "approve", "reject"], "unknown").alias("action"), case(3, [None, 1, 2]).cast("int").alias("revision"))
    return workflow.proposal_history(rows, ["ts", "event_id"]).withColumn("status", F.coalesce("status", F.lit("")))


# --- jobs ------------------------------------------------------------------------------------------------------------


def _jobs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sources, and jobs in a state for each remainder of doc_id by 8: none, ready, ready but edited, given up, failed once,
    of older bytes, pending, and one whose source is gone."""
    rows = files(s, d).select("doc_id", "path", "sha256")
    jobs = rows.where(~mod(8)).select(
        F.when(mod(8, 7), F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")).alias("path"), F.when(mod(8, 5), "old").otherwise(workflow.fingerprint("v1", "m", F.col("sha256"))).alias("fingerprint"),
        case(8, [None, "ready", "ready", "error", "error", "ready", "pending", "ready"]).alias("status"), case(8, [None, 1, 1, 3, 1, 2, 0, 2]).cast("int").alias("attempts"), (F.col("doc_id") % 8).isin(1, 5, 7).alias("current"),
    )
    return rows.select("path", "sha256"), jobs


def _tick(ready: bool) -> str:
    """The state of every job after a tick, by what remains of doc_id."""
    return f"""WITH {D.DOCS}, j AS (SELECT path, CASE doc_id % 8 WHEN 1 THEN 'ready' WHEN 2 THEN 'error' WHEN 3 THEN 'error' WHEN 4 THEN 'error' ELSE 'pending' END AS status,
            CASE doc_id % 8 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 0 END AS attempts, doc_id % 8 NOT IN (1, 2, 3) AS due FROM docs),
        k AS (SELECT *, {"due AND row_number() OVER (PARTITION BY due ORDER BY path) <= 3" if ready else "false"} AS called FROM j)
        SELECT path, CASE WHEN called THEN 'processing' WHEN due AND NOT {ready} THEN 'waiting' ELSE status END AS status, attempts + CASE WHEN called THEN 1 ELSE 0 END AS attempts, called FROM k
        UNION ALL SELECT 'gone/' || path, 'removed', 2, false FROM docs WHERE doc_id % 8 = 7"""


@query(_tick(True))
def job_tick(s, d):
    return workflow.ticked(*_jobs(s, d), "v1", "m").drop("fingerprint")


@query(_tick(False))
def job_tick_waiting(s, d):
    return workflow.ticked(*_jobs(s, d), "v1", "m", provider_ready=False).drop("fingerprint")


def _results(s: SparkSession, d: str) -> DataFrame:
    rows = docs(s, d).select("doc_id", "path")
    results = rows.where(~mod(5, 4)).select("path", case(5, [None, "File protetto", "HTTP 500", "Formato non supportato"]).alias("error"))
    return workflow.finished(rows.select("path", F.lit("processing").alias("status"), F.lit(1).alias("attempts")), results)


@query(f"""WITH {D.DOCS} SELECT path, CASE doc_id % 5 WHEN 0 THEN 'ready' WHEN 4 THEN 'processing' ELSE 'error' END AS status, CASE WHEN doc_id % 5 IN (1, 3) THEN 3 ELSE 1 END AS attempts,
    CASE doc_id % 5 WHEN 1 THEN 'File protetto' WHEN 2 THEN 'HTTP 500' WHEN 3 THEN 'Formato non supportato' ELSE '' END AS error FROM docs""")
def job_results(s, d):
    return _results(s, d).withColumn("error", F.coalesce("error", F.lit("")))


@query(f"WITH {D.DOCS} SELECT path, CASE doc_id % 5 WHEN 0 THEN 'ready' WHEN 4 THEN 'processing' ELSE 'pending' END AS status, CASE WHEN doc_id % 5 IN (0, 4) THEN 1 ELSE 0 END AS attempts, '' AS error FROM docs")
def job_retry(s, d):
    return workflow.retried(_results(s, d)).withColumn("error", F.coalesce("error", F.lit("")))
