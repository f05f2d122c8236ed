"""Where documents come from: views over the driver's tables, folders of files, and office files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions import text as T

# Extensions of plain text, and media types by extension.
TEXT_EXTENSIONS = ("md", "markdown", "txt", "csv", "tsv", "json", "yaml", "yml", "xml", "html", "htm", "log", "rst")
MEDIA_TYPES = {
    "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "csv": "text/csv", "json": "application/json", "html": "text/html", "htm": "text/html", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "png": "image/png", "jpg": "image/jpeg",
}
MAX_FILE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as raw sources: id, path, title, category (the language), client (the source) and tags."""
    path = F.concat(F.lit("20_RAW_SOURCES/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    title = F.concat(F.col("source"), F.lit(" "), F.col("lang"))
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", T.document_id(path).alias("document_id"), path.alias("path"), title.alias("title"), F.col("lang").alias("category"), F.col("source").alias("client"),
        F.array("lang", "source").alias("tags"), "text", F.col("n_chars").cast("long").alias("n_chars"),
    )


def with_status(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """docs with the editorial status that labels give (none: auto) and whether they are marked toxic."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", F.col("toxic") == 1)
    labels = labels.toDF("doc_id", "quality", "toxic")
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "draft").otherwise("auto")
    return docs.join(labels, "doc_id", "left").withColumn("status", status).withColumn("toxic", F.coalesce("toxic", F.lit(False))).drop("quality")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as passages: document_id, passage_id, position, locator, text."""
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.concat(F.col("conv_id").cast("string"), F.lit("_p"), F.col("turn").cast("string")).alias("passage_id"),
        F.col("turn").cast("long").alias("position"), F.concat(F.lit("Turno "), F.col("turn").cast("string")).alias("locator"), "role", "text",
    )


def read_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("md", "markdown"), most: int = MAX_FILE_BYTES, depth: int = 64) -> DataFrame:
    """Files under a folder (path, modified, size, content, sha256), without hidden ones and ones over the size limit;
    folders nested deeper than ``depth`` are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    deep = F.size(F.split(F.replace("path", F.lit(path.rstrip("/")), F.lit("")), "/")) > depth + 1
    safe = F.when(deep, F.raise_error(F.concat(F.lit("folders are nested too deep: "), "path")).cast("boolean")).otherwise(F.lit(True))
    return files.where((F.col("length") <= most) & ~F.col("path").rlike("/\\.[^/]*") & safe).select(
        "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("sha256")
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, document_id) of a JSON array of queries, a row for each relevant document; null where a query has none."""
    rows = spark.read.option("multiLine", "true").schema("queryId string, text string, relevantDocumentIds array<string>").json(path)
    return rows.select(F.col("queryId").alias("query_id"), "text", F.explode_outer("relevantDocumentIds").alias("document_id"))


def decode_text(content: Column) -> Column:
    """UTF-8, or UTF-16 behind its byte order mark; marks go, line ends become \\n; blank text is null."""
    mark = F.hex(F.substring(content, 1, 3))
    plain = (
        F.when(mark.startswith("FFFE"), F.decode(content, "UTF-16")).when(mark.startswith("FEFF"), F.decode(content, "UTF-16"))
        .otherwise(F.regexp_replace(F.decode(content, "UTF-8"), "^\\uFEFF", ""))
    )
    plain = F.regexp_replace(plain, "\\r\\n", "\n")
    return F.when(plain.rlike("\\S"), plain)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def media_type(path: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.element_at(kinds, extension(path)), F.lit("application/octet-stream"))


def extractor(path: Column) -> Column:
    """Which extractor takes a file: text, html, spreadsheet, office or none (unsupported)."""
    e = extension(path)
    return (
        F.when(e.isin("html", "htm"), "html").when(e.isin(*TEXT_EXTENSIONS), "text").when(e.isin("xlsx", "xls", "ods"), "spreadsheet")
        .when(e.isin("docx", "odt", "pptx"), "office").otherwise("unsupported")
    )


def extraction_status(error: Column) -> Column:
    """ready without an error, else by what the error says."""
    e = F.lower(error)
    return F.when(error.isNull(), "ready").when(e.contains("protected") | e.contains("password"), "protected").when(e.contains("unsupported"), "unsupported").otherwise("failed")


# Elements whose content is no text.
BLOCKED = frozenset("script style iframe object template noscript".split())
TAG = re.compile(r"""<((?:[^"'>]|"[^"]*"|'[^']*')*)>""")
NAME = re.compile(r"\s*(/?)\s*([A-Za-z0-9]*)")


def visible(html: str) -> str:
    """Text between tags: a > inside quotes ends no tag, blocked elements nest, an unclosed tag ends the page; & and > are escaped."""
    out, blocked, at = [], [], 0
    while (low := html.find("<", at)) >= 0:
        if not blocked:
            out.append(html[at:low])
        tag = TAG.match(html, low)
        if tag is None:
            at = len(html)
            break
        closing, name = NAME.match(tag[1]).groups()
        name = name.lower()
        if name in BLOCKED:
            if not closing:
                blocked.append(name)
            elif blocked and blocked[-1] == name:
                blocked.pop()
        if not blocked:
            out.append(" ")
        at = tag.end()
    if not blocked:
        out.append(html[at:])
    return " ".join("".join(out).split()).replace("&", "&amp;").replace(">", "&gt;")


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(visible, na_action="ignore")


def html_title(html: Column) -> Column:
    return T.collapse(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def xml_lines(root: ElementTree.Element) -> str:
    out: list[str] = []
    for node in root.iter():
        name = node.tag.rsplit("}", 1)[-1]
        out.append({"p": "\n\n", "h": "\n\n", "tc": "\t", "tr": "\n", "br": "\n", "tab": "\t"}.get(name, ""))
        if name in ("t", "p", "h", "span") and node.text:
            out.append(node.text)
        if name in ("span",) and node.tail:
            out.append(node.tail)
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def related(archive: zipfile.ZipFile, name: str) -> dict[str, str]:
    """The parts that a part refers to, by relationship id."""
    folder, _, file = name.rpartition("/")
    if f"{folder}/_rels/{file}.rels" not in archive.namelist():
        return {}
    links = ElementTree.fromstring(archive.read(f"{folder}/_rels/{file}.rels"))
    return {r.get("Id"): posixpath.normpath(posixpath.join("/" + folder, r.get("Target"))).lstrip("/") for r in links}


def local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def stated(element: ElementTree.Element, name: str, default: str = "") -> str:
    """An attribute by its local name."""
    return next((v for k, v in element.items() if k.rsplit("}", 1)[-1] == name), default)


def open_cells(archive: zipfile.ZipFile, most: int = 1 << 20) -> str:
    """Sheets of an open document as lines, as ``cells`` gives them; repeated rows and cells each have a line, up to a bound."""
    lines: list[str] = []
    for sheet in ElementTree.fromstring(archive.read("content.xml")).iter():
        if local(sheet) != "table":
            continue
        lines.append(f"## Foglio: {stated(sheet, 'name')}")
        formulas, row = [], 0
        for line in (r for r in sheet.iter() if local(r) == "table-row"):
            found, column = [], 0
            for cell in (c for c in line if local(c) in ("table-cell", "covered-table-cell")):
                times = int(stated(cell, "number-columns-repeated", "1"))
                text = "\n".join("".join(p.itertext()) for p in cell if local(p) == "p")
                value = next((v for v in (stated(cell, k) for k in ("value", "date-value", "time-value", "boolean-value")) if v), text)
                formula = stated(cell, "formula")
                if value or formula:
                    if times > most:
                        raise ValueError("failed: the sheet has too many cells")
                    found += [(column + k + 1, value, formula) for k in range(times)]
                column += times
            times = int(stated(line, "number-rows-repeated", "1"))
            if times * len(found) + len(lines) + len(formulas) > most:
                raise ValueError("failed: the sheet has too many cells")
            for r in range(row + 1, row + 1 + times) if found else ():
                lines += [f"- Riga {r}, colonna {c}: {v}" for c, v, _ in found if v]
                formulas += [f"- Formula riga {r}, colonna {c}: `{f}`" for c, _, f in found if f]
            row += times
        lines += formulas
    return "\n".join(lines)


def cells(archive: zipfile.ZipFile) -> str:
    """Sheets as lines: a heading for each sheet, a line for each cell that isn't empty, then one for each formula."""
    read = lambda name: ElementTree.fromstring(archive.read(name))
    shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in archive.namelist() else []
    sheets = [(s.get("name", ""), next((v for k, v in s.items() if k.endswith("}id")), "")) for s in read("xl/workbook.xml").iter() if s.tag.rsplit("}", 1)[-1] == "sheet"]
    parts, lines = related(archive, "xl/workbook.xml"), []
    for n, (title, relation) in enumerate(sheets, 1):
        lines.append(f"## Foglio: {title}")
        formulas = []
        for cell in read(parts.get(relation, f"xl/worksheets/sheet{n}.xml")).iter():
            if cell.tag.endswith("}c"):
                value = "".join(v.text or "" for v in cell.iter() if v.tag.rsplit("}", 1)[-1] in ("v", "t"))
                value = shared[int(value)] if cell.get("t") == "s" and value else value
                formula = "".join(f.text or "" for f in cell if local(f) == "f")
                if value or formula:
                    letters, row = re.match(r"([A-Z]+)(\d+)", cell.get("r", "A1")).groups()
                    column = 0
                    for c in letters:
                        column = column * 26 + ord(c) - 64
                    if value:
                        lines.append(f"- Riga {row}, colonna {column}: {value}")
                    if formula:
                        formulas.append(f"- Formula riga {row}, colonna {column}: `{formula}`")
        lines += formulas
    return "\n".join(lines)


def office_text(content: bytes, kind: str, members: int = 20_000, most: int = 16 << 20) -> str:
    """Text of a DOCX, ODT, PPTX, XLSX or ODS file; declarations, oversized archives and binary spreadsheets are refused."""
    if kind == "xls":
        raise ValueError("unsupported: a binary spreadsheet")
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        infos = archive.infolist()
        if len(infos) > members or sum(i.file_size for i in infos) > most:
            raise ValueError("failed: the archive is too large")
        if any(b"<!DOCTYPE" in archive.read(i)[:512] for i in infos if i.filename.endswith(".xml")):
            raise ValueError("failed: document type declarations are refused")
        if kind == "xlsx":
            return cells(archive)
        if kind == "ods":
            return open_cells(archive)
        names = archive.namelist()
        if kind == "pptx":
            parts = related(archive, "ppt/presentation.xml")
            ids = [next(v for k, v in s.items() if k.endswith("}id")) for s in ElementTree.fromstring(archive.read("ppt/presentation.xml")).iter() if s.tag.rsplit("}", 1)[-1] == "sldId"]
            slides = [parts[i] for i in ids]
            return "\n\n".join(f"## Slide {k}\n\n{xml_lines(ElementTree.fromstring(archive.read(n)))}" for k, n in enumerate(slides, 1))
        parts = ["content.xml"] if kind == "odt" else ["word/document.xml", *sorted(n for n in names if re.fullmatch(r"word/(header|footer|footnotes|endnotes)\d*\.xml", n))]
        return "\n\n".join(x for x in (xml_lines(ElementTree.fromstring(archive.read(n))) for n in parts if n in names) if x)


def extract_office(files: DataFrame) -> DataFrame:
    """(path, text, error) of rows (path, content) of office files; a file that can't be read has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    rows.append({"path": row["path"], "text": office_text(row["content"], row["path"].rsplit(".", 1)[-1].lower()), "error": None})
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append({"path": row["path"], "text": None, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("text", pa.string()), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def title_of(text: Column, path: Column) -> Column:
    """The title that the front matter states, else the first heading of the first level, else the file's name with - and _ as spaces."""
    body = F.regexp_replace(text, "^---\\r?\\n(?:[\\s\\S]*?\\r?\\n)?---(?:\\r?\\n|$)", "")
    heading = F.nullif(F.trim(F.regexp_extract(body, "(?m)^# (.*)$", 1)), F.lit(""))
    stem = F.regexp_replace(F.substring_index(path, "/", -1), "\\.[^.]*$", "")
    return F.coalesce(front_matter(text)["title"], heading, F.regexp_replace(stem, "[-_]", " "))


def front_matter(text: Column) -> Column:
    """state (READY without a block or with a plain one, else INVALID), and the values of title, status and client."""
    block = F.regexp_extract(F.replace(text, F.lit("\r\n"), F.lit("\n")), "^---\\n(?:([\\s\\S]*?)\\n)?---(?:\\n|$)", 1)
    opened = text.rlike("^---\\r?\\n")
    closed = text.rlike("^---\\r?\\n(?:[\\s\\S]*?\\n)?---(?:\\r?\\n|$)")
    value = lambda key: F.nullif(F.trim(F.regexp_extract(block, f"(?m)^{key}:[ \\t]*[\"']?(.*?)[\"']?[ \\t]*$", 1)), F.lit(""))
    status = value("status")
    plain = F.forall(F.split(block, "\n"), lambda line: line.rlike("^([A-Za-z_]+:.*|[ \\t]+.*|-.*|)$"))
    state = F.when(~opened, "READY").when(closed & plain & (status.isNull() | status.isin("draft", "review", "approved", "archived")), "READY").otherwise("INVALID")
    return F.struct(state.alias("state"), value("title").alias("title"), F.coalesce(status, F.lit("approved")).alias("status"), value("client").alias("client"))
