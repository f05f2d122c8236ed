"""Manifests and releases: differences, what must be sent, chains of parents, limits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T


def manifest_diff(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state): missing, added, modified or verified."""
    m, a = manifest.select("path", F.col("sha256").alias("was")), actual.select("path", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "modified").otherwise("verified")
    return m.join(a, "path", "full_outer").select("path", state.alias("state"))


def missing_objects(documents: DataFrame, base: DataFrame) -> DataFrame:
    """Contents that the base doesn't hold yet, once each."""
    return documents.select("sha256", "size").join(base.select("sha256"), "sha256", "left_anti").distinct()


def manifest_hash(files: DataFrame, releases: DataFrame, most: int = 1000) -> DataFrame:
    """(release_id, manifest_hash): the SHA-256 of each release's manifest as canonical JSON: keys sorted, documents by path.

    releases holds the manifests' fields, a null parent as null. A release has at most ``most`` documents, which are
    gathered; one with more is an error.
    """
    document = F.to_json(F.struct(*(F.col(c) for c in sorted(c for c in files.columns if c != "release_id"))))
    listed = files.select("release_id", F.col("relativePath").alias("path"), document.alias("json")).groupBy("release_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("path", "json"))).alias("all"))
    documents = F.when(F.col("n") <= most, F.array_join(F.transform("all", lambda d: d["json"]), ",")).otherwise(F.raise_error(F.concat(F.lit("a release holds too many documents: "), "release_id")))
    fields = {"release_id": "releaseId", "parent_id": "parentReleaseId"}
    rows = releases.join(listed, "release_id", "left")
    value = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), "(?s)^\\{\"v\":(.*)\\}$", 1), F.lit("null"))
    parts = {fields.get(c, c): F.when(F.col(c).isNull(), F.lit("null")).otherwise(value(c)) for c in releases.columns}
    parts["documents"] = F.concat(F.lit("["), F.coalesce(documents, F.lit("")), F.lit("]"))
    whole = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts))), F.lit("}"))
    return rows.select("release_id", F.sha2(whole, 256).alias("manifest_hash"))


def release_chain(releases: DataFrame, start: str, hops: int = 100) -> DataFrame:
    """(release_id, hop) from a release back through its parents, at most ``hops`` of them; a cycle is an error."""
    name = f"releases_{uuid.uuid4().hex}"
    releases.createOrReplaceTempView(name)
    return releases.sparkSession.sql(
        f"""WITH RECURSIVE chain (release_id, parent_id, hop) MAX RECURSION LEVEL {hops + 2} AS (
                SELECT release_id, parent_id, 0 FROM {name} WHERE release_id = :start
                UNION ALL SELECT r.release_id, r.parent_id, hop + 1 FROM chain JOIN {name} r ON r.release_id = chain.parent_id WHERE hop < {hops})
            SELECT release_id, CASE WHEN count(*) > 1 THEN CAST(raise_error('the chain of releases is a cycle') AS INT) ELSE min(hop) END AS hop FROM chain GROUP BY release_id""",
        args={"start": start},
    )


# Names that no release holds, and those that no snapshot holds.
SYSTEM_NAMES = ("SNAPSHOTS", "SEARCH_INDEX.json", "SYNC_PROFILE.json", "LOCK", "M7_PENDING.json")
IGNORED_NAMES = (".git", "node_modules", ".DS_Store", ".gitkeep", ".obsidian")
SYSTEM_FILES = ("00_SYSTEM/HOME.md", "00_SYSTEM/VAULT_RULES.md", "00_SYSTEM/VAULT_MANIFEST.json")


def excluded(path: Column) -> Column:
    """Whether snapshots leave a path out."""
    own = (path == "00_SYSTEM/SNAPSHOTS") | path.startswith("00_SYSTEM/SNAPSHOTS/")
    return own | F.exists(F.split(path, "/"), lambda p: p.isin(*IGNORED_NAMES))


def inspected(files: DataFrame, published: bool) -> DataFrame:
    """files (path, status: the front matter's, null without one; valid) with ``released``: private releases hold all but
    system names and hidden ones, published ones only approved, valid Markdown of the official folders."""
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.isin(*SYSTEM_NAMES))
    keep = ~hidden
    if published:
        official = F.substring_index("path", "/", 1).isin(*T.FOLDERS[1:11])
        keep = keep & official & F.col("path").endswith(".md") & F.coalesce((F.col("status") == "approved") & F.col("valid"), F.lit(False))
    return files.withColumn("released", keep)


def validated(files: DataFrame, most: int = 1000, most_bytes: int = 256 << 20, largest: int = 8 << 20) -> DataFrame:
    """(release_id, problem) of rows (release_id, path, sha256, size): the first rule that a release breaks, or ok."""
    bad = ~T.is_sync_path(F.col("path")) | (F.col("size") > largest) | (F.char_length("sha256") != 64)
    by_key = files.withColumns({"bad": bad, "key": T.collision_key(F.col("path"))}).groupBy("release_id", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("bad").alias("bad"))
    one = by_key.groupBy("release_id").agg(F.sum("n").alias("files"), F.sum("size").alias("bytes"), F.max("bad").alias("bad"), F.max("n").alias("same"))
    problem = F.when(F.col("bad"), "path").when(F.col("same") > 1, "collision").when((F.col("files") > most) | (F.col("bytes") > most_bytes), "limit").otherwise("ok")
    return one.select("release_id", problem.alias("problem"))


def vault_state(vaults: DataFrame, files: DataFrame) -> DataFrame:
    """(vault_id, folders, pages, sources, proposals, state) of vaults (vault_id, accessible, valid_manifest) with files (vault_id, path, error).

    A vault is READY, INCOMPLETE if a folder or system file is missing, INVALID if a file or the manifest is faulty,
    and NOT_ACCESSIBLE. A folder is there if a file is.
    """
    path = F.col("path")
    page = path.endswith(".md")
    counts = files.groupBy("vault_id").agg(
        F.count_distinct(F.when(F.substring_index(path, "/", 1).isin(*T.FOLDERS), F.substring_index(path, "/", 1))).alias("folders"), F.count_if(page).alias("pages"),
        F.count_if(page & path.startswith("20_RAW_SOURCES/")).alias("sources"), F.count_if(page & path.startswith("90_PROPOSALS/")).alias("proposals"),
        F.count_distinct(F.when(path.isin(*SYSTEM_FILES), path)).alias("system"), F.count("error").alias("errors"),
    )
    joined = vaults.join(counts, "vault_id", "left").fillna(0)
    manifest = F.col("system") == len(SYSTEM_FILES)
    invalid = (F.col("errors") > 0) | (manifest & ~F.col("valid_manifest"))
    missing = (F.col("folders") < len(T.FOLDERS)) | ~manifest
    state = F.when(~F.col("accessible"), "NOT_ACCESSIBLE").when(invalid, "INVALID").when(missing, "INCOMPLETE").otherwise("READY")
    return joined.select("vault_id", "folders", "pages", "sources", "proposals", state.alias("state"))


def browsed(files: DataFrame, folder: str = "all", most: int = 1000, largest: int = 512 << 10, total: int = 8 << 20) -> DataFrame:
    """(path, title, status) of a folder's Markdown files (path, title, status, size), hidden ones left out; too many, too
    large or too much in all is an error."""
    if folder != "all" and folder not in T.FOLDERS:
        raise ValueError("unknown folder")
    wanted = F.lower("path").endswith(".md") & ~F.exists(F.split("path", "/"), lambda p: p.startswith("."))
    kept = files.where(wanted if folder == "all" else wanted & path_under(folder))
    sums = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("top"))
    fits = (F.col("n") <= most) & (F.col("bytes") <= total) & (F.col("top") <= largest)
    title = F.coalesce("title", F.substring_index("path", "/", -1))
    path = F.when(fits, F.col("path")).otherwise(F.raise_error(F.lit("the folder is too large to browse")))
    return kept.crossJoin(F.broadcast(sums)).select(path.alias("path"), title.alias("title"), F.coalesce("status", F.lit("unspecified")).alias("status"))


def path_under(folder: str) -> Column:
    return F.col("path").startswith(folder + "/")


COMPILER = "0.2.0"
COMPILED_KINDS = ("md", "markdown", "txt", "html", "htm")


def compile_status(sources: DataFrame, provenance: DataFrame, drafts: DataFrame, version: str = COMPILER) -> DataFrame:
    """(path, status) of sources (path, sha256; null if unreadable): UNCOMPILED, COMPILED, CHANGED or ERROR (the draft is gone too)."""
    p = provenance.select("path", F.col("sha256").alias("was"), "version", "draft")
    joined = sources.join(p, "path", "left").join(drafts.select(F.col("path").alias("draft"), F.lit(True).alias("there")), "draft", "left")
    status = (
        F.when(F.col("sha256").isNull(), "ERROR").when(F.col("draft").isNull(), "UNCOMPILED").when(F.col("there").isNull(), "ERROR")
        .when((F.col("was") == F.col("sha256")) & (F.col("version") == version), "COMPILED").otherwise("CHANGED")
    )
    return joined.select("path", status.alias("status"))


def compiled(sources: DataFrame, provenance: DataFrame, drafts: DataFrame, version: str = COMPILER) -> DataFrame:
    """(path, status, source_id, draft) of sources (path, sha256, title, body): unsupported kinds and unreadable files, those
    that are unchanged since a draft that is still there, and for the others the draft to be written."""
    kind = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    current = compile_status(sources, provenance, drafts, version).withColumnRenamed("status", "state")
    status = F.when(~kind.isin(*COMPILED_KINDS), "unsupported").when(F.col("sha256").isNull() | F.col("body").isNull(), "error").when(F.col("state") == "COMPILED", "unchanged").otherwise("compiled")
    draft = F.concat(F.lit("# "), "title", F.lit("\n\n> Source: "), "path", F.lit("\n> SHA-256: "), "sha256", F.lit(f"\n> Compiler: {version}\n\n"), "body", F.lit("\n"))
    joined = sources.join(current, "path")
    return joined.select("path", status.alias("status"), F.concat(F.lit("src_"), F.sha2("path", 256)).alias("source_id"), F.when(status == "compiled", draft).alias("draft"))


def status_counts(items: DataFrame, states: tuple[str, ...], column: str = "status") -> DataFrame:
    """One row: how many items are in each of the states."""
    return items.agg(*(F.count_if(F.col(column) == s).alias(s) for s in states))


def newest_first(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("created"), F.desc("snapshot_id"))


def within_limits(files: DataFrame, most: int = 1000, most_bytes: int = 256 << 20) -> DataFrame:
    """One row: how many files and bytes, and whether a release may have them."""
    n, size = F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))
    return files.agg(n.alias("files"), size.alias("bytes"), ((n <= most) & (size <= most_bytes)).alias("ok"))
