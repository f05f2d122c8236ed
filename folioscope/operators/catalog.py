"""The document catalog: duplicates and aliases, reconciliation with what was found, verification, listing and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T


def deduplicated(files: DataFrame) -> DataFrame:
    """(sha256, path, canonical, copies) of every file: of equal contents the least path is canonical, the others are its aliases.

    A row per alias, so a content that many files share is no long row.
    """
    first = files.groupBy("sha256").agg(F.min("path").alias("canonical"), F.count(F.lit(1)).alias("copies"))
    return files.select("sha256", "path").join(first, "sha256").select("sha256", "path", "canonical", "copies")


def receipts(files: DataFrame, order: str) -> DataFrame:
    """files with a status: imported for the first of equal content in order, duplicate for the rest, error for blank ones."""
    first = files.groupBy("sha256").agg(F.min(order).alias("first"))
    blank = F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""
    return files.join(first, "sha256").withColumn("status", F.when(blank, "error").when(F.col(order) == F.col("first"), "imported").otherwise("duplicate"))


def reconciled(known: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change, revision) of rows (path, sha256[, revision]): added, revised (the revision rises), removed, unchanged."""
    k, f = known.select("path", F.col("sha256").alias("old"), "revision"), found.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "revised").otherwise("unchanged")
    revision = F.when(change == "added", 1).when(change == "revised", F.col("revision") + 1).otherwise(F.col("revision"))
    return k.join(f, "path", "full_outer").select("path", change.alias("change"), revision.cast("long").alias("revision"))


def matched(known: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change, document_id, revision, extraction, aliases_to) of every found file of a scan (path, document_id, sha256).

    A file is a catalogued one (document_id, path, sha256, revision, extraction) by its path or id, else by its
    content, for which the least id counts: then its path is an alias. A changed content raises the revision and
    resets the extraction to pending; a new one starts at revision 1.
    """
    k = known.select(F.col("document_id").alias("k_id"), F.col("path").alias("k_path"), F.col("sha256").alias("k_sha"), "revision", "extraction")
    by_path = found.join(k, F.col("path") == F.col("k_path")).select("path", F.lit(1).alias("kind"), "k_id")
    by_id = found.join(k, F.col("document_id") == F.col("k_id")).select("path", F.lit(1).alias("kind"), "k_id")
    contents = k.groupBy("k_sha").agg(F.min("k_id").alias("k_id"))
    by_content = found.join(contents, F.col("sha256") == F.col("k_sha")).select("path", F.lit(2).alias("kind"), "k_id")
    best = by_path.unionByName(by_id).unionByName(by_content).groupBy("path").agg(F.min(F.struct("kind", "k_id")).alias("m"))
    joined = found.join(best.select("path", "m.kind", "m.k_id"), "path", "left").join(k, "k_id", "left")
    change = F.when(F.col("kind").isNull(), "added").when(F.col("kind") == 2, "alias").when(F.col("sha256") != F.col("k_sha"), "revised").otherwise("unchanged")
    fresh = change.isin("added", "revised")
    revision = F.when(change == "added", 1).when(change == "revised", F.col("revision") + 1).otherwise(F.col("revision"))
    return joined.select(
        "path", change.alias("change"), F.coalesce("k_id", "document_id").alias("document_id"), revision.cast("long").alias("revision"),
        F.when(fresh, "pending").otherwise(F.col("extraction")).alias("extraction"), F.when(change == "alias", F.col("k_path")).alias("alias_of"),
    )


def with_jobs(catalog: DataFrame, jobs: DataFrame) -> DataFrame:
    """catalog (path, category, client, project) with what finished jobs (path, category, client, project) say, where they say something."""
    said = jobs.select("path", *(F.nullif(F.trim(F.col(c)), F.lit("")).alias(f"new_{c}") for c in ("category", "client", "project")))
    joined = catalog.join(said, "path", "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in ("category", "client", "project") else F.col(c) for c in catalog.columns))


def restricted(documents: DataFrame, source_ids: DataFrame, id_col: str = "document_id") -> DataFrame:
    """documents whose id is among the chosen sources; all of them where none is chosen."""
    chosen = source_ids.select(F.col("source_id").alias(id_col)).distinct()
    some = chosen.agg((F.count(F.lit(1)) > 0).alias("some"))
    marked = documents.join(chosen.withColumn("chosen", F.lit(True)), id_col, "left").crossJoin(F.broadcast(some))
    return marked.where(~F.col("some") | F.coalesce("chosen", F.lit(False))).drop("some", "chosen")


def pruned(known: DataFrame, found: DataFrame, managed: Column) -> DataFrame:
    """known without the rows under managed folders whose path was not found."""
    return known.join(found.select("path", F.lit(True).alias("there")), "path", "left").where(F.col("there").isNotNull() | ~managed).drop("there")


def verified(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status) of expected rows (path, sha256, revision): the first check that fails, or verified."""
    joined = expected.join(actual.select("path", F.col("sha256").alias("now"), F.col("revision").alias("is")), "path", "left")
    status = F.when(F.col("now").isNull(), "missing_original").when(F.col("now") != F.col("sha256"), "tampered_original").when(F.col("is") != F.col("revision"), "revision_mismatch").otherwise("verified")
    return joined.select("path", status.alias("status"))


def verified_passages(wanted: DataFrame, documents: DataFrame, files: DataFrame, passages: DataFrame) -> DataFrame:
    """(document_id, passage_id, status, text) of rows (document_id, revision, passage_id or null): the first check that fails.

    Checked in turn: the document is known, its file is there, has the recorded hash, the revision is the one asked
    for, the passage is there, and every passage (the one asked for, or all) still has its hash. Verified rows carry
    the text, passages in their order with an empty line between them.
    """
    whole = F.every(F.sha2("text", 256) == F.col("sha256"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda p: p["text"]), "\n\n")
    every = passages.groupBy("document_id").agg(whole.alias("whole"), body.alias("body"))
    one = passages.select("document_id", "passage_id", (F.sha2("text", 256) == F.col("sha256")).alias("sound"), F.col("text").alias("own"))
    known = documents.select("document_id", "path", F.col("sha256").alias("recorded"), F.col("revision").alias("now"))
    there = files.select("path", F.col("sha256").alias("actual"))
    joined = wanted.join(known, "document_id", "left").join(there, "path", "left").join(every, "document_id", "left").join(one, ["document_id", "passage_id"], "left")
    single = F.col("passage_id").isNotNull()
    status = (
        F.when(F.col("recorded").isNull(), "missing_document").when(F.col("actual").isNull(), "missing_original").when(F.col("actual") != F.col("recorded"), "tampered_original")
        .when(F.col("now") != F.col("revision"), "revision_mismatch").when(single & F.col("sound").isNull(), "missing_passage")
        .when(F.when(single, ~F.col("sound")).otherwise(~F.coalesce("whole", F.lit(True))), "tampered_passage").otherwise("verified")
    )
    return joined.select("document_id", "passage_id", status.alias("status"), F.when(status == "verified", F.when(single, F.col("own")).otherwise(F.coalesce("body", F.lit("")))).alias("text"))


def read_passage(passages: DataFrame, document_id: str, passage_id: str) -> DataFrame:
    """The text of one passage; one whose text no longer has its hash is an error."""
    sound = F.sha2("text", 256) == F.col("sha256")
    text = F.when(sound, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("the passage was changed: "), "passage_id")))
    return passages.where((F.col("document_id") == document_id) & (F.col("passage_id") == passage_id)).select("passage_id", "locator", text.alias("text"))


def resolved(wanted: DataFrame, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, matches, path): a wanted name by exact path, else alias, else as the end of a path or a file name.

    A leading ./ or / of the name doesn't count. path is null where none or several match. The ends of paths are
    joined as they stand, at most one for each folder.
    """
    clean = F.regexp_replace("name", "^(\\./)*/*", "")
    asked = wanted.withColumn("clean", clean)
    parts = F.split("path", "/")
    ends = catalog.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("end"))
    by_path = asked.join(catalog, F.col("clean") == catalog["path"]).select("name", "path", F.lit(1).alias("kind"))
    by_alias = asked.join(aliases, F.col("clean") == aliases["alias"]).select("name", "path", F.lit(2).alias("kind"))
    by_end = asked.join(ends, F.col("clean") == F.col("end")).select("name", "path", F.lit(3).alias("kind"))
    found = by_path.unionByName(by_alias).unionByName(by_end)
    best = found.groupBy("name").agg(F.min("kind").alias("kind"))
    hits = found.join(best, ["name", "kind"]).groupBy("name").agg(F.count_distinct("path").alias("matches"), F.min("path").alias("path"))
    out = wanted.join(hits, "name", "left").fillna(0, ["matches"])
    return out.select("name", "matches", F.when(F.col("matches") == 1, F.col("path")).alias("path"))


def current(artifacts: DataFrame, hashes: DataFrame) -> DataFrame:
    """Ids of artifacts (id, path, sha256: one row per dependency) all of whose dependencies still have the recorded hash."""
    checked = artifacts.join(hashes.select("path", F.col("sha256").alias("now")), "path", "left")
    return checked.groupBy("id").agg(F.every(F.coalesce(F.col("now") == F.col("sha256"), F.lit(False))).alias("current"))


def managed(jobs: DataFrame, dependencies: DataFrame, hashes: DataFrame) -> DataFrame:
    """(output, current) of jobs (output, output_hash, status): ready, the output as it was written, and at least one
    dependency (output, path, sha256), all of which still have their hash in hashes (path, sha256)."""
    now = hashes.select("path", F.col("sha256").alias("now"))
    sound = dependencies.join(now, "path", "left").groupBy("output").agg(F.every(F.coalesce(F.col("now") == F.col("sha256"), F.lit(False))).alias("sound"))
    own = now.withColumnsRenamed({"path": "output", "now": "written"})
    joined = jobs.join(sound, "output", "left").join(own, "output", "left")
    ok = (F.col("status") == "ready") & (F.col("written") == F.col("output_hash")) & F.col("sound")
    return joined.select("output", F.coalesce(ok, F.lit(False)).alias("current"))


def listed(documents: DataFrame, text: str = "", category: str = "all", status: str = "all", kind: str = "all", client: str = "", project: str = "") -> Column:
    """The conditions of a catalog list: text in the name, the path or a passage; client and project without case, null is not empty."""
    keep = F.lit(True)
    if text:
        needle = F.lit(text.lower())
        keep = F.contains(F.lower("file_name"), needle) | F.contains(F.lower("path"), needle) | F.exists("passages", lambda p: F.contains(F.lower(p), needle))
    for column, value in (("category", category), ("extraction", status), ("extension", kind)):
        if value != "all":
            keep = keep & (F.col(column) == value)
    for column, value in (("client", client), ("project", project)):
        if value:
            keep = keep & F.coalesce(F.lower(column) == value.lower(), F.lit(False))
    return keep


def summary(documents: DataFrame) -> DataFrame:
    """One row over (extraction, passages): documents, ready, processing (pending too), those that need attention, passages."""
    s = F.col("extraction")
    return documents.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "ready").alias("ready"), F.count_if(s.isin("processing", "pending")).alias("processing"),
        F.count_if(s.isin("unsupported", "protected", "failed")).alias("attention"), F.coalesce(F.sum("passages"), F.lit(0)).alias("total_passages"),
    )


def path_collisions(paths: DataFrame) -> DataFrame:
    """(key, n): paths that are one but for case and the composition of their accents."""
    return paths.groupBy(T.collision_key(F.col("path")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def import_copies(files: DataFrame, existing: DataFrame, largest: int = 32 << 20) -> DataFrame:
    """(path, target, status) of files (path, sha256, size) to be copied: the target's name begins with the content's hash.

    A target that exists (path, sha256) with equal bytes is there already, with other bytes a conflict; nothing is
    overwritten, and a file that is too large is an error of its own.
    """
    target = F.concat(F.lit("20_RAW_SOURCES/"), F.substring("sha256", 1, 16), F.lit("-"), F.substring_index("path", "/", -1))
    there = existing.select(F.col("path").alias("target"), F.col("sha256").alias("held"))
    status = F.when(F.col("size") > largest, "error").when(F.col("held").isNull(), "copy").when(F.col("held") == F.col("sha256"), "there").otherwise("conflict")
    return files.withColumn("target", target).join(there, "target", "left").select("path", "target", status.alias("status"))
