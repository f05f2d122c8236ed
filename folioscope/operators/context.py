"""Context for a language model: which documents may be used, budgets, citations and checks of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import chunking as C
from folioscope.functions import text as T


def eligible(path: Column, category: Column, status: Column, drafts: bool = False) -> Column:
    """Safe path, no part named for secrets; raw sources approved, auto or without status, notes approved markdown."""
    clean = F.forall(F.split(F.lower(path), "/"), lambda p: ~p.rlike("^(secrets?|credentials|passwords?)"))
    raw = path.startswith("20_RAW_SOURCES/") & (F.lit(drafts) | status.isNull() | status.isin("approved", "auto"))
    note = path.endswith(".md") & (F.lit(drafts) | ((status == "approved") & ~category.isin("proposal", "ai_output")))
    return T.is_safe_path(path) & clean & (raw | note)


def packed_with_skips(items: DataFrame, group: list[str], order: Column, identifier: str, size: str, most: int, count: int = 10) -> DataFrame:
    """(group, identifier, size) of items taken in order while they fit; one that doesn't fit is skipped, later ones may still.

    A group is the ranked sources of one query, at most a search's page; its fold is one aggregate in the JVM.
    """
    item = F.struct(order.alias("o"), F.col(identifier).alias("id"), F.col(size).cast("long").alias("size"))
    kind = dict(items.dtypes)[identifier]
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<id:{kind},size:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["size"] <= most) & (F.size(acc["taken"]) < count)
        return F.struct(
            F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["taken"], F.array(F.struct(x["id"].alias("id"), x["size"].alias("size"))))).otherwise(acc["taken"]).alias("taken"),
        )

    sorted_ = items.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("all"))
    taken = sorted_.select(*group, F.explode(F.aggregate("all", zero, step)["taken"]).alias("t"))
    return taken.select(*group, F.col("t.id").alias(identifier), F.col("t.size").alias(size))


def citation(path: Column, locator: Column) -> Column:
    return F.concat(F.lit("[["), path, F.lit("#"), locator, F.lit("]]"))


def titled_citation(title: Column, path: Column, sha256: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit("] ("), path, F.lit("#"), F.substring(sha256, 1, 8), F.lit(")"))


def packed_context(found: DataFrame, texts: DataFrame, most: int = 24_000, whole: int = 3000, count: int = 10) -> DataFrame:
    """(path, content) of a search's page (rank, path, matching_passage_id, matching_locator, passage) for a language model.

    A text of more than ``whole`` bytes is replaced by its matching passage behind the locator, or by its first
    ``whole`` bytes, less a character cut in two, where it has none; what fits the budget is taken in order, what doesn't is skipped.
    """
    passage = F.concat(F.lit("["), "matching_locator", F.lit("] "), "passage")
    short = F.when(F.octet_length("text") <= whole, F.col("text")).otherwise(F.coalesce(passage, C.fragments(F.col("text"), whole)[0]))
    content = found.join(texts, "path").withColumn("content", short).withColumn("size", F.octet_length("content")).withColumn("one", F.lit(1))
    taken = packed_with_skips(content, ["one"], F.col("rank"), "path", "size", most, count)
    return content.join(taken.select("path"), "path", "left_semi").select("rank", "path", "content")


def valid_wiki(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(wiki_id, valid) of rows (wiki_id, title, sections: array of (text, source_ids)): a title of at most 300 bytes, 1 to 30
    sections of at most 12,000 bytes, none blank, each with sources, all of which are in the batch (wiki_id, source_id)."""
    sized = lambda x, n: (F.trim(x) != "") & (F.octet_length(x) <= n)
    shape = sized(F.col("title"), 300) & F.size("sections").between(1, 30) & F.forall("sections", lambda s: sized(s["text"], 12_000) & (F.size(s["source_ids"]) > 0))
    cites = pages.select("wiki_id", F.explode_outer("sections").alias("s")).select("wiki_id", F.explode_outer("s.source_ids").alias("source_id"))
    unknown = cites.where("source_id is not null").join(known, ["wiki_id", "source_id"], "left_anti").select("wiki_id").distinct().withColumn("invented", F.lit(True))
    return pages.join(unknown, "wiki_id", "left").select("wiki_id", F.coalesce(shape & F.col("invented").isNull(), F.lit(False)).alias("valid"))


def fingerprint(dependencies: DataFrame, key: str, version: str, model: str) -> DataFrame:
    """(key, fingerprint): the hash over version, model and the dependencies (key, path, sha256) of each key as sorted JSON.

    A key's dependencies are gathered: those of one artifact.
    """
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256"))))
    return dependencies.groupBy(key).agg(F.sha2(F.concat_ws(":", F.lit(version), F.lit(model), F.to_json(pairs)), 256).alias("fingerprint"))


def cited(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, valid): whether every citation of rows (answer_id, source_id) is of a known source."""
    known = sources.select(F.col("source_id"), F.lit(True).alias("known")).distinct()
    return answers.join(known, "source_id", "left").groupBy("answer_id").agg(F.every(F.coalesce("known", F.lit(False))).alias("valid"))


def cleaned_classification(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Proposed classifications made safe: an unknown category becomes research, a client is kept only where the text names it."""
    known = F.col("category").isin(*categories)
    named = (F.char_length("client") <= 200) & F.contains(F.lower("text"), F.lower("client"))
    title = F.when(F.char_length("title").between(1, 300), F.col("title")).otherwise(F.col("stem"))
    return rows.withColumns({"final_category": F.when(known, F.col("category")).otherwise("research"), "fallback": ~F.coalesce(known, F.lit(False)), "final_client": F.when(named, F.col("client")), "final_title": title})
