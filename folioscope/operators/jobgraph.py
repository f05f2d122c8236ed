"""The automation's graph of jobs: sources are classified into parts, parts of one group fill wiki volumes, and what changes at one
level makes the next level's jobs due, obsolete or an error.

A tick is a few joins over the tables of sources, jobs and outputs; only the at most ``calls`` jobs that are called in
a tick meet the driver, and what a provider returns for them comes from the caller's functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import chunking
from folioscope.operators import workflow
from folioscope.sources.shared import cut

PARTS = "array<struct<path: string, sha256: string, size: bigint>>"
COLUMNS = ("key", "fingerprint", "status", "attempts", "error", "category", "client", "project", "parts")
#: The prefix of a volume's key and of its recipe, and the bytes of a volume.
WIKI, RECIPE, VOLUME = "wiki:", "wiki-v1", 48_000
Provider = Callable[[DataFrame], DataFrame]


def with_current(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """jobs with whether each is ready and all it wrote is there as it was written; outputs: (path, sha256), one row a path."""
    written = jobs.where("status = 'ready'").select("key", F.explode("parts").alias("p")).select("key", "p.path", F.col("p.sha256").alias("wrote"))
    there = written.join(outputs.select("path", "sha256"), "path", "left").groupBy("key").agg(F.min(F.coalesce(F.col("wrote") == F.col("sha256"), F.lit(False))).alias("current"))
    return jobs.join(there, "key", "left").withColumn("current", F.coalesce("current", F.lit(False)))


def group_of() -> Column:
    return F.to_json(F.array(*(F.coalesce(c, F.lit("")) for c in ("category", "client", "project"))))


def volumes(ready: DataFrame, sources: DataFrame, model: str, most: int = VOLUME) -> DataFrame:
    """(key, fingerprint, group, volume, category, client, project) of the wiki volumes that the parts of ready jobs fill.

    Parts follow one another by their source and path; a volume's fingerprint covers its parts, their sources and the model.
    """
    parts = ready.select("key", group_of().alias("group"), "category", "client", "project", F.explode("parts").alias("p")).select("key", "group", "category", "client", "project", "p.*")
    items = cut(parts.withColumn("place", F.concat("key", F.lit("\0"), "path")))
    placed = chunking.volumes(items, ["group"], "place", "size", most).select("group", "place", "volume").join(items, ["group", "place"])
    hashes = placed.join(sources.select(F.col("path").alias("key"), F.col("sha256").alias("source")), "key")
    uses = F.array(F.struct("path", "sha256"), F.struct(F.col("key").alias("path"), F.col("source").alias("sha256")))
    flat = hashes.select("group", "volume", "category", "client", "project", F.explode(uses).alias("d"))
    # A volume's parts are as many as its bytes allow.
    whole = flat.groupBy("group", "volume").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set("d")))).alias("uses"), *(F.first(c).alias(c) for c in ("category", "client", "project")))
    key = F.concat(F.lit(WIKI), F.sha2("group", 256), F.lit(":"), F.col("volume").cast("string"))
    return whole.select(key.alias("key"), F.sha2(F.concat(F.lit(f"{RECIPE}:{model}:"), "uses"), 256).alias("fingerprint"), "group", "volume", "category", "client", "project")


def answered(jobs: DataFrame, results: DataFrame, hopeless: bool) -> DataFrame:
    """jobs after the results (key, error, and what was written) of the called ones, which are few."""
    back = results.withColumn("back", F.lit(True)).alias("r")
    rows = jobs.alias("j").join(F.broadcast(back), "key", "left")
    come, failed = F.coalesce(F.col("r.back"), F.lit(False)), F.col("r.error").isNotNull()
    status = F.when(~come, F.col("j.status")).when(failed, "error").otherwise("ready")
    lost = come & failed & F.coalesce(F.lower("r.error").rlike("|".join(workflow.HOPELESS)), F.lit(False)) if hopeless else F.lit(False)
    taken = [F.when(come & ~failed, F.col(f"r.{c}")).otherwise(F.col(f"j.{c}")).alias(c) for c in ("category", "client", "project", "parts") if c in results.columns]
    kept = [F.col(f"j.{c}") for c in ("category", "client", "project", "parts") if c not in results.columns]
    return rows.select("key", "j.fingerprint", status.alias("status"), F.when(lost, workflow.ATTEMPTS).otherwise(F.col("j.attempts")).cast("int").alias("attempts"), F.when(come, F.col("r.error")).otherwise(F.col("j.error")).alias("error"), *taken, *kept, "j.called")


def tick(sources: DataFrame, jobs: DataFrame, outputs: DataFrame, recipe: str, model: str, classify: Provider, write: Provider, provider_ready: bool = True, calls: int = workflow.CALLS, most: int = VOLUME) -> DataFrame:
    """All jobs (COLUMNS and called) after a tick; those of sources have the path as key, those of volumes begin with ``wiki:``.

    Sources go first, by path, then volumes, by group and number; all levels share the calls. ``classify`` gets the called sources and
    gives (key, error, category, client, project, parts), ``write`` the called volumes and gives (key, error, parts). A source that
    is new or changed starts anew; an output that was changed by hand is an error that is not tried again; a source that is gone leaves
    ``removed``, a volume that no parts fill any more ``obsolete``. Both may come back. No table is gathered.
    """
    held = cut(with_current(jobs.select(*COLUMNS), outputs))
    own = held.where(~F.col("key").startswith(WIKI))
    stepped = workflow.ticked(sources, own.select(F.col("key").alias("path"), "fingerprint", "status", "attempts", "current"), recipe, model, provider_ready, calls)
    stepped = stepped.withColumnRenamed("path", "key").alias("n").join(own.alias("o"), "key", "left")
    same = F.coalesce(F.col("n.fingerprint") == F.col("o.fingerprint"), F.lit(False))
    rest = [F.when(same, F.col(f"o.{c}")).alias(c) for c in ("category", "client", "project")]
    begun = cut(stepped.select("key", "n.fingerprint", "n.status", "n.attempts", F.when(same, F.col("o.error")).alias("error"), *rest, F.when(same, F.col("o.parts")).otherwise(F.array().cast(PARTS)).alias("parts"), "n.called"))
    called = begun.where("called")
    after = cut(answered(begun, classify(called), True))
    left = calls - called.count() if provider_ready else 0

    wanted = volumes(after.where("status = 'ready'"), sources, model, most).alias("n")
    both = wanted.join(held.where(F.col("key").startswith(WIKI)).alias("o"), "key", "full_outer")
    gone, fresh, current = F.col("n.fingerprint").isNull(), ~F.col("o.fingerprint").eqNullSafe(F.col("n.fingerprint")), F.coalesce("o.current", F.lit(False))
    edited = (F.col("o.status") == "ready") & ~current
    status = F.when(gone, "obsolete").when(fresh, "pending").when(edited, "error").otherwise(F.col("o.status"))
    attempts = F.when(gone, F.col("o.attempts")).when(fresh, 0).when(edited, workflow.ATTEMPTS).otherwise(F.col("o.attempts"))
    keep = lambda c: F.when(gone | ~fresh, F.col(f"o.{c}"))
    rows = cut(both.select(
        "key", F.coalesce("n.fingerprint", "o.fingerprint").alias("fingerprint"), status.alias("status"), attempts.cast("int").alias("attempts"), keep("error").alias("error"),
        *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("category", "client", "project")), F.coalesce(keep("parts"), F.array().cast(PARTS)).alias("parts"), "n.group", "n.volume",
        (~gone & (fresh | ~current) & (attempts < workflow.ATTEMPTS)).alias("due"),
    ))
    first = rows.where("due").orderBy("group", "volume").limit(max(left, 0)).select("key", F.lit(True).alias("called"))
    taken = F.coalesce("called", F.lit(False))
    tried = rows.join(F.broadcast(first), "key", "left").select(
        "key", "fingerprint", F.when(taken, "processing").otherwise(F.col("status")).alias("status"), (F.col("attempts") + taken.cast("int")).alias("attempts"), "error", "category", "client", "project", "parts", taken.alias("called"),
    )
    tried = cut(tried)
    return after.unionByName(answered(tried, write(tried.where("called")), False))


def lost_documents(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(key, path) of what ready jobs wrote and is no longer there as written."""
    written = jobs.where("status = 'ready'").select("key", F.explode("parts").alias("p")).select("key", "p.path", "p.sha256")
    return written.join(outputs.select("path", "sha256"), ["path", "sha256"], "left_anti").select("key", "path")
