"""Jobs and proposals as folds over their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Failures after which a job is not tried again, and calls to a provider in one tick.
ATTEMPTS, CALLS = 3, 3
#: What an error says of a file that no further try can read.
HOPELESS = ("protetto", "password", "non supportato")


def latest_state(events: DataFrame, key: str, at: str, tie: str, state: str) -> DataFrame:
    """(key, state, events): the state of each key's last event, by time and then id; no key's events are gathered."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, tie)).alias(state), F.count(F.lit(1)).alias("events"))


def exhausted(events: DataFrame, key: str, kind: str, failure: str) -> DataFrame:
    """(key, failures, blocked) of the keys with failures."""
    return events.where(F.col(kind) == failure).groupBy(key).agg(F.count(F.lit(1)).alias("failures")).withColumn("blocked", F.col("failures") >= ATTEMPTS)


def operations(events: DataFrame, operation: str, payload: str) -> DataFrame:
    """(operation, sent, conflict): how often an operation id came, and whether it came with different payloads."""
    return events.groupBy(operation).agg(F.count(F.lit(1)).alias("sent"), (F.min(payload) != F.max(payload)).alias("conflict"))


def proposals(events: DataFrame, status: str = "", category: str = "") -> DataFrame:
    """(proposal_id, status, category, updated_at) of each proposal's last event, newest first; empty filters hold for all."""
    last = F.max_by(F.struct("status", "category", "updated_at"), F.struct("updated_at", "event_id")).alias("last")
    rows = events.groupBy("proposal_id").agg(last).select("proposal_id", "last.*")
    keep = F.lit(True)
    if status:
        keep = keep & (F.col("status") == status)
    if category:
        keep = keep & (F.col("category") == category)
    return rows.where(keep).orderBy(F.desc("updated_at"), "proposal_id")


#: The state that each action leads to, and the states it may start from; fixed values of the workflow.
MOVES = {"save": ("pending", (None, "pending")), "revise": ("pending", ("pending",)), "approve": ("approved", ("pending",)), "reject": ("rejected", ("pending",))}
#: Actions that state the revision they were decided on.
DECISIONS = ("revise", "approve", "reject")


def proposal_history(events: DataFrame, at: list[str]) -> DataFrame:
    """(proposal_id, status, revision, refused) after all events (proposal_id, action, revision, ...), in the order of ``at``.

    An event that its state does not allow, or that was decided on another revision than the latest, is refused and
    changes nothing; saves and revisions raise the revision. A null revision is not compared. A proposal's own events
    are folded in their order, by one aggregate in the JVM.
    """
    zero = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("revision"), F.lit(0).alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        status, allowed = acc["status"], F.lit(False)
        stale = e["action"].isin(*DECISIONS) & F.coalesce(e["revision"] != acc["revision"], F.lit(False))
        for action, (to, sources) in MOVES.items():
            fits = F.coalesce(acc["status"].isin(*(s for s in sources if s)), F.lit(False))
            fits = fits | acc["status"].isNull() if None in sources else fits
            hit = (e["action"] == action) & fits & ~stale
            status, allowed = F.when(hit, to).otherwise(status), allowed | hit
        written = allowed & e["action"].isin("save", "revise")
        return F.struct(status.alias("status"), (acc["revision"] + written.cast("int")).alias("revision"), (acc["refused"] + (~allowed).cast("int")).alias("refused"))

    folded = events.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct(*at, "action", "revision"))).alias("all"))
    return folded.withColumn("s", F.aggregate("all", zero, step)).select("proposal_id", "s.status", "s.revision", "s.refused")


def fingerprint(recipe: str, model: str, sha256: Column) -> Column:
    """What a job was made from: it is made anew when the recipe, the model or the bytes of its source change."""
    return F.sha2(F.concat_ws(":", F.lit(recipe), F.lit(model), sha256), 256)


def ticked(sources: DataFrame, jobs: DataFrame, recipe: str, model: str, provider_ready: bool = True, calls: int = CALLS) -> DataFrame:
    """(path, fingerprint, status, attempts, called) of every job after a tick.

    sources: (path, sha256), one row a path; jobs: (path, fingerprint, status, attempts, current), where current says
    whether what a job wrote is still there as written. A source that is new or has changed gets a new job; a ready job
    whose output was changed by hand is an error that is not tried again; a job without its source is removed. Of the
    jobs that are not done and may be tried, the first ``calls`` by path are called: their attempt counts before the
    call, so that one that never returns is counted too. Without a provider they wait.
    """
    both = sources.select("path", fingerprint(recipe, model, F.col("sha256")).alias("now")).join(jobs, "path", "full_outer")
    gone, fresh, current = F.col("now").isNull(), ~F.col("fingerprint").eqNullSafe(F.col("now")), F.coalesce("current", F.lit(False))
    edited = (F.col("status") == "ready") & ~current
    status = F.when(gone, "removed").when(fresh, "pending").when(edited, "error").otherwise(F.col("status"))
    attempts = F.when(gone, F.col("attempts")).when(fresh, 0).when(edited, ATTEMPTS).otherwise(F.col("attempts"))
    rows = both.select(
        "path", F.coalesce("now", "fingerprint").alias("fingerprint"), status.alias("status"), attempts.cast("int").alias("attempts"),
        (~gone & (fresh | ~current) & (attempts < ATTEMPTS)).alias("due"),
    )
    if not provider_ready:
        return rows.select("path", "fingerprint", F.when(F.col("due"), "waiting").otherwise(F.col("status")).alias("status"), "attempts", F.lit(False).alias("called"))
    # At most ``calls`` rows.
    first = rows.where("due").orderBy("path").limit(calls).select("path", F.lit(True).alias("called"))
    called = F.coalesce("called", F.lit(False))
    return rows.join(F.broadcast(first), "path", "left").select(
        "path", "fingerprint", F.when(called, "processing").otherwise(F.col("status")).alias("status"), (F.col("attempts") + called.cast("int")).alias("attempts"), called.alias("called"),
    )


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs (path, status, attempts) with the results (path, error) of calls: ready without an error; one that says that
    the file can't be read is not tried again."""
    hopeless = F.lower("error").rlike("|".join(HOPELESS))
    rows = jobs.join(results.select("path", "error", F.lit(True).alias("back")), "path", "left")
    status = F.when(F.col("back").isNull(), F.col("status")).when(F.col("error").isNull(), "ready").otherwise("error")
    return rows.select("path", status.alias("status"), F.when(F.coalesce(hopeless, F.lit(False)), ATTEMPTS).otherwise(F.col("attempts")).alias("attempts"), "error")


def retried(jobs: DataFrame) -> DataFrame:
    """jobs (path, status, attempts, error) with all errors pending again, as if never tried."""
    failed = F.col("status") == "error"
    return jobs.select(
        "path", F.when(failed, "pending").otherwise(F.col("status")).alias("status"), F.when(failed, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(~failed, F.col("error")).alias("error"),
    )


def automation_report(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row over sources (path) and jobs (path, status, current): sources, ready and blocked ones, and wikis that are current."""
    joined = sources.select("path").join(jobs, "path", "left")
    blocked = F.col("status").isin("error", "unsupported")
    of_sources = joined.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("current")).alias("ready"), F.count_if(blocked).alias("blocked"))
    wikis = jobs.where(F.col("path").startswith("wiki:")).agg(F.count_if(F.col("current")).alias("wikis"))
    return of_sources.crossJoin(wikis)
