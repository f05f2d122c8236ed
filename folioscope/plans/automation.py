"""Queries over the automation's graph of jobs and the log of proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import jobgraph, workflow
from folioscope.plans import dialect as D
from folioscope.plans.base import files, query
from folioscope.sources import vault
from folioscope.sources.shared import new_folder
from folioscope.streaming import proposals
from folioscope.streaming.ingest import run_once

# --- jobs ------------------------------------------------------------------------------------------------------------


def parts(path, sha256, size):
    return F.array(F.struct(path.alias("path"), sha256.alias("sha256"), size.cast("long").alias("size"))).cast(jobgraph.PARTS)


def _graph(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, jobs and outputs: few sources are new, an eighth has an edited output, an eighth has failed for good, some
    jobs' sources are gone; German groups have a volume of older parts, and one volume belongs to no group."""
    rows = files(s, d).withColumns({"new": F.col("doc_id") % 997 == 0, "k": F.col("doc_id") % 8})
    wrote, none = F.concat(F.lit("w/"), "path"), F.array().cast(jobgraph.PARTS)
    state = rows.where("not new").select(
        F.col("path").alias("key"), workflow.fingerprint("v1", "m", F.col("sha256")).alias("fingerprint"), F.when(F.col("k") == 2, "error").otherwise("ready").alias("status"), F.when(F.col("k") == 2, 3).otherwise(1).alias("attempts"),
        F.when(F.col("k") == 2, "bad").alias("error"), "category", "client", F.lit("").alias("project"), F.when(F.col("k") == 2, none).otherwise(parts(wrote, F.col("sha256"), F.col("size"))).alias("parts"),
    )
    gone = state.join(rows.where("doc_id % 16 = 7").select(F.col("path").alias("key")), "key", "left_semi").withColumn("key", F.concat(F.lit("gone/"), "key"))
    group = F.to_json(F.array("category", "client", F.lit("")))
    german = rows.where("category = 'de'").select("category", "client", group.alias("g")).distinct()
    old = german.select(F.concat(F.lit("wiki:"), F.sha2("g", 256), F.lit(":0")).alias("key"), F.lit("old").alias("fingerprint"), F.lit("ready").alias("status"), F.lit(2).alias("attempts"), F.lit(None).cast("string").alias("error"), "category", "client", F.lit("").alias("project"), none.alias("parts"))
    dead = s.range(1).select(F.lit("wiki:dead:0").alias("key"), F.lit("old").alias("fingerprint"), F.lit("ready").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"), *(F.lit("x").alias(c) for c in ("category", "client", "project")), none.alias("parts"))
    outputs = rows.where("not new and k <> 2").select(wrote.alias("path"), F.when(F.col("k") == 1, "edited").otherwise(F.col("sha256")).alias("sha256"))
    return rows.select("path", "sha256"), state.unionByName(gone).unionByName(old).unionByName(dead), outputs


def _classify(called: DataFrame) -> DataFrame:
    """A stand-in for the provider: a called source's group is in its path, and it becomes one part of ten bytes."""
    client = F.split("key", "/")[1]
    return called.select("key", F.lit(None).cast("string").alias("error"), F.lit("new").alias("category"), client.alias("client"), F.lit("").alias("project"), parts(F.concat(F.lit("w/"), "key"), F.lit("h"), F.lit(10)).alias("parts"))


def _write(called: DataFrame) -> DataFrame:
    return called.select("key", F.lit(None).cast("string").alias("error"), parts(F.concat("key", F.lit(".md")), F.lit("w"), F.lit(1)).alias("parts"))


@query(f"""WITH RECURSIVE {D.DOCS}, j AS (SELECT *, doc_id % 997 = 0 AS fresh, doc_id % 8 AS k, strlen(text) AS size FROM docs),
    s AS (SELECT *, fresh AND row_number() OVER (PARTITION BY fresh ORDER BY path) <= 3 AS called FROM j),
    r AS (SELECT path, sha256 AS source, CASE WHEN fresh THEN 'new' ELSE category END AS category, client, CASE WHEN fresh THEN 'h' ELSE sha256 END AS part, CAST(CASE WHEN fresh THEN 10 ELSE size END AS BIGINT) AS size FROM s WHERE called OR NOT fresh AND k NOT IN (1, 2)),
    o AS (SELECT *, '["' || category || '","' || client || '",""]' AS g, row_number() OVER (PARTITION BY category, client ORDER BY path) AS i FROM r),
    v AS (SELECT g, path, i, size AS filled, 0 AS volume FROM o WHERE i = 1
          UNION ALL SELECT o.g, o.path, o.i, CASE WHEN filled > 0 AND filled + o.size > 48000 THEN o.size ELSE filled + o.size END, volume + CASE WHEN filled > 0 AND filled + o.size > 48000 THEN 1 ELSE 0 END FROM v JOIN o ON o.g = v.g AND o.i = v.i + 1),
    deps AS (SELECT g, volume, category, client, unnest([{{'p': 'w/' || o.path, 'h': part}}, {{'p': o.path, 'h': source}}]) AS d FROM v JOIN o USING (g, path)),
    w AS (SELECT g, volume, category, client, sha256('wiki-v1:m:{{' || string_agg('"' || d.p || '":"' || d.h || '"', ',' ORDER BY d.p) || '}}') AS fingerprint FROM deps GROUP BY ALL),
    c AS (SELECT *, row_number() OVER (ORDER BY g, volume) <= 3 - (SELECT count(*) FROM s WHERE called) AS called FROM w)
    SELECT path AS key, CASE WHEN called THEN 'ready' WHEN fresh THEN 'pending' WHEN k IN (1, 2) THEN 'error' ELSE 'ready' END AS status, CASE WHEN called THEN 1 WHEN fresh THEN 0 WHEN k IN (1, 2) THEN 3 ELSE 1 END AS attempts, called,
           CASE WHEN called THEN 'new' WHEN fresh THEN '' ELSE category END AS category, CASE WHEN fresh AND NOT called THEN 0 WHEN k = 2 AND NOT fresh THEN 0 ELSE 1 END AS parts, '' AS wiki FROM s
    UNION ALL SELECT 'gone/' || path, 'removed', CASE WHEN k = 2 THEN 3 ELSE 1 END, false, category, CASE WHEN k = 2 THEN 0 ELSE 1 END, '' FROM s WHERE doc_id % 16 = 7 AND NOT fresh
    UNION ALL SELECT 'wiki:' || sha256(g) || ':' || volume, CASE WHEN called THEN 'ready' ELSE 'pending' END, CASE WHEN called THEN 1 ELSE 0 END, called, category, CASE WHEN called THEN 1 ELSE 0 END, fingerprint FROM c
    UNION ALL SELECT DISTINCT 'wiki:' || sha256(g) || ':0', 'obsolete', 2, false, 'de', 0, 'old' FROM (SELECT '["' || category || '","' || client || '",""]' AS g FROM docs WHERE category = 'de') WHERE g NOT IN (SELECT g FROM w)
    UNION ALL SELECT 'wiki:dead:0', 'obsolete', 1, false, 'x', 0, 'old'""")
def job_graph(s, d):
    """A tick over both levels: sources take calls first, volumes what is left; volumes whose parts changed start anew, one without parts is obsolete."""
    jobs = jobgraph.tick(*_graph(s, d), "v1", "m", _classify, _write)
    wiki = F.when(F.col("key").startswith(jobgraph.WIKI), F.col("fingerprint")).otherwise("")
    return jobs.select("key", "status", "attempts", "called", F.coalesce("category", F.lit("")).alias("category"), F.size("parts").alias("parts"), wiki.alias("wiki"))


# --- proposals -------------------------------------------------------------------------------------------------------


def _events(rows: DataFrame) -> DataFrame:
    """Events as requests: actions, revisions, hashes and operation ids by remainders of the id."""
    n = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ("save", "revise", "approve", "reject", "revise"))), (n % 5 + 1).cast("int"))
    text = lambda c: c.cast("string")
    return rows.select(
        F.col("user_id").alias("proposal_id"), F.col("ts").alias("at"), "event_id", action.alias("action"), F.when(n % 4 == 1, (n % 3).cast("int")).alias("revision"),
        F.when(n % 6 == 5, F.concat(F.lit("c"), text(n % 2))).alias("expected_sha256"), F.concat(F.lit("c"), text(n % 2)).alias("content_sha256"),
        F.when(n % 9 > 0, F.concat(F.lit("op"), text(n % 7))).alias("operation_id"), F.concat(action, text(n % 2)).alias("payload"),
    )


_LOG = """WITH RECURSIVE e AS (SELECT user_id AS p, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, ['save', 'revise', 'approve', 'reject', 'revise'][event_id % 5 + 1] AS a,
        CASE WHEN event_id % 4 = 1 THEN event_id % 3 END AS r, CASE WHEN event_id % 6 = 5 THEN 'c' || event_id % 2 END AS x, 'c' || event_id % 2 AS c, CASE WHEN event_id % 9 > 0 THEN 'op' || event_id % 7 END AS op FROM events),
    f AS (SELECT DISTINCT p, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(NULL AS VARCHAR) AS status, 0 AS revision, CAST(NULL AS VARCHAR) AS sha, CAST([] AS VARCHAR[]) AS ops FROM e
        UNION ALL SELECT p, k, event_id, o, CASE WHEN o <> 'accepted' THEN status WHEN a = 'approve' THEN 'approved' WHEN a = 'reject' THEN 'rejected' ELSE 'pending' END, revision + CASE WHEN o = 'accepted' AND a IN ('save', 'revise') THEN 1 ELSE 0 END,
            CASE WHEN o = 'accepted' AND a IN ('save', 'revise') THEN c ELSE sha END, CASE WHEN o = 'accepted' AND op IS NOT NULL THEN list_append(ops, op || ':' || a || right(c, 1)) ELSE ops END
        FROM (SELECT e.p, e.k, e.event_id, a, c, op, status, revision, sha, ops, CASE WHEN op IS NOT NULL AND list_contains(ops, op || ':' || a || right(c, 1)) THEN 'repeated'
                WHEN op IS NOT NULL AND len(list_filter(ops, lambda y: starts_with(y, op || ':'))) > 0 THEN 'conflict'
                WHEN NOT (CASE WHEN a = 'save' THEN status IS NULL OR status = 'pending' ELSE status IS NOT NULL AND status = 'pending' END) THEN 'refused'
                WHEN a <> 'save' AND (coalesce(r <> revision, false) OR (x IS NOT NULL AND x IS DISTINCT FROM sha)) THEN 'stale' ELSE 'accepted' END AS o
              FROM f JOIN e ON e.p = f.p AND e.k = f.k + 1)) """


@query(_LOG + "SELECT p AS proposal_id, event_id, outcome, coalesce(status, '') AS status, revision, coalesce(sha, '') AS sha256 FROM f WHERE k > 0")
def proposal_log(s, d):
    """Every request to a proposal and how it came out."""
    return proposals.log(_events(vault.read_table(s, d, "events"))).withColumns({c: F.coalesce(c, F.lit("")) for c in ("status", "sha256")})


@query(_LOG + "SELECT p AS proposal_id, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'repeated') AS repeated, count(*) FILTER (outcome = 'conflict') AS conflicts, count(*) FILTER (outcome = 'stale') AS stale, count(*) FILTER (outcome = 'refused') AS refused FROM f WHERE k > 0 GROUP BY p")
def proposal_stream(s, d):
    """The same as a stream over files of events, in batches, with the state kept in the checkpoint."""
    folder = new_folder(s, "proposals")
    rows = vault.read_table(s, d, "events")
    # Two files, one after the other in time: a stream is in order.
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    # One number for both files: approximate, it may differ from one time to the next, and events between two would be lost or come twice.
    middle = rows.agg(F.percentile_approx(at, 0.5).alias("m")).first()["m"]
    halves = rows.withColumn("late", F.coalesce(at > F.lit(middle), F.lit(False)))
    for k, late in enumerate((False, True)):
        halves.where(F.col("late") == late).drop("late").write.parquet(f"{folder}/in/{k}")
        source = s.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        outcomes = run_once(proposals.log_stream(_events(source)), folder)
    return proposals.latest(outcomes)
