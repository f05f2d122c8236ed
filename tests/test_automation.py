"""The graph of jobs against a simulation, the log of proposals as batch and stream, and the search for items."""

from __future__ import annotations

import hashlib
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import evaluate, jobgraph, workflow
from folioscope.sources.shared import new_folder
from folioscope.streaming import proposals
from folioscope.streaming.ingest import run_once

MOST = 25
JOBS = f"key string, fingerprint string, status string, attempts int, error string, category string, client string, project string, parts {jobgraph.PARTS}"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def provider(path: str, text: str) -> tuple[str | None, list]:
    """(error, parts) of a source: some fail, some for good, some make two parts."""
    if path.endswith("x"):
        return ("HTTP 500", [])
    if path.endswith("y"):
        return ("File protetto", [])
    return None, [(f"w/{path}:{k}", sha(f"{path}{text}{k}"), 10) for k in range(2 if path.endswith("2") else 1)]


class Simulation:
    """The rules of a tick over plain dictionaries."""

    def __init__(self):
        self.jobs, self.disk = {}, {}

    def current(self, job):
        return job["status"] == "ready" and bool(job["parts"]) and all(self.disk.get(p) == h for p, h, _ in job["parts"])

    def tick(self, sources: dict[str, str], ready: bool, calls: int) -> set[str]:
        called = set()
        for path in sorted(sources):
            fingerprint = sha(f"v1:m:{sha(sources[path])}")
            job = self.jobs.get(path)
            if job is None or job["fingerprint"] != fingerprint:
                job = self.jobs[path] = {"fingerprint": fingerprint, "status": "pending", "attempts": 0, "parts": [], "group": None}
            if self.current(job):
                continue
            if job["status"] == "ready":
                job.update(status="error", attempts=3)
            if job["attempts"] >= 3:
                continue
            if not ready:
                job["status"] = "waiting"
            elif len(called) < calls:
                called.add(path)
                job["attempts"] += 1
                error, parts = provider(path, sources[path])
                if error:
                    job.update(status="error", attempts=3 if "protetto" in error else job["attempts"])
                else:
                    job.update(status="ready", parts=parts, group=("c" + path[0], "", ""))
                    self.disk.update({p: h for p, h, _ in parts})
        for path, job in self.jobs.items():
            if not path.startswith("wiki:") and path not in sources:
                job["status"] = "removed"
        groups = {}
        for path in sorted(p for p in self.jobs if not p.startswith("wiki:")):
            if self.current(self.jobs[path]):
                groups.setdefault(json.dumps(self.jobs[path]["group"], separators=(",", ":")), []).extend((path, *p) for p in sorted(self.jobs[path]["parts"]))
        active = set()
        for group in sorted(groups):
            batches, size = [[]], 0
            for item in groups[group]:
                if size + item[3] > MOST and batches[-1]:
                    batches, size = [*batches, []], 0
                batches[-1].append(item)
                size += item[3]
            for volume, batch in enumerate(batches):
                key = f"wiki:{sha(group)}:{volume}"
                active.add(key)
                uses = {p: h for _, p, h, _ in batch} | {path: sha(sources[path]) for path, _, _, _ in batch}
                fingerprint = sha("wiki-v1:m:" + json.dumps(dict(sorted(uses.items())), separators=(",", ":")))
                job = self.jobs.get(key)
                if job is None or job["fingerprint"] != fingerprint:
                    job = self.jobs[key] = {"fingerprint": fingerprint, "status": "pending", "attempts": 0, "parts": [], "group": tuple(json.loads(group))}
                if self.current(job):
                    continue
                if job["status"] == "ready":
                    job.update(status="error", attempts=3)
                if not ready or len(called) >= calls or job["attempts"] >= 3:
                    continue
                called.add(key)
                job["attempts"] += 1
                if key[-1] == "1":
                    job["status"] = "error"
                else:
                    job.update(status="ready", parts=[(key + ".md", sha(fingerprint), 1)])
                    self.disk[key + ".md"] = sha(fingerprint)
        for key, job in self.jobs.items():
            if key.startswith("wiki:") and key not in active:
                job["status"] = "obsolete"
        return called


def test_ticks_follow_the_rules(spark):
    sim, jobs, disk = Simulation(), spark.createDataFrame([], JOBS), {}
    sources = {f"{g}/{k}": f"text {g}{k}" for g in "ab" for k in ("1", "2", "3", "x", "y")}

    def classify(called):
        texts = {r["key"]: sources[r["key"]] for r in called.select("key").collect()}
        rows = [(p, *((e, None, None, None) if e else (None, "c" + p[0], "", "")), parts) for p, t in texts.items() for e, parts in [provider(p, t)]]
        return spark.createDataFrame(rows, f"key string, error string, category string, client string, project string, parts {jobgraph.PARTS}")

    def write(called):
        rows = [(r["key"], "HTTP 500" if r["key"][-1] == "1" else None, [] if r["key"][-1] == "1" else [(r["key"] + ".md", sha(r["fingerprint"]), 1)]) for r in called.collect()]
        return spark.createDataFrame(rows, f"key string, error string, parts {jobgraph.PARTS}")

    for step in range(9):
        ready, calls = step != 1, 3 if step < 3 else 7
        if step == 5:
            sources["a/1"] = "changed"
            disk["w/b/3:0"] = sim.disk["w/b/3:0"] = "edited by hand"
        if step == 6:
            for k in "123xy":
                del sources[f"b/{k}"]
        if step == 8:
            sources["b/1"] = "text b1"
        said = jobgraph.tick(spark.createDataFrame([(p, sha(t)) for p, t in sources.items()], "path string, sha256 string"), jobs, spark.createDataFrame(list(disk.items()), "path string, sha256 string"), "v1", "m", classify, write, ready, calls, MOST).collect()
        called = sim.tick(sources, ready, calls)
        assert {r["key"] for r in said if r["called"]} == called, step
        assert {r["key"]: (r["fingerprint"], r["status"], r["attempts"], sorted(map(tuple, r["parts"]))) for r in said} == {k: (j["fingerprint"], j["status"], j["attempts"], sorted(j["parts"])) for k, j in sim.jobs.items()}, step
        disk.update({p["path"]: p["sha256"] for r in said if r["called"] for p in r["parts"]})
        jobs = spark.createDataFrame([tuple(r[c] for c in jobgraph.COLUMNS) for r in said], JOBS)
    states = {j["status"] for j in sim.jobs.values()}
    assert {"ready", "error", "removed", "obsolete"} <= states


EVENTS = "proposal_id long, at long, event_id long, action string, revision int, expected_sha256 string, content_sha256 string, operation_id string, payload string"


def test_decisions_and_operation_ids():
    p = proposals.Proposal()
    say = lambda action, op=None, payload="p", revision=None, expected=None, content=None: p.decide({"action": action, "operation_id": op, "payload": payload, "revision": revision, "expected_sha256": expected, "content_sha256": content})
    assert say("approve") == "refused" and say("dance") == "refused"
    assert say("save", "o1", content="h1") == "accepted" and say("save", "o1", content="h1") == "repeated" and say("save", "o1", "q") == "conflict"
    assert say("revise", "o2", revision=1, expected="h0") == "stale" and say("revise", "o2", revision=1, expected="h1", content="h2") == "accepted"
    assert say("approve", "o3", revision=1) == "stale" and say("approve", "o3", revision=2, expected="h2") == "accepted"
    assert say("reject") == "refused" and (p.status, p.revision, p.sha256) == ("approved", 2, "h2")
    full = proposals.Proposal("pending", 1, "h", {"o": "p"})
    with pytest.raises(proposals.LogFull):
        full.decide({"action": "revise", "operation_id": "n", "payload": "p", "revision": None, "expected_sha256": None, "content_sha256": "h"}, 1)


def test_a_restarted_stream_equals_the_batch(spark):
    rows = [(k % 3 if k % 11 else None, k // 3, k, ["save", "revise", "revise", "approve"][(k // 3) % 4 if k % 5 else 1], [None, 1, 2][k % 3 if k % 2 else 0], None, f"c{k % 4}", None if k % 6 == 0 else f"o{k % 13}", f"p{k % 2}") for k in range(90)]
    folder = new_folder(spark, "log")
    for low in range(0, 90, 30):
        spark.createDataFrame(rows[low : low + 30], EVENTS).coalesce(1).write.parquet(f"{folder}/in/{low}")
        # Each call starts a new query from the checkpoint, as after a loss.
        source = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        streamed = run_once(proposals.log_stream(source), folder)
    want = proposals.log(spark.createDataFrame(rows, EVENTS))
    columns = want.columns
    assert sorted(map(str, streamed.select(columns).collect())) == sorted(map(str, want.collect()))
    assert {r["outcome"] for r in want.collect()} == {"accepted", "repeated", "conflict", "stale", "refused"}


def test_containing_finds_every_item(spark):
    docs = spark.createDataFrame([(1, "abc abd"), (2, "漢字😀x"), (3, ""), (4, None), (5, "abcabc")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "abc"), ("b", "bc"), ("c", "字😀"), ("d", "abc"), ("e", ""), ("f", None), ("g", "zzz")], "query_id string, text string")
    want = sorted((q["query_id"], d["doc_id"]) for q in items.collect() for d in docs.collect() if q["text"] is not None and d["text"] is not None and q["text"] in d["text"])
    for most in (1000, 3):
        assert sorted(map(tuple, evaluate.containing(docs, items, most).collect())) == want
    assert evaluate.containing(docs, items.limit(0)).count() == 0 == evaluate.containing(docs.limit(0), items).count()


def test_finished_and_lost(spark):
    jobs = spark.createDataFrame([("k", "f", "ready", 1, None, "c", "", "", [("p", "h", 1)])], JOBS)
    assert jobgraph.lost_documents(jobs, spark.createDataFrame([("p", "other")], "path string, sha256 string")).collect() == [("k", "p")]
    assert workflow.CALLS == 3 and jobs.where(F.col("key") == "k").count() == 1


def test_the_stream_halves_at_one_time(spark, tmp_path, monkeypatch):
    """An approximate median that comes out otherwise each time it is computed loses no event and repeats none."""
    from folioscope.plans import automation

    @F.pandas_udf("long")
    def unsteady(x: pd.Series) -> int:
        return int(x.median()) + int.from_bytes(os.urandom(4)) % 200 * 1_000_000

    rows = spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(automation.F, "percentile_approx", lambda x, p: unsteady(x))
    out = automation.proposal_stream(spark, str(tmp_path))
    names = ("accepted", "repeated", "conflicts", "stale", "refused")
    assert sum(sum(r[c] for c in names) for r in out.collect()) == 400
