"""A log of proposals: decisions by revision and hash, and operation ids that are answered once.

One function decides on an event; a batch folds it over each proposal's events as they stream by in order, a stream
keeps its state between batches in the checkpoint, so that a restart loses nothing and decides nothing twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.operators.workflow import MOVES

#: Operation ids that a proposal remembers; one more is an error, as none may be forgotten.
OPERATIONS = 20_000
EVENTS = ("proposal_id", "at", "event_id", "action", "revision", "expected_sha256", "content_sha256", "operation_id", "payload")
OUTCOMES = "proposal_id long, event_id long, outcome string, status string, revision int, sha256 string"


class LogFull(ValueError):
    """A proposal has more operations than it may remember."""


@dataclass
class Proposal:
    status: str | None = None
    revision: int = 0
    sha256: str | None = None
    operations: dict[str, str] = field(default_factory=dict)

    def decide(self, e: dict, most: int = OPERATIONS) -> str:
        """accepted, repeated (an operation that was accepted, with the same payload), conflict (with another), stale or refused.

        A save or a revision is a new revision with its own hash. A decision names the revision, the hash or both that it
        was made on. Only what is accepted changes anything or takes an operation id.
        """
        known = self.operations.get(e["operation_id"]) if e["operation_id"] is not None else None
        if known is not None:
            return "repeated" if known == e["payload"] else "conflict"
        to, sources = MOVES.get(e["action"], (None, ()))
        if to is None or self.status not in sources:
            return "refused"
        if e["action"] != "save" and (e["revision"] not in (None, self.revision) or e["expected_sha256"] not in (None, self.sha256)):
            return "stale"
        if e["operation_id"] is not None:
            if len(self.operations) >= most:
                raise LogFull(f"more than {most} operations")
            self.operations[e["operation_id"]] = e["payload"] or ""
        self.status = to
        if e["action"] in ("save", "revise"):
            self.revision, self.sha256 = self.revision + 1, e["content_sha256"]
        return "accepted"


def outcome(key: int | None, e: dict, p: Proposal, said: str) -> dict:
    return {"proposal_id": key, "event_id": e["event_id"], "outcome": said, "status": p.status, "revision": p.revision, "sha256": p.sha256}


def plain(row: dict) -> dict:
    return {k: None if v is None or v is pd.NaT or v != v else v for k, v in row.items()}


def log(events: DataFrame, most: int = OPERATIONS) -> DataFrame:
    """(proposal_id, event_id, outcome, status, revision, sha256) of every event, by time and then id.

    A proposal's events pass through one task in order; what is held is its state, not its events.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, schema = None, None, pa.schema([("proposal_id", pa.int64()), ("event_id", pa.int64()), ("outcome", pa.string()), ("status", pa.string()), ("revision", pa.int32()), ("sha256", pa.string())])
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if now is None or e["proposal_id"] != key:
                    key, now = e["proposal_id"], Proposal()
                out.append(outcome(key, e, now, now.decide(e, most)))
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = events.select(*EVENTS).repartition("proposal_id").sortWithinPartitions("proposal_id", "at", "event_id")
    return rows.mapInArrow(fold, OUTCOMES)


def log_stream(events: DataFrame, most: int = OPERATIONS) -> DataFrame:
    """The same for a stream of events: each batch's are decided in order, on the state that earlier batches left."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        now, out = Proposal(**held), []
        for e in pd.concat(frames).sort_values(["at", "event_id"], kind="stable").astype(object).to_dict("records"):
            e = plain(e)
            out.append(outcome(key[0], e, now, now.decide(e, most)))
        state.update((json.dumps(asdict(now)),))
        made = pd.DataFrame(out)
        yield made.astype({"revision": "int32"})

    grouped = events.select(*EVENTS).groupBy("proposal_id")
    return grouped.applyInPandasWithState(fold, OUTCOMES, "state string", "append", GroupStateTimeout.NoTimeout)


def latest(outcomes: DataFrame) -> DataFrame:
    """(proposal_id, accepted, repeated, conflicts, stale, refused): how often each came out."""
    names = {"accepted": "accepted", "repeated": "repeated", "conflicts": "conflict", "stale": "stale", "refused": "refused"}
    return outcomes.groupBy("proposal_id").agg(*(F.count_if(F.col("outcome") == v).alias(k) for k, v in names.items()))
