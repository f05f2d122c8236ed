"""Conversation structure repair: an error-correcting Earley parse of every conversation's roles.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Turns may be kept, given another role or
deleted, and turns may be inserted; the cheapest such edits, ties by the least audit string, are the repair.

The grammar is left-linear: every production has at most one nonterminal, in its first place. So every chart item begins
in column 0, a column follows from the one before it, and a conversation is parsed in one pass as its turns stream by
in order. An item keeps its cost, its place among the audits of its column and the digest of the repair so far; the
audit itself is read off links from column to column, 8 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import slices

#: Characters that count as white space.
BLANKS = " \t\n\x0b\x0c\r"
END = "end"
#: Productions; a body's names that are no head are terminals: initials of roles, or the end of the conversation.
PRODUCTIONS = (
    ("dialogue", (END,)),
    ("dialogue", ("answered", END)),
    ("answered", ("asked", "a")),
    ("asked", ("u",)),
    ("asked", ("headed", "u")),
    ("asked", ("answered", "u")),
    ("headed", ("s",)),
)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
FINDINGS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Costs:
    """Keeping a turn costs nothing."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass(frozen=True)
class Grammar:
    """Weighted role grammar; ``roles`` names the terminals that a turn may be rewritten to or inserted as."""

    productions: tuple = PRODUCTIONS
    roles: tuple = (("u", "user"), ("a", "assistant"))
    start: str = "dialogue"
    costs: Costs = field(default_factory=Costs)

    def __post_init__(self):
        heads = {head for head, _ in self.productions}
        if any(not body or heads & set(body[1:]) for _, body in self.productions):
            raise ValueError("every production needs a body whose nonterminals stand in its first place only")

    def waiting(self) -> list[tuple[int, int, str]]:
        """Items before a terminal: (production, dot, terminal)."""
        heads = {head for head, _ in self.productions}
        return [(p, d, x) for p, (_, body) in enumerate(self.productions) for d, x in enumerate(body) if x not in heads]


class Chart:
    """The last column of the chart, and the links of all audits. Items are keyed by (production, dot).

    An item's value is (cost, rank, tail, digest): its audit is that of ``rank`` in the column, followed by the inserts in
    ``tail``. Audits of a column end with the edit of the same turn, so none begins another, and ranks decide ties.
    """

    def __init__(self, grammar: Grammar):
        self.grammar, self.roles = grammar, dict(grammar.roles)
        self.terminal = {(p, d): x for p, d, x in grammar.waiting()}
        # A nonterminal that is complete from column 0 to here takes these items over their first symbol.
        self.over = {head: [(p, 1) for p, (_, body) in enumerate(grammar.productions) if body[0] == head] for head, _ in grammar.productions}
        self.links, self.shapes = [], {}
        self.column = self.closed({item: (0, 0, "", None) for item in self.terminal if item[1] == 0})

    def closed(self, column: dict) -> dict:
        """The column with all that follows in it: completed nonterminals and inserted turns, least (cost, audit) each."""
        todo = list(column)
        while todo:
            item = todo.pop()
            cost, rank, tail, digest = column[item]
            head, body = self.grammar.productions[item[0]]
            if item[1] == len(body):
                found = [(x, (cost, rank, tail), None) for x in self.over[head]]
            elif (role := self.roles.get(self.terminal[item])) is not None:
                found = [((item[0], item[1] + 1), (cost + self.grammar.costs.insert, rank, tail + "I"), role)]
            else:
                continue
            for target, value, role in found:
                if target not in column or value < column[target][:3]:
                    column[target] = (*value, digest if role is None else written(digest, role, ""))
                    todo.append(target)
        return column

    def scan(self, role: str, text: str, fault: int) -> None:
        """The next column: the turn is deleted, kept or given the role that an item waits for."""
        costs, best = self.grammar.costs, {}
        initial, extra = role[:1], costs.truncated if fault == TRUNCATED else 0
        for item, wanted in self.terminal.items():
            if item not in self.column:
                continue
            cost, rank, tail, digest = self.column[item]
            moves = [(item, (cost + costs.delete, rank, tail + "D"), None)]
            if fault not in (BLANK, DUPLICATE):
                after = (item[0], item[1] + 1)
                if wanted == initial:
                    moves.append((after, (cost + extra, rank, tail + "K"), role))
                if wanted in self.roles:
                    moves.append((after, (cost + costs.rerole + extra, rank, tail + "R"), self.roles[wanted]))
            for target, value, spoken in moves:
                if target not in best or value < best[target][0]:
                    best[target] = (value, spoken, digest)
        audits = tuple(sorted({value[1:] for value, _, _ in best.values()}))
        self.links.append(self.shapes.setdefault(audits, audits))
        place = {audit: k for k, audit in enumerate(audits)}
        self.column = self.closed({item: (value[0], place[value[1:]], "", digest if spoken is None else written(digest, spoken, text)) for item, (value, spoken, digest) in best.items()})

    def repair(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired turns) of the completed chart."""
        complete = [self.column[item] for item, x in self.terminal.items() if x == END and item in self.column]
        cost, rank, tail, digest = min(complete, key=lambda value: value[:3])
        letters = [tail]
        for audits in reversed(self.links):
            rank, tail = audits[rank]
            letters.append(tail)
        return cost, "".join(reversed(letters)), (digest or hashlib.sha256()).hexdigest()


def written(digest, role: str, text: str):
    """The digest after one more turn; None stands for no turn yet."""
    line = f"{role}:{text}".encode()
    if digest is None:
        return hashlib.sha256(line)
    digest = digest.copy()
    digest.update(b"\n" + line)
    return digest


class Findings:
    """What is told of one conversation, gathered turn by turn."""

    def __init__(self, grammar: Grammar, legal: frozenset = frozenset({"su", "ua", "au"})):
        self.chart, self.legal, self.faults, self.illegal, self.before = Chart(grammar), legal, [0] * 4, 0, None
        self.least = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + role[:1] not in self.legal
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        self.chart.scan(role, text, fault)

    def row(self) -> dict:
        gaps = 0 if self.least is None else min(self.last - self.least + 1 - self.turns, MOST)
        cost, audit, digest = self.chart.repair()
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the contract's damage by crc32 of ``conv_id:turn``, nulls written as one space.

    Of a dropped turn a row without text stays, marked as gone, so that its conversation is not lost.
    """
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def with_faults(turns: DataFrame) -> DataFrame:
    """turns with ``fault``: the first that holds of blank, duplicate (role and text came before), truncated."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    # One shuffle serves the window, which streams over its sorted rows, and the parse.
    rows = turns.repartition("conv_id").withColumns({"_same": same, "_last": last})
    earlier = Window.partitionBy("conv_id", "_same", "gone").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(F.col("_last") == "", BLANK).when(F.row_number().over(earlier) > 1, DUPLICATE).when(~F.col("_last").isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return rows.withColumn("fault", fault.cast("int")).drop("_same", "_last")


def repair(turns: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``turns`` has conv_id, turn, role, text and, to keep conversations without turns, rows that are ``gone``. Null
    roles and texts are one space; a null conv_id is a conversation; null turns come first; turns with one number go by role, then
    text. Without turns the counts are 0, the audit is empty and the hash that of the empty string. Other columns are not read; gaps
    end at the largest long. A conversation's hash and audit are sequential, so it is one task's stream, not held whole.
    """
    grammar = grammar or Grammar()
    have = turns if "gone" in turns.columns else turns.withColumn("gone", F.lit(False))
    filled = have.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), "gone")
    rows = with_faults(filled).sortWithinPartitions("conv_id", *order())
    key = rows.schema["conv_id"]
    schema = T.StructType([T.StructField("conv_id", key.dataType), *T.StructType.fromDDL(FINDINGS).fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, out = None, None, []
        for batch in slices(batches):
            ids = batch.column("conv_id")
            for key_, turn, role, text, gone, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")), strict=True):
                if now is None or key_ != known:
                    if now is not None:
                        out.append({"conv_id": known, **now.row()})
                    known, now = key_, Findings(grammar)
                if not gone:
                    now.add(turn, role, text, fault)
            if len(out) >= 1000:
                yield as_batch(out, ids.type)
                out = []
        if now is not None:
            out.append({"conv_id": known, **now.row()})
            yield as_batch(out, ids.type)

    return rows.mapInArrow(parse, schema)


def as_batch(rows: list[dict], key: pa.DataType) -> pa.RecordBatch:
    kinds = [("conv_id", key), *((x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in FINDINGS.split(", "))]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def edits(repairs: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """(conv_id, place, row, edit, new_role): a row for each turn of the repaired conversations, by their audits.

    ``row`` counts a conversation's turns in order from 1, null for an inserted turn; ``new_role`` is null where a turn
    keeps its role. A repair of an odd number of turns begins with the system's.
    """
    roles = dict((grammar or Grammar()).roles)
    key = repairs.schema["conv_id"]
    schema = T.StructType([T.StructField("conv_id", key.dataType), *T.StructType.fromDDL("place long, row long, edit string, new_role string").fields])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.schema([("conv_id", batch.column("conv_id").type), ("place", pa.int64()), ("row", pa.int64()), ("edit", pa.string()), ("new_role", pa.string())])
            out = []
            for key_, audit in zip(batch.column("conv_id").to_pylist(), batch.column("audit").to_pylist(), strict=True):
                headed, place, row = (len(audit) - audit.count("D")) % 2, 0, 0
                for edit in audit:
                    row += edit != "I"
                    if edit == "D":
                        continue
                    role = None if edit == "K" else roles["u" if (place - headed) % 2 == 0 else "a"]
                    place += 1
                    out.append({"conv_id": key_, "place": place, "row": None if edit == "I" else row, "edit": edit, "new_role": role})
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out = []
            yield pa.RecordBatch.from_pylist(out, kinds)

    return repairs.select("conv_id", "audit").mapInArrow(spread, schema)


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the conversations as they read after the repair; an inserted turn has no number and no text."""
    have = turns.where(~F.col("gone")) if "gone" in turns.columns else turns
    filled = have.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    numbered = filled.withColumn("row", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order())).cast("long")).alias("t")
    made = edits(repairs).alias("e")
    joined = made.join(numbered, F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("e.row") == F.col("t.row")), "left")
    return joined.select("e.conv_id", "place", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
