"""Conversation repair, divergence of sources and token counts: SQL twins, brute force and the library, and the edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import dialogues, divergence, entries, tokencount

FOLDER = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def same_as_sql(spark, con, name, folder=FOLDER):
    want = con.sql(entries.ORACLES[name])
    got = [tuple(r[c] for c in want.columns) for r in entries.QUERIES[name](spark, folder).collect()]
    key = lambda row: [(x is not None, x) for x in row]
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["op11_dialogues", "op12_divergence"])
def test_query_equals_its_sql_twin(spark, db, name):
    same_as_sql(spark, db, name)


# --- 11 --------------------------------------------------------------------------------------------------------------


def accepted(initials: str) -> bool:
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(rest) > 0 and rest == "ua" * (len(rest) // 2))


def brute_force(turns: list[tuple[str, str, int]]) -> tuple[int, str, str]:
    """The least (cost, audit, repaired) over all edits, with at most two inserts at a place."""
    best = None
    inserts = [list(x) for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    options = []
    for role, text, fault in turns:
        extra, own = 5 * (fault == dialogues.TRUNCATED), [(2, "D", None)]
        if fault not in (dialogues.BLANK, dialogues.DUPLICATE):
            own += [(extra, "K", (role, text)), (1 + extra, "R", ("user", text)), (1 + extra, "R", ("assistant", text))]
        options.append(own)
    for gaps in itertools.product(inserts, repeat=len(turns) + 1):
        if sum(map(len, gaps)) > 2:
            continue
        for edits in itertools.product(*options):
            cost, audit, out = 0, "", []
            for k, gap in enumerate(gaps):
                cost, audit = cost + 5 * len(gap), audit + "I" * len(gap)
                out += [(role, "") for role in gap]
                if k < len(edits):
                    cost, audit = cost + edits[k][0], audit + edits[k][1]
                    out += [edits[k][2]] if edits[k][2] else []
            if accepted("".join(role[:1] or "-" for role, _ in out)):
                found = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
                best = min(best or found, found)
    return best


def test_chart_finds_the_cheapest_edits():
    rng = random.Random(2)
    for _ in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "u", ""]), f"t{k}", rng.choice([0, 0, 0, 1, 2, 3, 3])) for k in range(rng.randrange(4))]
        chart = dialogues.Chart(dialogues.Grammar())
        for turn in turns:
            chart.scan(*turn)
        cost, audit, repaired = brute_force(turns)
        assert chart.repair() == (cost, audit, hashlib.sha256(repaired.encode()).hexdigest()), turns


def test_inserts_are_found_where_they_are_cheapest():
    chart = dialogues.Chart(dialogues.Grammar(costs=dialogues.Costs(rerole=9, delete=9, insert=1)))
    for role in ("system", "user", "user", "assistant", "assistant"):
        chart.scan(role, "x.", dialogues.SOUND)
    assert chart.repair()[:2] == (2, "KKIKKIK")


def test_grammar_must_be_left_linear():
    with pytest.raises(ValueError, match="first place"):
        dialogues.Grammar(productions=(("dialogue", ("u", "dialogue")),))


def test_long_conversation_is_linear(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("tool").alias("role"), F.concat(F.lit("line "), "id", F.lit(".")).alias("text"))
    found = dialogues.repair(rows).collect()
    assert len(found) == 1 and found[0]["cost"] == n and found[0]["audit"] == "R" * n and found[0]["illegal"] == n - 1


def test_edges_of_conversations(spark):
    rows = [
        (1, None, "user", "first."), (1, 5, None, None), (1, 9, "assistant", "cut"), (1, 5, "user", "ask?  "), (1, 5, "user", "ask?  "),
        (None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (2, None, None, None), (3, -(2**63), "user", "a."), (3, 2**63 - 1, "assistant", "b."),
    ]
    turns = spark.createDataFrame(rows, TURNS).withColumns({"cost": F.lit("clash"), "fault": F.lit("clash"), "_same": F.lit(0)})
    got = {r["conv_id"]: r for r in dialogues.repair(turns).collect()}
    assert set(got) == {None, 1, 2, 3}
    assert (got[None]["cost"], got[None]["audit"], got[None]["repaired_sha256"]) == (0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Hi.").hexdigest())
    one = got[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"]) == (3, 1, 1, 1, 3)
    assert (got[2]["gaps"], got[2]["blank"], got[2]["audit"], got[2]["cost"]) == (0, 1, "D", 2)
    assert got[3]["gaps"] == 2**63 - 1
    assert dialogues.repair(turns.limit(0)).count() == 0
    gone = turns.withColumn("gone", F.lit(True))
    assert all(r["audit"] == "" and r["cost"] == 0 and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for r in dialogues.repair(gone).collect())


def test_nulls_in_damage(spark, tmp_path):
    rows = [(k if k % 7 else None, k % 5 if k % 3 else None, None if k % 4 == 0 else "assistant", None if k % 5 == 0 else f"Text {k}! ") for k in range(300)]
    spark.createDataFrame(rows, TURNS).dropDuplicates(["conv_id", "turn"]).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    same_as_sql(spark, con, "op11_dialogues", str(tmp_path))
    kinds = {zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in rows}
    assert {0, 1, 2, 3, 4} <= kinds


def test_repaired_turns_have_the_hash(spark):
    turns = dialogues.damaged(spark.read.parquet(f"{FOLDER}/conversations.parquet"))
    repairs = dialogues.repair(turns)
    lines = {}
    for r in sorted(dialogues.repaired_turns(turns, repairs).collect(), key=lambda r: (r["conv_id"], r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repairs.collect():
        assert hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


# --- 12 --------------------------------------------------------------------------------------------------------------


def test_rare_terms_beyond_the_automata_are_counted_too(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    whole = {tuple(r) for r in divergence.audit(docs).collect()}
    assert whole == {tuple(r) for r in divergence.audit(docs, most=2000, each=300).collect()}
    assert whole == {tuple(r) for r in divergence.audit(docs, most=0).collect()}


def test_padded_terms_match_whole_terms_only():
    made = divergence.automaton(["an", "ban", "é", "漢😀", "a"])
    text = divergence.folded(pa.array(["Ban an;ANNA a'a é\x00é 漢😀 banan"]))[0].as_py()
    assert divergence.occurrences(made, f" {text} ").tolist() == [1, 0, 4, 4, 2, 2, 3]


def test_edges_of_divergence(spark, tmp_path):
    rng = random.Random(4)
    words = ["a", "Á", "á", "b1c", "😀", "x y", "z-z", "Ab", "aB"]
    rows = [(k, rng.choice([None, "", " 1 ", *(" ".join(rng.choices(words, k=9)) for _ in range(9))]), rng.choice([None, "", "en", "de", "fr"]), rng.choice([None, "", "s", "t", "é"])) for k in range(150)]
    rows += [(999, "only once", "xx", "s"), (999, None, "xx", "t"), (1000, "a a a", "en", "huge")] + [(7, "a b", "en", "s")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("value", "rank", "p", "term", "n")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT doc_id, text, lang, source FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_as_sql(spark, con, "op12_divergence", str(tmp_path))
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (10**13, 3 * 10**13, 10**8), (2**62, 2**62, 1), (6, 7, 10**9), (333333332, 999999999, 1)]
    rows = spark.createDataFrame(cases, "n long, total long, v long").select("n", "total", "v", divergence.share("n", "total", "v").alias("p")).collect()
    assert [r["p"] for r in rows] == [1 + 10**9 * (n + 1) // (total + v) for n, total, v in cases]


# --- 13 --------------------------------------------------------------------------------------------------------------

PARTS = ["a", "B", "z", "é", "×", "÷", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r", " ", "　", " ", "\x85", "\x1c", "\x00", ".", ",", "!", '"', "(", "[", "1", "９", "漢", "字", "。", "，", "か", "д", "😀", "<|endoftext|>", "<|endof", "|>", "_", "-", "​", "́", "ß", "᠎", "힣", "İ"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokencount.TOKENIZER)


def test_counts_equal_the_library(tokenizer):
    rng = random.Random(6)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(50))) for _ in range(20_000)] + ["x" * 5000, "漢字。" * 900, " " * 3000, "a. " * 20_000]
    counter = tokencount.Counter(open(tokencount.TOKENIZER).read())
    assert counter.of_texts(pa.array(texts)).tolist() == [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = entries.op13_token_counts(spark, FOLDER).collect()
    assert len(got) == docs.count()
    for r in got:
        n = len(tokenizer.encode(want[r["doc_id"]], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(want[r["doc_id"]].encode()), n, n > 512)


def test_edges_of_token_counts(spark, tokenizer):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 30_000), (3, "x " * 30_000), (4, "y" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "n_bytes": F.lit("clash")})
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(docs).collect())
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False))
    assert got == sorted((i or 0, len(t or ""), count(t or ""), count(t or "") > 512) for i, t in rows)
    assert tokencount.count_tokens(docs.limit(0)).count() == 0


def test_other_tokenizers_get_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert not tokencount.may_split(open(path).read()) and tokencount.may_split(open(tokencount.TOKENIZER).read())
    docs = spark.createDataFrame([(1, "Über  the\nHill. <|endoftext|> x"), (2, None)], "doc_id long, text string")
    made = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, path, limit=3).collect()}
    assert got == {1: len(made.encode("Über  the\nHill. <|endoftext|> x", add_special_tokens=False)), 2: 0}
