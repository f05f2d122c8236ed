from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import chunking as C


def test_passages_of_blank_and_short_text():
    assert C.passages(None) == [] and C.passages(" \n\n ") == []
    assert C.passages("one\n\ntwo") == [("Paragrafi 1-2", "one\n\ntwo")]


def test_pages_change_the_locator_without_overlap():
    text = "## Pagina 1\n\n" + "a" * 500 + "\n\n## Pagina 2\n\n" + "b" * 500
    (first, one), (second, two) = C.passages(text)
    assert (first, second) == ("Pagina 1", "Pagina 2") and "b" not in one.split("\n\n")[1] and "a" * 10 not in two


def test_long_paragraphs_are_cut_after_sentences_and_overlap():
    text = ("word " * 150 + "end. ") * 4
    found = C.passages(text)
    assert all(len(t) <= C.TARGET + C.OVERLAP + 2 for _, t in found) and len(found) > 2
    assert found[1][1].startswith(found[0][1][-C.OVERLAP :].strip())


def test_every_character_is_kept():
    text = "x" * 5000
    assert sum(len(p.text) for p in C.pieces(text)) == 5000


def test_fragments_and_volumes(spark):
    assert [r[0] for r in spark.range(1).select(F.explode(C.fragments(F.lit("abcdefg"), 3))).collect()] == ["abc", "def", "g"]
    assert spark.range(1).select(C.fragments(F.lit(""), 3).alias("f")).first()[0] == []
    items = spark.createDataFrame([("g", i, s) for i, s in enumerate([30, 30, 50, 10, 100, 5])] + [("h", 0, 1)], "g string, o int, size long")
    got = {(r["g"], r["o"]): r["volume"] for r in C.volumes(items, ["g"], "o", "size", 60).collect()}
    assert got == {("g", 0): 0, ("g", 1): 0, ("g", 2): 1, ("g", 3): 1, ("g", 4): 2, ("g", 5): 3, ("h", 0): 0}


def test_running_budget_stops_at_the_first_overflow(spark):
    items = spark.createDataFrame([(i, s) for i, s in enumerate([5, 5, 9, 1])], "o int, size int").withColumn("g", F.lit(1))
    assert sorted(r["o"] for r in C.running_budget(items, ["g"], ["o"], "size", 12).collect()) == [0, 1]


def test_fragments_end_between_characters(spark):
    text = "".join(random.Random(3).choices(["a", "é", "€", "😀"], k=500))
    got = [r[0] for r in spark.range(1).select(F.explode(C.fragments(F.lit(text), 10))).collect()]
    assert "".join(got) == text and all(7 <= len(x.encode()) <= 10 for x in got[:-1])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_volumes_over_many_ranges_equal_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(g, i, rng.choice([0, 1, 5, 20, 59, 60, 61, 200]) if rng.random() < 0.3 else rng.randint(0, 9)) for g, n in (("a", 3), ("b", 900), ("c", 0), ("d", 70)) for i in range(n)]
    want, filled, volume, last = {}, 0, 0, None
    for g, i, size in rows:
        filled, volume = (filled, volume) if g == last else (0, 0)
        if filled > 0 and filled + size > 60:
            filled, volume = 0, volume + 1
        filled, last = filled + size, g
        want[g, i] = volume
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        items = spark.createDataFrame(rows, "g string, o int, size long").repartition(5)
        got = {(r["g"], r["o"]): r["volume"] for r in C.volumes(items, ["g"], "o", "size", 60).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_running_budget_across_ranges(spark):
    """What overflows in one range keeps the next ones out, and items of one place go or stay together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # A large item is followed by many small ones, in every range but the first.
        items = spark.createDataFrame([("g", k, 5 if k < 2 else 9 if k < 40 else 1) for k in range(400)] + [("h", 0, 5), ("h", 1, 4), ("h", 1, 4)], "g string, o long, size long")
        assert sorted((r["g"], r["o"], r["used"]) for r in C.running_budget(items, ["g"], ["o"], "size", 12).collect()) == [("g", 0, 5), ("g", 1, 10), ("h", 0, 5)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
