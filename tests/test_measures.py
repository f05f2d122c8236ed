"""Order statistics by counting, and the recalls of fusions."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.operators import evaluate, vectors


def samples() -> list[tuple[str | None, float | None]]:
    rng = random.Random(12)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(700)] + [("equal", 7.0)] * 300 + [("one", -2.5)] + [("none", None)] * 3
    rows += [("skewed", 10.0 ** rng.uniform(-250, 250) * rng.choice([-1, 1])) for _ in range(400)] + [("ties", float(rng.randrange(4))) for _ in range(500)]
    return rows + [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 5e-324)] + [(None, float(k)) for k in range(50)]


@pytest.mark.parametrize("few", [25, 10_000])
def test_percentiles_equal_the_library(spark, few):
    rows = samples()
    con = duckdb.connect()
    con.sql("CREATE TABLE v (g VARCHAR, x DOUBLE)")
    con.executemany("INSERT INTO v VALUES (?, ?)", [r for r in rows if r[0] != "wide"])
    want = {r[0]: r[1:] for r in con.sql("SELECT g, quantile_cont(x, 0.5), quantile_cont(x, 0.9), quantile_cont(x, 0.95), quantile_cont(x, 0.99), min(x), max(x) FROM v WHERE x IS NOT NULL GROUP BY g").fetchall()}
    got = {r["g"]: r for r in evaluate.percentiles(spark.createDataFrame([r for r in rows if r[0] != "wide"], "g string, x double"), "x", ["g"], few).collect()}
    assert set(got) == set(want) and None in got and "none" not in got
    for g, values in want.items():
        for name, value in zip(("p50", "p90", "p95", "p99", "least", "greatest"), values, strict=True):
            assert got[g][name] == pytest.approx(value, rel=1e-12, abs=1e-4), (g, name)


def test_ranks_are_exact(spark):
    rows = [r for r in samples() if r[0] and r[1] is not None]
    groups: dict[str, list[float]] = {}
    for g, x in rows:
        groups.setdefault(g, []).append(x)
    ranks = [(g, k) for g, xs in groups.items() for k in {0, len(xs) // 3, len(xs) - 1}]
    got = evaluate.order_statistics(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], spark.createDataFrame(ranks, "g string, rank long"), 40).collect()
    assert {(r["g"], r["rank"]): r["value"] for r in got} == {(g, k): sorted(groups[g])[k] for g, k in ranks}


def test_without_groups_and_without_rows(spark):
    values = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert evaluate.percentiles(values, "x", [], 5).first().asDict() == {"p50": 50.0, "p90": 90.0, "p95": 95.0, "p99": 99.0, "least": 0.0, "greatest": 100.0, "mean": 50.0}
    assert evaluate.percentiles(values.limit(0), "x", []).count() == 0


def test_recalls_of_ways(spark):
    both = spark.createDataFrame([(1, 1, 9.0, None), (1, 2, 1.0, 0.9), (2, 3, None, 0.8)], "query_id long, doc_id long, lex double, sem double")
    ways = {"lex": ("f1", None, F.col("l")), "sem": ("f2", 0.2, F.col("s"))}
    relevant = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "query_id long, doc_id long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r["config"]: r["recall"] for r in evaluate.recalls_of_ways(vectors.scaled_by(both, "query_id"), ways, relevant, queries, 1).collect()}
    assert got == {"lex": round((0 + 0.5 + 1) / 3, 4), "sem": round((1 + 0.5 + 1) / 3, 4)}
