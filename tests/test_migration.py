"""A migration of the embedding cache that is cut off and goes on asks the model for the rest only."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators import migration
from folioscope.sources.shared import new_folder


def passages(spark, n: int, text: str = "text"):
    rows = spark.range(n).select(F.concat(F.lit("p"), "id").alias("passage_id"), F.concat(F.lit(text + " "), "id").alias("embedded_text"))
    return rows.withColumns({"sha256": F.sha2("embedded_text", 256), "embedded_text_sha256": F.sha2("embedded_text", 256)})


def embedder(folder: str, dimensions: int = 2):
    """Gives a text's length and number, and notes every text that it was asked for."""

    def embed(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        assert len(texts) <= 16
        return [[float(len(t)), *([float(t.split()[-1])] * (dimensions - 1))] for t in texts]

    return embed


def asked(folder) -> list[str]:
    return sorted(t for name in os.listdir(folder) for t in open(f"{folder}/{name}").read().split("\n"))


def test_cut_off_and_resumed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(migration, "FILE_PASSAGES", 20)
    rows, home, stage = passages(spark, 200).repartition(4).cache(), new_folder(spark, "cache"), new_folder(spark, "stage")
    seen, embed = [], embedder(str(tmp_path))
    with pytest.raises(migration.Cancelled):
        migration.migrate(rows, home, stage, embed, "m1", 2, stop=lambda p: seen.append(p.done) or len(seen) > 2, step_files=3)
    first = asked(tmp_path)
    assert 0 < len(first) < 200 and migration.current(spark, home).count() == 0
    assert migration.progress(spark, stage).done == len(first)
    assert migration.migrate(rows, home, stage, embed, "m1", 2, step_files=3) == migration.Progress(200, 200)
    assert asked(tmp_path) == sorted(f"text {k}" for k in range(200))
    cache = {r["passage_id"]: r["vector"] for r in migration.current(spark, home).collect()}
    assert cache == {f"p{k}": [float(len(f"text {k}")), float(k)] for k in range(200)}


def test_another_model_and_changed_passages(spark, tmp_path):
    home = new_folder(spark, "cache")
    folders = [tmp_path / x for x in "abc"]
    for f in folders:
        f.mkdir()
    migration.migrate(passages(spark, 30), home, new_folder(spark, "stage"), embedder(str(folders[0])), "m1", 2)
    later = passages(spark, 20).where("passage_id <> 'p3'").unionByName(passages(spark, 4, "new").where("passage_id = 'p3'"))
    migration.migrate(later, home, new_folder(spark, "stage"), embedder(str(folders[1])), "m1", 2)
    assert asked(folders[1]) == ["new 3"]
    assert {r["passage_id"] for r in migration.current(spark, home).collect()} == {f"p{k}" for k in range(20)}
    migration.migrate(later, home, new_folder(spark, "stage"), embedder(str(folders[2]), 3), "m2", 3)
    assert len(asked(folders[2])) == 20 and {(r["model"], len(r["vector"])) for r in migration.current(spark, home).collect()} == {("m2", 3)}
    migration.migrate(later.limit(0), home, new_folder(spark, "stage"), embedder(str(folders[2]), 3), "m2", 3)
    assert migration.current(spark, home).count() == 0


def test_a_failing_model_leaves_the_cache(spark, tmp_path):
    home, stage = new_folder(spark, "cache"), new_folder(spark, "stage")
    migration.migrate(passages(spark, 5), home, new_folder(spark, "stage"), embedder(str(tmp_path)), "m1", 2)

    def broken(texts):
        raise OSError("no network")

    with pytest.raises(Exception, match="no network"):
        migration.migrate(passages(spark, 9), home, stage, broken, "m1", 2)
    assert migration.current(spark, home).count() == 5
    migration.migrate(passages(spark, 9), home, stage, embedder(str(tmp_path)), "m1", 2)
    assert migration.current(spark, home).count() == 9
