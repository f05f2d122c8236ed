"""The pipeline's stages against brute force over what their predecessors kept."""

from __future__ import annotations

import pytest
from test_corpus_operators import brute_components

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    out["documents"] = docs.toPandas()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        folder = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, FOLDER).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out[name] = docs.toPandas()
    return out


def test_columns_stay_until_the_last_stage(kept):
    frames = list(kept.values())
    assert all(list(f.columns) == list(frames[0].columns) for f in frames[:-1])
    assert list(frames[-1].columns) == ["doc_id", "n_tokens", "ids", "round_trip"]


def test_filters_keep_good_documents(spark, kept):
    assert len(kept["language ID"]) >= 0.98 * len(kept["documents"])
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().set_index("doc_id").quality
    left = set(kept["quality classifier"].doc_id)
    before = [i for i in kept["language ID"].doc_id if i in labels.index]
    good, poor = [i for i in before if labels[i] == 1], [i for i in before if labels[i] == 0]
    assert sum(i in left for i in good) >= 0.9 * len(good) and sum(i in left for i in poor) <= 0.4 * len(poor)


def test_one_of_each_group_stays(kept):
    docs = kept["quality classifier"]
    roots = {c for _, _, c in brute_components(list(zip(docs.doc_id, docs.text, strict=True)))}
    assert set(kept["n-gram Jaccard join"].doc_id) == roots


def test_leaks_go(spark, kept):
    items = [" ".join(t.lower().split()) for t in spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas().text]
    leaks = lambda f: {r.doc_id for r in f.itertuples() if any(x in " ".join(r.text.lower().split()) for x in items)}
    before, after = kept["n-gram Jaccard join"], kept["benchmark decontamination"]
    assert not leaks(after) and leaks(before) <= set(before.doc_id) - set(after.doc_id)


def test_tokens_and_run(spark, kept):
    last = kept["SentencePiece encoding"]
    assert last.round_trip.all() and (last.n_tokens == last.ids.map(len)).all()
    assert set(corpus_pipeline.run(spark, FOLDER).toPandas().doc_id) == set(last.doc_id)
