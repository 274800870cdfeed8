"""The pipeline: each stage's decisions, its columns, and clean documents left alone."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quillon.llm import queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(n))
    clean = [text(8) for _ in range(30)]
    bench = " ".join(rng.choice(vocab) for _ in range(40))
    near = clean[0].split(" ")
    near[5], near[40] = "changed", "words"
    rows = list(enumerate(clean))
    rows += [(100, clean[1]), (101, " ".join(near)), (102, f"{text(6)}\n{bench}"), (103, "too short"), (104, None), (105, "spam " * 80)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, corpus).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen.append({r.doc_id for r in docs.collect()})
    clean = set(range(30))
    assert seen[0] == clean | {100, 101, 102}
    assert clean <= seen[1] and 100 not in seen[1]  # an exact copy loses all lines
    assert clean <= seen[2]
    assert seen[3] == seen[2] - {102} and clean <= seen[3]
    assert seen[4] <= seen[3]


def test_near_stage_keeps_one_of_each_group(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id in (0, 1, 2, 100, 101)")
    rows = corpus_pipeline.near(spark, docs, corpus).collect()
    assert {r.doc_id for r in rows} in ({0, 1, 2}, {0, 1, 2, 101})


def test_run_and_registration(spark, corpus):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.queries()) <= set(__spark_entry__.queries())
    out = corpus_pipeline.run(spark, corpus)
    assert "copy" in out.columns and out.count() > 0


def test_empty_documents(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    assert docs.count() == 0
