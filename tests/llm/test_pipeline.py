import hashlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from leafmill.llm import secrets, toxicity  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    """Each stage on what the one before has kept, against what it promises."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.toPandas()
        if name != "tokens":
            assert docs.columns == columns
    start = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    model = toxicity.train_model(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).toPandas().set_index("doc_id")
    assert set(kept["toxicity"].doc_id) == set(scores.index[scores.predicted == 0])
    from tests.llm.test_near import brute

    toxic = kept["toxicity"]
    classes = brute(list(zip(toxic.doc_id, toxic.text)), 5)
    assert sorted(kept["near_duplicates"].doc_id) == sorted(set(classes.values()))
    marked = kept["secrets"].set_index("doc_id")
    assert sorted(marked.index) == sorted(kept["near_duplicates"].doc_id)
    changed = [i for i in marked.index if marked.text[i] != start.text[i]]
    assert changed and all(secrets.MARK in marked.text[i] and marked.n_chars[i] == len(marked.text[i]) for i in changed)
    mixed, tokens = kept["mixing"], kept["tokens"]
    assert mixed.doc_id.value_counts().max() <= 2 and set(mixed.text) <= set(marked.text)
    assert sorted(tokens.decoded_sha256) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in mixed.text)


def test_run(spark, sf_dir):
    got = pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100


def test_odd(spark, odd, empty, sf_dir):
    for frame in (odd, empty):
        docs = frame
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            assert name == "tokens" or docs.columns == odd.columns
        assert (docs.count() == 0) == (frame is empty)
