"""The pipeline's stages, each on its own input, against what its operator says."""

import pytest

import corpus_pipeline as p
from debuglens.llm import exact_dedup, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from debuglens.session import written

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        after = written(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_return_documents(stages):
    assert [name for name, _, _ in stages] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mixing_sources", "bpe_encoding"]
    for _, before, after in stages[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()


def test_quality_stage(stages, spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids(stages[0][2])
    right = [(d in kept) == (q == 1) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.95


def test_exact_stage(stages):
    _, before, after = stages[1]
    want = {r["keep_id"] for r in exact_dedup.exact_groups(before).collect()}
    assert ids(after) == want and after.count() == len(want)


def test_near_stage(stages):
    _, before, after = stages[2]
    assert ids(after) == {r["component_id"] for r in simhash.near_groups(before).collect()}


def test_mixing_stage(stages):
    _, before, after = stages[3]
    assert ids(after) <= ids(before)
    assert after.groupBy("doc_id").count().filter("count > 2").count() == 0


def test_encoding_stage(stages):
    import hashlib

    _, before, after = stages[4]
    want = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in before.collect())
    assert sorted(r["decoded_sha256"] for r in after.collect()) == want
