"""What a task of the pipeline hands to its Python worker at once."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as p
from debuglens.llm import quality
from debuglens.session import BATCH_BYTES

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def docs(spark):
    before = spark.conf.get(NAME)
    rows = [(k, f"w{k} " * 2500, "en", "s", None) for k in range(1200)] + [(5, None, "en", None, None)]
    yield spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    spark.conf.set(NAME, before)


@pytest.mark.parametrize("stage", ["quality", "exact", "near", "encoding"])
def test_stages_bound_their_batches(spark, docs, monkeypatch, stage):
    """Ten megabytes of texts in one partition come in several batches, none far above the bound."""
    monkeypatch.setattr(p.quality, "fit", lambda *_: None)
    monkeypatch.setattr(p, "table", lambda *_: None)
    getattr(p, f"{stage}_stage")(spark, docs, "")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.get_total_buffer_size()])], names=["n"])

    got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert len(got) > 2 and max(got) < 2 * BATCH_BYTES


def test_a_smaller_bound_stays(spark, docs):
    spark.conf.set(NAME, "65536")
    p.quality.ready(p.lean(spark))
    assert "65536" in spark.conf.get(NAME)


def test_texts_reach_the_worker_once(spark, docs, monkeypatch):
    """accepted() decides as score() does and gives rows back whole, without a second copy of the text."""
    r = np.random.default_rng(3)
    y = (np.arange(80) % 2).astype(float)
    x, m = r.random((80, quality.BIGRAMS + quality.TRAITS)) + y[:, None] / 3, r.random((80, quality.META))
    model = quality.co_train(x, m, y, x[:0], m[:0])
    few = docs.limit(300).unionByName(docs.filter("text IS NULL"))
    want = sorted(map(str, few.collect()))
    marks = [t["accepted"] for t in quality.score(few, model).collect()]
    got = quality.accepted(few, model)
    assert got.columns == few.columns and got.count() == sum(marks)
    assert sorted(map(str, quality.accepted(few, None).collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("MapInArrow") :].split("Project")[1].split("\n")[0].count("AS text") == 0
