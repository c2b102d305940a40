"""Co-training against fits without it, and the rules for labels."""

import numpy as np
import pytest

from debuglens.llm import quality


def views(n, seed):
    """Two noisy views of a class that know it independently of each other."""
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n).astype(float)
    return r.normal(0, 1, (n, 12)) + 1.1 * y[:, None] * (np.arange(12) < 6), r.normal(0, 1, (n, 9)) + 1.2 * y[:, None] * (np.arange(9) < 5), y


def test_rounds_help_where_labels_are_few():
    gains = []
    for seed in range(8):
        x, m, y = views(24, seed)
        px, pm, _ = views(1500, 100 + seed)
        tx, tm, ty = views(2000, 200 + seed)
        right = [((quality.co_train(x, m, y, px, pm, rounds).score(tx, tm)[0] >= 0.5) == (ty == 1)).mean() for rounds in (0, 4)]
        gains.append(right[1] - right[0])
    assert np.mean(gains) > 0.01


def test_a_view_never_speaks_against_its_own_verdict():
    r = np.random.default_rng(4)
    x, _, y = views(400, 3)
    noise = r.normal(0, 1, (400, 5))
    model = quality.co_train(x, noise, y, x[:0], noise[:0])
    weights = model.both.w[:2] * model.heard
    assert (weights >= 0).all() and weights[0] > 0
    better = model.score(np.r_[x[:1] + 3], noise[:1])[0]
    assert better >= model.score(x[:1], noise[:1])[0] - 1e-9


def test_labels_of_both_classes_teach_nothing(spark):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "bad !!! ###", "en", "s") for k in range(40)] + [(None, "x", "en", "s"), (1, "another", "en", "s")], "doc_id long, text string, lang string, source string")
    one = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, one.union(one.selectExpr("doc_id", "1 - quality", "toxic"))) is None
    model = quality.fit(docs, one.union(one))
    got = {(r["doc_id"], r["accepted"]) for r in quality.score(docs, model).collect() if r["doc_id"] not in (None, 1)}
    assert got == {(k, k % 2 == 1) for k in range(40) if k != 1}


def test_stretches_of_long_texts(monkeypatch):
    data = np.random.default_rng(1).integers(32, 127, 5000, dtype=np.uint8).tobytes()
    whole = quality.text_view(data)
    monkeypatch.setattr(quality, "STRETCH", 700)
    assert quality.text_view(data) == pytest.approx(whole)
