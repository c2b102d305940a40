"""The near-duplicate stage against brute-force similarity of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from debuglens.llm import nearsets


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def roots(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if find(a) != find(b) and likeness(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


@pytest.fixture(scope="module")
def rows():
    """Copies with 0 to 7 of 200 words changed: similarities on both sides of 0.8."""
    r = random.Random(12)
    out = [(0, None), (1, ""), (2, "One two"), (3, "one  TWO"), (4, "one three")]
    passage = " ".join(f"p{k}" for k in range(40))
    for base in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        for k in range(8):
            copy = list(words)
            for at in r.sample(range(200), k):
                copy[at] = f"x{r.randrange(5000)}"
            out.append((100 + base * 10 + k, " ".join(copy)))
        out.append((1000 + base, " ".join(words[:60]) + " " + passage))
    return out


@pytest.mark.parametrize("tile", [nearsets.TILE, 3])
def test_near_sets(spark, rows, tile):
    got = {r["doc_id"]: r["component_id"] for r in nearsets.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
    assert got == roots({d: grams(t) for d, t in rows})


def test_near_stage_keeps_one_of_each_component(spark, rows):
    want = roots({d: grams(t) for d, t in rows})
    stayed = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert stayed == sorted(set(want.values())) and len(stayed) < len(rows)


def test_bands_miss_no_pair_at_the_limit():
    r = np.random.default_rng(5)
    for _ in range(2000):
        all_ = r.integers(0, 1 << 63, 500, np.uint64)
        a, b = all_[:450], np.r_[all_[:400], all_[450:]]
        assert len(np.intersect1d(a, b)) / 500 == 0.8
        assert (nearsets.bands(np.sort(a)) == nearsets.bands(np.sort(b))).any()


def test_no_rows(spark):
    assert nearsets.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
