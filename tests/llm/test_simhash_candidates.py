"""The near stage's SimHash step: fingerprints, radius, shards and their trees against plain versions."""

import numpy as np
import pytest

from debuglens.llm import nearsets

MASK = (1 << 64) - 1


def plain_fingerprint(grams):
    """Bit by bit, with Python's numbers."""
    votes, first = [0] * nearsets.BITS, None
    for gram in map(int, grams):
        bits = []
        for salt in map(int, nearsets._SALTS):
            x = gram ^ salt
            for factor in (0xD6E8FEB86659FD93, 0xCA9B0C7EBA1DA115):
                x = (x ^ x >> 32) * factor & MASK
            x ^= x >> 32
            bits += [x >> k & 1 for k in range(64)]
        first = first or bits
        votes = [v + b for v, b in zip(votes, bits)]
    n = len(grams)
    bits = [v * 2 > n or v * 2 == n and f for v, f in zip(votes, first if n == 2 else map(int, nearsets._TIES))] if n else [0] * nearsets.BITS
    return [sum(int(b) << k for k, b in enumerate(bits[64 * w : 64 * w + 64])) for w in range(nearsets.WORDS)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 50, 333])
def test_fingerprints(n):
    grams = np.unique(np.random.default_rng(n).integers(0, MASK, n, np.uint64))
    assert nearsets.fingerprint(grams).tolist() == plain_fingerprint(grams)


def apart(a, b):
    return int(nearsets.distance(nearsets.fingerprint(a)[None], nearsets.fingerprint(b)[None])[0])


@pytest.mark.parametrize("shared", [4, 8, 12, 40, 400])
def test_the_radius_covers_similarity(shared):
    r = np.random.default_rng(shared)
    of = shared * 5 // 4
    for _ in range(400):
        grams = r.integers(0, MASK, 2 * of, np.uint64)
        split = shared + r.integers(0, of - shared + 1)
        a, b = np.unique(grams[:split]), np.unique(np.r_[grams[:shared], grams[split:of]])
        assert apart(a, b) <= nearsets.RADIUS
        assert apart(a, np.unique(grams[of:])) > nearsets.RADIUS


def planted(seed, clusters, size, flips):
    """Codes of clusters around random ones, flips bits apart at most from their middle."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(clusters):
        middle = r.integers(0, 2, nearsets.BITS, np.uint8)
        for _ in range(size):
            bits = middle.copy()
            bits[r.permutation(nearsets.BITS)[: r.integers(0, flips + 1)]] ^= 1
            out.append(np.packbits(bits, bitorder="little").view("<u8"))
    return np.unique(np.array(out, np.uint64), axis=0)


def plain_classes(codes, radius=nearsets.RADIUS):
    label = np.arange(len(codes))
    near = nearsets.distance(codes[:, None], codes[None]) <= radius
    for _ in range(len(codes)):
        after = np.where(near, label[None], len(codes)).min(axis=1)
        if (after == label).all():
            return label
        label = after


@pytest.mark.parametrize("clusters, size, flips", [(300, 1, 0), (40, 6, 60), (3, 220, 45), (2, 400, 12), (1, 500, 70)])
def test_trees_and_crowds(clusters, size, flips):
    """Shards of over CROWD codes too."""
    codes = planted(7, clusters, size, flips)
    label = np.arange(len(codes))
    for a, b in nearsets.near_codes(codes, np.zeros(len(codes), np.int64)):
        assert (nearsets.distance(codes[a], codes[b]) <= nearsets.RADIUS).all()
        label = nearsets.merge(label, np.minimum(a, b), np.maximum(a, b))
    assert (label == plain_classes(codes)).all()


def test_candidates_of_many_shards(spark, monkeypatch):
    """400 codes in shards of about 50 and tables of about 4: all clusters are found, and nothing else."""
    monkeypatch.setattr(nearsets, "SHARD", 50)
    monkeypatch.setattr(nearsets, "LEAF", 4)
    nearsets.plan.cache_clear()
    codes = planted(11, 100, 4, 18)
    assert nearsets.plan(len(codes))[1] == 3
    rows = spark.createDataFrame([(c.astype("<u8").tobytes(),) for c in codes], "code binary")
    got = {bytes(r["code"]): bytes(r["component"]) for r in nearsets.candidates(rows).collect()}
    nearsets.plan.cache_clear()
    names = [c.astype("<u8").tobytes() for c in codes]
    mine = [got.get(n, n) for n in names]
    label = plain_classes(codes)
    assert len(set(label.tolist())) == 100 == len(set(mine))
    assert len(set(zip(label.tolist(), mine))) == 100


@pytest.mark.parametrize("n", [0, 1, 32, 33, 1000, 200_000])
def test_plans_keep_what_they_promise(n):
    groups, outer, inner = nearsets.plan(n)
    assert nearsets.missed(groups, outer, inner) <= nearsets.MISSED
    assert n / 2**outer <= nearsets.SHARD and n / 2 ** (outer + inner) <= nearsets.LEAF
