"""Burkhard-Keller trees over codes of 64 bits or a row of such words, built and searched with array operations.

A forest holds one tree per shard; a child hangs below its parent at an edge named by their
Hamming distance. A search keeps a frontier of (query, node) pairs and follows only the edges
that the triangle inequality leaves within the radius.
"""

from __future__ import annotations

import numpy as np

#: Pairs of query and node that a search may hold at once, about 32 bytes each.
FRONTIER = 1 << 20


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of codes, which are words or rows of words."""
    bits = np.bitwise_count(a ^ b)
    return bits.astype(np.int64) if bits.ndim == 1 else bits.sum(axis=-1, dtype=np.int64)


class Forest:
    """Trees over codes, one per shard; codes of a shard must differ and stand together."""

    def __init__(self, codes: np.ndarray, shards: np.ndarray):
        self.codes, n = codes, len(codes)
        words = codes.shape[1] if codes.ndim > 1 else 1
        #: Distances are 0 to 64 for each word.
        self.edges, self.frontier = 64 * words + 1, FRONTIER // words
        first = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if n else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[first, n])
        self.root = np.repeat(first, self.size)
        at = self.root.copy()
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        keys, nodes = [], []
        while len(rest):
            key = at[rest] * self.edges + distance(codes[rest], codes[at[rest]])
            unique, where, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(unique)
            nodes.append(rest[where])
            at[rest] = rest[where][back]
            stays = np.ones(len(rest), bool)
            stays[where] = False
            rest = rest[stays]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.node = key[order], (np.concatenate(nodes) if nodes else key)[order]

    def linked(self, radius: int):
        """Yield arrays (a, b) of indices, a < b, whose codes differ in at most radius bits."""
        n = len(self.codes)
        weight = np.cumsum(np.repeat(self.size, self.size)) if n else np.zeros(0, np.int64)
        begin = 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(weight, (weight[begin - 1] if begin else 0) + self.frontier, "right")))
            query = np.arange(begin, end)
            node = self.root[begin:end]
            while len(query):
                apart = distance(self.codes[query], self.codes[node])
                hit = (apart <= radius) & (query < node)
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.key, node * self.edges + np.maximum(apart - radius, 0), "left")
                high = np.searchsorted(self.key, node * self.edges + np.minimum(apart + radius, self.edges - 1), "right")
                count = high - low
                query = np.repeat(query, count)
                node = self.node[np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(query))] if len(query) else query
            begin = end


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, where label[i] is the least member of i's class, after the classes of each a and b are merged."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
