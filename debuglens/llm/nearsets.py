"""Near duplicates by SimHash, confirmed by the exact Jaccard similarity of word shingles.

A set of shingles has a SimHash of ``64 * WORDS`` bits. Two sets of similarity 0.8 differ in 15 %
of the bits on average (the angle of sets at Jaccard J has cosine 2J/(1+J)), sets that share
nothing in half of them, so the code is long enough for a radius that covers 0.8 and lets hardly
any others in. Codes are dealt into shards by some of their bits, several times over
(``plan()``); within, further bits make tables of small shards, each with a BK-tree, as
``simhash`` has for 3 of 64 bits. Links are stars, so no pairs are made; the components of these
links are candidates. Inside a component every pair is compared by its whole shingle sets.
Components of more than ``TILE`` sets are dealt out as pairs of tiles, and a task reports links
to the least member of each local class.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debuglens.llm.bktree import FRONTIER, Forest, distance, merge
from debuglens.llm.common import attach, cut, one_of_each, parts, ready, text_bytes, text_digest
from debuglens.llm.components import components
from debuglens.llm.simhash import LOWER, SEED

SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words of a fingerprint.
WORDS = 4
BITS = 64 * WORDS
#: Differing bits of a candidate: 7 deviations above the mean at 0.8, 6 below that of unrelated sets.
RADIUS = 80
#: Codes of a task's shard, and of a table's shards within it, on average at most.
SHARD, LEAF = 1 << 15, 32
#: Tables within a shard.
TABLES = 8
#: Shards of a table with more codes give off stars before the rest makes a tree.
CROWD = 256
#: The calculated share of pairs of similarity 0.8 that no table brings together.
MISSED = 1e-6
#: Sets of a component that one task compares; larger components are split.
TILE = 512
#: Postings counted at once.
POSTINGS = 1 << 21
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, WORDS, np.uint64)
#: Breaks ties alike in all sets, as near sets may differ in any one shingle.
_TIES = np.random.default_rng(SEED).integers(0, 2, BITS, np.uint8)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; a text of fewer words is one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)))) if len(words) >= shingle else iter((b" ".join(words),))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - shingle + 1)))


def ones(rows: np.ndarray) -> np.ndarray:
    """How many of the rows of words have each bit, by carry-save adders."""
    out, level = np.zeros(64 * rows.shape[1], np.int64), 0
    while len(rows):
        carry = [rows[:0]]
        while len(rows) > 2:
            n = len(rows) // 3
            a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
            odd = a ^ b
            carry.append((a & b) | (odd & c))
            rows = np.concatenate([odd ^ c, rows[3 * n :]])
        for row in rows:
            out += np.unpackbits(row.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << level
        rows, level = np.concatenate(carry), level + 1
    return out


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """The SimHash of sorted distinct hashes: a bit is 1 if more than half of them have it, on a tie if _TIES has it; of none, zero.

    Ties of two hashes go by the lesser one: half of the bits are ties, and nothing but the same two is similar.
    """
    if not len(grams):
        return np.zeros(WORDS, np.uint64)
    x = grams[:, None] ^ _SALTS
    for factor in (0xD6E8FEB86659FD93, 0xCA9B0C7EBA1DA115):
        x ^= x >> np.uint64(32)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(32)
    ties = np.unpackbits(x[0].astype("<u8").view(np.uint8), bitorder="little") if len(x) == 2 else _TIES
    return np.packbits(2 * ones(x) + ties > len(x), bitorder="little").view("<u8").astype(np.uint64)


def missed(groups: int, outer: int, inner: int, tables: int = TABLES, flip: float = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi) -> float:
    """The chance that a pair whose bits differ with probability flip shares no shard and table, or is beyond the radius."""
    out = 0.0
    for d in range(BITS + 1):
        here = math.comb(BITS, d) * flip**d * (1 - flip) ** (BITS - d)
        both = math.comb(BITS - d, outer) / math.comb(BITS, outer)
        all_ = math.comb(BITS - d, outer + inner) / math.comb(BITS, outer + inner)
        out += here if d > RADIUS or not both else here * (1 - both * (1 - (1 - all_ / both) ** tables)) ** groups
    return out


@lru_cache(64)
def plan(n: int) -> tuple[int, int, int]:
    """For n codes: how often they are dealt out, by how many bits, and by how many more within a shard."""
    outer = max(0, math.ceil(math.log2(max(1, n) / SHARD)))
    inner = max(0, math.ceil(math.log2(max(1, n) / LEAF)) - outer)
    groups = 1
    while outer + inner and missed(groups, outer, inner) > MISSED:
        groups += 1
    return groups, outer, inner


def _chosen(codes: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The number that the bits at these positions make, for each code."""
    out = np.zeros(len(codes), np.int64)
    for k, at in enumerate(positions.tolist()):
        out |= ((codes[:, at >> 6] >> np.uint64(at & 63)) & np.uint64(1)).astype(np.int64) << k
    return out


@lru_cache(1 << 12)
def _positions(group: int, outer: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits that deal out a group's shards, and the others."""
    all_ = np.random.default_rng((SEED, group)).permutation(BITS)
    return all_[:outer], all_[outer:]


@lru_cache(1 << 12)
def _tables(group: int, outer: int, inner: int) -> list[np.ndarray]:
    """The bits of each table of a group's shards."""
    rest = _positions(group, outer)[1]
    return [np.random.default_rng((SEED, group, t)).permutation(rest)[:inner] for t in range(TABLES if inner else 1)]


def bands(grams: np.ndarray, n: int = 1 << 18) -> np.ndarray:
    """A number for each table in which the set's code stands among n codes; sets meet where these agree."""
    code, (groups, outer, inner) = fingerprint(grams)[None], plan(n)
    return np.concatenate([_chosen(code, np.r_[_positions(g, outer)[0], table]) for g in range(groups) for table in _tables(g, outer, inner)])


def near_codes(codes: np.ndarray, shards: np.ndarray, radius: int = RADIUS):
    """Yield arrays (a, b) of indices whose classes are those of all pairs of a shard within the radius.

    Codes of a shard differ and stand together. While a shard is a crowd its first code links to
    all within the radius; this star, whose members need not meet each other, is compared with
    the rest and leaves. What remains makes a BK-tree.
    """
    edge = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True])
    stays = np.ones(len(codes), bool)
    for at in np.flatnonzero(np.diff(edge) > CROWD).tolist():
        rest = np.arange(edge[at], edge[at + 1])
        while len(rest) > CROWD:
            near = distance(codes[rest], codes[rest[0]]) <= radius
            star, rest = rest[near], rest[~near]
            stays[star] = False
            yield np.full(len(star) - 1, star[0]), star[1:]
            step = max(1, FRONTIER // WORDS // max(1, len(rest)))
            for k in range(0, len(star), step):
                a, b = np.nonzero(distance(codes[star[k : k + step], None], codes[rest][None]) <= radius)
                yield star[k + a], rest[b]
    kept = np.flatnonzero(stays)
    for a, b in Forest(codes[kept], shards[kept]).linked(radius):
        yield kept[a], kept[b]


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").astype(np.uint64).reshape(-1, WORDS)


def _dealt(groups: int, outer: int):
    """(shard, code) of each code, once for each group."""

    def run(batches):
        for batch in batches:
            codes = _words(batch.column(0))
            for g in range(groups):
                yield pa.RecordBatch.from_arrays([pa.array(_chosen(codes, _positions(g, outer)[0]) | g << 32), batch.column(0)], names=["shard", "code"])

    return run


def _starred(outer: int, inner: int):
    """Links (a, b) of the codes of each shard to the least member of their local class; rows come sorted by shard."""

    def linked(shard, column):
        codes = _words(column)
        label = np.arange(len(codes))
        for table in _tables(shard >> 32, outer, inner):
            key = _chosen(codes, table)
            order = np.argsort(key, kind="stable")
            for a, b in near_codes(codes[order], key[order]):
                label = merge(label, order[a], order[b])
        moved = np.flatnonzero(label != np.arange(len(codes)))
        return pa.RecordBatch.from_arrays([column.take(pa.array(moved)), column.take(pa.array(label[moved]))], names=["a", "b"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True]).tolist()
            for i, j in zip(edge, edge[1:]):
                if held and shards[i] != now:
                    yield linked(now, pa.concat_arrays(held))
                    held = []
                now = int(shards[i])
                held.append(batch.column(1).slice(i, j - i))
        if held:
            yield linked(now, pa.concat_arrays(held))

    return run


def candidates(codes: DataFrame) -> DataFrame:
    """(code, component) of the distinct codes (code) that links reach; component is the least code reached."""
    groups, outer, inner = plan(codes.count())
    dealt = codes.mapInArrow(_dealt(groups, outer), "shard long, code binary").repartition(parts(codes), "shard").sortWithinPartitions("shard")
    near = components(dealt.mapInArrow(_starred(outer, inner), "a binary, b binary").distinct())
    return near.withColumnRenamed("node", "code")


def _sketched(shingle: int):
    def run(batches):
        for batch in batches:
            keys, codes = [], []
            for text in batch.column(1):
                grams = shingles(text.as_buffer().to_pybytes(), shingle)
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
                codes.append(fingerprint(grams).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(codes, pa.binary())], names=["doc_id", "digest", "key", "code"])

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            sets = [shingles(text.as_buffer().to_pybytes(), shingle).tobytes() for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["key", "grams"])

    return run


def similar(sets: list[np.ndarray], similarity: float = SIMILARITY):
    """Yield arrays (a, b) of indices, b < a, of all pairs at least so similar."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(word, kind="stable")
    posting = owner[order]
    begin = np.searchsorted(word[order], np.arange(len(word) and word.max() + 2))
    start = np.r_[0, np.cumsum(size)]
    for a in range(1, len(sets)):
        mine = word[start[a] : start[a + 1]]
        count = begin[mine + 1] - begin[mine]
        until, shared, at = np.cumsum(count), np.zeros(len(sets), np.int64), 0
        while at < len(mine):
            stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + POSTINGS, "right")))
            n = count[at:stop]
            shared += np.bincount(posting[np.repeat(begin[mine[at:stop]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], minlength=len(sets))
            at = stop
        b = np.flatnonzero(shared[:a] >= similarity * (size[a] + size[:a] - shared[:a]) - 1e-9)
        if len(b):
            yield np.full(len(b), a), b


def _links(similarity: float):
    def linked(keys, sets):
        label = np.arange(len(keys))
        for a, b in similar(sets, similarity):
            label = merge(label, a, b)
        moved = np.flatnonzero(label != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in moved], pa.binary()), pa.array([keys[i] for i in label[moved]], pa.binary())], names=["a", "b"])

    def run(batches):
        now, keys, sets = None, [], []
        for batch in batches:
            for shard, key, grams in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if shard != now:
                    if len(keys) > 1:
                        yield linked(keys, sets)
                    now, keys, sets = shard, [], []
                keys.append(key.as_py())
                sets.append(np.frombuffer(grams.as_buffer().to_pybytes(), np.uint64))
        if len(keys) > 1:
            yield linked(keys, sets)

    return run


def near_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """near_rows() without what tells rows of one doc_id apart: doc_id, component_id."""
    return near_rows(docs, shingle, similarity, tile).select("doc_id", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, rows without one last, then of the smallest digest."""
    rows = cut(near_rows(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    least = rows.groupBy("component").agg(F.min(order).alias("least"))
    return one_of_each(docs, rows.join(least, "component").select("doc_id", "digest", order.eqNullSafe(F.col("least")).alias("kept")))


def near_rows(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, digest, component, component_id.

    Texts are lower-cased (A-Z), split at white space and cut into shingles of words; a text of
    fewer words is one shingle. Texts whose sets of shingles have a Jaccard similarity of at
    least similarity link, texts without words among themselves only, and component_id is the
    smallest doc_id that links reach, null if no row of the component has one; component
    names it in any case. A null text has no words. Rows that repeat a doc_id, and rows without
    one, each have the component of their own text. An empty table gives an empty result, and
    columns other than doc_id and text are not read. Candidates are made for SIMILARITY; a lower
    similarity would lose links.
    """
    ready(docs.sparkSession)
    sketched = cut(docs.select("doc_id", text_bytes(), text_digest().alias("digest")).mapInArrow(_sketched(shingle), "doc_id long, digest long, key binary, code binary"))
    # equal sets collapse first
    codes = cut(sketched.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("code").alias("code")))
    group = codes.select("key", "code").join(candidates(codes.select("code").distinct()), "code", "left").select("key", F.coalesce("component", "code").alias("component"))
    tiles = group.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles"))
    members = cut(group.join(tiles, "component").withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")))
    ids = codes.join(members.select("key"), "key").filter("node IS NOT NULL").select(F.col("node").alias("doc_id")).distinct()
    texts = docs.select("doc_id", text_bytes())
    wanted = attach(texts.filter("doc_id IS NOT NULL"), ids, "doc_id").select("text").unionByName(texts.filter("doc_id IS NULL").select("text"))
    sets = wanted.mapInArrow(_sets(shingle), "key binary, grams binary").join(members, "key").dropDuplicates(["key"])
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.xxhash64("component", F.least(u, "own"), F.greatest(u, "own"))))
    dealt = sets.select(pair.alias("shard"), "key", "grams").repartition(parts(docs), "shard").sortWithinPartitions("shard")
    linked = cut(components(cut(dealt.mapInArrow(_links(similarity), "a binary, b binary").distinct())))
    roots = codes.select("key", "node").join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = roots.groupBy("component").agg(F.min("node").alias("component_id"))
    return sketched.select("doc_id", "digest", "key").join(roots.join(least, "component").select("key", "component", "component_id"), "key").select("doc_id", "digest", "component", "component_id")
