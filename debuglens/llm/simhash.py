"""SimHash near-duplicates, found with sharded BK-trees.

Equal fingerprints collapse first. Two codes that differ in at most 3 of 64 bits agree on all
but 3 of any set of blocks, so each code joins one shard for each choice of the agreeing blocks;
the number of blocks grows with the number of codes, which keeps shards small. A task builds a
BK-tree for each of its shards and follows only edges within the radius. Shards of more than
``TILE`` codes are dealt out as pairs of tiles. A shard reports links to the least member of
each local class, never its pairs; classes are then joined across shards.
"""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debuglens.llm.bktree import Forest, merge
from debuglens.llm.common import cut, parts, ready, text_bytes
from debuglens.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Codes of a shard that one task compares; larger shards are split.
TILE = 8192
#: Shingles hashed at once.
BLOCK = 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is 1 if more than half of the shingles' hashes have it."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = iter((b" ".join(words),)), 1
    else:
        grams, n = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)))), len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, islice(grams, m), repeat(SEED)), np.uint64, m)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            codes = np.fromiter((simhash(t.as_buffer().to_pybytes(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    return run


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """The bits that shards of n codes agree on, one mask for each choice of agreeing blocks."""
    for blocks in range(radius + 1, 2 * radius + 2):
        width = -(-64 // blocks)
        if n / 2 ** ((blocks - radius) * (64 // blocks)) <= 64 or blocks == 2 * radius + 1:
            each = [sum(1 << b for b in range(k * width, min(64, (k + 1) * width))) for k in range(blocks)]
            return [sum(x) for x in combinations(each, blocks - radius)]
    raise AssertionError


def _links(radius: int):
    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        shard, code = (table.column(c).to_numpy() for c in ("shard", "code"))
        order = np.lexsort((code, shard))
        shard, code = shard[order], code[order].view(np.uint64)
        label = np.arange(len(code))
        for a, b in Forest(code, shard).linked(radius):
            label = merge(label, a, b)
        moved = np.flatnonzero(label != np.arange(len(code)))
        for at in range(0, len(moved), 1 << 16):
            part = moved[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(code[part].view(np.int64)), pa.array(code[label[part]].view(np.int64))], names=["a", "b"])

    return run


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z), split at white space and cut into shingles of words; a text of
    fewer words is one shingle, and a text of none (null included) has fingerprint zero, which
    links like any other. Fingerprints that differ in at most radius bits link, and
    component_id is the smallest doc_id that links reach. An empty table gives an empty result;
    rows that repeat a doc_id each have their row, and rows without one have the component of
    their fingerprint, null if no row of it has a doc_id. Columns other than doc_id and text are
    not read.
    """
    ready(docs.sparkSession)
    coded = cut(docs.select("doc_id", text_bytes()).mapInArrow(_fingerprints(shingle), "doc_id long, code long"))
    codes = cut(coded.groupBy("code").agg(F.min("doc_id").alias("node")))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(codes.count(), radius)]
    sharded = codes.select("code", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])).alias("s")).select("s.band", "s.key", "code")
    large = sharded.groupBy("band", "key").count().filter(F.col("count") > tile).select("band", "key", F.ceil(F.col("count") / F.lit(tile)).cast("int").alias("tiles"))
    tiled = sharded.join(large, ["band", "key"], "left").withColumn("own", F.pmod(F.xxhash64("code"), F.coalesce("tiles", F.lit(1))).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda u: F.xxhash64("band", "key", F.least(u, "own"), F.greatest(u, "own"))))
    dealt = tiled.select(pair.alias("shard"), "code").repartition(parts(docs), "shard")
    edges = dealt.mapInArrow(_links(radius), "a long, b long").distinct()
    roots = cut(codes.join(components(edges).withColumnRenamed("node", "code"), "code", "left").select("code", "node", F.coalesce("component", "code").alias("component")))
    joined = roots.join(roots.groupBy("component").agg(F.min("node").alias("component_id")), "component").select("code", "component_id")
    return coded.join(joined, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
