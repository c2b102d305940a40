"""Exact deduplication by composable polynomial fingerprints.

A text, with its white space deleted, is cut into chunks of fixed size. A chunk's hash is its
value as a number in base 256 modulo a large prime; the hash of a concatenation is
``H(a) * 256**len(b) + H(b)``, so chunk hashes that were made apart combine into the hash of a
huge document. Texts of equal fingerprint and length are only candidates: every member is
compared with its group's survivor chunk by chunk, as a merge join of chunk rows, so that no
task holds more than a chunk of either text. Members that differ are grouped among themselves
again until none are left.

Nothing larger than a chunk row is ever gathered: a group's survivor is dealt out over salts,
one for each ``SALT_ROWS`` members.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debuglens.llm.common import NO_ID, cut, one_of_each, ready, text_bytes, text_digest

#: The modulus: 2**120 - 119, a prime, so a fingerprint fits two longs.
MODULUS = 2**120 - 119
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
CHUNK = 32 * 1024
SALT_ROWS = 512
#: Members of groups up to this many are a broadcast side of at most 40 MB, and so are the rows of this many groups.
BROADCAST_ROWS = 1_000_000
GROUPS = 250_000


def combine(left: int, right: int, right_length: int, modulus: int = MODULUS) -> int:
    """The hash of a concatenation from the hashes of its two parts."""
    return (left * pow(256, right_length, modulus) + right) % modulus


def fingerprint(data: bytes, modulus: int = MODULUS, chunk: int = CHUNK) -> int:
    value = 0
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        value = combine(value, int.from_bytes(part, "big") % modulus, len(part), modulus)
    return value


ROW = ["member", "digest"]


def _fingerprints(modulus: int, chunk: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_points", pa.int64()), ("fp_hi", pa.int64()), ("fp_lo", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(3):
                data = text.as_buffer().to_pybytes().translate(None, WHITE)
                value = fingerprint(data, modulus, chunk)
                found.append((value >> 60, value & (1 << 60) - 1, len(data), hashlib.sha256(data).hexdigest()))
            made = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, f.type) for c, f in zip(made, list(schema)[3:]))], schema=schema)

    return run


def _chunks(chunk: int):
    schema = pa.schema([("member", pa.int64()), ("digest", pa.int64()), ("best", pa.int64()), ("best_digest", pa.int64()), ("salt", pa.int64()), ("at", pa.int64()), ("part", pa.binary())])

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for *ids, text in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5)):
                data = text.as_buffer().to_pybytes().translate(None, WHITE)
                for at in range(0, len(data), chunk):
                    rows.append((*ids, at, data[at : at + chunk]))
                    held += len(rows[-1][-1])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def exact_groups(docs: DataFrame, modulus: int = MODULUS, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest doc_id, a row
    without doc_id last. A null text counts as empty, and empty texts are equal. Rows that repeat
    a doc_id are rows of their own, each with the group of its own text: ``group_size`` counts
    them all, and ``kept`` holds for each row that ties with the one that stays in both code
    points and doc_id. An empty table gives an empty result; other columns are not read.
    """
    return exact_rows(docs, modulus, chunk).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_rows(docs: DataFrame, modulus: int = MODULUS, chunk: int = CHUNK) -> DataFrame:
    """exact_groups() with digest, which tells rows of one doc_id apart."""
    ready(docs.sparkSession)
    texts = docs.select("doc_id", text_digest().alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"), text_bytes())
    slim = texts.mapInArrow(_fingerprints(modulus, chunk), "doc_id long, digest long, n_points long, fp_hi long, fp_lo long, n_bytes long, text_sha256 string")
    slim = cut(slim.withColumn("member", F.coalesce("doc_id", F.lit(NO_ID))))
    key = ["fp_hi", "fp_lo", "n_bytes"]
    groups = cut(_firsts(slim, key).filter("rows > 1"))
    small = groups.limit(GROUPS + 1).count() <= GROUPS
    joined = slim.join(F.broadcast(groups) if small else groups, key, "left")
    differing = _differing(docs, joined.filter(_apart()), chunk, _repeats(slim))
    if differing.isEmpty():
        own = F.col("rows").isNull()
        kept = own | ((F.col("member") == F.col("best")) & (F.col("n_points") == F.col("best_points")))
        return joined.select("doc_id", "digest", F.when(own, F.col("doc_id")).otherwise(_named("best")).alias("keep_id"), F.coalesce("rows", F.lit(1)).alias("group_size"), kept.alias("kept"), "text_sha256")
    return _resolved(docs, slim, joined, differing, key, chunk)


def _named(column: str):
    return F.nullif(column, F.lit(NO_ID))


def _apart():
    """Whether a row isn't the very row that stays, or a repetition of it."""
    return F.col("best").isNotNull() & ~((F.col("best") == F.col("member")) & (F.col("best_digest") == F.col("digest")))


def _firsts(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, best, best_digest, best_points, rows) of each group."""
    order = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("none"), "member", "digest")
    groups = rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    return groups.select(*key, F.col("first.member").alias("best"), F.col("first.digest").alias("best_digest"), (-F.col("first.p")).alias("best_points"), "rows")


def _repeats(slim: DataFrame) -> bool:
    """Whether a doc_id and text occur in several rows."""
    return not slim.groupBy(ROW).count().filter("count > 1").isEmpty()


def _differing(docs: DataFrame, pending: DataFrame, chunk: int, repeats: bool) -> DataFrame:
    """(member, digest) of the rows among pending whose text differs from that of their best, compared in chunks."""
    salts = F.ceil(F.col("rows") / F.lit(SALT_ROWS)).cast("long")
    best = ["best", "best_digest"]
    members = pending.select(*ROW, *best, F.pmod(F.xxhash64(*ROW), salts).alias("salt")).distinct()
    spread = pending.groupBy(best).agg(F.max(salts).alias("n"))
    bests = spread.select(F.col("best").alias("member"), F.col("best_digest").alias("digest"), *best, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt"))

    def chunked(ids: DataFrame) -> DataFrame:
        return _with_text(docs, ids).mapInArrow(_chunks(chunk), "member long, digest long, best long, best_digest long, salt long, at long, part binary")

    right = chunked(bests).select(*best, "salt", "at", F.col("part").alias("other"))
    if repeats:
        right = right.dropDuplicates([*best, "salt", "at"])
    compared = chunked(members).join(right, [*best, "salt", "at"], "left")
    return cut(compared.filter(~F.col("part").eqNullSafe(F.col("other"))).select(*ROW).distinct())


def _with_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(member, digest, best, best_digest, salt, text); the id side is broadcast only if its counted rows fit a bound."""
    ids = cut(ids)
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(ids) if small else ids
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("member"), text_digest().alias("digest"), text_bytes())
    return rows.join(side, ROW).select(*ROW, "best", "best_digest", "salt", "text")


def _resolved(docs: DataFrame, slim: DataFrame, joined: DataFrame, differing: DataFrame, key: list[str], chunk: int) -> DataFrame:
    """Groups again, without their best, the members that differ from it, until no member differs."""
    columns = ["doc_id", *ROW, "n_points", "text_sha256", F.coalesce("best", "member").alias("best"), F.coalesce("best_points", "n_points").alias("best_points")]
    settled, rest = joined.join(differing, ROW, "left_anti").select(columns), slim.join(differing, ROW, "left_semi")
    repeats = _repeats(slim)
    while True:
        again = cut(rest.join(_firsts(rest, key), key))
        different = _differing(docs, again.filter(_apart()), chunk, repeats)
        settled = cut(settled.unionByName(again.join(different, ROW, "left_anti").select(columns)))
        if different.isEmpty():
            break
        rest = cut(slim.join(different, ROW, "left_semi"))
    sizes = settled.groupBy("text_sha256").agg(F.count("*").alias("group_size"))
    kept = (F.col("member") == F.col("best")) & (F.col("n_points") == F.col("best_points"))
    return settled.join(sizes, "text_sha256").select("doc_id", "digest", _named("best").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def survivors(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, the one that exact_groups() keeps; ties go to the smallest digest."""
    rows = cut(exact_rows(docs).select("doc_id", "digest", "kept", "text_sha256"))
    tied = rows.filter("kept").groupBy("doc_id", "text_sha256").agg(F.min("digest").alias("digest"), F.count_distinct("digest").alias("n")).filter("n > 1")
    if not tied.isEmpty():
        best = rows.filter("kept").groupBy("doc_id", "text_sha256").agg(F.min("digest").alias("least"))
        told = rows.join(best.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("of"), F.col("text_sha256").alias("sha"), "least"), (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("of")) & (F.col("text_sha256") == F.col("sha")), "left")
        rows = told.select("doc_id", "digest", (F.col("kept") & (F.col("digest") == F.col("least"))).alias("kept"))
    return one_of_each(docs, rows)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
), g AS (
  SELECT doc_id, k,
         first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY k) AS group_size
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""
