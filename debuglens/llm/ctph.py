"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over a window of bytes ends a piece wherever its low bits are all ones; each
piece gives a letter. The number of low bits is the block size's power of two, chosen so that a
text has 32 to 128 pieces whatever its length; the next larger block sizes are kept too. Two
fingerprints are compared at block sizes that both have, by edit distance, and count as alike
only if they share a run of letters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debuglens.llm.common import NO_ID, parts, ready

WINDOW = 7
MOST, FEWEST = 128, 32
#: Bytes rolled at once.
STRETCH = 1 << 20
#: Block sizes that a fingerprint has.
LEVELS = 3
#: Letters in a row that alike fingerprints share.
RUN = 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: A fixed number for each byte, and the powers that weigh the window's bytes.
NUMBERS = np.array([xxhash.xxh32_intdigest(bytes((b,))) for b in range(256)], np.uint32)
POWERS = [np.uint32(pow(0x01000193, k, 1 << 32)) for k in range(WINDOW)]


def triggers(data: bytes, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of pieces for the block size 2**low, and the bits above the low ones."""
    ends, wider = [], []
    mask = np.uint32((1 << low) - 1)
    for at in range(0, len(data), STRETCH):
        begin = max(0, at - WINDOW + 1)
        t = NUMBERS[np.frombuffer(data, np.uint8, min(len(data), at + STRETCH) - begin, begin)]
        r = t.copy()
        for k in range(1, min(WINDOW, len(t))):
            r[k:] += t[:-k] * POWERS[k]
        r ^= r >> np.uint32(15)
        r *= np.uint32(0x2C1B3C6D)
        r ^= r >> np.uint32(12)
        r = r[at - begin :]
        found = np.flatnonzero((r & mask) == mask)
        ends.append(found + at + 1)
        wider.append(r[found] >> np.uint32(low))
    return (np.concatenate(ends), np.concatenate(wider)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def _letters(data: bytes, ends: list[int]) -> str:
    cuts = [0, *ends] if ends and ends[-1] == len(data) else [0, *ends, len(data)]
    return "".join([LETTERS[xxhash.xxh32_intdigest(data[i:j]) & 63] for i, j in zip(cuts, cuts[1:])]) if data else ""


def fingerprint(data: bytes) -> str:
    """``power:letters:letters at the next power:...`` for LEVELS powers; the empty text has power 0 and no letters."""
    low = max(1, (len(data) // 64).bit_length() - 1)
    ends, wider = triggers(data, low)
    if len(ends) < FEWEST:
        while low > 1 and len(ends) < FEWEST:
            low -= 1
            ends, wider = triggers(data, low)
    while len(ends) > MOST and low < 31:
        low += 1
        ends, wider = triggers(data, low)
    kept = [ends[(wider & np.uint32((1 << k) - 1)) == (1 << k) - 1] for k in range(LEVELS)]
    return ":".join([str(low if data else 0), *(_letters(data, e.tolist()) for e in kept)])


def edit_distance(a: str, b: str) -> int:
    """Levenshtein's distance, a column of the table at a time as the bits of an integer."""
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(diagonal | up) & full, up & diagonal
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(diagonal | rise) & full, rise & diagonal
    return distance


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; 0 for fingerprints whose block sizes are not compatible."""
    if a == b:
        return 1.0
    (p, *first), (q, *second) = a.split(":"), b.split(":")
    if not first[0] or not second[0]:
        return 0.0
    one, two = dict(enumerate(first, int(p))), dict(enumerate(second, int(q)))
    return max((_alike(one[k], two[k]) for k in one.keys() & two.keys()), default=0.0)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(bounds: np.ndarray, last: int):
    """Rows with their range, and again, as extra, in the range that needs them as the next document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            own = np.searchsorted(bounds, ids, "left").astype(np.int32)
            below = np.flatnonzero((own < len(bounds)) & (bounds[np.minimum(own, len(bounds) - 1)] == ids)) if len(bounds) else np.zeros(0, np.int64)
            around = np.flatnonzero(ids == last)
            rows = np.r_[np.arange(len(ids)), below, around]
            to = np.r_[own, own[below] + 1, np.zeros(len(around), np.int64)].astype(np.int32)
            extra = np.arange(len(rows)) >= len(ids)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(extra), taken.column(0), taken.column(1)], names=["part", "extra", "doc_id", "text"])

    return run


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(batches):
    before = None
    for batch in batches:
        rows = []
        for extra, doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            text = text.as_py()
            now = (doc_id, text, fingerprint(text.encode()))
            if before is not None:
                changed = edited(before[1], text).encode()
                other = fingerprint(changed)
                rows.append((before[0], len(before[1]), hashlib.sha256(changed).hexdigest(), before[2], other, likeness(before[2], other), likeness(before[2], now[2])))
            before = None if extra else now
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty. The next document is the one of the next smaller doc_id, and
    the largest comes after the smallest; rows that repeat a doc_id follow each other in order
    of their text. An only document is its own next one. A row without doc_id
    comes last. An empty table gives an empty result, and other columns are not read.

    Documents are dealt once, in ranges of ids whose bounds are ids of documents; a bound's
    document also goes to the range above it, which ends with it.
    """
    ready(docs.sparkSession)
    n = parts(docs)
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    found = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(0.5)), F.lit(max(10_000, 20 * n))).alias("q"), F.max("doc_id").alias("last")).first()
    bounds = np.array(sorted(set(found["q"] or ())), np.int64)
    rows = docs.mapInArrow(_dealt(bounds, found["last"] if found["last"] is not None else 0), "part int, extra boolean, doc_id long, text string")
    dealt = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("extra", F.desc("doc_id"), "text")
    out = dealt.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
