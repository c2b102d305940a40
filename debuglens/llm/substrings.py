"""Removal of repeated substrings: every byte covered by a string of LENGTH bytes that starts elsewhere too.

The suffixes that matter are found from content. Every window of LENGTH bytes has an anchor, the
place of its least hash of GRAM bytes; equal windows have their anchors at the same distance d
from their start. Windows are therefore compared only with windows of equally anchored places,
and the strings compared are cut at fixed distances from the anchor, so that equal windows always
meet. Each test asks whether a string of bytes around an anchor occurs a second time, and is a
count by fingerprint with partial aggregation, so a passage that a third of all documents share
is a single key with a large count and never a group in one task:

1. For the near (d <= HALF) and far (d >= HALF) windows of an anchor: the bytes that all of them
   have in common. If these are unique, so is each window. If the bytes that the windows cover
   together occur twice, all windows are repeated.
2. What is left, the ends of shared passages, is cut into SLICES of distances, with the same tests.
3. The windows of slices still open are counted one by one.

Strings count as equal if two fingerprints agree, 128 bits in all: that of the common part, which
is also what rows are dealt by, and that of the whole. Common parts that are so frequent that
their rows should not meet in one task are found on a sample of the documents and counted with
partial aggregations instead; either way gives the same result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from debuglens.llm.common import BROADCAST_ROWS, attach, cut, ready, text_bytes

LENGTH = 400
GRAM = 16
#: Anchors can be this far from the start of their window.
FAR = LENGTH - GRAM
HALF = 200
SLICE = 24
#: Windows whose anchors are found at once; an anchor's place takes 24 bits of a number.
STRETCH = 1 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_PLACE = np.uint64((1 << 24) - 1)
HALVES = ((0, HALF), (HALF + 1, FAR))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of each anchor, in order; windows are named by their start."""
    n = len(data) - LENGTH + 1
    found = []
    for at in range(0, n, STRETCH):
        windows = min(STRETCH, n - at)
        m = windows + FAR
        one = np.ndarray((m,), "<u8", data, at, (1,))
        two = np.ndarray((m,), "<u8", data, at + 8, (1,))
        h = one * _A + two * _B
        h ^= h >> np.uint64(32)
        h *= _C
        h = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= FAR + 1:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        rest = FAR + 1 - width
        least = np.minimum(h[: len(h) - rest], h[rest:]) if rest else h
        place = (least & _PLACE).astype(np.int64) + at
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((place[first], first + at, np.r_[first[1:] - 1, windows - 1] + at))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.r_[True, place[1:] != place[:-1]]
    return place[new], first[new], last[np.r_[new[1:], True]]


def _string(data: bytes, begin: int, end: int) -> int | None:
    """A string's fingerprint; null if it isn't all there."""
    return xxhash.xxh3_64_intdigest(data[begin:end], 7) - (1 << 63) if begin >= 0 and end <= len(data) else None


def _core(data: bytes, place: int, near: int, far: int, seed: int) -> int | None:
    """The fingerprint of the bytes that all windows of these distances have in common."""
    begin, end = place - near, place - far + LENGTH
    return xxhash.xxh3_64_intdigest(data[begin:end], seed) - (1 << 63) if begin >= 0 and end <= len(data) else None


TESTS = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), ("first", pa.int16()), ("last", pa.int16()), ("core", pa.int64()), ("whole", pa.int64())])
#: first and last are distances from the place.
TEST_COLUMNS = "doc_id long, place long, part int, first short, last short, core long, whole long"


def _test(doc_id: int, data: bytes, place: int, part: int, near: int, far: int, first: int, last: int):
    """A row for the windows at distances near to far that this anchor has, or None if it has none."""
    low, high = max(first, place - far), min(last, place - near)
    if low > high:
        return None
    return (doc_id, place, part, place - low, place - high, _core(data, place, near, far, part), _string(data, place - far, place - near + LENGTH))


def _given(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), TESTS)], schema=TESTS)


def _halves(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer().to_pybytes()
            for place, first, last in zip(*(x.tolist() for x in anchors(data))):
                for part, (near, far) in enumerate(HALVES):
                    if row := _test(doc_id, data, place, part, near, far, first, last):
                        rows.append(row)
            if len(rows) > 50_000:
                yield _given(rows)
                rows = []
        if rows:
            yield _given(rows)


def _slices(batches):
    for batch in batches:
        rows = []
        for doc_id, text, open_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = text.as_buffer().to_pybytes()
            for x in open_:
                near, far = HALVES[x["part"]]
                for d in range(near, far + 1, SLICE):
                    if row := _test(doc_id, data, x["place"], 2 + d, d, min(far, d + SLICE - 1), x["place"] - x["first"], x["place"] - x["last"]):
                        rows.append(row)
            if len(rows) > 50_000:
                yield _given(rows)
                rows = []
        if rows:
            yield _given(rows)


def _windows(batches):
    names = ["doc_id", "first", "core", "whole"]

    def give(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    for batch in batches:
        rows = []
        for doc_id, text, open_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = text.as_buffer().to_pybytes()
            for x in open_:
                near = x["part"] - 2
                far = min(near + SLICE - 1, HALVES[near > HALF][1])
                core = _core(data, x["place"], near, far, x["part"])
                for i in range(x["place"] - x["first"], x["place"] - x["last"] + 1):
                    rows.append((doc_id, i, core, _string(data, i, i + LENGTH)))
                if len(rows) > 50_000:
                    yield give(rows)
                    rows = []
        if rows:
            yield give(rows)


#: Rows of one common part that may meet in a task, and the share of documents that they are estimated on.
MEET = 100_000
SAMPLE = 16


def _frequent(docs: DataFrame, tests, sample: int = SAMPLE) -> DataFrame:
    """Common parts with about MEET rows or more; at most one for each MEET rows of the input."""
    some = tests(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0))
    return cut(some.groupBy("core").count().filter(F.col("count") >= MEET // sample).select("core"))


def _beside(rows: DataFrame, frequent: DataFrame, has: int, how: str) -> DataFrame:
    """rows with (inner) or without (left_anti) the has frequent common parts, broadcast if they fit the bound of counted tables."""
    return rows.join(F.broadcast(frequent), "core", how) if has <= BROADCAST_ROWS else attach(rows, frequent, "core", how, small=False)


def _decided(tests: DataFrame, frequent: DataFrame) -> DataFrame:
    """tests whose common part occurs twice, with repeated (all their windows occur elsewhere) and stays (a closer look is due).

    A repeated row can be the only place where another row's windows occur again, so of each
    repeated string whose common part is also that of a row that isn't, one row stays as a
    witness.
    """
    known = tests.filter("core IS NOT NULL")
    has = frequent.count()
    usual = _beside(known, frequent, has, "left_anti") if has else known
    string = Window.partitionBy("core", "whole")
    counted = usual.withColumn("n_whole", F.count("whole").over(string)).withColumn("rank", F.row_number().over(string.orderBy("doc_id", "place")))
    part = Window.partitionBy("core")
    counted = counted.withColumn("n_core", F.count("*").over(part)).withColumn("lone", F.min("n_whole").over(part) < 2)
    out = counted.filter("n_core > 1").select("doc_id", "place", "part", "first", "last", (F.col("n_whole") > 1).alias("repeated"), ((F.col("n_whole") < 2) | ((F.col("rank") == 1) & F.col("lone"))).alias("stays"))
    if has:
        out = out.unionByName(_decided_frequent(_beside(known, frequent, has, "inner")))
    return cut(out)


def _decided_frequent(tests: DataFrame) -> DataFrame:
    """The same by partial aggregations and joins that can be split, for common parts of very many rows."""
    strings = cut(tests.groupBy("core", "whole").agg(F.count("whole").alias("n_whole"), F.min(F.struct("doc_id", "place")).alias("chosen")))
    parts_ = strings.groupBy("core").agg((F.min("n_whole") < 2).alias("lone"))
    told = tests.join(strings.join(parts_, "core").withColumnsRenamed({"core": "c_", "whole": "w_"}), (F.col("core") == F.col("c_")) & F.col("whole").eqNullSafe(F.col("w_")))
    witness = (F.col("chosen") == F.struct("doc_id", "place")) & F.col("lone")
    return told.select("doc_id", "place", "part", "first", "last", (F.col("n_whole") > 1).alias("repeated"), ((F.col("n_whole") < 2) | witness).alias("stays"))


def _open(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, text, open) of the documents with tests that stay; a document's list is bounded by its text."""
    lists = told.filter("stays").groupBy("doc_id").agg(F.collect_list(F.struct("place", "part", "first", "last")).alias("open"))
    return attach(docs, lists, "doc_id", small=False).select("doc_id", "text", "open")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last): runs of windows, named by their starts, that also occur elsewhere; all of them, maybe overlapping."""
    ready(docs.sparkSession)
    texts = docs.select("doc_id", text_bytes())
    halves = lambda d: d.mapInArrow(_halves, TEST_COLUMNS)
    whole = _decided(halves(texts), _frequent(texts, halves))
    slices = lambda d: d.mapInArrow(_slices, TEST_COLUMNS)
    opened = cut(_open(texts, whole))
    closer = _decided(slices(opened), _frequent(opened, slices))
    windows = cut(_open(opened.select("doc_id", "text"), closer).mapInArrow(_windows, "doc_id long, first long, core long, whole long"))
    frequent = _frequent(windows, lambda d: d)
    has = frequent.count()
    usual = _beside(windows, frequent, has, "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("core", "whole")))
    often = _beside(windows, frequent, has, "inner")
    twice = often.groupBy("core", "whole").count().filter(F.col("count") > 1).select("core", "whole")
    again = usual.filter("n > 1").select("doc_id", "first").unionByName(often.join(twice, ["core", "whole"]).select("doc_id", "first"))
    run = ["doc_id", (F.col("place") - F.col("first")).alias("first"), (F.col("place") - F.col("last")).alias("last")]
    told = [t.filter("repeated").select(*run) for t in (whole, closer)]
    return told[0].unionByName(told[1]).unionByName(again.withColumn("last", F.col("first")))


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def spans(runs: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal spans of bytes that runs of windows cover."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def _removed(batches):
    for batch in batches:
        rows, size = [], 0
        for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = text.as_buffer().to_pybytes()
            gone = spans([(r["first"], r["last"]) for r in runs or ()])
            cuts = [0, *(x for s in gone for x in s), len(data)]
            kept = b"".join([data[i:j] for i, j in zip(cuts[::2], cuts[1::2])])
            rows.append((doc_id, len(data), len(data) - len(kept), len(gone), [x for s in gone for x in s], kept))
            size += len(kept)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), REMOVED)], schema=REMOVED)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), REMOVED)], schema=REMOVED)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (starts and ends in turn), kept (the other bytes).

    Texts are UTF-8 bytes, null is empty; matches never cross documents, and strings are judged on
    the input. Texts of fewer than LENGTH bytes lose nothing. doc_id names a document: rows that
    repeat one are copies of it and lose the same bytes, all of them if the text is long enough.
    An empty table gives an empty result.
    """
    lists = repeated(docs).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = attach(docs.select("doc_id", text_bytes()), lists, "doc_id", "left", small=False)
    return joined.select("doc_id", "text", "runs").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of without_repeats()."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
