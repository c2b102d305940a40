"""Language identification with a bit-sliced Bloom filter over character trigrams.

Slot i of the filter is a mask with a bit for each language, in as many words as it takes, so one probe answers for all
languages at once: the AND of a trigram's slots is the set of languages that (may) contain it.
A text's count for a language is the number of its trigrams with that bit; the counts are
corrected for the filter's false positives, which are known from each language's fill, and the
largest corrected count decides.

Fitting uses a bounded sample (``SAMPLE_DOCS`` documents per language in expectation,
``GRAMS`` trigrams each) of every language; every text is then scored whole.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debuglens.llm.common import ready

#: Expected number of training documents per language; the sample is drawn by a hash of the id.
SAMPLE_DOCS = 2000
GRAMS = 20_000
#: A trigram belongs to a language if it is at least this share as frequent there as anywhere.
SHARE = 0.5
LEAST = 3
HASHES = 3
SLOT_BITS = 18
#: Code points scored at once.
SLICE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str]):
    """(hash of each trigram around a letter, index of the first of each text, whether a text has a letter)."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(texts)) + 1)
    letter = _letters()[points]
    at = np.flatnonzero(letter[1:-1]) + 1
    points = np.where(letter, points, 32).astype(np.uint64)
    h = points[at - 1] * np.uint64(0x9E3779B97F4A7C15) + points[at] * np.uint64(0xC2B2AE3D27D4EB4F) + points[at + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    edge = np.searchsorted(at, np.r_[1, ends + 1])
    return h, edge, np.diff(edge) > 0


class Filter:
    """The bit-sliced filter: slots of language masks."""

    def __init__(self, languages: list[str], hashes: list[np.ndarray]):
        self.languages = languages
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * np.dtype(t).itemsize), np.uint64)
        self.bits = 8 * np.dtype(kind).itemsize
        #: a row of slots for each word of the masks
        self.slots = np.zeros((max(1, -(-len(languages) // self.bits)), 1 << SLOT_BITS), kind)
        for b, h in enumerate(hashes):
            for k in range(HASHES):
                self.slots[b // self.bits, self.slot(h, k)] |= kind(1 << b % self.bits)
        fill = np.array([((self.slots[b // self.bits] >> kind(b % self.bits)) & kind(1)).mean() for b in range(len(languages))])
        self.false = fill**HASHES

    @staticmethod
    def slot(h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def masks(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """One word of each trigram's mask: the languages from word * bits on."""
        out = self.slots[word][self.slot(h, 0)]
        for k in range(1, HASHES):
            out = out & self.slots[word][self.slot(h, k)]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h, edge, spoken = grams(texts)
        n = np.diff(edge)
        counts = np.empty((len(texts), len(self.languages)))
        for b in range(len(self.languages)):
            if b % self.bits == 0:
                masks = self.masks(h, b // self.bits)
            total = np.r_[0, np.cumsum((masks >> masks.dtype.type(b % self.bits)) & masks.dtype.type(1), dtype=np.int64)]
            counts[:, b] = total[edge[1:]] - total[edge[:-1]]
        counts = np.maximum(0, (counts - n[:, None] * self.false) / np.maximum(1e-9, 1 - self.false))
        best = counts.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        top = counts.max(axis=1, initial=0)
        score = np.where(spoken, top / np.maximum(counts.sum(axis=1), 1e-9), 0.0)
        return [self.languages[b] if s and self.languages else "und" for b, s in zip(best.tolist(), spoken.tolist())], np.minimum(score, 1.0)


def sliced(batch: pa.RecordBatch, column: int, points: int = SLICE):
    """Yield (first row, list of texts) of at most about points code points."""
    held, size, first = [], 0, 0
    for row, text in enumerate(batch.column(column)):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size > points:
            yield first, held
            held, size, first = [], 0, row + 1
    if held:
        yield first, held


def _counted(batches):
    for batch in batches:
        sums: dict[str, list] = {}
        for first, texts in sliced(batch, 1):
            langs = batch.column(0).slice(first, len(texts)).to_pylist()
            for lang in set(langs):
                h, _, _ = grams([t for t, x in zip(texts, langs) if x == lang])
                sums.setdefault(lang, []).append(np.unique(h, return_counts=True))
        for lang, found in sums.items():
            h, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([c for _, c in found]), minlength=len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def fit(docs: DataFrame, trains: Column) -> Filter:
    """A filter learnt from text and lang of the rows of docs for which trains holds and lang is not null.

    Languages are in order of their counts, so a text without a known trigram gets the commonest.
    """
    ready(docs.sparkSession)
    rows = docs.filter(trains & F.col("lang").isNotNull())
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not common:
        return Filter([], [])
    share = F.element_at(F.create_map(*[F.lit(x) for r in common for x in (r["lang"], min(1.0, SAMPLE_DOCS / r["count"]))]), F.col("lang"))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < share * (1 << 30))
    counts = sample.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shared = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    chosen = shared.withColumn("most", F.max("p").over(Window.partitionBy("gram"))).filter((F.col("p") >= SHARE * F.col("most")) & (F.col("n") >= LEAST))
    ranked = chosen.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= GRAMS)
    kept = ranked.select("lang", "gram").toArrow()
    langs, hashes = kept.column("lang").to_numpy(zero_copy_only=False), kept.column("gram").to_numpy().view(np.uint64)
    names = [r["lang"] for r in common]
    return Filter(names, [hashes[langs == x] for x in names])


def _predicted(model: Filter):
    def run(batches):
        for batch in batches:
            for first, texts in sliced(batch, 2):
                lang, score = model.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Filter, held_out: Column) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (share of the corrected counts).

    A null or empty text or one without a letter is ``und`` with score 0; so is every text if
    nothing was learnt. Only the text is looked at, the whole of it; of languages with equal
    counts the commonest wins. Repeated rows, and rows without a doc_id, each have their row. An
    empty table gives an empty result, and columns other than doc_id and text are not read.
    """
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")
