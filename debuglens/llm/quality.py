"""Quality classification by co-training two views of a page.

The text view sees a document's content: byte-bigram frequencies and rates of letters, cases,
signs and repeated words. The metadata view sees only what a page's record tells: its length,
language, source and layout in lines. Each view has a logistic classifier; over rounds each
labels, of a pool of unlabelled documents, those it is most sure of for the other one to learn
from. Each view is then calibrated on labelled rows kept apart, and a final calibrated sum of the
two views' log-odds scores every document.

The models are fitted on the driver, on a sample bounded by ``LABELLED`` and ``POOL`` rows of
about 2 KB of features each; scoring reads every whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debuglens.llm.common import ready

#: The bounds of the fit: labelled rows, and unlabelled rows that rounds may label.
LABELLED, POOL = 4000, 2000
ROUNDS = 4
#: Rows that each view hands over for each class in a round.
HANDED = 100
#: A view hands over only what it holds at least this likely.
SURE = 0.95
#: Documents scored below it are rejected; low, as very short clean texts tell little.
THRESHOLD = 0.2
BIGRAMS, TRAITS, META = 512, 12, 48
#: Bytes of a text looked at at once.
STRETCH = 1 << 20
_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
_KIND[128:] = 6
_FOLD = np.array([(b * 2654435761 >> 7) & 0xFFFF for b in range(256)], np.uint32)


def text_view(data: bytes) -> np.ndarray:
    """BIGRAMS hashed bigram frequencies (their square roots), then TRAITS rates of the whole text."""
    bins, kinds, same, n = np.zeros(BIGRAMS), np.zeros(7), 0, max(1, len(data))
    for at in range(0, len(data), STRETCH):
        b = np.frombuffer(data, np.uint8, min(STRETCH + 1, len(data) - at), at)
        kinds += np.bincount(_KIND[b[:STRETCH]], minlength=7)
        bins += np.bincount((_FOLD[b[:-1]] * np.uint32(31) + _FOLD[b[1:]]) % np.uint32(BIGRAMS), minlength=BIGRAMS)
        same += int((b[1:] == b[:-1]).sum())
    words = data.split()
    m = max(1, len(words))
    repeats = sum(map(bytes.__eq__, words[1:], words))
    alike = len(set(words)) / m
    lines = data.split(b"\n")
    traits = [*(kinds / n), same / n, repeats / m, alike, min(2.0, len(data) / m / 10), len(set(lines)) / len(lines)]
    return np.concatenate([np.sqrt(bins / n), traits])


def _slot(text: str, slots: int) -> int:
    return hashlib.blake2b(text.encode(), digest_size=4).digest()[0] % slots


def meta_view(lang, source, points: int, lines: int) -> np.ndarray:
    """Length, lines and their ratio on log scales, then hashed language and source."""
    out = np.zeros(META)
    size = np.log1p(points)
    out[:6] = size / 10, (size / 10) ** 2, np.log1p(lines) / 5, np.log1p(points / max(1, lines)) / 10, points < 100, lines < 2
    out[6 + _slot(f"l{lang}", 10)] = 1
    out[16 + _slot(f"s{source}", 32)] = 1
    return out


class Logistic:
    """Ridge-penalised logistic regression of standardised columns, fitted by Newton's steps."""

    def __init__(self, ridge: float = 1.0, steps: int = 12):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Logistic":
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-6
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.w, -30, 30)


def likely(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


class CoTrained:
    """The two views, their calibrations and their sum."""

    def __init__(self, text, meta, text_scale, meta_scale, both, heard):
        self.text, self.meta, self.text_scale, self.meta_scale, self.both = text, meta, text_scale, meta_scale, both
        #: 1 for a view that takes part in the sum, 0 for one that would speak against its own verdict.
        self.heard = heard

    def views(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.text_scale.odds(self.text.odds(x)[:, None]), self.meta_scale.odds(self.meta.odds(m)[:, None])

    def score(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views(x, m)
        return likely(self.both.odds(np.c_[a, b] * self.heard)), likely(a), likely(b)


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, px: np.ndarray, pm: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """Fit both views on labelled rows (x, m, y), exchange pseudo-labels of the pool (px, pm), calibrate and combine.

    Every fourth labelled row is kept from the views for their calibration.
    """
    apart = np.arange(len(y)) % 4 == 3
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    held = apart if apart.any() else ~apart
    xs, ms = [x[~apart], x[:0]], [m[~apart], m[:0]]
    ys, zs = [y[~apart], y[:0]], [y[~apart], y[:0]]
    free = np.ones(len(px), bool)
    for turn in range(rounds + 1):
        text, meta = Logistic().fit(np.concatenate(xs), np.concatenate(ys)), Logistic().fit(np.concatenate(ms), np.concatenate(zs))
        if turn == rounds or not free.any():
            break
        moved = 0
        for teacher, own, features, labels, of in ((text, px, ms, zs, pm), (meta, pm, xs, ys, px)):
            at = np.flatnonzero(free)
            p = likely(teacher.odds(own[at]))
            order = np.argsort(p, kind="stable")
            low, high = order[:HANDED], order[-HANDED:]
            low, high = at[low[p[low] <= 1 - SURE]], at[high[p[high] >= SURE]]
            features.append(np.concatenate([of[low], of[high]]))
            labels.append(np.r_[np.zeros(len(low)), np.ones(len(high))])
            free[low] = free[high] = False
            moved += len(low) + len(high)
        if not moved:
            break
    text_scale = Logistic(1e-3).fit(text.odds(x[held])[:, None], y[held])
    meta_scale = Logistic(1e-3).fit(meta.odds(m[held])[:, None], y[held])
    views = np.c_[text_scale.odds(text.odds(x[held])[:, None]), meta_scale.odds(meta.odds(m[held])[:, None])]
    both, heard = Logistic(1e-2).fit(views, y[held]), np.ones(2)
    if (both.w[:2] < 0).any():
        # calibrated views can't have negative weights: the one that has is left out
        heard = (both.w[:2] >= 0).astype(float)
        heard = heard if heard.any() else np.array([1.0, 0.0])
        both = Logistic(1e-2).fit(views * heard, y[held])
    return CoTrained(text, meta, text_scale, meta_scale, both, heard)


COLUMNS = ("doc_id", "text", "lang", "source", "points", "lines")


def _inputs(docs: DataFrame, more=()) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.cast("binary").alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.length(text).cast("long").alias("points"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"), *more)


def _featured(batch: pa.RecordBatch, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    part = batch.slice(first, count)
    x = np.stack([text_view(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column(1)])
    m = np.stack([meta_view(*row) for row in zip(*(part.column(k).to_pylist() for k in (2, 3, 4, 5)))])
    return x, m


def _features(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            x, m = _featured(batch, first, 256)
            quality = batch.column(6).slice(first, len(x))
            rows = [r.tobytes() for r in np.c_[x, m].astype("<f4")]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), quality, pa.array(rows, pa.binary())], names=["doc_id", "quality", "features"])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained | None:
    """The classifier learnt from labels (doc_id, quality 0 or 1); None if they don't have both classes.

    The sample is the labelled, and the unlabelled, documents whose ids hash lowest, in equal
    parts of both classes where there are enough. A doc_id with labels of both classes teaches
    nothing, and neither do rows without a doc_id; of rows that repeat one, the one of the
    smallest features is learnt from. Empty tables give None.
    """
    ready(docs.sparkSession)
    turn = F.xxhash64("doc_id", F.lit("quality"))
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    chosen = [known.filter(F.col("quality") == q).select("doc_id", "quality", turn.alias("t")).orderBy("t", "doc_id").limit(labelled // 2) for q in (0, 1)]
    other = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("quality"), turn.alias("t")).orderBy("t", "doc_id").limit(pool)
    # at most labelled + pool rows of three numbers
    sample = F.broadcast(chosen[0].unionByName(chosen[1]).unionByName(other))
    rows = _inputs(docs).join(sample, "doc_id").select(*COLUMNS, "quality").mapInArrow(_features, "doc_id long, quality int, features binary")
    got = rows.groupBy("doc_id", "quality").agg(F.min("features").alias("features")).orderBy("doc_id").toArrow()
    if not got.num_rows:
        return None
    values = np.stack([np.frombuffer(b, "<f4") for b in got.column("features").to_pylist()]).astype(np.float64)
    order = np.array([hashlib.blake2b(b"%d" % d, digest_size=8).digest() for d in got.column("doc_id").to_pylist()]).argsort(kind="stable")
    values, quality = values[order], np.array([-1 if q is None else q for q in got.column("quality").to_pylist()])[order]
    have = quality >= 0
    if len(set(quality[have])) < 2:
        return None
    split = BIGRAMS + TRAITS
    return co_train(values[have, :split], values[have, split:], quality[have].astype(float), values[~have, :split], values[~have, split:])


def _scored(model: CoTrained | None):
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                x, m = _featured(batch, first, 256)
                both, text, meta = model.score(x, m) if model is not None else (np.ones(len(x)),) * 3
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), pa.array(text), pa.array(meta), pa.array(both), pa.array(both >= THRESHOLD)], names=["doc_id", "text_score", "meta_score", "score", "accepted"])

    return run


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (0 to 1), accepted.

    A null text counts as empty, a null language or source as a value of its own. Without labels
    of both classes nothing can be told: every document has score 1 and is accepted. Each row is
    scored by its own columns, so rows that repeat a doc_id or have none need no rule; equal rows
    have equal scores. Whole texts are read, a stretch at a time. An empty table gives an empty
    result, and columns other than doc_id, text, lang and source are not read.
    """
    ready(docs.sparkSession)
    return _inputs(docs).mapInArrow(_scored(model), "doc_id long, text_score double, meta_score double, score double, accepted boolean")


def accepted(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """The rows of docs, with their columns, that the classifier accepts, in one pass over the texts.

    Each text goes to Python once, as the column of docs that comes back.
    """
    ready(docs.sparkSession)
    names = docs.columns
    views = ("lang", "source", "points", "lines")

    def run(batches):
        for batch in batches:
            text = batch.column(len(views) + at)
            seen = pa.RecordBatch.from_arrays([text, text, *batch.columns[: len(views)]], names=COLUMNS)
            for first in range(0, batch.num_rows, 256):
                x, m = _featured(seen, first, 256)
                keep = model.score(x, m)[0] >= THRESHOLD if model is not None else np.ones(len(x), bool)
                part = batch.slice(first, len(x)).filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(part.columns[len(views) :], names=names)

    at = [c.lower() for c in names].index("text")
    wide = _inputs(docs, [F.col(c).alias(f"own_{k}_") for k, c in enumerate(names)])
    return wide.drop("doc_id", "text").mapInArrow(run, docs.schema)
