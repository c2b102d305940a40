"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in shuffled order (the MD5 of the id), served twice over
at most. A document's virtual start and finish are the words its source has queued before it and
up to its end, divided by the source's target. All queues together have served the total budget
when the virtual clock reads 1, because the targets add up to the budget. The mix is the
documents in globally range-sorted order of virtual finish, truncated there: what starts before
the budget is used up is taken, and the document in service at that moment gives its leading
words only.

The running sum inside a source is taken in two levels (hash buckets of a source, then rows of a
bucket), so a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debuglens.llm.common import attach, by_row, cut, fresh, plain_ids, text_digest

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
#: A document may be taken this many times.
REPEATS = 2


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source, source_size), a row per source.

    Sources by code point, null last, take the weights in turn. Targets fill up like water: a
    source's share of the budget by weight, never above REPEATS times its size, and what a full
    source can't take is shared by the others. The table has a row per source, so its windows
    are small whatever the number of documents is.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), n + 1)).withColumn("cap", F.col("source_size") * F.lit(float(REPEATS)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total * F.lit(budget) - before) / left
    leveled = weighed.withColumn("level", level)
    water = F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(Window.partitionBy())
    return leveled.withColumn("water", water).select("source_key", "source_size", F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def _queued(docs: DataFrame, weights, budget: float) -> DataFrame:
    """A row per document with the words that its source has queued before it: doc_id, digest, size, source_size, target, start."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    sized = cut(
        docs.select(
            "doc_id",
            text_digest().alias("digest"),
            F.col("source").cast("string").alias("source"),
            key.alias("source_key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("turn"),
        ).withColumn("bucket", F.substring("turn", 1, 3))
    )
    buckets = cut(sized.groupBy("source_key", "source", "bucket").agg(F.sum("size").alias("words")))
    aims = targets(buckets.groupBy("source_key", "source").agg(F.sum("words").alias("source_size")), weights, budget)
    earlier = F.coalesce(F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = buckets.select("source_key", "bucket", earlier.alias("before")).join(aims, "source_key")
    queue = Window.partitionBy("source_key", "bucket").orderBy("turn", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("size").over(queue) - F.col("size")
    return sized.join(offsets, ["source_key", "bucket"]).withColumn("start", start).select("doc_id", "digest", "size", "source_size", "target", "start")


def _words(lap: int) -> Column:
    """The words of a document that the mix takes in a lap of its source's queue: those served before the virtual clock reads 1."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target") + 0.5) - F.col("start") - F.col("source_size") * lap)).cast("long")


def shares(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the virtual times of its first lap.

    ``size`` is the number of words, 0 for a null text; documents of size 0 are taken 0 times. A
    null source is a source of its own. Ties in the shuffled order, which are rows that repeat a
    doc_id or have none, go by size and text; each has a row of its own. An empty table gives an
    empty result; columns other than doc_id, text and source are not read.
    """
    taken = sum((_words(lap) for lap in range(1, REPEATS)), _words(0))
    return _queued(docs, weights, budget).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.try_divide(F.col("start"), "target").alias("virtual_start"), F.try_divide(F.col("start") + F.col("size"), "target").alias("virtual_finish"))


def mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """The mix itself, with the columns of docs, in global order of virtual finish: a document as often as the mix takes it.

    Each lap of a document has its own virtual finish, (lap * source size + words up to its end)
    / target; the mix is range-sorted by it and ends where the budget is used up. Rows are whole
    documents: the one whose service the budget cuts short stays in that lap if at least half of
    its words are taken. Documents of no words can't be taken. Rows that repeat a doc_id and a
    text are alike to the mix: each is taken as often as the first of them.
    """
    laps = F.array(*[F.when(2 * _words(lap) >= F.col("size"), (F.col("start") + F.col("source_size") * lap + F.col("size")) / F.col("target")) for lap in range(REPEATS)])
    queued = _queued(docs, weights, budget).filter("size > 0").select("doc_id", "digest", F.filter(laps, lambda x: x.isNotNull()).alias("finishes"))
    told = cut(queued)
    finish = fresh(docs, "finishes")
    taken = told.filter(F.size("finishes") > 0).withColumnRenamed("finishes", finish)
    if plain_ids(told):
        times = attach(docs, taken.drop("digest"), "doc_id", "inner", F.lit(2 + REPEATS))
    else:
        times = by_row(docs, taken.groupBy("doc_id", "digest").agg(F.max_by(finish, F.struct(F.size(finish), F.array_min(finish))).alias(finish)))
    one = fresh(docs, "virtual_finish_")
    served = times.withColumn(one, F.explode(finish))
    return served.repartitionByRange(F.col(one), F.col("doc_id")).sortWithinPartitions(one, "doc_id").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS weight FROM s
), f AS (
  SELECT *, 2 * source_size AS cap, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, coalesce(least(cap, max(CASE WHEN level * weight < cap THEN level END) OVER () * weight), cap) AS target FROM f
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target,
  CAST(greatest(0, least(size, floor(target + 0.5) - start)) + greatest(0, least(size, floor(target + 0.5) - start - source_size)) AS BIGINT) AS taken
FROM q
"""
