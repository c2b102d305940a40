"""Index lookups over symbol tables as set-oriented joins.

A symbol table has at least handle, address (null: none), size and name. A probe table has its
own columns and one to look up. Point-in-interval and nearest lookups are rewritten into joins of
disjoint intervals: intervals are dealt into address buckets whose width follows the density of
the intervals, so the join is an equi-join on the bucket with a range filter, without a global
sort of the probes and without a cross join.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debuglens.session import by_key, cut

#: Addresses are unsigned 32-bit numbers.
TOP = 1 << 32


def numbered(rows: DataFrame, *order: str, name: str = "handle") -> DataFrame:
    """Adds name, 0 to n - 1 in global order: a range sort, then each partition's place behind those before it."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # a number for each partition
    counts = dict(placed.groupBy("part_").count().collect())
    before = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0)))]
    return placed.withColumn(name, F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("part_") + 1) + F.col("at_")).drop("part_", "at_")


def by_handle(probes: DataFrame, symbols: DataFrame, handle: str) -> DataFrame:
    """Probes with the symbol whose handle they hold; a handle of no symbol drops out."""
    return probes.join(symbols, probes[handle] == symbols["handle"])


def by_handle_list(lists: DataFrame, symbols: DataFrame, handles: str, position: str = "pos") -> DataFrame:
    """A row for each listed handle that exists, with its position; a null list gives none."""
    listed = lists.select("*", F.posexplode_outer(handles).alias(position, "handle")).drop(handles)
    return listed.join(symbols, "handle")


def starting_at(probes: DataFrame, symbols: DataFrame, address: str) -> DataFrame:
    """All symbols that start at the probed address."""
    return probes.join(symbols, probes[address] == symbols["address"])


def first_starting_at(symbols: DataFrame) -> DataFrame:
    """(address, handle): the first linked symbol of each address."""
    return symbols.filter("address IS NOT NULL").groupBy("address").agg(F.min("handle").alias("handle"))


def by_name(symbols: DataFrame) -> DataFrame:
    """(name, n, first_handle) of each name."""
    return symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("handle").alias("first_handle"))


#: Buckets that an interval may touch at its level.
TOUCHED = 64
#: Intervals that are broadcast; more are dealt out with their probes.
FEW = 1 << 10
#: Symbols that ranges meet at once, and ranges that such a chunk meets in one place.
CHUNK, RANGES = 1 << 10, 1 << 12


def _width(intervals: DataFrame) -> tuple[int, int, int]:
    """The width of the finest buckets, the level of the coarsest that are needed, and the number of intervals."""
    low, high, n, longest = intervals.agg(F.min("lo_"), F.max("hi_"), F.count("*"), F.max(F.col("hi_") - F.col("lo_"))).first()
    if not n:
        return 1, 0, 0
    width, top = max(1, 4 * (high - low) // n), 0
    while longest > width * TOUCHED ** (top + 1):
        top += 1
    return width, top, n


def interval_join(probes: DataFrame, intervals: DataFrame, at: str, how: str = "inner") -> DataFrame:
    """Probes joined with the intervals [lo_, hi_) that contain their value of at.

    An interval goes to the buckets it touches, about five for each four intervals if they are
    disjoint. Intervals that touch more than TOUCHED go to buckets TOUCHED times as wide, and so
    on; where there are such, a probe is sought once at each level. A few intervals are sent to
    the probes, however many of these there are: their buckets are too few to deal out.
    """
    finest, top, n = _width(intervals)
    sent = F.broadcast if n <= FEW else by_key
    full = intervals.filter("lo_ < hi_")
    if not top:
        width = F.lit(finest).cast("long")
        dealt = full.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("lo_") / width), F.floor((F.col("hi_") - 1) / width))))
        sought = probes.withColumn("bucket_", F.floor(F.col(at) / width))
        on = (sought["bucket_"] == dealt["bucket_"]) & (sought[at] >= dealt["lo_"]) & (sought[at] < dealt["hi_"])
        return sought.join(sent(dealt), on, how).drop("bucket_", "lo_", "hi_")
    span, level = F.col("hi_") - F.col("lo_"), F.lit(top)
    for k in reversed(range(top)):
        level = F.when(span <= finest * TOUCHED ** (k + 1), k).otherwise(level)
    widths = F.array(*[F.lit(finest * TOUCHED**k).cast("long") for k in range(top + 1)])
    placed = full.withColumn("level_", level).withColumn("width_", F.get(widths, F.col("level_")))
    dealt = placed.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("lo_") / F.col("width_")), F.floor((F.col("hi_") - 1) / F.col("width_"))))).drop("width_")
    levels = F.array(*[F.struct(F.lit(k).alias("level_"), F.floor(F.col(at) / F.lit(finest * TOUCHED**k).cast("long")).alias("bucket_")) for k in range(top + 1)])
    sought = probes.withColumn("place_", F.explode(levels)).select(*probes.columns, "place_.level_", "place_.bucket_")
    on = (sought["level_"] == dealt["level_"]) & (sought["bucket_"] == dealt["bucket_"]) & (sought[at] >= dealt["lo_"]) & (sought[at] < dealt["hi_"])
    found = sought.join(sent(dealt), on).drop("level_", "bucket_", "lo_", "hi_")
    if how == "inner":
        return found
    # a probe stands in several rows: those that no level has an interval for come back once
    key = [c for c in probes.columns]
    alone = probes.alias("p").join(found.select(*[F.col(c).alias(f"f_{k}") for k, c in enumerate(key)]).distinct(), [F.col(f"p.`{c}`").eqNullSafe(F.col(f"f_{k}")) for k, c in enumerate(key)], "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def with_next(symbols: DataFrame, group: list[str] | None = None, width: int = 1 << 16) -> DataFrame:
    """Adds next_start, the start of the symbol after it in order of (address, handle).

    The window runs inside address buckets; a bucket's last symbol takes the least address of
    the next bucket that has any, from a table with one row per bucket.
    """
    group = group or []
    placed = symbols.filter("address IS NOT NULL").withColumn("bucket_", F.floor(F.col("address") / width))
    inside = Window.partitionBy(*group, "bucket_").orderBy("address", "handle")
    buckets = placed.groupBy(*group, "bucket_").agg(F.min("address").alias("low_"))
    follows = buckets.select(*group, "bucket_", F.lead("low_").over(Window.partitionBy(*group).orderBy("bucket_")).alias("after_"))
    joined = placed.withColumn("lead_", F.lead("address").over(inside)).join(by_key(follows), [*group, "bucket_"])
    return joined.withColumn("next_start", F.coalesce("lead_", "after_")).drop("bucket_", "lead_", "after_")


def overlapping(probes: DataFrame, symbols: DataFrame, address: str, how: str = "left") -> DataFrame:
    """The symbol of the greatest start at or below the address, if it reaches over it.

    Only the nearest start counts: [address, min(end, next start)) are disjoint, and of equal
    starts the last linked one has an interval that is not empty.
    """
    ends = with_next(symbols)
    intervals = ends.withColumn("lo_", F.col("address")).withColumn("hi_", F.least(F.col("address") + F.col("size"), F.coalesce("next_start", F.lit(TOP))))
    return interval_join(probes, intervals.drop("next_start"), address, how)


def after(probes: DataFrame, symbols: DataFrame, address: str, how: str = "left") -> DataFrame:
    """The first linked symbol of the least start above the address."""
    firsts = first_starting_at(symbols)
    starts = with_next(firsts)
    least = starts.agg(F.min("address")).first()[0]
    shifted = starts.select(F.col("next_start").alias("start_"), F.col("address").alias("lo_"), F.col("next_start").alias("hi_")).filter("hi_ IS NOT NULL")
    if least is not None:
        first = starts.sparkSession.range(1).select(F.lit(least).cast("long").alias("start_"), F.lit(0).cast("long").alias("lo_"), F.lit(least).cast("long").alias("hi_"))
        shifted = shifted.unionByName(first)
    named = shifted.join(firsts.withColumnRenamed("address", "start_"), "start_").withColumnRenamed("start_", "address")
    return interval_join(probes, named, address, how)


def in_ranges(ranges: DataFrame, symbols: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Symbols in half-open address ranges; a null end is open, two null ends are empty.

    Symbols in order of address are cut into chunks of CHUNK, and a range meets those between the
    ones that its ends fall into, so rows that come together are few even where the result is
    the square of the tables. Partitions follow the number of these meetings; a chunk that more
    than RANGES ranges meet on average stands in several of them.
    """
    at = numbered(symbols.filter("address IS NOT NULL"), "address", name="nth_").withColumn("chunk_", F.floor(F.col("nth_") / CHUNK))
    chunks = at.groupBy("chunk_").agg(F.min("address").alias("first_"), F.max("address").alias("last_"), F.collect_list(F.struct(*symbols.columns)).alias("symbols_"))
    edges = cut(chunks.select("chunk_", "first_", "last_"))
    n, least, most = edges.agg(F.count("*"), F.min("first_"), F.max("last_")).first()
    bounded = ranges.filter(F.col(low).isNotNull() | F.col(high).isNotNull())
    begin = F.greatest(F.coalesce(F.col(low), F.lit(least)), F.lit(least)).cast("long")
    end = F.least(F.coalesce(F.col(high) - 1, F.lit(most)), F.lit(most)).cast("long")
    sought = bounded.withColumn("begin_", begin).withColumn("end_", end).filter("begin_ <= end_")
    # the first chunk that ends at or after the beginning, and the last one that starts at or before the end
    order = Window.orderBy("chunk_")
    ending = edges.select(F.col("chunk_").alias("from_"), F.coalesce(F.lag("last_").over(order) + 1, F.col("first_")).alias("lo_"), (F.col("last_") + 1).alias("hi_"))
    starting = edges.select(F.col("chunk_").alias("to_"), F.col("first_").alias("lo_"), F.coalesce(F.lead("first_").over(order), F.lit(most) + 1).alias("hi_"))
    found = cut(interval_join(interval_join(sought, ending, "begin_"), starting, "end_").drop("begin_", "end_"))
    met = found.agg(F.sum(F.col("to_") - F.col("from_") + 1)).first()[0] or 0
    copies = max(1, met // (RANGES * max(n, 1)))
    parts = max(1, min(n * copies, 20_000))
    pairs = found.withColumn("chunk_", F.explode(F.sequence("from_", "to_"))).withColumn("copy_", F.pmod(F.xxhash64(*ranges.columns), F.lit(copies)).cast("int")).drop("from_", "to_")
    dealt = chunks.select("chunk_", "symbols_", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy_"))
    joined = pairs.repartition(parts, "chunk_", "copy_").join(by_key(dealt.repartition(parts, "chunk_", "copy_")), ["chunk_", "copy_"])
    each = joined.select(*ranges.columns, F.explode("symbols_").alias("symbol_"))
    inside = (F.col(low).isNull() | (F.col("symbol_.address") >= F.col(low))) & (F.col(high).isNull() | (F.col("symbol_.address") < F.col(high)))
    return each.filter(inside).select("symbol_.*", *ranges.columns)


def union_of(kinds: dict[str, DataFrame]) -> DataFrame:
    """One table of several symbol lists with kind and kind_rank, the order in which kinds are searched."""
    parts = [df.select(F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"), "handle", "address", "size", "name") for rank, (kind, df) in enumerate(kinds.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def kind_starting_at(kinds: dict[str, DataFrame]) -> DataFrame:
    """(address, kind, handle): of the kinds at an address the first one's first symbol."""
    best = F.min(F.struct("kind_rank", "handle", "kind"))
    return union_of(kinds).filter("address IS NOT NULL").groupBy("address").agg(best.alias("b")).select("address", "b.kind", "b.handle")


def kind_with_name(kinds: dict[str, DataFrame]) -> DataFrame:
    """(name, kind, handle): the first kind that has the name."""
    best = F.min(F.struct("kind_rank", "handle", "kind"))
    return union_of(kinds).groupBy("name").agg(best.alias("b")).select("name", "b.kind", "b.handle")


def kind_after(probes: DataFrame, kinds: dict[str, DataFrame], address: str) -> DataFrame:
    """The kind and handle of the least start above the address; ties go to the earlier kind."""
    firsts = kind_starting_at(kinds)
    found = after(probes, union_of(kinds).select(F.col("handle"), "address"), address)
    return found.drop("handle").join(firsts, "address", "left")


def kind_overlapping(probes: DataFrame, kinds: dict[str, DataFrame], address: str, key: list[str]) -> DataFrame:
    """The first kind, in search order, whose list has an overlapping symbol."""
    ends = with_next(union_of(kinds), ["kind_rank"])
    intervals = ends.select("kind_rank", "kind", "handle", F.col("address").alias("lo_"), F.least(F.col("address") + F.col("size"), F.coalesce("next_start", F.lit(TOP))).alias("hi_"))
    hits = interval_join(probes.select(*key, address), intervals, address)
    return hits.groupBy(*key).agg(F.min(F.struct("kind_rank", "kind", "handle")).alias("hit")).select(*key, "hit.kind", "hit.handle")


def dense_index(symbols: DataFrame, handle: str = "handle", buckets: int = 1 << 12) -> DataFrame:
    """Adds idx, the number of symbols with a smaller handle, in two levels of counts."""
    wide = symbols.withColumn("bucket_", F.floor(F.col(handle) / buckets))
    counts = wide.groupBy("bucket_").agg(F.count("*").alias("n_"))
    before = counts.select("bucket_", (F.sum("n_").over(Window.orderBy("bucket_")) - F.col("n_")).alias("before_"))
    inner = F.row_number().over(Window.partitionBy("bucket_").orderBy(handle)) - 1
    return wide.withColumn("in_", inner).join(by_key(before), "bucket_").withColumn("idx", F.col("before_") + F.col("in_")).drop("bucket_", "in_", "before_")


def contained(points: DataFrame, ranges: DataFrame, at: str, low: Column, high: Column) -> DataFrame:
    """Every pair of a point and a half-open range that contains it; ranges may overlap."""
    return interval_join(points, ranges.withColumn("lo_", low).withColumn("hi_", high), at)
