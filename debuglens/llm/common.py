"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from debuglens.session import cut, ready, table

__all__ = ["BROADCAST_ROWS", "NO_ID", "attach", "cut", "documents", "parts", "ready", "table", "text_bytes", "text_digest"]

#: Stands for a missing doc_id inside operators.
NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(name: str = "text") -> Column:
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary")).alias(name)


def text_digest(name: str = "text") -> Column:
    """A number that tells the rows of one doc_id apart by their text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))


#: A counted id table of at most this many numbers (about 16 bytes each) may be broadcast.
BROADCAST_ROWS = 1_000_000


#: Slots of a sieve: 16 MB of bits, whatever the number of ids is.
SLOTS = 1 << 27


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sieved(docs: DataFrame, ids: DataFrame, on: str, mark: str) -> DataFrame:
    """docs with the column mark, true for each row whose id is in ids and for few others.

    Ids are hashed into a bitmap of fixed size, kept in rows of 4 KB and broadcast: its bound
    doesn't depend on the number of ids. With more ids than slots it lets all rows through.
    """
    bucket, bit, bitmap = (fresh(docs, n) for n in ("bucket_", "bit_", "map_"))
    slot = F.pmod(F.xxhash64(on, F.lit("sieve")), F.lit(SLOTS))
    bits = ids.select(F.shiftright(slot, 15).alias(bucket), slot.bitwiseAND(F.lit(32767)).alias(bit))
    maps = bits.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias(bitmap))
    placed = docs.withColumn(bucket, F.shiftright(slot, 15)).withColumn(bit, slot.bitwiseAND(F.lit(32767)).cast("int"))
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    test = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col(bit).bitwiseAND(F.lit(7)))) != 0
    return placed.join(F.broadcast(maps), bucket, "left").withColumn(mark, F.coalesce(test, F.lit(False))).drop(bucket, bit, bitmap)


def attach(docs: DataFrame, ids: DataFrame, on: str, how: str = "inner", weight: Column | None = None, small: bool = True) -> DataFrame:
    """docs joined (inner, left or left_anti) with ids, a table that has each id once.

    weight counts the numbers in a row of ids, 1 if not given. If small, and the counted numbers
    fit the bound, ids is broadcast. Otherwise a sieve picks the rows that may have a partner,
    and only these are shuffled.
    """
    ids = cut(ids)
    if small and (ids.agg(F.sum(F.lit(1) if weight is None else weight + 1)).first()[0] or 0) <= BROADCAST_ROWS:
        return docs.join(F.broadcast(ids), on, how)
    mark = fresh(docs, "maybe_")
    told = sieved(docs, ids, on, mark)
    met = told.filter(F.col(mark)).drop(mark).join(ids.hint("merge"), on, how)
    if how == "inner":
        return met
    return met.unionByName(told.filter(~F.col(mark)).drop(mark), allowMissingColumns=True)


def by_row(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """docs joined with rows (doc_id, digest, ...) by doc_id, null or not, and text."""
    key, text = fresh(docs, "row_id_"), fresh(docs, "row_digest_")
    sought = rows.withColumn(key, F.coalesce("doc_id", F.lit(NO_ID))).withColumnRenamed("digest", text).drop("doc_id")
    marked = docs.withColumn(key, F.coalesce("doc_id", F.lit(NO_ID))).withColumn(text, text_digest())
    return marked.join(sought, [key, text], how).drop(key, text)


def plain_ids(rows: DataFrame) -> bool:
    """Whether each row has a doc_id and no other row has the same."""
    return rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows that rows (doc_id, digest, kept) doesn't keep; of rows that repeat a doc_id and a text, one stays.

    Where doc_ids are unique only the dropped ones are joined; otherwise rows are told apart by
    their texts too.
    """
    rows = cut(rows.select("doc_id", "digest", "kept"))
    if plain_ids(rows):
        return attach(docs, rows.filter("NOT kept").select("doc_id"), "doc_id", "left_anti")
    key, text = fresh(docs, "one_id_"), fresh(docs, "one_digest_")
    stay = by_row(docs, rows.filter("kept").select("doc_id", "digest").distinct())
    return stay.withColumn(key, F.col("doc_id")).withColumn(text, text_digest()).dropDuplicates([key, text]).select(*docs.columns)
