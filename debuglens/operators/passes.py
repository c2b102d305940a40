"""Whole-table passes over symbols: hashes, duplicates, gaps and islands, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debuglens.session import by_key

WORD = 1 << 32


def opcode_hash(stream: DataFrame, key: str, order: str, opcode: str, block: int = 4096) -> DataFrame:
    """(key, hash): h = h * 31 + opcode modulo 2**32 over each key's opcodes in order.

    Blocks of a key's order carry (hash, 31**n) and combine, so a long function isn't one list.
    """
    blocks = stream.withColumn("block_", F.floor(F.col(order) / block))
    step = F.transform(F.array_sort(F.collect_list(F.struct(order, opcode))), lambda s: s[opcode])
    zero = F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("p"))
    mask = F.lit(WORD - 1)
    part = F.aggregate(step, zero, lambda a, x: F.struct((a["h"] * 31 + x).bitwiseAND(mask).alias("h"), (a["p"] * 31).bitwiseAND(mask).alias("p")))
    parts = blocks.groupBy(key, "block_").agg(part.alias("s"))
    # both factors are below 2**32: the product is taken in two halves to stay below 2**63
    times = lambda a, b: (F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(mask), 16) + a * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(mask)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("block_", "s"))), lambda r: r["s"])
    return parts.groupBy(key).agg(F.aggregate(rows, F.lit(0).cast("long"), lambda h, r: (times(h, r["p"]) + r["h"]).bitwiseAND(mask)).alias("hash"))


def functions_match(functions: DataFrame) -> DataFrame:
    """(source_file, matches): at least as many hashes match as differ, rows without both hashes aside."""
    both = (F.col("current_hash") != 0) & (F.col("original_hash") != 0)
    same = F.count_if(both & (F.col("current_hash") == F.col("original_hash")))
    other = F.count_if(both & (F.col("current_hash") != F.col("original_hash")))
    return functions.groupBy("source_file").agg((same >= other).alias("matches"))


def fake_functions(functions: DataFrame, externals: DataFrame) -> DataFrame:
    """Functions with the address of fakes taken away.

    Where several functions start at an address, those of the group that the external symbol of
    that address doesn't name lose it; if none is named and all are of the group, the last keeps it.
    functions: handle, address, name, in_group; externals: address, name.
    """
    rows = functions.join(externals.withColumnRenamed("name", "external_"), "address", "left")
    here = Window.partitionBy("address")
    match = F.coalesce(F.col("external_") == F.col("name"), F.lit(False))
    named = rows.withColumn("match_", match).withColumn("n_", F.count("*").over(here)).withColumn("keep_", F.max(F.col("match_") | ~F.col("in_group")).over(here))
    last = F.row_number().over(Window.partitionBy("address", "in_group").orderBy(F.desc("handle")))
    fake = F.col("address").isNotNull() & (F.col("n_") > 1) & F.col("in_group") & ~F.col("match_") & (F.col("keep_") | (F.col("last_") > 1))
    return named.withColumn("last_", last).withColumn("address", F.when(~fake, F.col("address"))).drop("external_", "match_", "n_", "keep_", "last_")


def duplicate_functions(functions: DataFrame, source_files: DataFrame) -> DataFrame:
    """Functions with the address of duplicates taken away: the first in-group row of an (address, name) keeps it.

    Nothing changes at addresses with no source file below them.
    """
    least = source_files.agg(F.min("address").alias("least_"))
    order = F.row_number().over(Window.partitionBy("address", "name", "in_group").orderBy("handle"))
    rows = functions.withColumn("rn_", order).crossJoin(F.broadcast(least))  # one row
    gone = F.col("in_group") & (F.col("rn_") > 1) & (F.col("address") > F.col("least_"))
    return rows.withColumn("address", F.when(~F.coalesce(gone, F.lit(False)), F.col("address"))).drop("rn_", "least_")


def symbols_not_yet_there(symbols: DataFrame, earlier: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Symbols whose address no earlier function or variable starts at, nor an earlier creating row of the same table.

    symbols: idx, address, creates (whether the row makes a function or a variable). Addresses
    are those of a group, such as a module.
    """
    place = [*group, "address"]
    fresh = symbols.join(by_key(earlier.select(place).distinct()), place, "left_anti")
    first = F.min(F.when(F.col("creates"), F.col("idx"))).over(Window.partitionBy(place))
    return fresh.withColumn("first_", first).filter(F.col("first_").isNull() | (F.col("idx") <= F.col("first_"))).drop("first_")


def islands(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Adds island, the number of changes of value before the row; rows of one island follow each other."""
    w = Window.partitionBy(*group).orderBy(order)
    changed = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")
    return rows.withColumn("changed_", changed).withColumn("island", F.sum("changed_").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("changed_")


def breaks(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Adds is_break: whether value differs from the row before, the first row being one."""
    return rows.withColumn("is_break", ~F.lag(value).over(Window.partitionBy(*group).orderBy(order)).eqNullSafe(F.col(value)) | (F.row_number().over(Window.partitionBy(*group).orderBy(order)) == 1))


def continued(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, seg, text): strings that end in a backslash are joined with what follows."""
    w = Window.partitionBy(group).orderBy(order)
    starts = F.coalesce(~F.lag(F.endswith(F.col(text), F.lit("\\"))).over(w), F.lit(True))
    segs = lines.withColumn("seg", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bare = F.when(F.endswith(F.col(text), F.lit("\\")), F.expr(f"left({text}, length({text}) - 1)")).otherwise(F.col(text))
    return segs.groupBy(group, "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), bare.alias("t")))), lambda s: s["t"]), "").alias("text"))


def last_of(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """(key, value) of each key's last row in order: later rows replace earlier ones."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def first_of(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min_by(value, order).alias(value))


def route_elf_symbol(kind: Column, size: Column) -> Column:
    """Where a symbol of an ELF symbol table goes by its type number: label, global, function, file, or nowhere."""
    return F.when(kind == 0, "label").when((kind == 1) & (size != 0), "global").when(kind == 1, "label").when(kind == 2, "function").when(kind == 4, "file")


def resolve_type_names(references: DataFrame, numbers: DataFrame, types: DataFrame) -> DataFrame:
    """References (ref, file, number, name, is_this) with tier and target.

    First by the file's type number, then the group's first type of that name; an unnamed this
    stays unresolved, and what is left becomes a new forward-declared type, named by target_name.
    """
    by_number = numbers.withColumnRenamed("handle", "n_")
    by_name_ = types.groupBy("name").agg(F.min("handle").alias("m_"))
    rows = references.join(by_number, ["file", "number"], "left").join(by_name_, "name", "left")
    tier = F.when(F.col("n_").isNotNull(), 1).when(F.col("m_").isNotNull(), 2).when(F.col("is_this"), 3).otherwise(4)
    return rows.withColumn("tier", tier).withColumn("target", F.coalesce("n_", "m_")).drop("n_", "m_")


def capped_warnings(rows: DataFrame, key: str, order: str, most: int = 10) -> DataFrame:
    """At most the first ten rows of each key."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("rn_") <= most).drop("rn_")


def best_file(counts: DataFrame) -> DataFrame:
    """(type, file, n): the candidate file with most references, ties to the first candidate, only if any."""
    w = Window.partitionBy("type").orderBy(F.desc("n"), "pos")
    return counts.filter("n > 0").withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").select("type", "file", "n")
