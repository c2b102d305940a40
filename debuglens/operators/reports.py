"""Reports as tables of lines in order; a sink only has to write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debuglens.functions import columns as C
from debuglens.operators.lookup import dense_index

JSON_FORMAT, JSON_VERSION = "Symbol Database", 15


def symbol_json(symbols: DataFrame, more: list[Column] = ()) -> DataFrame:
    """(handle, json): empty names, null addresses and zero sizes are left out."""
    fields = [F.nullif("name", F.lit("")).alias("name"), F.col("address"), F.nullif(F.col("size"), F.lit(0)).alias("size"), *more]
    return symbols.select("handle", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def document_lines(lists: dict[str, DataFrame], application: str) -> DataFrame:
    """(part, ord, line) of one JSON document of all lists, a line for each symbol; sort by part and ord to write it."""
    spark = next(iter(lists.values())).sparkSession
    head = f'{{"format":"{JSON_FORMAT}","version":{JSON_VERSION},"application":"{application}"'
    out = spark.createDataFrame([(0, 0, head), (2 * len(lists) + 2, 0, "}")], "part int, ord long, line string")
    for k, (name, rows) in enumerate(lists.items()):
        most = rows.agg(F.max("handle").alias("most_"))
        body = rows.join(F.broadcast(most)).select(F.lit(2 * k + 2).alias("part"), F.col("handle").alias("ord"), F.concat("json", F.when(F.col("handle") < F.col("most_"), ",").otherwise("")).alias("line"))
        edge = spark.createDataFrame([(2 * k + 1, 0, f'{"]" if k else ""},"{name}":[')], "part int, ord long, line string")
        out = out.unionByName(edge).unionByName(body)
    return out.unionByName(spark.createDataFrame([(2 * len(lists) + 1, 0, "]")], "part int, ord long, line string"))


def dot_lines(nodes: DataFrame, edges: DataFrame, name: str = "type_dependencies") -> DataFrame:
    """(part, line) of a directed graph of nodes (id, label) and edges (src, dst) between them."""
    spark = nodes.sparkSession
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\\\\\])', r"\\$1"), F.lit('"'))
    head = spark.createDataFrame([(0, f"digraph {name} {{"), (3, "}")], "part int, line string")
    node = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("\t"), F.col("id").cast("string"), F.lit(" [label="), quote(F.col("label")), F.lit("]")).alias("line"))
    known = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    edge = known.select(F.lit(2).alias("part"), F.concat(F.lit("\t"), F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"), F.lit(";")).alias("line"))
    return head.unionByName(node).unionByName(edge)


def _place() -> Column:
    """An address of eight digits; none has all bits set."""
    return C.hex8(F.coalesce("address", F.lit(C.MASK32)))


def label_lines(symbols: DataFrame) -> DataFrame:
    return symbols.select("handle", F.concat(_place(), F.lit(" "), "name").alias("line"))


def file_lines(files: DataFrame) -> DataFrame:
    """(handle, line) of source files: address and path."""
    return label_lines(files)


def section_lines(sections: DataFrame) -> DataFrame:
    """(handle, line) of sections: address, size and name."""
    return sections.select("handle", F.concat(_place(), F.lit(" "), C.hex8(F.coalesce("size", F.lit(0))), F.lit(" "), "name").alias("line"))


def include_lines(includes: DataFrame, path: str) -> DataFrame:
    """(path, line) of the distinct included files; sort by path to write them."""
    return includes.filter(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct().select("path", F.concat(F.lit('#include "'), "path", F.lit('"')).alias("line"))


def elf_lines(symbols: DataFrame) -> DataFrame:
    """Rows of ELF symbol tables as lines in columns: value, size, type, binding, visibility, name."""
    kind = C.lookup({0: "NOTYPE", 1: "OBJECT", 2: "FUNC", 3: "SECTION", 4: "FILE"}, F.col("type").cast("int"))
    bind = C.lookup({0: "LOCAL", 1: "GLOBAL", 2: "WEAK"}, F.col("bind").cast("int"))
    shown = C.lookup({0: "DEFAULT", 1: "INTERNAL", 2: "HIDDEN", 3: "PROTECTED"}, F.col("visibility").cast("int"))
    return symbols.withColumn("line", F.format_string("%08x %8d %-8s%-8s%-10s%s", "value", "size", F.coalesce(kind, F.lit("?")), F.coalesce(bind, F.lit("?")), F.coalesce(shown, F.lit("?")), "name"))


def sndll_lines(symbols: DataFrame) -> DataFrame:
    """Rows of SNDLL tables as lines: type, value, name."""
    kind = C.lookup({0: "NIL", 1: "EXTERNAL", 2: "RELATIVE", 3: "WEAK", 4: "ABSOLUTE"}, F.col("type").cast("int"))
    return symbols.withColumn("line", F.format_string("%8s %08x %s", F.coalesce(kind, F.col("type").cast("string")), "value", F.coalesce("string", F.lit(""))))


def mdebug_lines(symbols: DataFrame) -> DataFrame:
    """Local symbols of .mdebug sections as lines: value, type, class, index, and the stabs code of those that have one."""
    code = C.stabs_code(F.col("index"))
    mark = F.coalesce(F.concat(F.lit("stab "), F.hex(code)), F.concat(F.lit("index "), F.col("index").cast("string")))
    return symbols.withColumn("line", F.format_string("%08x %2d %2d %-14s%s", "value", "symbol_type", "symbol_class", mark, "string"))


def dwarf_lines(entries: DataFrame, attrs: DataFrame, key: str) -> DataFrame:
    """(key, die, seq, line): an entry's line, indented by its depth, then a line for each attribute."""
    tabs = lambda extra: F.repeat(F.lit("\t"), (F.col("depth") + extra).cast("int"))
    value = F.coalesce(F.concat(F.lit('"'), F.col("text"), F.lit('"')), F.concat(F.lit("0x"), C.hex_plain(F.col("number"))), F.concat(F.lit("bytes "), F.hex("block")))
    head = entries.select(key, "die", F.lit(-1).cast("long").alias("seq"), F.concat(tabs(0), F.col("tag")).alias("line"))
    body = attrs.join(entries.select(key, "die", "depth"), [key, "die"]).select(key, "die", "seq", F.concat(tabs(1), F.col("attr"), F.lit(" "), value).alias("line"))
    return head.unionByName(body)


def stack_comment(offset: Column, frame: Column, caller: bool = False) -> Column:
    """Where a variable stands: from the frame's end, or from the caller's stack pointer."""
    inside = frame.isNotNull() & F.lit(not caller)
    at = F.when(inside, offset + frame).otherwise(offset)
    sign, where = F.when(at < 0, "-0x").otherwise("0x"), F.when(inside, "(sp)").otherwise("(caller sp)")
    return F.concat(F.lit("/* "), sign, C.hex_plain(F.abs(at)), where, F.lit(" */ "))


def global_comment(location: Column, address: Column) -> Column:
    return F.concat(F.lit("/* "), location, F.coalesce(F.concat(F.lit(" "), C.hex_plain(address)), F.lit("")), F.lit(" */ "))


def file_breaks(symbols: DataFrame, value: str) -> DataFrame:
    """Adds is_break: whether value differs from that of the symbol before it in order of handles, the first being one.

    Rows meet by their dense places, so no task has them all.
    """
    placed = dense_index(symbols)
    before = placed.select((F.col("idx") + 1).alias("idx"), F.col(value).alias("before_"), F.lit(True).alias("any_"))
    return placed.join(before, "idx", "left").withColumn("is_break", F.col("any_").isNull() | ~F.col("before_").eqNullSafe(F.col(value))).drop("idx", "before_", "any_")


def header_rows(headers: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value): a header unpivoted."""
    return headers.unpivot([key], fields, "field", "value")


def overwritable(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """Paths that may be written: not there, empty, or marked as not begun."""
    begun = existing.filter(~F.startswith("text", F.lit("// STATUS: NOT STARTED")) & (F.col("text") != ""))
    return paths.join(begun.select("path"), "path", "left_anti")


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Writes line in order as text; one file of a large report has as many parts as the sort."""
    lines.orderBy(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
