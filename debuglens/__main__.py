"""Command line: ``python -m debuglens COMMAND PATH [--out DIR]`` reads symbol files below a path and shows or writes a table or a report."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debuglens.operators import graph, printing, reports
from debuglens.operators.analyser import analyse
from debuglens.operators.database import SymbolDb
from debuglens.operators.importer import import_files
from debuglens.sources import tables


def _identify(files: DataFrame) -> DataFrame:
    return tables.with_type(files).groupBy("type").agg(F.count("*").alias("n"))


def _elf(files: DataFrame) -> DataFrame:
    return tables.with_type(files).filter("type = 'ELF'").select(F.col("path").alias("image"), "content")


def _analysed(entity: str):
    def run(files: DataFrame) -> DataFrame:
        symbols = tables.mdebug_table(_elf(files), "symbols", tables.MDEBUG, strict=False)
        procedures = tables.mdebug_table(_elf(files), "procedures", tables.PROCEDURES, strict=False).select("image", "file_idx", F.col("symbol_index").alias("sym_idx"), "frame_size")
        bases = tables.mdebug_table(_elf(files), "files", tables.MFILES, strict=False).select("image", "file_idx", F.col("address").alias("base"))
        joined = symbols.join(procedures, ["image", "file_idx", "sym_idx"], "left").join(bases, ["image", "file_idx"], "left")
        keyed = joined.withColumn("file", F.xxhash64("image", "file_idx"))
        return analyse(keyed).filter(F.col("entity") == entity)

    return run


COMMANDS = {
    "identify": ("count files by type", _identify),
    "sections": ("section headers of ELF files", lambda f: tables.elf_sections(_elf(f), strict=False)),
    "tables": ("symbol tables of ELF files, in the order of import", lambda f: tables.elf_symbol_tables(_elf(f))),
    "symbols": ("rows of ELF symbol tables", lambda f: tables.elf_symbols(_elf(f), strict=False)),
    "functions": ("functions of .mdebug sections", _analysed("function")),
    "globals": ("global variables of .mdebug sections", _analysed("global")),
    "locals": ("local variables with their live ranges", _analysed("local")),
    "types": ("data types of .mdebug sections", _analysed("data_type")),
}


def _json(db: SymbolDb) -> DataFrame:
    lists = {kind: reports.symbol_json(db[kind].withColumns({c: F.lit(None).cast("long") for c in ("address", "size") if c not in db[kind].columns})) for kind in sorted(db.tables) if kind not in ("faults", "symbol_sources")}
    return reports.document_lines(lists, "debuglens")


def _graph(db: SymbolDb) -> DataFrame:
    kinds = printing.distinct_types(db)
    plain = F.get_json_object("tree", "$.kind") != "builtin"
    nodes = kinds.filter(plain & (F.col("name") != "")).select(F.col("handle").alias("id"), F.col("name").alias("label"))
    edges = printing.type_references(kinds).select("src", "dst", F.lit("reference").alias("kind"), F.lit(False).alias("is_forward_declared"))
    return reports.dot_lines(nodes, graph.dependencies(edges))


def _types(db: SymbolDb) -> DataFrame:
    return printing.types_text(printing.distinct_types(db)).select("handle", F.col("text").alias("line"))


#: Reports of the database as lines, and the columns that order them.
REPORTS = {
    "print-functions": ("functions as C++, by source file", lambda db: printing.by_file(db, "functions", printing.functions_text(db)), ["idx"]),
    "print-globals": ("global variables as C++, by source file", lambda db: printing.by_file(db, "global_variables", printing.globals_text(db)), ["idx"]),
    "print-types": ("distinct types as C++", _types, ["handle"]),
    "type-graph": ("which types refer to which, as DOT", _graph, ["part", "line"]),
    "labels": ("labels with their addresses", lambda db: reports.label_lines(db["labels"]), ["handle"]),
    "files": ("source files with their addresses", lambda db: reports.file_lines(db["source_files"]), ["handle"]),
    "json": ("the database as one JSON document", _json, ["part", "ord"]),
    "faults": ("files that can't be imported, and why", lambda db: db["faults"].select("module_handle", F.concat_ws(": ", "path", "message").alias("line")), ["module_handle"]),
}


def _sources(spark: SparkSession, path: str, listed: str, folder: str) -> None:
    """Writes the source files of one symbol file for the paths that a list names, in the list's order."""
    files = tables.images(spark, path)
    db = import_files(files)
    images = files.join(db["modules"].select(F.col("handle").alias("module_handle"), F.col("name").alias("path")), "path").select("module_handle", "content")
    words = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    paths = tables.text_file(spark, listed).select(F.posexplode(words).alias("idx", "path")).join(db["modules"].select(F.col("handle").alias("module_handle")))
    for written in printing.write_sources(printing.source_texts(db, paths, images=images), folder):
        print(written)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="debuglens", description="Tables of debugging symbols.", formatter_class=argparse.RawDescriptionHelpFormatter, epilog="commands:\n" + "\n".join(f"  {k:17}{v[0]}" for k, v in [*COMMANDS.items(), *REPORTS.items(), ("sources", ("write source files again (needs --list and --out)",))]))
    out.add_argument("command", choices=[*COMMANDS, *REPORTS, "sources"])
    out.add_argument("path", help="a file, or a folder that is searched whole")
    out.add_argument("--out", help="write here instead of showing: Parquet, lines of a report, or source files")
    out.add_argument("--list", help="a text file of source paths in order")
    return out


def main(argv: list[str] | None = None) -> None:
    given = parser().parse_args(argv)
    spark = SparkSession.builder.appName("debuglens").getOrCreate()
    if given.command == "sources":
        if not (given.list and given.out):
            raise SystemExit("sources needs --list and --out")
        return _sources(spark, given.path, given.list, given.out)
    if given.command in REPORTS:
        _, of, order = REPORTS[given.command]
        lines = of(import_files(tables.images(spark, given.path)))
        if given.out:
            return reports.write_lines(lines, given.out, order)
        for row in lines.orderBy(*order).toLocalIterator():
            print(row["line"])
        return None
    rows = COMMANDS[given.command][1](tables.images(spark, given.path))
    if given.out:
        rows.write.parquet(given.out)
    else:
        rows.show(100, truncate=False)


if __name__ == "__main__":
    main()
