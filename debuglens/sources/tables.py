"""Symbol files as DataFrames: one row per record, decoded per file inside the executors."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debuglens.session import ready
from debuglens.sources import decode
from debuglens.sources.layout import Malformed

#: Rows that a task gives at once.
BATCH = 10_000
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, content) of whole files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def text_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def with_type(files: DataFrame) -> DataFrame:
    """Adds type by the first four bytes: ELF, SNDLL or unknown."""
    magic = F.hex(F.substring("content", 1, 4))
    return files.withColumn("type", F.when(magic == "7F454C46", "ELF").when(magic.isin("534E5231", "534E5232"), "SNDLL").otherwise("unknown"))


def decoded(files: DataFrame, rows: Callable, columns: str, strict: bool = True) -> DataFrame:
    """rows(content, extra columns...) of each file as a table; the first column of files is a key that comes along.

    A malformed file fails the query if strict, else it gives no rows.
    """
    ready(files.sparkSession)
    fields = [c.rsplit(" ", 1) for c in columns.split(", ")]
    key = files.columns[0]
    schema = pa.schema([pa.field(n, _KINDS[t]) for n, t in fields])

    names, types = schema.names, schema.types

    def run(batches):
        held: list[dict] = []
        owners: list = []
        kind = None

        def give():
            arrays = [pa.array([r.get(n) for r in held], t) for n, t in zip(names, types)]
            return pa.RecordBatch.from_arrays([pa.array(owners, kind), *arrays], names=[key, *names])

        for batch in batches:
            kind = batch.column(0).type
            for owner, *given in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    # what may have to be left out is held whole, the rest goes on as it is read
                    found = rows(*given) if strict else list(rows(*given))
                except Malformed:
                    if strict:
                        raise
                    continue
                for row in found:
                    held.append(row)
                    owners.append(owner)
                    if len(held) >= BATCH:
                        yield give()
                        held, owners = [], []
        if held:
            yield give()

    return files.mapInArrow(run, f"{key} {files.schema[0].dataType.simpleString()}, {columns}")


SECTIONS = "idx long, name string, type long, addr long, offset long, size long, link long"
SEGMENTS = "idx long, type long, offset long, vaddr long, filesz long, memsz long"
SYMTAB = "idx long, name string, value long, size long, type long, bind long, visibility long"
SNDLL = "idx long, type long, value long, string string"
MDEBUG = "file_idx long, sym_idx long, value long, symbol_type long, symbol_class long, index long, string string"
EXTERNALS = "sym_idx long, value long, symbol_type long, symbol_class long, index long, string string"
MFILES = "file_idx long, address long, path string, working_dir string"
PROCEDURES = "file_idx long, address long, symbol_index long, frame_size long"
DIES = "die long, length long, tag string, sibling long, parent long, depth long"
ATTRS = "die long, seq long, attr string, form string, number long, text string, block binary"


def elf_sections(files: DataFrame, strict: bool = True) -> DataFrame:
    return decoded(files, lambda c: decode.elf(c)["sections"], SECTIONS, strict)


def elf_segments(files: DataFrame, strict: bool = True) -> DataFrame:
    return decoded(files, lambda c: decode.elf(c)["segments"], SEGMENTS, strict)


def elf_symbol_tables(files: DataFrame) -> DataFrame:
    """(priority, format, section) of each file's symbol tables, in the order of import."""

    def rows(content):
        return [{"priority": p, "format": f, "section": s.get("name")} for p, f, s in decode.symbol_tables(decode.elf(content)["sections"])]

    return decoded(files, rows, "priority long, format string, section string")


def elf_symbols(files: DataFrame, strict: bool = True) -> DataFrame:
    def rows(content):
        sections = decode.elf(content)["sections"]
        section = decode.section_named(sections, ".symtab")
        return decode.symtab(content, section, sections) if section else []

    return decoded(files, rows, SYMTAB, strict)


def sndll_symbols(files: DataFrame, strict: bool = True) -> DataFrame:
    """files: (key, content, address), the address being null for a whole file."""
    return decoded(files, decode.sndll, SNDLL, strict)


def mdebug_table(files: DataFrame, part: str, columns: str, strict: bool = True) -> DataFrame:
    """files, symbols, procedures or externals of the .mdebug sections of ELF files."""

    def rows(content):
        section = decode.section_named(decode.elf(content)["sections"], ".mdebug")
        return decode.mdebug(content, section["offset"])[part] if section else []

    return decoded(files, rows, columns, strict)


MDEBUG_ALL = "part string, file_idx long, sym_idx long, value long, symbol_type long, symbol_class long, index long, string string, address long, path string, working_dir string, symbol_index long, frame_size long"


def mdebug_all(files: DataFrame, strict: bool = True) -> DataFrame:
    """The rows of all tables of the .mdebug sections in one pass; part names the table."""

    def rows(content):
        section = decode.section_named(decode.elf(content)["sections"], ".mdebug")
        found = decode.mdebug(content, section["offset"]) if section else {}
        return [r | {"part": part} for part, rs in found.items() for r in rs]

    return decoded(files, rows, MDEBUG_ALL, strict)


def dwarf_all(files: DataFrame, strict: bool = True) -> DataFrame:
    """Entries and attributes in one pass; part is entry or attr. files: (key, bytes of .debug)."""

    def rows(content):
        return (r | {"part": part} for part, r in decode.walked(content))

    return decoded(files, rows, f"part string, {DIES}, {ATTRS.removeprefix('die long, ')}", strict)


def dwarf_entries(files: DataFrame, strict: bool = True) -> DataFrame:
    """files: (key, bytes of .debug)."""
    return decoded(files, lambda c: (r for part, r in decode.walked(c) if part == "entry"), DIES, strict)


def dwarf_attributes(files: DataFrame, strict: bool = True) -> DataFrame:
    return decoded(files, lambda c: (r for part, r in decode.walked(c) if part == "attr"), ATTRS, strict)


def scanned(attrs: DataFrame, names: list[str]) -> DataFrame:
    """One row per entry with the last occurrence of each named attribute, as number and text."""
    out = attrs.filter(F.col("attr").isin(*names)).groupBy(attrs.columns[0], "die").pivot("attr", names)
    return out.agg(F.max_by(F.coalesce("text", F.col("number").cast("string")), "seq"))
