"""From symbol files to the symbol database: every table of a file, best first, as entity lists.

All files are imported together: a list is one table, and module_handle says whose row it is.
Tables are read in the order mdebug, DWARF, ELF symbol table, SNDLL, section headers; a symbol of
a later one is left out where an earlier one has a function or a variable at its address. A file
that can't be decoded gives no rows at all and is listed with its fault, the others are whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from debuglens.functions.demangle import demangle
from debuglens.operators import lookup, passes
from debuglens.operators.analyser import folded, located
from debuglens.operators.database import SymbolDb
from debuglens.operators.lookup import numbered
from debuglens.session import by_key, cut, lean, ready
from debuglens.sources import decode, tables
from debuglens.sources.layout import Malformed

#: Symbol sources in the order of import; a source's handle is its place.
SOURCES = ("MIPS Debug Symbol Table", "DWARF Symbol Table", "ELF Symbol Table", "SNDLL Symbol Table", "ELF Section Headers")
MDEBUG, DWARF, SYMTAB, SNDLL, HEADERS = range(len(SOURCES))
JUNK = ("__gnu_compiled_c", "__gnu_compiled_cplusplus", "gcc2_compiled.")
CODE = (".text", ".vutext")
DATA = (".data", ".rodata", ".sdata", ".sbss", ".bss", ".lit4", ".lit8", ".vudata")
DWARF_TYPES = ("array_type", "class_type", "enumeration_type", "pointer_type", "reference_type", "string_type", "structure_type", "subroutine_type", "typedef", "union_type", "ptr_to_member_type", "set_type", "subrange_type")


def demangled(rows: DataFrame) -> DataFrame:
    """rows with name in clear text and mangled_name as it was; a name that no scheme made stays and has a null there."""
    ready(rows.sparkSession)
    columns = [f for f in rows.schema.fields if f.name != "mangled_name"]
    schema = StructType([*columns, StructField("mangled_name", StringType())])
    at = [f.name for f in columns].index("name")

    def run(batches):
        for batch in batches:
            names = batch.column(at).to_pylist()
            clear = {n: demangle(n) for n in set(names) if n}
            arrays = [*batch.columns]
            arrays[at] = pa.array([clear.get(n) or n for n in names], pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([n if clear.get(n) else None for n in names], pa.string())], names=[f.name for f in schema.fields])

    return rows.select(*[f.name for f in columns]).mapInArrow(run, schema)


def _checked(content: bytes):
    """Rows that say whether a file can be decoded, whole: fault is null if so."""
    try:
        if decode.file_type(content) == "SNDLL":
            decode.sndll(content)
        elif decode.file_type(content) == "ELF":
            image = decode.elf(content)
            for _, form, section in decode.symbol_tables(image["sections"]):
                if form == "mdebug":
                    decode.mdebug(content, section["offset"])
                elif form == "dwarf":
                    decode.dies(decode.section_bytes(content, section))
                elif form == "symtab":
                    decode.symtab(content, section, image["sections"])
                elif form == "sndll":
                    decode.sndll(decode.section_bytes(content, section), section["addr"])
        else:
            return [{"fault": "unknown file type"}]
    except Malformed as e:
        return [{"fault": str(e)}]
    return [{"fault": None}]


def _debug(content: bytes):
    sections = decode.elf(content)["sections"]
    return [{"debug": decode.section_bytes(content, s)} for _, form, s in decode.symbol_tables(sections) if form == "dwarf"]


def _sndata(content: bytes):
    """SNDLL symbols of a file of that type, or of such a section; addresses are absolute but for ABSOLUTE ones."""
    if decode.file_type(content) == "SNDLL":
        return decode.sndll(content)
    return [row for _, form, s in decode.symbol_tables(decode.elf(content)["sections"]) if form == "sndll" for row in decode.sndll(decode.section_bytes(content, s), s["addr"])]


def importable(files: DataFrame) -> DataFrame:
    """(module_handle, path, content, fault) of files (path, content), modules numbered by path."""
    told = cut(tables.decoded(files.select("path", "content"), _checked, "fault string"))
    return numbered(told, "path", name="module_handle").join(by_key(files.select("path", "content")), "path")


def import_files(files: DataFrame, deduplicate: bool = True, overlay: int | None = None) -> SymbolDb:
    """The database of files (path, content); its list faults has (module_handle, path, message) of those left out.

    overlay picks the DWARF units of that overlay; without one, units of any overlay are left out.
    """
    lean(ready(files.sparkSession))
    told = cut(importable(files))
    good = told.filter("fault IS NULL")
    mdebug, broken = _mdebug(good.filter(F.substring("content", 1, 4) == F.lit(b"\x7fELF")).select("module_handle", "content"))
    bad = told.filter("fault IS NOT NULL").select("module_handle", "path", F.col("fault").alias("message")).unionByName(broken.join(by_key(told.select("module_handle", "path")), "module_handle").select("module_handle", "path", "message"))
    # a module that failed half way leaves nothing behind
    whole = good.join(by_key(broken.select("module_handle").distinct()), "module_handle", "left_anti")
    images = whole.filter(F.substring("content", 1, 4) == F.lit(b"\x7fELF")).select("module_handle", "content")
    rows = cut(mdebug.unionByName(_dwarf(images, overlay)).unionByName(_headers(images)))
    later = [_symtab(images), _sndll(whole.select("module_handle", "content"), rows)]
    for found in later:
        if deduplicate:
            earlier = rows.filter("kind IN ('functions', 'global_variables', 'local_variables') AND address IS NOT NULL")
            routed = found.withColumn("idx", F.col("seq")).withColumn("creates", F.col("kind").isin("functions", "global_variables"))
            checked = passes.symbols_not_yet_there(routed.filter("kind <> 'source_files'"), earlier, ("module_handle",)).drop("idx", "creates")
            found = checked.unionByName(found.filter("kind = 'source_files'"))
        rows = cut(rows.unionByName(found))
    return _lists(rows, whole, bad)


COLUMNS = {"module_handle": "long", "source_handle": "long", "kind": "string", "unit": "long", "seq": "long", "owner": "long", "name": "string", "address": "long", "size": "long", "storage": "string", "number": "long", "is_static": "boolean", "low": "long", "high": "long", "path": "string", "tree": "string"}


def _shaped(rows: DataFrame, source: int, **given) -> DataFrame:
    """rows as entity rows: given columns, and nulls for the rest."""
    columns = {"source_handle": F.lit(source), **given}
    there = set(rows.columns)
    return rows.select(*[(columns[n] if n in columns else F.col(n) if n in there else F.lit(None)).cast(t).alias(n) for n, t in COLUMNS.items()])


ENTITIES = {"function": "functions", "parameter": "parameter_variables", "local": "local_variables", "global": "global_variables", "data_type": "data_types"}


def _mdebug(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity rows of the .mdebug sections, and (module_handle, message) of modules with malformed symbols."""
    read = cut(tables.mdebug_all(images))
    part = lambda name, columns: read.filter(F.col("part") == name).select("module_handle", *columns)
    procedures = part("procedures", ["file_idx", F.col("symbol_index").alias("sym_idx"), "frame_size"])
    # a file's number is its place among all files
    units = numbered(part("files", ["file_idx", "address", "path"]), "module_handle", "file_idx", name="file")
    symbols = part("symbols", ["file_idx", "sym_idx", "value", "symbol_type", "symbol_class", "index", "string"])
    joined = symbols.join(by_key(units.select("module_handle", "file_idx", "file", F.col("address").alias("base"), "path")), ["module_handle", "file_idx"]).join(by_key(procedures), ["module_handle", "file_idx", "sym_idx"], "left")
    owners = units.select("file", "module_handle")
    rows = cut(folded(joined, False, trees=True).join(by_key(owners), "file"))
    broken = cut(rows.filter("entity = 'fault'").select("module_handle", F.col("name").alias("message")))
    externals = part("externals", ["sym_idx", "value", "symbol_class", "string"]).withColumnRenamed("module_handle", "module")
    found = located(rows.join(by_key(broken.select("module_handle").distinct()), "module_handle", "left_anti"), externals, owners.withColumnRenamed("module_handle", "module"))
    kind = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (k, v)])
    kept = found.filter(F.col("entity").isin(*ENTITIES))
    entities = _shaped(kept, MDEBUG, kind=F.try_element_at(kind, F.col("entity")), unit=F.col("file"))
    ok = units.join(by_key(broken.select("module_handle").distinct()), "module_handle", "left_anti")
    sources = _shaped(ok, MDEBUG, kind=F.lit("source_files"), unit=F.col("file"), seq=F.lit(-1), name=F.col("path"))
    return entities.unionByName(sources), broken


def _dwarf(images: DataFrame, overlay: int | None) -> DataFrame:
    """Entity rows of .debug sections: source files from units, functions from subroutines, and named types."""
    sections = tables.decoded(images, _debug, "debug binary")
    read = cut(tables.dwarf_all(sections))
    entries = read.filter("part = 'entry'").select("module_handle", "die", "tag", "parent", "depth")
    attrs = read.filter("part = 'attr'").select("module_handle", "die", "seq", "attr", "number", "text")
    told = tables.scanned(attrs, ["name", "mangled_name", "low_pc", "high_pc", "overlay_id", "byte_size"])
    known = entries.join(by_key(told), ["module_handle", "die"], "left")
    number = lambda c: F.col(c).cast("long")
    # the first overlay that lists a unit has it
    members = attrs.filter("attr = 'member'").join(by_key(known.filter("tag = 'overlay'").select("module_handle", "die", number("overlay_id").alias("overlay"))), ["module_handle", "die"])
    placed = members.groupBy("module_handle", F.col("number").alias("die")).agg(F.min_by("overlay", F.struct("die", "seq")).alias("overlay"))
    units = known.filter("tag = 'compile_unit' AND depth = 0").join(by_key(placed), ["module_handle", "die"], "left")
    chosen = units.filter(F.col("overlay").isNull() if overlay is None else F.col("overlay") == overlay).select("module_handle", "die", F.coalesce("name", F.lit("")).alias("name"), number("low_pc").alias("low_pc"), number("high_pc").alias("high_pc"))
    # units of one name that follow each other are one source file; a file's number is its first unit's place
    grouped = cut(passes.islands(chosen, ["module_handle"], "die", "name"))
    files = grouped.groupBy("module_handle", "island").agg(F.min("die").alias("unit"), F.first("name").alias("name"), F.min("low_pc").alias("address"), (F.max("high_pc") - F.min("low_pc")).alias("size"))
    owner = grouped.join(by_key(files.select("module_handle", "island", "unit")), ["module_handle", "island"]).select("module_handle", F.col("die").alias("parent"), "unit")
    inside = known.filter("depth = 1").join(by_key(owner), ["module_handle", "parent"])
    subroutines = inside.filter(F.col("tag").isin("subroutine", "global_subroutine"))
    functions = _shaped(subroutines, DWARF, kind=F.lit("functions"), seq=F.col("die"), name=F.coalesce("mangled_name", "name", F.lit("")), address=number("low_pc"), size=number("high_pc") - number("low_pc"), is_static=F.col("tag") == "subroutine")
    types = _shaped(inside.filter(F.col("tag").isin(*DWARF_TYPES) & F.col("name").isNotNull()), DWARF, kind=F.lit("data_types"), seq=F.col("die"), size=number("byte_size"))
    return functions.unionByName(types).unionByName(_shaped(files, DWARF, kind=F.lit("source_files"), seq=F.lit(-1)))


def _symtab(images: DataFrame) -> DataFrame:
    rows = tables.elf_symbols(images).filter("value <> 0 AND visibility = 0")
    route = passes.route_elf_symbol(F.col("type"), F.col("size"))
    kind = F.create_map(*[F.lit(x) for k, v in {"label": "labels", "global": "global_variables", "function": "functions", "file": "source_files"}.items() for x in (k, v)])
    routed = rows.withColumn("kind", F.try_element_at(kind, route)).filter("kind IS NOT NULL")
    return _shaped(routed, SYMTAB, seq=F.col("idx"), address=F.col("value"), size=F.nullif("size", F.lit(0)))


def _headers(images: DataFrame) -> DataFrame:
    sections = tables.elf_sections(images).filter("idx > 0")
    return _shaped(sections, HEADERS, kind=F.lit("sections"), seq=F.col("idx"), address=F.nullif("addr", F.lit(0)))


def _sndll(files: DataFrame, rows: DataFrame) -> DataFrame:
    """SNDLL symbols by the section around them: functions in code, variables in data, else labels."""
    found = tables.decoded(files, _sndata, tables.SNDLL).filter("value <> 0 AND string <> ''")
    sections = rows.filter("kind = 'sections' AND address IS NOT NULL").select("module_handle", F.col("seq").alias("handle"), "address", "size", F.col("name").alias("section"))
    ends = lookup.with_next(sections, ["module_handle"])
    spans = ends.select("module_handle", "section", F.col("address").alias("lo_"), F.least(F.col("address") + F.col("size"), F.coalesce("next_start", F.lit(lookup.TOP))).alias("hi_")).filter("lo_ < hi_")
    # a file has a few dozen sections, so the join on the module is followed by few comparisons a symbol
    placed = found.join(by_key(spans.withColumnRenamed("module_handle", "m_")), (found["module_handle"] == F.col("m_")) & (found["value"] >= F.col("lo_")) & (found["value"] < F.col("hi_")), "left").drop("m_")
    kind = F.when(F.col("section").isin(*CODE), "functions").when(F.col("section").isin(*DATA), "global_variables").otherwise("labels")
    return _shaped(placed, SNDLL, kind=kind, seq=F.col("idx"), name=F.col("string"), address=F.col("value"))


def _lists(rows: DataFrame, modules: DataFrame, bad: DataFrame) -> SymbolDb:
    """One list per kind, handles in order of module, source and place; owners as handles."""
    spark = rows.sparkSession
    out = {
        "modules": modules.select(F.col("module_handle").alias("handle"), F.col("path").alias("name")),
        "symbol_sources": spark.createDataFrame(list(enumerate(SOURCES)), "handle long, name string"),
        "faults": bad,
    }
    key, order = ["module_handle", "source_handle", "unit"], ("module_handle", "source_handle", "unit", "seq")
    junk = rows.filter(~F.coalesce((F.col("kind") == "labels") & F.col("name").isin(*JUNK), F.lit(False)))
    # one sort for all lists; a list's handles count from its first row
    every = numbered(junk, "kind", *order, name="nth_")
    first = dict(every.groupBy("kind").agg(F.min("nth_")).collect())
    listed = {kind: every.filter(F.col("kind") == kind).withColumn("handle", F.col("nth_") - first.get(kind, 0)).drop("kind", "nth_") for kind in ("source_files", "functions", "global_variables", "local_variables", "parameter_variables", "data_types", "labels", "sections")}
    files = listed["source_files"].filter("unit IS NOT NULL").select(*key, F.col("handle").alias("source_file"))
    functions = listed["functions"].select(*key, F.col("seq").alias("owner"), F.col("handle").alias("function"))
    base = ["handle", "module_handle", "source_handle", "name", "address", "size"]
    for kind, found in listed.items():
        if kind in ("functions", "global_variables"):
            found = cut(demangled(found.join(by_key(files), key, "left"))).select(*base, "mangled_name", "source_file", "storage", F.col("number").alias("frame_size"), "is_static", "path", "tree")
        elif kind in ("local_variables", "parameter_variables"):
            found = found.join(by_key(functions), [*key, "owner"], "left").select(*base, "function", "storage", F.col("number").alias("place"), "low", "high", "tree")
        elif kind == "data_types":
            found = found.join(by_key(files), key, "left").select(*base, "source_file", (F.col("storage") == "typedef").alias("is_typedef"), "tree")
        else:
            found = found.select(*base)
        out[kind] = found
    return SymbolDb(out)
