"""C++ reports of a symbol database and the source files that it lets one write again.

Text is made a symbol at a time from the symbol's own row and its children's. What follows what,
and where blank lines stand, is decided by windows over one output file or by dense places, so no
task ever holds a whole report.
"""

from __future__ import annotations

import json
import os
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from debuglens.functions import ast, cpp
from debuglens.functions import columns as C
from debuglens.operators import lookup, reports, types
from debuglens.operators.database import SymbolDb
from debuglens.operators.importer import MDEBUG, numbered
from debuglens.session import by_key, cut, ready
from debuglens.sources import decode, tables
from debuglens.sources.layout import Malformed

# The mark of files not begun, and where types of no single file go.
NOT_STARTED = "// STATUS: NOT STARTED\n\n"
LOST = "lost+found.h"
#: Endings of paths that are written as C or C++; others are assembly.
ENDINGS = ("c", "cpp", "cc", "iac", "src")
TEXT = "text string, spaced int"


def _text(rows: DataFrame, of, config: cpp.PrinterConfig) -> DataFrame:
    """(handle, text, spaced) of each row by of(row, config); rows that it gives None for are left out."""

    def run(row):
        for part in (row, *(row.get("parameters") or ()), *(row.get("locals") or ())):
            part["tree"] = json.loads(part["tree"]) if part.get("tree") else None
        found = of(row, config)
        return [] if found is None else [{"text": found[0], "spaced": int(found[1])}]

    return tables.decoded(rows.select("handle", F.struct(*rows.columns).alias("row")), run, TEXT)


def _children(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """(handle, name) of functions: their children in order."""
    listed = F.struct("handle", "name", "storage", "place", "address", "tree", *more)
    return rows.filter("function IS NOT NULL").groupBy(F.col("function").alias("handle")).agg(F.array_sort(F.collect_list(listed)).alias(name))


def functions_text(db: SymbolDb, config: cpp.PrinterConfig = cpp.PrinterConfig(), bodies: DataFrame | None = None, data: DataFrame | None = None) -> DataFrame:
    """(handle, text, spaced) of functions: head, parameters, and locals and bodies if wanted.

    bodies: (address, body); data: (kind, handle, data), initialisers of variables.
    """
    locals_ = db["local_variables"].withColumn("is_static", F.col("place").isNull() & F.col("address").isNotNull())
    given = data.filter("kind = 'local_variables'").select("handle", "data") if data is not None else None
    locals_ = locals_.withColumn("data", F.lit(None).cast("string")) if given is None else locals_.join(by_key(given), "handle", "left")
    rows = db["functions"].join(by_key(_children(db["parameter_variables"], "parameters")), "handle", "left").join(by_key(_children(locals_, "locals", "is_static", "data")), "handle", "left")
    # tables without parameters say nothing about them
    rows = rows.withColumn("parameters", F.when(F.col("source_handle") == MDEBUG, F.coalesce("parameters", F.array())))
    rows = rows.join(by_key(members(db).withColumn("is_member", F.lit(True))), "handle", "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))
    rows = rows.join(by_key(bodies.select("address", "body")), "address", "left") if bodies is not None else rows.withColumn("body", F.lit(None).cast("string"))
    return _text(rows.select("handle", "name", "address", "size", "frame_size", "is_static", "is_member", "tree", "parameters", "locals", "body"), cpp.function, config)


def members(db: SymbolDb) -> DataFrame:
    """(handle) of functions that a struct or union of their module declares, by the last two parts of their names."""
    plain, parts = F.substring_index("name", "(", 1), r"^(?:.*::)?(.*?)::([^:]*)$"
    pieces = db["functions"].select("handle", "module_handle", F.regexp_extract(plain, parts, 1).alias("ty"), F.regexp_extract(plain, parts, 2).alias("f")).filter("ty <> ''")
    declared = F.from_json(F.get_json_object("tree", "$.members"), "array<struct<name:string>>")
    names = db["data_types"].filter("tree IS NOT NULL").select("module_handle", F.col("name").alias("ty"), F.explode(declared["name"]).alias("f"))
    return pieces.join(by_key(names), ["module_handle", "ty", "f"], "left_semi").select("handle")


def globals_text(db: SymbolDb, config: cpp.PrinterConfig = cpp.PrinterConfig(), data: DataFrame | None = None) -> DataFrame:
    """(handle, text, spaced) of global variables, with initialisers if data (kind, handle, data) has them."""
    rows = db["global_variables"].select("handle", "name", "storage", "address", "is_static", "tree", F.lit(None).cast("long").alias("place"))
    rows = rows.withColumn("data", F.lit(None).cast("string")) if data is None else rows.join(by_key(data.filter("kind = 'global_variables'").select("handle", "data")), "handle", "left")
    return _text(rows, cpp.global_variable, config)


def distinct_types(db: SymbolDb) -> DataFrame:
    """(module_handle, handle, name, tree, is_typedef, files, reason) of each module's types, deduplicated; handle is the representative's.

    files are the handles of the source files that define the type.
    """
    known = db["data_types"].filter("tree IS NOT NULL")
    rows = known.select("module_handle", "name", F.col("handle").alias("seq"), F.col("source_file").cast("string").alias("file"), "tree")
    found = types.deduplicated(rows, ("module_handle",))
    out = found.select("module_handle", F.col("representative").alias("handle"), "name", F.col("shape").alias("tree"), F.array_sort(F.col("files").cast("array<long>")).alias("files"), F.regexp_replace("reason", "^differs: ", "").alias("reason"))
    return out.join(by_key(known.select("handle", F.coalesce("is_typedef", F.lit(False)).alias("is_typedef"))), "handle")


def types_text(rows: DataFrame, config: cpp.PrinterConfig = cpp.PrinterConfig()) -> DataFrame:
    """(handle, text, spaced) of types as distinct_types() gives them."""
    return _text(rows.select("handle", "name", "tree", "is_typedef", "reason"), cpp.data_type, config)


def by_file(db: SymbolDb, kind: str, texts: DataFrame, by_address: bool = False) -> DataFrame:
    """(handle, line) of a report: each symbol's text, with the name of its file before it wherever that changes.

    idx is the place to sort by.
    """
    files = db["source_files"].select(F.col("handle").alias("source_file"), F.col("name").alias("file_name"))
    rows = texts.join(by_key(db[kind].select("handle", "address", "source_file")), "handle").join(by_key(files), "source_file", "left")
    if by_address:
        rows = numbered(rows.withColumnRenamed("handle", "symbol"), "address", "symbol")
    else:
        rows = cut(rows.withColumn("symbol", F.col("handle")))
    marked = cut(reports.file_breaks(rows, "source_file"))
    rule = F.concat(F.lit(f"{cpp.RULE}\n{cpp.FILE}"), F.coalesce("file_name", F.lit("(unknown)")), F.lit(f"\n{cpp.RULE}\n"))
    before = lookup.dense_index(marked).select((F.col("idx") + 1).alias("idx"), F.col("spaced").alias("spaced_before"))
    placed = lookup.dense_index(marked).join(by_key(before), "idx", "left")
    blank = F.when((F.col("spaced") == 1) | (F.col("spaced_before") == 1), "\n").otherwise("")
    line = F.when(F.col("is_break"), F.concat(F.lit("\n"), rule, F.lit("\n"), "text")).otherwise(F.concat(blank, "text"))
    return placed.select("idx", F.col("symbol").alias("handle"), line.alias("line"))


def types_head(db: SymbolDb, input_file: str, tool: str, version: str, toolchains: DataFrame | None = None) -> str:
    """The comment blocks above a report of types: where it comes from, toolchains (a file without any has an unknown one), built-in types."""
    named = ["unknown"] if toolchains is None else [r[0] for r in toolchains.select(F.explode(F.when(F.size("toolchains") > 0, F.col("toolchains")).otherwise(F.array(F.lit("unknown"))))).distinct().sort("col").toLocalIterator()]
    get = lambda p: F.get_json_object("tree", p)
    builtin = db["data_types"].filter(get("$.kind") == "builtin").select("name", get("$.class").alias("class")).distinct().sort("name", "class")
    listed = [f"{r['name']:<25}{r['class']}" for r in builtin.toLocalIterator()]
    blocks = [cpp.block_beginning(input_file, tool, version), cpp.block_list("Toolchain version(s)", named)]
    return "\n".join([*blocks, cpp.block_list("Built-in types", listed)] if listed else blocks)


# Initialisers.


def initialisers(db: SymbolDb, images: DataFrame) -> DataFrame:
    """(kind, handle, data) of variables whose bytes are in their module's file; images: (module_handle, content).

    A task holds one module: its file, its named types and its variables.
    """
    ready(images.sparkSession)
    columns = ["module_handle", "kind", "handle", "name", "address", "tree"]
    held = F.col("address").isNotNull() & F.col("tree").isNotNull() & ~F.coalesce(F.col("storage").isin("bss", "sbss", "stack", "register"), F.lit(True))
    sought = None
    for kind in ("global_variables", "local_variables"):
        part = db[kind].filter(held).withColumn("kind", F.lit(kind)).select(*columns)
        sought = part if sought is None else sought.unionByName(part)
    # pointers are named after what stands where they point to
    of = lambda kind: db[kind].withColumn("kind", F.lit(kind))
    told = of("data_types").filter("tree IS NOT NULL").withColumn("address", F.lit(None).cast("long")).select(*columns)
    for kind in ("functions", "global_variables"):
        told = told.unionByName(of(kind).filter("address IS NOT NULL").withColumn("tree", F.when(F.lit(kind) == "global_variables", F.col("tree"))).select(*columns))
    context = told.withColumn("content", F.lit(None).cast("binary")).unionByName(images.select("module_handle", F.lit("image").alias("kind"), "content"), allowMissingColumns=True)

    def run(variables: pa.Table, context: pa.Table) -> pa.Table:
        content, named, pointers = None, {}, {}
        # functions come before variables, and of several at one place the first counts
        for row in context.sort_by([("kind", "ascending"), ("handle", "ascending")]).to_pylist():
            tree = json.loads(row["tree"]) if row["tree"] else None
            if row["kind"] == "image":
                content = row["content"]
            elif row["kind"] == "data_types":
                named.setdefault(row["name"], tree)
            else:
                pointers.setdefault(row["address"], row["name"] if tree and tree["kind"] == "array" else f"&{row['name']}")
        out = []
        if content is not None:
            segments = decode.elf(content)["segments"]
            sizes = {n: ast.size_of(t) for n, t in named.items()}
            for v in variables.to_pylist():
                tree = json.loads(v["tree"])
                try:
                    data = decode.memory(content, segments, v["address"], ast.size_of(tree, sizes) or 0)
                except Malformed:
                    continue
                if data:
                    out.append({"kind": v["kind"], "handle": v["handle"], "data": cpp.literals(tree, data, 0, named, pointers, sizes=sizes)})
        return pa.Table.from_pylist(out, pa.schema([("kind", pa.string()), ("handle", pa.int64()), ("data", pa.string())]))

    return sought.groupBy("module_handle").cogroup(context.groupBy("module_handle")).applyInArrow(run, "kind string, handle long, data string")


# Source files.


def paired(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(module_handle, path, file) of source files and the paths (module_handle, idx, path) of a list.

    Both go in order, and a path takes the next file of its name; a path that finds none stops
    those behind it. A task holds the names of one module.
    """
    ready(files.sparkSession)
    name = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("handle"), right.sort_by("idx").to_pylist()
        out, at = [], 0
        for module, handle, short in zip(*(left[c].to_pylist() for c in ("module_handle", "handle", "short"))):
            if at < len(right) and right[at]["short"] == short:
                out.append({"module_handle": module, "path": right[at]["path"], "file": handle})
                at += 1
        return pa.Table.from_pylist(out, pa.schema([("module_handle", pa.int64()), ("path", pa.string()), ("file", pa.int64())]))

    left = files.select("module_handle", "handle", name("name").alias("short"))
    right = paths.select("module_handle", "idx", "path", name("path").alias("short"))
    return left.groupBy("module_handle").cogroup(right.groupBy("module_handle")).applyInArrow(run, "module_handle long, path string, file long")


def type_references(kinds: DataFrame) -> DataFrame:
    """(src, dst, n): how often each type's tree names another one of its module; the first of a name is meant."""

    def uses(text):
        found, todo = Counter(), [json.loads(text)]
        while todo:
            tree = todo.pop()
            if tree["kind"] == "type_name" and tree["refers"]:
                found[tree["refers"]] += 1
            todo += [b["type"] for b in tree.get("bases") or ()] + (tree.get("fields") or []) + (tree.get("members") or []) + (tree.get("params") or [])
            todo += [tree[r] for r in ("element", "underlying", "returns", "class", "value") if isinstance(tree.get(r), dict)]
        return [{"name": n, "n": k} for n, k in found.items()]

    named = kinds.groupBy("module_handle", "name").agg(F.min("handle").alias("dst"))
    counted = tables.decoded(kinds.select("handle", "tree"), uses, "name string, n long").withColumnRenamed("handle", "src")
    return counted.join(by_key(kinds.select(F.col("handle").alias("src"), "module_handle")), "src").join(by_key(named), ["module_handle", "name"]).select("src", "dst", "n")


def routed_types(db: SymbolDb, kinds: DataFrame) -> DataFrame:
    """kinds (as distinct_types() gives them) with their files after both guesses, and only: whether one file alone had the type.

    A class belongs to the file of the last function whose this points to it; then a type of
    several files, or of none, goes to the file whose types refer to it most.
    """
    kinds = cut(kinds.withColumn("only", F.size("files") == 1))
    get = lambda p: F.get_json_object("tree", p)
    first = db["parameter_variables"].groupBy("function").agg(F.min_by(F.struct("name", "tree", "module_handle"), "handle").alias("p")).select("function", "p.*")
    pointed = first.filter((F.col("name") == "this") & (get("$.kind") == "pointer") & (get("$.value.kind") == "type_name") & (get("$.value.forward") == "false"))
    owners = pointed.select("function", "module_handle", get("$.value.refers").alias("name")).join(by_key(db["functions"].select(F.col("handle").alias("function"), "source_file")), "function")
    named = kinds.groupBy("module_handle", "name").agg(F.min("handle").alias("handle"))
    claimed = owners.filter("source_file IS NOT NULL").groupBy("module_handle", "name").agg(F.max_by("source_file", "function").alias("claimed")).join(by_key(named), ["module_handle", "name"]).select("handle", "claimed")
    kinds = cut(kinds.join(by_key(claimed), "handle", "left").withColumn("files", F.when(F.col("claimed").isNotNull(), F.array("claimed")).otherwise(F.col("files"))).drop("claimed"))
    references = type_references(kinds)
    mapped = types.map_to_files(kinds.select(F.col("module_handle").alias("module"), "handle", "files"), references)
    return kinds.drop("files").join(by_key(mapped), "handle")


def source_texts(db: SymbolDb, paths: DataFrame, bodies: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """(module_handle, path, text): the C or C++ file and the header of each path (module_handle, idx, path) that a source file was found for, and lost+found.h with the types of no single file.

    bodies: (address, body) of functions; images: (module_handle, content), for initialisers. Rows
    of one output file meet in a group of theirs.
    """
    pairs = cut(paired(db["source_files"], paths)).filter(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(*ENDINGS))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    base = cpp.PrinterConfig(print_offsets_and_sizes=False, omit_this_parameter=True, substitute_parameter_lists=True)
    code = cpp.PrinterConfig(**{**base.__dict__, "print_storage_information": False, "print_variable_data": True})
    head = cpp.PrinterConfig(**{**base.__dict__, "print_storage_information": False, "make_globals_extern": True, "skip_statics": True, "print_function_bodies": False, "skip_member_functions_outside_types": True})
    data = None if images is None else cut(initialisers(db, images))
    kinds = cut(routed_types(db, distinct_types(db)))
    one = F.size("files") == 1
    columns = ["module_handle", "path", "part", "file", "handle", "text", "spaced"]

    def placed(texts, owners, part, header):
        path = F.concat(stem, F.lit(".h")) if header else F.col("path")
        told = texts.join(by_key(owners), "handle").join(by_key(pairs.select("file", "path")), "file")
        return told.select("module_handle", path.alias("path"), F.lit(part).alias("part"), "file", "handle", "text", "spaced")

    of = lambda kind: db[kind].select("handle", "module_handle", F.col("source_file").alias("file"))
    type_owners = lambda rows: rows.select("handle", "module_handle", F.col("files")[0].alias("file"))
    named = pairs.select("module_handle", "path").distinct()
    header = F.concat(stem, F.lit(".h"))
    macro = C.include_guard(header)
    fixed = lambda path, part, text, spaced: named.select("module_handle", path.alias("path"), F.lit(part).alias("part"), F.lit(-1).cast("long").alias("file"), F.lit(-1).cast("long").alias("handle"), text.alias("text"), F.lit(spaced).alias("spaced"))
    include = F.concat(F.lit(f'{NOT_STARTED}#include "'), F.regexp_extract(header, r"([^/\\]*)$", 1), F.lit('"'))
    begin = F.concat(F.lit(f"{NOT_STARTED}#ifndef "), macro, F.lit("\n#define "), macro)
    parts = [
        fixed(F.col("path"), 0, include, 1),
        placed(types_text(kinds.filter(one & F.col("only")), code), type_owners(kinds.filter(one)), 1, False),
        placed(globals_text(db, code, data), of("global_variables"), 2, False),
        placed(functions_text(db, code, bodies, data), of("functions"), 3, False),
        fixed(header, 0, begin, 1),
        placed(types_text(kinds.filter(one & ~F.col("only")), head), type_owners(kinds.filter(one)), 1, True),
        placed(globals_text(db, head), of("global_variables"), 2, True),
        placed(functions_text(db, head), of("functions"), 3, True),
        fixed(header, 4, F.concat(F.lit("#endif // "), macro), 1),
        types_text(kinds.filter(~one), base).join(by_key(kinds.select("handle", "module_handle")), "handle").select("module_handle", F.lit(LOST).alias("path"), F.lit(1).alias("part"), F.lit(-1).cast("long").alias("file"), "handle", "text", "spaced"),
    ]
    rows = parts[0].select(*columns)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*columns))
    order = Window.partitionBy("module_handle", "path").orderBy("part", "file", "handle")
    # a header's variables are set off from its functions
    before, last = F.lag("spaced").over(order), F.lag("part").over(order)
    blank = before.isNotNull() & ((F.col("spaced") == 1) | (before == 1) | ((last == 2) & (F.col("part") > 2) & F.endswith("path", F.lit(".h"))))
    lines = rows.withColumn("text", F.concat(F.when(blank, "\n").otherwise(""), "text", F.lit("\n")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "file", "handle", "text"))), lambda s: s["text"]), "")
    return lines.groupBy("module_handle", "path").agg(whole.alias("text"))


def write_sources(texts: DataFrame, folder: str) -> list[str]:
    """Writes (path, text) rows below a folder, one file at a time, and returns the paths written.

    A file that somebody has begun to work on stays as it is. Paths that lead out of the folder are refused.
    """
    done, top = [], os.path.realpath(folder)
    for row in texts.select("path", "text").toLocalIterator():
        path = os.path.realpath(os.path.join(top, row["path"]))
        if os.path.commonpath([top, path]) != top:
            raise ValueError(f"{row['path']} is not below {folder}")
        if os.path.exists(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                start = f.read(len(NOT_STARTED))
            if start and not start.startswith(NOT_STARTED.strip()):
                continue
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(row["text"])
        done.append(row["path"])
    return done
