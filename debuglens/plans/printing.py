"""C++ reports and source files of forged programs: a module for each 64 rows of part, of two source files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from debuglens.functions import cpp
from debuglens.operators import printing
from debuglens.operators.analyser import STABS_BASE
from debuglens.operators.importer import import_files
from debuglens.plans.registry import Bridge, query
from debuglens.session import by_key, cut, dealt, ready
from debuglens.sources import forge

ROWS, DATA, RECORD = 64, 0x100000, 12


def _symbols(r: dict) -> list[dict]:
    """A struct that points to itself, a function with parameters and a local, and a variable of the struct."""
    k, odd = r["k"], r["k"] % 2
    at = lambda text, value, kind, index, place=1: {"string": text, "value": value, "symbol_type": kind, "symbol_class": place, "index": index}
    stab = lambda text, value, code, place=0: at(text, value, 0, STABS_BASE + code, place)
    this = [stab(f"this:P(2,{k})", 4, 0x40)] if k % 3 == 0 else []
    return [
        stab(f"T{k}:T(1,{k})=s{RECORD if odd else 8}m:(0,1),0,32;next:(2,{k})=*(1,{k}),32,32;{'both:(3,1),64,32;' if odd else ''};", 0, 0x80),
        at(f"f{k}", k * 64, 14 if k % 5 == 0 else 6, 0),
        stab(f"f{k}:{'f' if k % 5 == 0 else 'F'}(0,1)", k * 64, 0x24),
        *this,
        stab("a:p(0,1)", 16, 0xA0),
        at(f"f{k}", r["size"], 8, 0),
        stab("x:(0,1)", 8, 0x80),
        stab("", 4, 0xC0),
        stab("", r["size"], 0xE0),
        stab("", 0, 0x24),
        stab(f"t{k}:G(1,{k})", 0, 0x20, 13),
    ]


def _image(rows: list[dict]) -> bytes:
    """A module's file; the variables' bytes are one segment."""
    n, shared = rows[0]["module"], [{"string": s, "value": 0, "symbol_type": 0, "symbol_class": 0, "index": STABS_BASE + 0x80} for s in ("int:t(0,1)=r(0,1);-2147483648;2147483647;", "Both:T(3,1)=s4v:(0,1),0,32;;")]
    files = [{"path": f"src/m{n}_{odd}.c", "address": 4096, "symbols": [*shared, *(s for r in rows if r["k"] % 2 == odd for s in _symbols(r))]} for odd in (0, 1)]
    place = lambda r: DATA + r["k"] % ROWS * RECORD
    externals = [{"string": f"t{r['k']}", "value": place(r), "symbol_type": 1, "symbol_class": 13, "index": 5} for r in rows]
    data = bytearray(ROWS * RECORD)
    for r in rows:
        words = (r["k"], place(r) if r["k"] % 4 else 0, r["size"])
        data[place(r) - DATA : place(r) - DATA + RECORD] = b"".join(w.to_bytes(4, "little") for w in words)
    section = forge.mdebug(files, externals, offset=52 + len(data))
    return forge.elf([{"name": ".data", "content": bytes(data), "addr": DATA}, {"name": ".mdebug", "content": section}], [{"type": 1, "offset": 52, "vaddr": DATA, "filesz": len(data), "memsz": len(data)}])


def _files(b: Bridge):
    ready(b.spark)
    rows = b.table("part").select(F.floor(F.col("p_partkey") / ROWS).cast("long").alias("module"), F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("size"))

    def run(table: pa.Table) -> pa.Table:
        got = table.sort_by("k").to_pylist()
        return pa.table({"path": pa.array([f"/images/{got[0]['module']}"]), "content": pa.array([_image(got)], pa.binary())})

    return cut(dealt(rows, "module").groupBy("module").applyInArrow(run, "path string, content binary"))


_PROGRAMS: dict = {}


def _program(b: Bridge):
    """(files, database) of the forged program, imported once a session: its lists are checkpoints."""
    key = (b.spark.sparkContext.applicationId, b.sf_dir)
    if key not in _PROGRAMS:
        files = _files(b)
        _PROGRAMS[key] = (files, import_files(files))
    return _PROGRAMS[key]


def _named(db, rows, key="module_handle"):
    return rows.join(by_key(db["modules"].select(F.col("handle").alias(key), F.col("name").alias("module"))), key)


P = f"p AS (SELECT '/images/' || (p_partkey // {ROWS}) AS module, p_partkey // {ROWS} AS n, p_partkey AS k, CAST(p_size AS BIGINT) AS size FROM part)"
N, T = "chr(10)", "chr(9)"
THIS = "CASE WHEN k % 3 = 0 THEN '/* a0 4 */ T' || k || ' *this, ' ELSE '' END"
HEAD = "CASE WHEN k % 5 = 0 THEN 'static ' ELSE '' END || 'int f' || k"


@query("b06_functions", f"WITH {P} SELECT module, '/* ' || lpad(lower(to_hex(k * 64)), 8, '0') || ' ' || lpad(lower(to_hex(size)), 8, '0') || ' */ ' || {HEAD} || '(' || {THIS} || '/* 0x10(caller sp) */ int a) {{' || {N} || {T} || '/* 0x8(caller sp) */ int x;' || {N} || '}}' AS text FROM p")
def b06_functions(b: Bridge):
    """Functions with their parameters, locals and where these stand."""
    _, db = _program(b)
    texts = printing.functions_text(db).join(by_key(db["functions"].select("handle", "module_handle")), "handle")
    return _named(db, texts).select("module", "text")


@query("b08_lists", f"WITH {P} SELECT module, {HEAD} || '(' || CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN '/* a0 4 */ T' || k || ' *this, ' ELSE '' END || 'int a);' AS text FROM p WHERE k % 2 = 0 UNION ALL SELECT module, 'int f' || k || '(' || {THIS} || '/* 0x10(caller sp) */ int a);' FROM p WHERE k % 2 = 1 AND k % 5 <> 0")
def b08_lists(b: Bridge):
    """Parameter lists: without this and storage for even functions, with both and without statics for odd ones."""
    _, db = _program(b)
    odd = F.regexp_extract("name", r"(\d+)", 1).cast("long") % 2 == 1
    plain = cpp.PrinterConfig(print_function_bodies=False, print_storage_information=False, omit_this_parameter=True)
    out = None
    for config, rows in ((plain, db["functions"].filter(~odd)), (cpp.PrinterConfig(print_function_bodies=False, skip_statics=True, caller_stack_offsets=True), db["functions"].filter(odd))):
        part = printing.functions_text(db.with_table("functions", rows), config).join(by_key(rows.select("handle", "module_handle")), "handle")
        out = part if out is None else out.unionByName(part)
    # the second form has address and size before it
    return _named(db, out).select("module", F.regexp_replace("text", r"^/\* [0-9a-f]{8} [0-9a-f]{8} \*/ ", "").alias("text"))


VALUE = f"'{{' || {N} || {T} || '/* .m = */ ' || k || ',' || {N} || {T} || '/* .next = */ ' || CASE WHEN k % 4 = 0 THEN 'NULL' ELSE '&t' || k END || CASE WHEN k % 2 = 1 THEN ',' || {N} || {T} || '/* .both = */ {{' || {N} || {T} || {T} || '/* .v = */ ' || size || {N} || {T} || '}}' ELSE '' END || {N} || '}}'"


@query("b09_nested", f"WITH {P} SELECT module, '/* sdata ' || lower(to_hex({DATA} + k % {ROWS} * {RECORD})) || ' */ T' || k || ' t' || k || ' = ' || {VALUE} || ';' AS text FROM p")
def b09_nested(b: Bridge):
    """Variables with initialisers read from the file: nested in braces, pointers by the names of what they point to."""
    files, db = _program(b)
    images = files.join(by_key(db["modules"].select(F.col("handle").alias("module_handle"), F.col("name").alias("path"))), "path").select("module_handle", "content")
    texts = printing.globals_text(db, cpp.PrinterConfig(print_variable_data=True), printing.initialisers(db, images))
    return _named(db, texts.join(by_key(db["global_variables"].select("handle", "module_handle")), "handle")).select("module", "text")


BLOCK = f"'{cpp.RULE}' || {N} || '// FILE -- src/m' || n || '_' || k % 2 || '.c' || {N} || '{cpp.RULE}' || {N}"


@query("b16_report", f"WITH {P}, r AS (SELECT n, k, CASE WHEN k = min(k) OVER (PARTITION BY n, k % 2) THEN {N} || {BLOCK} || {N} ELSE '' END AS above FROM p) SELECT above || '/* sdata ' || lower(to_hex({DATA} + k % {ROWS} * {RECORD})) || ' */ T' || k || ' t' || k || ';' AS line FROM r")
def b16_report(b: Bridge):
    """The report of global variables: a block names the file wherever it changes."""
    _, db = _program(b)
    return printing.by_file(db, "global_variables", printing.globals_text(db)).select("line")


@query("b17_types", f"WITH {P} SELECT module, 'T' || k AS name, 'struct T' || k || ' {{ // 0x' || CASE WHEN k % 2 = 1 THEN 'c' ELSE '8' END || {N} || {T} || '/* 0x0 */ int m;' || {N} || {T} || '/* 0x4 */ T' || k || ' *next;' || {N} || CASE WHEN k % 2 = 1 THEN {T} || '/* 0x8 */ Both both;' || {N} ELSE '' END || '}};' AS text FROM p UNION ALL SELECT DISTINCT module, 'Both', 'struct Both {{ // 0x4' || {N} || {T} || '/* 0x0 */ int v;' || {N} || '}};' FROM p")
def b17_types(b: Bridge):
    """The types of each module, deduplicated over its files; built-in ones have no definition."""
    _, db = _program(b)
    kinds = cut(printing.distinct_types(db))
    texts = printing.types_text(kinds).join(by_key(kinds.select("handle", "module_handle", "name")), "handle")
    return _named(db, texts).select("module", "name", "text")


GUARD = "'SRC_M' || n || '_' || o || '_H'"
BODY = "CASE WHEN k % 7 = 0 THEN chr(9) || chr(10) || chr(9) || 'return ' || k || ';' || chr(10) ELSE '' END"


@query(
    "b20_files",
    f"""WITH {P}, q AS (SELECT *, k % 2 AS o, 'T' || k || ' t' || k AS v FROM p),
g AS (SELECT module, n, o,
 string_agg({N} || 'struct T' || k || ' {{' || {N} || {T} || 'int m;' || {N} || {T} || 'T' || k || ' *next;' || {N} || CASE WHEN o = 1 THEN {T} || 'Both both;' || {N} ELSE '' END || '}};' || {N}, '' ORDER BY k) AS types,
 string_agg({N} || v || ' = ' || {VALUE} || ';' || {N}, '' ORDER BY k) AS vars,
 string_agg({N} || {HEAD} || '(int a) {{' || {N} || {T} || 'int x;' || {N} || {BODY} || '}}' || {N}, '' ORDER BY k) AS fns,
 string_agg('extern ' || v || ';' || {N}, '' ORDER BY k) AS externs,
 coalesce(string_agg('int f' || k || '(int a);' || {N}, '' ORDER BY k) FILTER (WHERE k % 5 <> 0), '') AS protos,
 bool_or(k % 5 <> 0) AS any_proto
 FROM q GROUP BY module, n, o)
SELECT module, 'src/m' || n || '_' || o || '.c' AS path, '// STATUS: NOT STARTED' || {N} || {N} || '#include "m' || n || '_' || o || '.h"' || {N} || types || vars || fns AS text FROM g
UNION ALL SELECT module, 'src/m' || n || '_' || o || '.h', '// STATUS: NOT STARTED' || {N} || {N} || '#ifndef ' || {GUARD} || {N} || '#define ' || {GUARD} || {N} || CASE WHEN o = 1 THEN {N} || 'struct Both {{' || {N} || {T} || 'int v;' || {N} || '}};' || {N} ELSE '' END || {N} || externs || CASE WHEN any_proto THEN {N} ELSE '' END || protos || {N} || '#endif // ' || {GUARD} || {N} FROM g""",
)
def b20_files(b: Bridge):
    """Source files and headers written again from symbols, types routed to the file that refers to them, with bodies and initialisers."""
    files, db = _program(b)
    handles = db["modules"].select(F.col("handle").alias("module_handle"), F.col("name").alias("path"))
    images = files.join(by_key(handles), "path").select("module_handle", "content")
    number = F.regexp_extract("path", r"(\d+)$", 1)
    listed = handles.select("module_handle", F.posexplode(F.array(*(F.concat(F.lit("src/m"), number, F.lit(f"_{odd}.c")) for odd in (0, 1)))).alias("idx", "path"))
    k = F.col("p_partkey")
    bodies = b.table("part").filter(k % 7 == 0).select((k * 64).alias("address"), F.concat(F.lit("\treturn "), k.cast("string"), F.lit(";\n")).alias("body"))
    texts = printing.source_texts(db, listed, bodies, images)
    return _named(db, texts).select("module", "path", "text")


@query("b11_blocks", f"WITH {P} SELECT '// File written by debuglens 1' || {N} || '// ' || {N} || '// Input file:' || {N} || '//   parts' || {N} || '// Toolchain version(s):' || {N} || (SELECT string_agg('//   ' || t, {N} ORDER BY t) FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'unknown' END AS t FROM part) q) || {N} || '// Built-in types:' || {N} || '//   ' || rpad('int', 25, ' ') || 'signed_32' AS text")
def b11_blocks(b: Bridge):
    """The comment blocks above a report of types."""
    _, db = _program(b)
    chains = b.table("part").select(F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("toolchains"))
    return b.spark.createDataFrame([(printing.types_head(db, "parts", "debuglens", "1", chains),)], "text string")
