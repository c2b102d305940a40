"""Types, graphs and reports (B rows, F05, J07 to J16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from debuglens.functions import ast
from debuglens.functions import columns as C
from debuglens.operators import graph, lookup, passes, reports, types
from debuglens.plans.registry import FN, GV, SF, Bridge, query
from debuglens.session import dealt


def _struct(b: Bridge):
    """A struct type for each part: a number, a pointer, an array and bitfields."""
    k, n = F.col("h").cast("string"), (F.col("n") % 9).cast("string")
    stab = F.concat(F.lit("T"), k, F.lit(":T(1,1)=s16i:(0,1)=r(0,1);-2147483648;2147483647;,0,32;p:(1,2)=*(0,2)=r(0,2);0;255;,32,32;a:(1,3)=ar(0,9)=r(0,9);0;4294967295;;0;"), n, F.lit(";(0,2),64,32;b:(0,1),96,5;c:(0,1),101,27;;"))
    return types.trees(b.table("part").select(F.col("p_partkey").alias("h"), F.col("p_size").alias("n")).withColumn("stab", stab).select("h", "stab"))


FIELDS = "f(name, kind, pos) AS (VALUES ('i', 'builtin', 0), ('p', 'pointer', 4), ('a', 'array', 8), ('b', 'bitfield', 12), ('c', 'bitfield', 12))"


@query("j09", f"WITH {FIELDS} SELECT p_partkey AS h, name, kind, CAST(pos AS BIGINT) AS \"offset\" FROM part, f")
def j09(b: Bridge):
    """Trees of STABS types, with places in bytes."""
    return types.each(_struct(b), lambda t: [{"name": f["name"], "kind": f["kind"], "offset": f["offset"]} for f in t["fields"]], "name string, kind string, offset long")


@query("j11", "SELECT p_partkey AS h, v.name, CAST(v.bits AS BIGINT) AS bits, CAST(v.pos AS BIGINT) AS at_bit FROM part, (VALUES ('b', 5, 0), ('c', 27, 5)) v(name, bits, pos)")
def j11(b: Bridge):
    """Bitfields in their storage units."""
    return types.each(_struct(b), lambda t: [{"name": f["name"], "bits": f["bits"], "at_bit": f["at"]} for f in t["fields"] if f["kind"] == "bitfield"], "name string, bits long, at_bit long")


@query("e13", "SELECT p_partkey AS h, CAST(16 AS BIGINT) AS size, CAST(p_size % 9 + 1 AS BIGINT) AS array_size FROM part")
def e13(b: Bridge):
    return types.each(_struct(b), lambda t: [{"size": ast.size_of(t), "array_size": ast.size_of(t["fields"][2])}], "size long, array_size long")


@query("b06", "SELECT p_partkey AS h, 'struct T' || p_partkey || ' { // 0x10' || chr(10) || chr(9) || '/* 0x0 */ signed_32 i;' || chr(10) || chr(9) || '/* 0x4 */ unsigned_8 *p;' || chr(10) || chr(9) || '/* 0x8 */ unsigned_8 a[' || (p_size % 9 + 1) || '];' || chr(10) || chr(9) || '/* 0xc:00 */ signed_32 b : 5;' || chr(10) || chr(9) || '/* 0xc:05 */ signed_32 c : 27;' || chr(10) || '}' AS text FROM part")
def b06(b: Bridge):
    return types.each(_struct(b), lambda t: [{"text": ast.declaration(t)}], "text string")


@query("j15", "SELECT p_partkey AS h, v.path, CASE v.path WHEN '.i' THEN CAST(-p_partkey AS VARCHAR) WHEN '.p' THEN CASE WHEN p_partkey = 0 THEN 'NULL' ELSE '0x' || lower(to_hex(p_partkey)) END WHEN '.b' THEN CAST((p_partkey + 16) % 32 - 16 AS VARCHAR) ELSE CAST(p_partkey // 32 AS VARCHAR) END AS value FROM part, (VALUES ('.i'), ('.p'), ('.b'), ('.c')) v(path)")
def j15(b: Bridge):
    """Variables' bytes read through their types."""
    h = F.col("h")
    data = F.concat(C.le_bytes(-h, 4), C.le_bytes(h, 4), F.lit(b"\1\2\3\4"), C.le_bytes(h, 4))
    return types.refined(_struct(b).withColumn("data", data)).filter("path NOT LIKE '.a%'")


@query("j16", "SELECT p_partkey AS h, k, CASE WHEN k < 4 THEN k + 1 WHEN k < 8 THEN (p_partkey >> CAST(8 * (k - 4) AS BIGINT)) & 255 ELSE 9 END AS value FROM part, range(9) v(k) WHERE k <= p_size % 9")
def j16(b: Bridge):
    """Elements of an array, each a literal, up to its end."""
    data = F.concat(C.le_bytes(F.col("h"), 4), C.le_bytes(F.col("h"), 4), F.lit(b"\1\2\3\4"), C.le_bytes(F.col("h"), 4), F.lit(b"\x09"))
    leaves = types.refined(_struct(b).withColumn("data", data)).filter("path LIKE '.a[%'")
    k = F.regexp_extract("path", r"\[(\d+)\]", 1).cast("long")
    return leaves.select("h", k.alias("k"), F.col("value").cast("long").alias("value"))


def _variants(b: Bridge):
    stab = F.concat(F.lit("N:T(1,"), (F.col("p_partkey") % 50).cast("string"), F.lit(")=s"), (F.col("p_size") % 3 + 4).cast("string"), F.lit("m:(0,1),0,32;;"))
    rows = b.table("part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), stab.alias("stab"))
    return types.trees(rows)


@query("f05", "SELECT p_name AS name, min(p_partkey) AS representative, count(DISTINCT p_brand) AS files FROM part GROUP BY p_name, p_size % 3")
def f05(b: Bridge):
    """Types of one name and shape become one row, whatever their numbers; the first is kept."""
    return types.deduplicated(_variants(b)).select("name", "representative", F.size("files").cast("long").alias("files"))


@query("j07", "SELECT name, n > 1 AS differs FROM (SELECT p_name AS name, count(DISTINCT p_size % 3) AS n FROM part GROUP BY p_name) q")
def j07(b: Bridge):
    """Names whose types differ between files, and why."""
    kept = types.deduplicated(_variants(b)).groupBy("name").agg(F.max("reason").alias("reason"))
    return kept.select("name", F.coalesce(F.col("reason") == "differs: size", F.lit(False)).alias("differs"))


#: The nine lists of a document, each from the whole of a table.
NINE = {
    "data_types": ("part", "p_partkey", "p_type", None),
    "functions": ("part", "p_partkey", "p_name", "p_partkey * 64"),
    "global_variables": ("supplier", "s_suppkey", "s_name", "s_suppkey * 640"),
    "labels": ("customer", "c_custkey", "c_name", "c_custkey * 8"),
    "local_variables": ("orders", "o_orderkey", "o_orderstatus", None),
    "modules": ("region", "r_regionkey", "r_name", None),
    "parameter_variables": ("events", "event_id", "event_type", None),
    "sections": ("nation", "n_nationkey", "n_name", "n_nationkey * 4096"),
    "source_files": ("nation", "n_nationkey", "n_name", "n_nationkey * 4096"),
}
NINE_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST({key} AS BIGINT) AS handle, {name} AS name, CAST({address or 'NULL'} AS BIGINT) AS address FROM {table}" for kind, (table, key, name, address) in NINE.items())


def _nine(b: Bridge):
    return {kind: b.table(table).selectExpr(f"CAST({key} AS BIGINT) AS handle", f"{name} AS name", f"CAST({address or 'NULL'} AS BIGINT) AS address", "CAST(NULL AS BIGINT) AS size") for kind, (table, key, name, address) in NINE.items()}


@query("b01", f"SELECT kind, handle, name, address FROM ({NINE_SQL}) q")
def b01(b: Bridge):
    """One document of nine lists, read again from its lines: a list's head says whose the lines after it are."""
    lines = reports.document_lines({kind: reports.symbol_json(rows) for kind, rows in _nine(b).items()}, "debuglens")
    kinds = F.create_map(*[F.lit(x) for k, kind in enumerate(NINE) for x in (2 * k + 2, kind)])
    body = lines.filter(F.try_element_at(kinds, F.col("part")).isNotNull() & F.startswith("line", F.lit("{")))
    said = F.from_json(F.regexp_replace("line", ",$", ""), "name string, address long")
    return body.select(F.try_element_at(kinds, F.col("part")).alias("kind"), F.col("ord").alias("handle"), said.alias("j")).select("kind", "handle", "j.name", "j.address")


@query("b01_whole", f"SELECT count(*) + 1 + {len(NINE)} + 2 AS lines FROM ({NINE_SQL}) q")
def b01_whole(b: Bridge):
    lines = reports.document_lines({kind: reports.symbol_json(rows) for kind, rows in _nine(b).items()}, "debuglens")
    return lines.agg(F.count("*").alias("lines"))


@query("b02", f"WITH {FN} SELECT handle, CASE WHEN handle % 3 <> 0 THEN name END AS name, CASE WHEN handle % 5 <> 0 THEN address END AS address, CASE WHEN size % 2 <> 0 THEN size END AS size FROM fn")
def b02(b: Bridge):
    """Symbols as JSON, read again: what is empty is left out."""
    rows = b.functions.select("handle", F.when(F.col("handle") % 3 == 0, "").otherwise(F.col("name")).alias("name"), F.when(F.col("handle") % 5 != 0, F.col("address")).alias("address"), F.when(F.col("size") % 2 == 0, 0).otherwise(F.col("size")).cast("long").alias("size"))
    return reports.symbol_json(rows).select("handle", F.from_json("json", "name string, address long, size long").alias("j")).select("handle", "j.*")


@query("b10", "SELECT l_orderkey AS o, l_linenumber AS ln, CASE WHEN l_linenumber % 2 = 0 THEN '/* 0x' || lower(to_hex(l_partkey + 16)) || '(sp) */ ' ELSE '/* -0x' || lower(to_hex(l_partkey + 1)) || '(caller sp) */ ' END AS text FROM lineitem")
def b10(b: Bridge):
    even = F.col("l_linenumber") % 2 == 0
    text = reports.stack_comment(F.when(even, F.col("l_partkey")).otherwise(-F.col("l_partkey") - 1), F.when(even, 16))
    return b.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), text.alias("text"))


@query("b13", "SELECT 'digraph type_dependencies {' AS line UNION ALL SELECT '}' UNION ALL SELECT chr(9) || p_partkey || ' [label=\"' || p_name || '\"]' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT DISTINCT chr(9) || l_partkey || ' -> ' || l_suppkey || ';' FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 2 = 0 AND l_suppkey IN (SELECT p_partkey FROM part)")
def b13(b: Bridge):
    nodes = b.functions.filter("handle % 2 = 0").select(F.col("handle").alias("id"), F.col("name").alias("label"))
    made = b.table("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("reference").alias("kind"), F.lit(False).alias("is_forward_declared"))
    return reports.dot_lines(nodes, graph.dependencies(made)).select("line")


@query("b15", "SELECT p_brand AS file, v.field, CASE v.field WHEN 'magic' THEN 28681 WHEN 'file_descriptor_count' THEN 1 WHEN 'procedure_descriptor_count' THEN 1 ELSE count(*) END AS value FROM part, (VALUES ('magic'), ('file_descriptor_count'), ('procedure_descriptor_count'), ('local_symbol_count'), ('external_symbols_count')) v(field) GROUP BY 1, 2")
def b15(b: Bridge):
    """The symbolic headers of .mdebug sections, a line for each field."""
    from debuglens.plans.formats import _brands, _forged, _mdebug
    from debuglens.sources import decode, layout, tables

    fields = ["magic", "file_descriptor_count", "procedure_descriptor_count", "local_symbol_count", "external_symbols_count"]

    def rows(content):
        section = decode.section_named(decode.elf(content)["sections"], ".mdebug")
        return [layout.SYMBOLIC_HEADER.read(content, section["offset"], "symbolic header")]

    headers = tables.decoded(_forged(_brands(b), "file", _mdebug), rows, ", ".join(f"{f} long" for f in fields))
    return reports.header_rows(headers, "file", fields)


@query("b16", f"WITH {FN}, g AS (SELECT handle * 3 + handle % 2 AS handle, file FROM fn) SELECT handle, lag(file) OVER (ORDER BY handle) IS DISTINCT FROM file AS is_break FROM g")
def b16(b: Bridge):
    """A report names the file wherever it changes from one function to the next, whatever gaps their handles have."""
    rows = b.functions.select((F.col("handle") * 3 + F.col("handle") % 2).alias("handle"), "file")
    return reports.file_breaks(rows, "file").select("handle", "is_break")


@query("b17", "SELECT p_name AS name, p_brand AS file FROM part GROUP BY 1, 2")
def b17(b: Bridge):
    return b.functions.select("name", "file").distinct()


@query("b18", f"WITH {FN} SELECT handle, lpad(lower(to_hex(address)), 8, '0') || ' ' || name AS line FROM fn")
def b18(b: Bridge):
    return reports.label_lines(b.functions)


@query("b18_files", f"WITH {SF} SELECT handle, lpad(lower(to_hex(address)), 8, '0') || ' ' || name AS line FROM sf")
def b18_files(b: Bridge):
    return reports.file_lines(b.source_files)


@query("b18_sections", f"WITH {SF} SELECT handle, lpad(lower(to_hex(address)), 8, '0') || ' ' || lpad(lower(to_hex(size)), 8, '0') || ' ' || name AS line FROM sf")
def b18_sections(b: Bridge):
    return reports.section_lines(b.source_files)


@query("b18_includes", "SELECT DISTINCT '#include \"' || p_type || '.h\"' AS line FROM part")
def b18_includes(b: Bridge):
    rows = b.table("part").select(F.concat("p_type", F.lit(".h")).alias("path"))
    return reports.include_lines(rows, "path").select("line")


@query("b14_elf", "SELECT p_brand AS file, lpad(lower(to_hex(p_partkey * 64)), 8, '0') || ' ' || lpad(CAST(p_size AS VARCHAR), 8, ' ') || ' ' || rpad(['NOTYPE', 'OBJECT', 'FUNC', 'SECTION', 'FILE'][p_partkey % 5 + 1], 8, ' ') || 'GLOBAL  ' || rpad(['DEFAULT', 'INTERNAL', 'HIDDEN', 'PROTECTED'][p_partkey % 4 + 1], 10, ' ') || p_name || '_' || p_partkey AS line FROM part")
def b14_elf(b: Bridge):
    from debuglens.plans.formats import _brands, _elf, _forged
    from debuglens.sources import tables

    return reports.elf_lines(tables.elf_symbols(_forged(_brands(b), "file", _elf))).select("file", "line")


@query("b14_sndll", "SELECT p_brand AS file, lpad(['NIL', 'EXTERNAL', 'RELATIVE', 'WEAK', 'ABSOLUTE', '5'][p_partkey % 6 + 1], 8, ' ') || ' ' || lpad(lower(to_hex(p_partkey * 8)), 8, '0') || ' ' || CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE '' END AS line FROM part")
def b14_sndll(b: Bridge):
    from debuglens.plans.formats import _brands, _forged, _sndll
    from debuglens.sources import tables

    files = _forged(_brands(b), "file", _sndll).withColumn("address", F.lit(None).cast("long"))
    return reports.sndll_lines(tables.sndll_symbols(files)).select("file", "line")


@query("b14_mdebug", "SELECT p_brand AS file, lpad(lower(to_hex(p_partkey)), 8, '0') || '  0 ' || lpad(CAST(p_partkey % 20 AS VARCHAR), 2, ' ') || ' ' || 'stab 80       ' || p_name || ':t' || p_partkey || '=0' AS line FROM part")
def b14_mdebug(b: Bridge):
    from debuglens.plans.formats import _brands, _forged, _mdebug
    from debuglens.sources import tables

    return reports.mdebug_lines(tables.mdebug_table(_forged(_brands(b), "file", _mdebug), "symbols", tables.MDEBUG)).select("file", "line")


@query("b14_dwarf", "SELECT p_brand AS file, line FROM part, (VALUES (0), (1), (2), (3)) v(k), LATERAL (SELECT CASE k WHEN 0 THEN chr(9) || 'subroutine' WHEN 1 THEN chr(9) || chr(9) || 'name \"' || p_name || '\"' WHEN 2 THEN chr(9) || chr(9) || 'low_pc 0x' || lower(to_hex(p_partkey * 64)) ELSE chr(9) || chr(9) || 'high_pc 0x' || lower(to_hex(p_partkey * 64 + p_size)) END AS line) l UNION ALL SELECT file, line FROM (SELECT p_brand AS file, p_type AS unit, min(p_partkey) AS low FROM part GROUP BY 1, 2) q, (VALUES (0), (1), (2)) v(k), LATERAL (SELECT CASE k WHEN 0 THEN 'compile_unit' WHEN 1 THEN chr(9) || 'name \"' || unit || '\"' ELSE chr(9) || 'low_pc 0x' || lower(to_hex(low)) END AS line) l")
def b14_dwarf(b: Bridge):
    """Entries and attributes of .debug sections as indented lines, but for the places of siblings."""
    from debuglens.plans.formats import _brands, _debug, _forged
    from debuglens.sources import tables

    read = tables.dwarf_all(_forged(_brands(b), "file", _debug))
    entries = read.filter("part = 'entry'").select("file", "die", "tag", "depth")
    attrs = read.filter("part = 'attr' AND attr <> 'sibling'").select("file", "die", "seq", "attr", "number", "text", "block")
    return reports.dwarf_lines(entries, attrs, "file").select("file", "line")


@query("b19", "SELECT CASE p_partkey % 4 WHEN 0 THEN 'ELF' WHEN 3 THEN 'unknown' ELSE 'SNDLL' END AS type, count(*) AS n FROM part GROUP BY 1")
def b19(b: Bridge):
    from debuglens.plans.formats import a04

    return a04(b).groupBy("type").agg(F.count("*").alias("n"))


@query("b20", "SELECT p_brand || '.' || CASE WHEN p_size % 2 = 0 THEN 'c' ELSE 'h' END AS path, count(*) AS n FROM part GROUP BY 1")
def b20(b: Bridge):
    """Which path each type is written to."""
    path = F.concat("file", F.lit("."), F.when(F.col("size") % 2 == 0, "c").otherwise("h"))
    return b.functions.groupBy(path.alias("path")).agg(F.count("*").alias("n"))


@query("b21", "SELECT p_partkey || '.c' AS path FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 6 = 0")
def b21(b: Bridge):
    h = F.col("p_partkey")
    paths = b.table("part").select(F.concat(h.cast("string"), F.lit(".c")).alias("path"), "p_partkey")
    there = paths.filter("p_partkey % 3 = 0").select("path", F.when(F.col("p_partkey") % 12 == 0, "").when(F.col("p_partkey") % 6 == 0, "// STATUS: NOT STARTED\n").otherwise("int x;").alias("text"))
    return reports.overwritable(paths.select("path"), there)


@query("b14", "SELECT p_partkey AS h, lpad(CASE p_partkey % 3 WHEN 0 THEN 'NIL' WHEN 1 THEN 'EXTERNAL' ELSE 'ABSOLUTE' END, 8, ' ') || ' ' || lpad(lower(to_hex(p_partkey * 8)), 8, '0') || ' ' || p_name AS line FROM part")
def b14(b: Bridge):
    kind = C.lookup({0: "NIL", 1: "EXTERNAL", 2: "ABSOLUTE"}, (F.col("p_partkey") % 3).cast("int"))
    return b.table("part").select(F.col("p_partkey").alias("h"), F.format_string("%8s %08x %s", kind, F.col("p_partkey") * 8, F.col("p_name")).alias("line"))


@query("i45", "SELECT p_partkey AS h, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey // 2 AS VARCHAR) || '.f' ELSE CAST(p_partkey // 2 AS VARCHAR) || '.5f' END AS text FROM part")
def i45(b: Bridge):
    from debuglens.sources.tables import decoded

    rows = b.table("part").select(F.col("p_partkey").alias("h"), (F.col("p_partkey") / 2).cast("string").alias("v"))
    return decoded(dealt(rows), lambda v: [{"text": ast.float_text(float(v), 9) + "f"}], "text string")


@query("d21", f"WITH {SF} SELECT name, idx FROM (SELECT name, CAST(row_number() OVER (ORDER BY handle) - 1 AS BIGINT) AS idx FROM sf) q")
def d21(b: Bridge):
    """Source files paired in order with the paths of a list."""
    return lookup.dense_index(b.source_files.select("handle", "name")).select("name", F.col("idx").cast("long").alias("idx"))


@query("a34", "SELECT l_suppkey AS unit, arg_min(l_partkey, l_orderkey * 10 + l_linenumber) AS overlay FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey * 10 + l_linenumber IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem GROUP BY 1 HAVING count(*) = 1)) q GROUP BY l_suppkey")
def a34(b: Bridge):
    """The first overlay that lists a compile unit has it."""
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    once = b.table("lineitem").groupBy(seq.alias("seq")).agg(F.count("*").alias("n"), F.min("l_suppkey").alias("unit"), F.min("l_partkey").alias("overlay")).filter("n = 1")
    return passes.first_of(once, ["unit"], "seq", "overlay")
