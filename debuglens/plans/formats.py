"""Round trips: rows of the driver's tables written as symbol files or STABS text and read back by the decoders."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debuglens.functions import demangle, stabs
from debuglens.functions import columns as C
from debuglens.operators import lookup, passes
from debuglens.plans.registry import Bridge, query
from debuglens.session import dealt, ready
from debuglens.sources import decode, forge, tables


class Rows:
    """The rows of an Arrow table as dicts, a thousand of which are there at a time."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __len__(self) -> int:
        return self.table.num_rows

    def __getitem__(self, k: int) -> dict:
        return self.table.slice(k, 1).to_pylist()[0]

    def __iter__(self):
        for batch in self.table.to_batches(1000):
            yield from batch.to_pylist()


def _forged(rows: DataFrame, key: str, build) -> DataFrame:
    """(key, content): a file built from each group's rows, Rows in order of the second column."""

    order = rows.columns[1]
    ready(rows.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        got = Rows(table.sort_by(order))
        return pa.table({key: pa.array([got[0][key]], table.schema.field(key).type), "content": pa.array([build(got)], pa.binary())})

    return rows.groupBy(key).applyInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")


def _brands(b: Bridge) -> DataFrame:
    return b.table("part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("h"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"), F.col("p_type").alias("ptype"))


def _elf(rows: list[dict]) -> bytes:
    symbols = [{"name": f"{r['name']}_{r['h']}", "value": r["h"] * 64, "size": r["size"], "type": r["h"] % 5, "bind": 1, "visibility": r["h"] % 4} for r in rows]
    data, strings = forge.symtab(symbols)
    text = b"".join((r["h"] * 2654435761 % 2**32).to_bytes(4, "little") for r in rows)
    sections = [{"name": ".text", "content": text, "type": 1, "addr": 0x1000}, {"name": ".symtab", "content": data, "type": 2, "link": 3}, {"name": ".strtab", "content": strings, "type": 3}]
    return forge.elf(sections, [{"type": 1, "offset": 52, "vaddr": 0x1000, "filesz": len(text), "memsz": len(text)}], entry=0x1000)


ELF_ROWS = "SELECT p_brand AS file, p_name || '_' || p_partkey AS name, p_partkey * 64 AS value, CAST(p_size AS BIGINT) AS size, p_partkey % 5 AS type, CAST(1 AS BIGINT) AS bind, p_partkey % 4 AS visibility FROM part"


@query("a19", ELF_ROWS)
def a19(b: Bridge):
    return tables.elf_symbols(_forged(_brands(b), "file", _elf)).drop("idx")


@query("a04", "SELECT p_partkey AS h, CASE p_partkey % 4 WHEN 0 THEN 'ELF' WHEN 1 THEN 'SNDLL' WHEN 2 THEN 'SNDLL' ELSE 'unknown' END AS type FROM part")
def a04(b: Bridge):
    magic = F.element_at(F.array(*[F.lit(x) for x in (b"\x7fELF", b"SNR1", b"SNR2", b"SNR3")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = b.table("part").select(F.col("p_partkey").alias("h"), F.concat(magic, F.lit(b"rest")).alias("content"))
    return tables.with_type(files).select("h", "type")


SECTION_ROWS = "FROM (SELECT p_brand AS file, count(*) AS n, sum(length(p_name || '_' || p_partkey) + 1) AS names FROM part GROUP BY p_brand) q"


@query("a05", f"SELECT file, s.idx, s.name, CAST(CASE s.idx WHEN 1 THEN 4 * n WHEN 2 THEN 16 * n WHEN 3 THEN names + 1 WHEN 4 THEN 33 ELSE 0 END AS BIGINT) AS bytes {SECTION_ROWS}, (VALUES (0, ''), (1, '.text'), (2, '.symtab'), (3, '.strtab'), (4, '.shstrtab')) s(idx, name)")
def a05(b: Bridge):
    def rows(content):
        return [s | {"bytes": s["size"]} for s in decode.elf(content)["sections"]]

    return tables.decoded(_forged(_brands(b), "file", _elf), rows, "idx int, name string, bytes long")


@query("a06", "SELECT DISTINCT p_brand AS file, 2 AS idx FROM part")
def a06(b: Bridge):
    """The first section of a name."""
    sections = tables.elf_sections(_forged(_brands(b), "file", _elf))
    return passes.first_of(sections.filter("name = '.symtab'").select("file", F.col("idx").cast("int").alias("idx"), "name"), ["file"], "idx", "idx")


@query("a08", "SELECT DISTINCT p_brand AS file, k AS priority, f AS format FROM part, (VALUES (2, 'symtab'), (4, 'elf_section_headers')) v(k, f)")
def a08(b: Bridge):
    found = tables.elf_symbol_tables(_forged(_brands(b), "file", _elf))
    return found.select("file", F.col("priority").cast("int").alias("priority"), "format")


@query("a39", "SELECT file, h, w FROM (SELECT p_brand AS file, p_partkey AS h, (p_partkey * 2654435761) % 4294967296 AS w FROM part) q")
def a39(b: Bridge):
    """Words read by virtual address through the segments, joined with the rows that made them."""
    from pyspark.sql import Window

    def words(content):
        image = decode.elf(content)
        size = image["segments"][0]["filesz"]
        return [{"k": k, "w": int.from_bytes(decode.memory(content, image["segments"], 0x1000 + 4 * k, 4), "little")} for k in range(size // 4)]

    read = tables.decoded(_forged(_brands(b), "file", _elf), words, "k long, w long")
    made = _brands(b).select("file", "h", (F.row_number().over(Window.partitionBy("file").orderBy("h")) - 1).cast("long").alias("k"))
    return made.join(read, ["file", "k"]).select("file", "h", "w")


@query("a40", "SELECT l_orderkey AS o, l_linenumber AS ln, CASE WHEN l_partkey % 700 < 300 THEN 4096 + l_partkey % 700 WHEN l_partkey % 700 BETWEEN 400 AND 599 THEN 8192 + l_partkey % 700 - 400 END AS address FROM lineitem")
def a40(b: Bridge):
    """File offsets to addresses through segments."""
    segments = b.spark.createDataFrame([(0, 300, 4096), (400, 600, 8192)], "lo long, hi long, vaddr long")
    offsets = b.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), (F.col("l_partkey") % 700).alias("at"))
    hit = lookup.interval_join(offsets, segments.select(F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), F.col("lo").alias("begin"), "vaddr"), "at", "left")
    return hit.select("o", "ln", (F.col("vaddr") + F.col("at") - F.col("begin")).alias("address"))


def _sndll(rows: list[dict]) -> bytes:
    return forge.sndll([{"string": r["name"] if r["h"] % 7 else "", "value": r["h"] * 8, "type": r["h"] % 6} for r in rows], version=1 + rows[0]["h"] % 2)


@query("a20", "SELECT p_brand AS file, p_partkey % 6 AS type, p_partkey * 8 AS value, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS string FROM part")
def a20(b: Bridge):
    files = _forged(_brands(b), "file", _sndll).withColumn("address", F.lit(None).cast("long"))
    return tables.sndll_symbols(files).drop("idx")


@query("c04", "SELECT p_brand AS file, p_partkey * 8 AS value, p_name AS string FROM part WHERE p_partkey % 7 <> 0 AND p_partkey <> 0")
def c04(b: Bridge):
    files = _forged(_brands(b), "file", _sndll).withColumn("address", F.lit(None).cast("long"))
    return tables.sndll_symbols(files).filter("value <> 0 AND string <> ''").select("file", "value", "string")


def _mdebug(rows: list[dict]) -> bytes:
    symbols = [{"string": f"{r['name']}:t{r['h']}=0", "value": r["h"], "symbol_type": 0, "symbol_class": r["h"] % 20, "index": 0x8F300 + 0x80} for r in rows]
    procedures = [{"address": rows[0]["h"] * 4, "symbol_index": 0, "frame_size": rows[0]["size"]}]
    externals = [{"string": r["name"], "value": r["h"], "symbol_type": 1 if r["h"] % 2 else 6, "symbol_class": 1, "index": 5} for r in rows]
    section = forge.mdebug([{"path": f"{rows[0]['file']}.c", "address": 4096, "symbols": symbols, "procedures": procedures}], externals, offset=52, moved=rows[0]["h"] % 3 * 16)
    return forge.elf([{"name": ".mdebug", "content": section, "type": 0x70000005}])


@query("a14", "SELECT p_brand AS file, p_partkey AS value, p_partkey % 20 AS symbol_class, CAST(128 AS BIGINT) AS code, p_name || ':t' || p_partkey || '=0' AS string FROM part")
def a14(b: Bridge):
    """Local symbols of .mdebug sections, some of which were moved without an update of their offsets."""
    rows = tables.mdebug_table(_forged(_brands(b), "file", _mdebug), "symbols", tables.MDEBUG)
    return rows.select("file", "value", "symbol_class", C.stabs_code(F.col("index")).alias("code"), "string")


@query("a14_files", "SELECT DISTINCT p_brand AS file, p_brand || '.c' AS path, CAST(4096 AS BIGINT) AS address FROM part")
def a14_files(b: Bridge):
    return tables.mdebug_table(_forged(_brands(b), "file", _mdebug), "files", tables.MFILES).select("file", "path", "address")


@query("a15", "SELECT p_brand AS file, min(p_partkey) AS value, min(p_partkey) * 4 AS address, CAST(arg_min(p_size, p_partkey) AS BIGINT) AS frame_size FROM part GROUP BY p_brand")
def a15(b: Bridge):
    """Procedure descriptors attached to their symbols."""
    files = _forged(_brands(b), "file", _mdebug)
    symbols = tables.mdebug_table(files, "symbols", tables.MDEBUG).withColumnRenamed("sym_idx", "symbol_index")
    procedures = tables.mdebug_table(files, "procedures", tables.PROCEDURES)
    return symbols.join(procedures, ["file", "file_idx", "symbol_index"]).select("file", "value", "address", "frame_size")


@query("a16", "SELECT p_brand AS file, p_partkey AS value, p_name AS string, CASE WHEN p_partkey % 2 = 1 THEN 'GLOBAL' ELSE 'PROC' END AS kind FROM part")
def a16(b: Bridge):
    rows = tables.mdebug_table(_forged(_brands(b), "file", _mdebug), "externals", tables.EXTERNALS)
    return rows.select("file", "value", "string", C.lookup({1: "GLOBAL", 6: "PROC"}, F.col("symbol_type").cast("int")).alias("kind"))


def _debug(rows: Rows) -> bytes:
    """A unit for each type, in order of their first rows; a unit's rows follow each other in the table."""
    table = rows.table.sort_by([("ptype", "ascending"), ("h", "ascending")]).combine_chunks()
    counts = table.group_by("ptype", use_threads=False).aggregate([([], "count_all")]).sort_by("ptype")
    n = counts["count_all"].to_pylist()
    units = [Rows(table.slice(at, k)) for at, k in zip(accumulate(n, initial=0), n)]
    units = sorted(((unit[0], unit) for unit in units), key=lambda u: u[0]["h"])
    return forge.debug(("compile_unit", [("name", "string", first["ptype"]), ("low_pc", "addr", first["h"])], (("subroutine", [("name", "string", r["name"]), ("low_pc", "addr", r["h"] * 64), ("high_pc", "addr", r["h"] * 64 + r["size"])], ()) for r in unit)) for first, unit in units)


@query("a21", "SELECT p_brand AS file, 'compile_unit' AS tag, CAST(0 AS BIGINT) AS depth, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 'subroutine', 1, count(*) FROM part GROUP BY p_brand")
def a21(b: Bridge):
    return tables.dwarf_entries(_forged(_brands(b), "file", _debug)).groupBy("file", "tag", "depth").agg(F.count("*").alias("n"))


@query("a22", "SELECT p_brand AS file, p_type AS unit, count(*) AS n FROM part GROUP BY 1, 2")
def a22(b: Bridge):
    """Children of each compile unit."""
    files = _forged(_brands(b), "file", _debug)
    entries = tables.dwarf_entries(files)
    names = tables.scanned(tables.dwarf_attributes(files), ["name"]).select("file", F.col("die").alias("parent"), F.col("name").alias("unit"))
    return entries.filter("tag = 'subroutine'").join(names, ["file", "parent"]).groupBy("file", "unit").agg(F.count("*").alias("n"))


@query("a24", "SELECT p_brand AS file, p_name AS name, p_partkey * 64 AS low, p_partkey * 64 + p_size AS high FROM part")
def a24(b: Bridge):
    """The attributes of subprograms: name, and bounds by their forms."""
    files = _forged(_brands(b), "file", _debug)
    found = tables.scanned(tables.dwarf_attributes(files), ["name", "low_pc", "high_pc"]).filter("high_pc IS NOT NULL")
    return found.select("file", "name", F.col("low_pc").cast("long").alias("low"), F.col("high_pc").cast("long").alias("high"))


@query("a26", "SELECT p_brand AS file, count(DISTINCT p_type) * 3 + count(*) * 4 AS n FROM part GROUP BY p_brand")
def a26(b: Bridge):
    return tables.dwarf_attributes(_forged(_brands(b), "file", _debug)).groupBy("file").agg(F.count("*").alias("n"))


@query("a44", "SELECT p_brand AS file, CAST(4096 + 4 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS BIGINT) AS address, ((p_partkey * 2654435761) % 4294967296) >> 26 AS opcode FROM part")
def a44(b: Bridge):
    """Instruction words of .text, four bytes apart."""

    def words(content):
        image = decode.elf(content)
        section = decode.section_named(image["sections"], ".text")
        data = decode.section_bytes(content, section)
        return [{"address": section["addr"] + k, "w": int.from_bytes(data[k : k + 4], "little")} for k in range(0, len(data), 4)]

    return tables.decoded(_forged(_brands(b), "file", _elf), words, "address long, w long").select("file", "address", C.mips_field(F.col("w"), "opcode").alias("opcode"))


# STABS text.


def _stabs(rows: DataFrame, text, columns: str, of) -> DataFrame:
    """of(parsed symbol) as rows, for the text column of each row, keyed by its first column."""
    return tables.decoded(dealt(rows.select(rows.columns[0], text.alias("text"))), lambda t: of(stabs.parse_symbol(t)), columns)


@query("i01", "SELECT p_partkey AS h, 'T' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'type_tag' ELSE 'type_name' END AS descriptor, CAST(1 AS BIGINT) AS file_no, CAST(p_partkey AS BIGINT) AS type_no, CAST(p_size AS BIGINT) AS size, 'a' AS field, CAST(p_size * 8 AS BIGINT) AS bits FROM part")
def i01(b: Bridge):
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("T"), key, F.when(F.col("p_partkey") % 2 == 0, ":T(1,").otherwise(":t(1,"), key, F.lit(")=s"), F.col("p_size").cast("string"), F.lit("a:(0,1),0,"), (F.col("p_size") * 8).cast("string"), F.lit(";;"))

    def of(s):
        f = s.type.child("field")
        return [{"name": s.name, "descriptor": s.descriptor, "file_no": s.type.number[0], "type_no": s.type.number[1], "size": s.type.attrs["size"], "field": f.name, "bits": f.attrs["size_bits"]}]

    return _stabs(b.table("part").withColumnRenamed("p_partkey", "h").select("h", "p_size").withColumn("p_partkey", F.col("h")), text, "name string, descriptor string, file_no long, type_no long, size long, field string, bits long", of)


@query("i03", "SELECT p_partkey AS h, CASE p_partkey % 6 WHEN 0 THEN 'pointer' WHEN 1 THEN 'reference' WHEN 2 THEN 'const' WHEN 3 THEN 'volatile' WHEN 4 THEN 'function' ELSE 'array' END AS kind, CAST(p_partkey AS BIGINT) AS target FROM part")
def i03(b: Bridge):
    letter = F.element_at(F.array(*[F.lit(x) for x in ("*", "&", "k", "B", "f", "ar(1,9);0;4;")]), (F.col("h") % 6 + 1).cast("int"))
    text = F.concat(F.lit("x:(1,2)="), letter, F.lit("(0,"), F.col("h").cast("string"), F.lit(")"))
    rows = b.table("part").select(F.col("p_partkey").alias("h"))
    return _stabs(rows, text, "kind string, target long", lambda s: [{"kind": s.type.kind, "target": s.type.children[-1][1].number[1]}])


@query("i04", "SELECT p_partkey AS h, f.name, CAST(f.k * 32 AS BIGINT) AS offset_bits, f.vis AS visibility FROM part, (VALUES ('a', 0, 'private'), ('b', 1, 'protected'), ('c', 2, 'public'), ('s', NULL, NULL), ('$vf', 5, NULL)) f(name, k, vis)")
def i04(b: Bridge):
    rows = b.table("part").select(F.col("p_partkey").alias("h"))
    text = F.lit("R:T(1,1)=s12a:/0(0,1),0,32;b:/1(0,1),32,32;c:/2(0,1),64,32;s:(0,1):_ZR1s;$vf:(0,2),160;;")
    return _stabs(rows, text, "name string, offset_bits long, visibility string", lambda s: [{"name": n.name, "offset_bits": n.attrs.get("offset_bits"), "visibility": n.attrs["visibility"]} for r, n in s.type.children if r == "field"])


@query("i05", "SELECT p_partkey AS h, f.name, f.modifier, CAST(f.v AS BIGINT) AS vtable_index FROM part, (VALUES ('f', 'none', NULL), ('g', 'static', NULL), ('h', 'virtual', 3)) f(name, modifier, v)")
def i05(b: Bridge):
    rows = b.table("part").select(F.col("p_partkey").alias("h"))
    text = F.lit("R:T(1,1)=s1f::(1,2)=##(0,1);:_Z1f;2A.;g::(1,2):_Z1g;2B?;h::(1,2):_Z1h;2D*3;(1,1);;;")
    return _stabs(rows, text, "name string, modifier string, vtable_index long", lambda s: [{"name": n.name, "modifier": n.attrs["modifier"], "vtable_index": n.attrs.get("vtable_index")} for r, n in s.type.children if r == "member_function"])


@query("i08", "SELECT p_partkey AS h, 'N<A::b' || p_partkey || ','':''>' AS name FROM part")
def i08(b: Bridge):
    rows = b.table("part").select(F.col("p_partkey").alias("h"))
    text = F.concat(F.lit("N<A::b"), F.col("h").cast("string"), F.lit(",':'>:T(1,1)=s1;"))
    return _stabs(rows, text, "name string", lambda s: [{"name": s.name}])


@query("i09", "SELECT p_partkey AS h, CAST(k AS BIGINT) AS type_no FROM part, (VALUES (1), (2), (3), (p_partkey % 50 + 4)) v(k)")
def i09(b: Bridge):
    """All type numbers that a string defines, nested ones too."""
    rows = b.table("part").select(F.col("p_partkey").alias("h"))
    text = F.concat(F.lit("R:T(1,1)=s8a:(1,2)=*(1,3)=f(0,9),0,32;b:(1,"), (F.col("h") % 50 + 4).cast("string"), F.lit(")=k(1,2),32,32;;"))
    return _stabs(rows, text, "type_no long", lambda s: [{"type_no": n[1]} for n in s.type.numbered()])


@query("i10", "SELECT p_partkey AS h, 'ns::C' || p_partkey || '::get(int, char const*)' AS name FROM part")
def i10(b: Bridge):
    key = F.concat(F.lit("C"), F.col("p_partkey").cast("string"))
    mangled = F.concat(F.lit("_ZN2ns"), F.length(key).cast("string"), key, F.lit("3getEiPKc"))
    rows = b.table("part").select(F.col("p_partkey").alias("h"), mangled.alias("m"))
    return tables.decoded(dealt(rows), lambda m: [{"name": demangle.demangle(m)}], "name string")


@query("i11", "SELECT p_partkey AS h, CASE p_partkey % 4 WHEN 0 THEN 'operator+' WHEN 1 THEN 'operator new' WHEN 2 THEN 'operator+=' ELSE 'operator Type' END AS name FROM part")
def i11(b: Bridge):
    mangled = F.element_at(F.array(*[F.lit(x) for x in ("__pl", "__nw", "op$assign_plus", "__op4Type")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = b.table("part").select(F.col("p_partkey").alias("h"), mangled.alias("m"))
    return tables.decoded(dealt(rows), lambda m: [{"name": demangle.operator_name(m)}], "name string")
