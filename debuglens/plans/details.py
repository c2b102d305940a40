"""Further rows of the inventory: readers, filters, flags and smaller rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debuglens.functions import ast, stabs
from debuglens.functions import columns as C
from debuglens.functions import cpp
from debuglens.operators import lookup, passes, reports, types
from debuglens.operators.analyser import LOCATIONS, analyse
from debuglens.plans.formats import _brands, _debug, _elf, _forged, _mdebug
from debuglens.plans.registry import FN, GV, Bridge, query
from debuglens.plans.sequences import P, _symbols
from debuglens.session import dealt
from debuglens.sources import decode, dwarf, forge, tables

#: Import switches, in the order of their bits.
FLAGS = ("demangle_parameters", "demangle_return_type", "dont_deduplicate_symbols", "dont_deduplicate_types", "dont_demangle_names", "include_generated_member_functions", "no_access_specifiers", "no_linkonce_sections", "no_member_functions", "no_optimized_out_functions", "no_symbol_sections", "strict_parsing", "typedef_all_enums", "typedef_all_structs", "typedef_all_unions", "unique_functions")
JUNK_LABELS = ("__gnu_compiled_c", "__gnu_compiled_cplusplus", "gcc2_compiled.")
CONSTRUCTORS = ("__ct", "__comp_ctor", "__base_ctor")
DESTRUCTORS = ("__dt", "__comp_dtor", "__base_dtor", "__deleting_dtor")


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(1 << FLAGS.index(name))) != 0


def member_kind(name: Column, type_name: Column) -> Column:
    """constructor, destructor, assignment or other, by a member function's name and its type's."""
    plain = C.without_template_arguments(type_name)
    construct = name.isin(*CONSTRUCTORS) | ((plain != "") & (name == plain)) | F.startswith(name, F.lit("$_"))
    destroy = name.isin(*DESTRUCTORS) | (name == F.concat(F.lit("~"), plain))
    return F.when(construct, "constructor").when(destroy, "destructor").when(name == "operator=", "assignment").otherwise("other")


def refinable(storage: Column, address: Column, has_type: Column) -> Column:
    """Whether a variable's data is in the file."""
    return storage.isNotNull() & ~storage.isin("bss", "sbss") & address.isNotNull() & has_type


@query("a01", "SELECT 'region.parquet' AS file, 'PAR1' AS magic")
def a01(b: Bridge):
    files = tables.images(b.spark, f"{b.sf_dir}/region.parquet")
    return files.select(C.file_name(F.col("path")).alias("file"), F.decode(F.substring("content", 1, 4), "ISO-8859-1").alias("magic"))


@query("a02", "SELECT 'PAR1' AS magic")
def a02(b: Bridge):
    return tables.text_file(b.spark, f"{b.sf_dir}/region.parquet").select(F.substring("value", 1, 4).alias("magic"))


@query("a03", "SELECT * FROM (VALUES ('benchmark'), ('conversations'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) v(name)")
def a03(b: Bridge):
    """Every file below a folder, whatever its depth."""
    return tables.images(b.spark, b.sf_dir).select(F.regexp_extract("path", r"/(\w+)\.parquet", 1).alias("name")).distinct()


@query("a07", "SELECT p_brand AS file, CAST(4 * count(*) AS BIGINT) AS bytes FROM part GROUP BY p_brand")
def a07(b: Bridge):
    def rows(content):
        return [{"bytes": len(decode.section_bytes(content, decode.section_named(decode.elf(content)["sections"], ".text")))}]

    return tables.decoded(_forged(_brands(b), "file", _elf), rows, "bytes long")


@query("a09", "SELECT DISTINCT p_brand AS file, v.pos, v.name FROM part, (VALUES (0, '.strtab'), (1, '.text')) v(pos, name)")
def a09(b: Bridge):
    """A list of sections in the caller's order, and nothing else."""
    wanted = b.spark.createDataFrame([(0, ".strtab"), (1, ".text")], "pos int, name string")
    return tables.elf_sections(_forged(_brands(b), "file", _elf)).join(F.broadcast(wanted), "name").select("file", "pos", "name")


@query("a10", "SELECT DISTINCT p_brand AS file, '.symtab' AS name, '.strtab' AS strings FROM part")
def a10(b: Bridge):
    """A symbol table with the section that it links to."""
    s = tables.elf_sections(_forged(_brands(b), "file", _elf))
    linked = s.select("file", F.col("idx").alias("link"), F.col("name").alias("strings"))
    return s.filter("name = '.symtab'").select("file", "name", "link").join(linked, ["file", "link"]).select("file", "name", "strings")


@query("a11", "SELECT p_partkey AS h, CASE p_partkey % 5 WHEN 0 THEN 'mdebug' WHEN 1 THEN 'dwarf' WHEN 2 THEN 'symtab' WHEN 3 THEN 'sndll' END AS format FROM part")
def a11(b: Bridge):
    name = F.element_at(F.array(*[F.lit(x) for x in (".mdebug", ".debug", ".symtab", ".sndata", ".none")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return b.table("part").select(F.col("p_partkey").alias("h"), C.lookup({s: f for _, f, s in decode.FORMATS}, name).alias("format"))


@query("a12", "SELECT p_brand AS file, CAST(28681 AS BIGINT) AS magic, count(*) AS symbols, count(*) AS externals FROM part GROUP BY p_brand")
def a12(b: Bridge):
    """The symbolic header read by column expressions."""
    at = lambda n: C.le_unsigned(F.col("content"), F.lit(52 + n), 4)
    return _forged(_brands(b), "file", _mdebug).select("file", at(0).bitwiseAND(F.lit(0xFFFF)).alias("magic"), at(0x20).alias("symbols"), at(0x58).alias("externals"))


@query("a13", "SELECT p_brand AS file, min(p_partkey) % 3 * 16 AS moved FROM part GROUP BY p_brand")
def a13(b: Bridge):
    """How far a section was moved: the least positive table offset should follow the header."""
    offsets = [0x0C, 0x14, 0x1C, 0x24, 0x2C, 0x34, 0x3C, 0x44, 0x4C, 0x54, 0x5C]
    positive = [F.nullif(F.greatest(C.le_signed(F.col("content"), F.lit(52 + n), 4), F.lit(0)), F.lit(0)) for n in offsets]
    return _forged(_brands(b), "file", _mdebug).select("file", (F.lit(52) - (F.least(*positive) - 0x60)).alias("moved"))


@query("a23", "SELECT p_brand AS file, count(DISTINCT p_type) - 1 AS followed FROM part GROUP BY p_brand")
def a23(b: Bridge):
    """Compile units whose sibling is the next unit."""
    units = tables.dwarf_entries(_forged(_brands(b), "file", _debug)).filter("depth = 0")
    after = units.select("file", F.col("die").alias("sibling"))
    hit = units.select("file", "die", "sibling").join(after, ["file", "sibling"], "left_semi").groupBy("file").agg(F.count("*").alias("followed"))
    return units.select("file").distinct().join(hit, "file", "left").select("file", F.coalesce("followed", F.lit(0)).alias("followed"))


@query("a25", "SELECT p_brand AS file, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2")
def a25(b: Bridge):
    """Chosen attributes of each subprogram, the last occurrence of each."""
    found = tables.scanned(tables.dwarf_attributes(_forged(_brands(b), "file", _debug)), ["name", "high_pc"])
    return found.filter("high_pc IS NOT NULL").groupBy("file", "name").agg(F.count("*").alias("n"))


@query("a27", "SELECT p_brand AS file, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand")
def a27(b: Bridge):
    """Entries found again by their offsets."""
    entries = tables.dwarf_entries(_forged(_brands(b), "file", _debug))
    at = entries.filter("tag = 'subroutine'").select("file", F.col("parent").alias("die"))
    return at.join(entries.select("file", "die"), ["file", "die"]).groupBy("file").agg(F.count("*").alias("n"))


@query("a28", "SELECT p_brand AS file, CAST(sum(p_partkey * 64) + sum(p_partkey * 64 + p_size) AS BIGINT) AS total FROM part GROUP BY p_brand")
def a28(b: Bridge):
    """Values by their forms: addresses are numbers, names are not."""
    attrs = tables.dwarf_attributes(_forged(_brands(b), "file", _debug))
    entries = tables.dwarf_entries(_forged(_brands(b), "file", _debug)).filter("tag = 'subroutine'").select("file", "die")
    return attrs.filter("form = 'addr'").join(entries, ["file", "die"]).groupBy("file").agg(F.sum("number").alias("total"))


def _block(b: Bridge, block: Column, of, columns: str) -> DataFrame:
    return tables.decoded(dealt(b.table("part").select(F.col("p_partkey").alias("h"), block.alias("block"))), of, columns)


@query("a29", "SELECT p_partkey AS h, v.op, CASE v.op WHEN 'basereg' THEN 29 WHEN 'const' THEN p_partkey END AS value FROM part, (VALUES ('basereg'), ('const'), ('add')) v(op)")
def a29(b: Bridge):
    block = F.concat(F.lit(b"\2\x1d\0\0\0\4"), C.le_bytes(F.col("p_partkey"), 4), F.lit(b"\7"))
    return _block(b, block, lambda d: [{"op": o, "value": v} for o, v in decode.location(d)], "op string, value long")


@query("a30", "SELECT p_partkey AS h, 'pointer_to,const' AS mods, CASE p_partkey % 3 WHEN 0 THEN 'char' WHEN 1 THEN 'integer' ELSE 'float' END AS fund FROM part")
def a30(b: Bridge):
    block = F.concat(F.lit(b"\1\3"), F.element_at(F.array(F.lit(b"\1\0"), F.lit(b"\7\0"), F.lit(b"\x0e\0")), (F.col("p_partkey") % 3 + 1).cast("int")))

    def of(d):
        found = dwarf.type_of("mod_fund_type", None, d)
        return [{"mods": ",".join(found["mods"]), "fund": found["fund"]}]

    return _block(b, block, of, "mods string, fund string")


@query("a31", "SELECT p_partkey AS h, v.format, CASE v.format WHEN 'FT_C_C' THEN p_size END AS high FROM part, (VALUES ('FT_C_C'), ('ET')) v(format)")
def a31(b: Bridge):
    block = F.concat(F.lit(b"\0\7\0\0\0\0\0"), C.le_bytes(F.col("p_size").cast("long"), 4), F.lit(b"\x08\x55\0\1\0"))
    return _block(b, block, lambda d: [{"format": x["format"], "high": x["high"]} for x in dwarf.subscripts(d)], "format string, high int")


@query("a32", "SELECT p_partkey AS h, v.name, CASE v.name WHEN 'A' THEN p_size ELSE -1 END AS value FROM part, (VALUES ('A'), ('B')) v(name)")
def a32(b: Bridge):
    block = F.concat(C.le_bytes(F.col("p_size").cast("long"), 4), F.lit(b"A\0\xff\xff\xff\xffB\0"))
    return _block(b, block, lambda d: [{"value": v, "name": n} for v, n in decode.enumeration(d)], "name string, value int")


def _overlays(rows: list[dict]) -> bytes:
    return forge.debug([("overlay", [("overlay_id", "data4", r["h"]), ("overlay_name", "string", r["name"])], []) for r in rows])


@query("a33", "SELECT p_brand AS file, CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part")
def a33(b: Bridge):
    files = _forged(_brands(b), "file", _overlays)
    top = tables.dwarf_entries(files).filter("tag = 'overlay' AND depth = 0").select("file", "die")
    found = tables.scanned(tables.dwarf_attributes(files), ["overlay_id", "overlay_name"])
    return found.join(top, ["file", "die"]).select("file", F.col("overlay_id").alias("id"), F.col("overlay_name").alias("name"))


@query("a35", "SELECT DISTINCT p_brand AS file, s.name, s.address FROM part, (VALUES ('', NULL), ('.text', 4096), ('.symtab', NULL), ('.strtab', NULL), ('.shstrtab', NULL)) s(name, address)")
def a35(b: Bridge):
    s = tables.elf_sections(_forged(_brands(b), "file", _elf))
    return s.select("file", "name", C.non_zero(F.col("addr")).cast("int").alias("address"))


@query("a38", f"WITH {FN} SELECT s_suppkey AS h, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM fn WHERE handle % 5 <> 0 AND address = s_suppkey * 96)")
def a38(b: Bridge):
    """Link-once sections become symbols unless one starts at their address already."""
    named = C.link_once(F.concat(F.when(F.col("s_suppkey") % 2 == 0, ".gnu.linkonce.t.").otherwise(".other."), "s_name"))["symbol_name"]
    rows = b.table("supplier").select(F.col("s_suppkey").alias("h"), named.alias("name"), (F.col("s_suppkey") * 96).alias("address"))
    return rows.filter("name IS NOT NULL").join(b.functions.filter("handle % 5 <> 0").select("address"), "address", "left_anti").select("h", "name")


@query("a41", "SELECT l_orderkey AS o, l_linenumber AS ln, CASE WHEN l_partkey % 1000 < 400 THEN 0 WHEN l_partkey % 1000 < 600 THEN 1 WHEN l_partkey % 1000 < 900 THEN 1 END AS segment FROM lineitem")
def a41(b: Bridge):
    """The last segment that contains the entry point."""
    segments = b.spark.createDataFrame([(0, 0, 600), (1, 400, 900)], "idx int, low long, high long")
    points = b.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), (F.col("l_partkey") % 1000).alias("at"))
    distinct = points.select("at").distinct()
    hit = lookup.contained(distinct, segments, "at", F.col("low"), F.col("high")).groupBy("at").agg(F.max("idx").alias("segment"))
    return points.join(hit, "at", "left").select("o", "ln", "segment")


def function_bodies(lines: DataFrame) -> DataFrame:
    """(file, address, body) of @function blocks: the text between the first line that ends with a brace and the last closing brace; a later block of an address replaces an earlier one."""
    w = Window.partitionBy("file").orderBy("n")
    mark = F.regexp_extract("line", r"^@function ([0-9a-fA-F]+)", 1)
    seg = lines.withColumn("mark", F.nullif(mark, F.lit(""))).withColumn("seg", F.sum(F.col("mark").isNotNull().cast("int")).over(w)).filter("seg > 0")
    blocks = seg.groupBy("file", "seg").agg(F.max("mark").alias("hex"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("mark").isNull(), F.struct("n", "line")))), lambda s: s["line"]), "\n").alias("text"))
    body = F.regexp_extract("text", r"(?s)^.*?\{\n(.*\n)?\}", 1)
    return blocks.groupBy("file", F.conv("hex", 16, 10).cast("long").alias("address")).agg(F.max_by(body, F.col("seg")).alias("body"))


@query("a46", "SELECT p_brand AS file, p_partkey % 1000 * 16 AS address, '  return ' || max(p_partkey) || ';' || chr(10) AS body FROM part GROUP BY p_brand, p_partkey % 1000")
def a46(b: Bridge):
    k = F.col("p_partkey")
    text = F.array(F.concat(F.lit("@function "), C.hex8(k % 1000 * 16)), F.lit("int f()"), F.lit("{"), F.concat(F.lit("  return "), k.cast("string"), F.lit(";")), F.lit("}"), F.lit(""))
    lines = b.table("part").select(F.col("p_brand").alias("file"), k, F.posexplode(text).alias("i", "line")).select("file", (k * 10 + F.col("i")).alias("n"), "line")
    return function_bodies(lines)


# Filters and flags.


@query("c03", "SELECT p_partkey AS h, p_partkey % 4 < 3 AS is_junk FROM part")
def c03(b: Bridge):
    name = F.element_at(F.array(*[F.lit(x) for x in (*JUNK_LABELS, "main")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return b.table("part").select(F.col("p_partkey").alias("h"), name.isin(*JUNK_LABELS).alias("is_junk"))


@query("c08", "SELECT p_partkey AS h, p_partkey % 5 = 4 AND p_size % 2 = 0 AND p_size % 3 <> 0 AS ok FROM part")
def c08(b: Bridge):
    storage = F.element_at(F.array(F.lit("bss"), F.lit("sbss"), F.lit(None).cast("string"), F.lit("bss"), F.lit("data")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return b.table("part").select(F.col("p_partkey").alias("h"), refinable(storage, F.when(F.col("p_size") % 2 == 0, 1), F.col("p_size") % 3 != 0).alias("ok"))


@query("c10", "SELECT DISTINCT p_brand AS file, p_type AS info FROM part WHERE p_size % 2 = 0")
def c10(b: Bridge):
    """Strings of the info class, the marker aside."""
    rows = b.table("part").select(F.col("p_brand").alias("file"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("@stabs").alias("info"))
    return rows.filter("info <> '@stabs'").distinct()


@query("c11", "SELECT p_partkey AS h, CASE p_partkey % 24 WHEN 0 THEN 'nil' WHEN 2 THEN 'data' WHEN 3 THEN 'bss' WHEN 5 THEN 'abs' WHEN 13 THEN 'sdata' WHEN 14 THEN 'sbss' WHEN 15 THEN 'rdata' WHEN 17 THEN 'common' WHEN 18 THEN 'scommon' WHEN 21 THEN 'sundefined' END AS place FROM part")
def c11(b: Bridge):
    return b.table("part").select(F.col("p_partkey").alias("h"), C.lookup(LOCATIONS, (F.col("p_partkey") % 24).cast("int")).alias("place"))


@query("c12", f"WITH {FN} SELECT handle FROM fn WHERE handle % 3 <> 0 AND handle % 5 <> 0")
def c12(b: Bridge):
    """Statics and member functions left out, as the report's switches say."""
    config = cpp.PrinterConfig(skip_statics=True, skip_member_functions_outside_types=True)
    rows = b.functions.withColumn("is_static", F.col("handle") % 3 == 0).withColumn("is_member", F.col("handle") % 5 == 0)
    return rows.filter(~(F.lit(config.skip_statics) & F.col("is_static")) & ~(F.lit(config.skip_member_functions_outside_types) & F.col("is_member"))).select("handle")


@query("c13", f"WITH {FN} SELECT handle, CASE WHEN handle % 3 = 0 THEN handle % 4 END AS overlay FROM fn WHERE handle % 3 <> 0")
def c13(b: Bridge):
    """Without an overlay chosen, only units that are in none."""
    members = b.functions.filter("handle % 3 = 0").select("handle", (F.col("handle") % 4).alias("overlay"))
    return b.functions.select("handle").join(members, "handle", "left").filter("overlay IS NULL")


@query("c14", "SELECT p_partkey AS h, p_partkey % 3 <> 2 AS is_type FROM part")
def c14(b: Bridge):
    tag = F.element_at(F.array(F.lit("typedef"), F.lit("union_type"), F.lit("subroutine")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return b.table("part").select(F.col("p_partkey").alias("h"), tag.isin(*dwarf.TYPE_TAGS).alias("is_type"))


@query("c15", "SELECT p_partkey AS h, CASE WHEN (p_size & 64) <> 0 THEN NULL ELSE p_brand END AS access FROM part")
def c15(b: Bridge):
    return b.table("part").select(F.col("p_partkey").alias("h"), F.when(~has_flag(F.col("p_size"), "no_access_specifiers"), F.col("p_brand")).alias("access"))


@query("c16", "SELECT p_partkey AS h, v.name FROM part, (VALUES ('demangle_parameters', 1), ('demangle_return_type', 2), ('strict_parsing', 2048)) v(name, bit) WHERE (p_partkey & v.bit) <> 0")
def c16(b: Bridge):
    chosen = ("demangle_parameters", "demangle_return_type", "strict_parsing")
    rows = b.table("part").select(F.col("p_partkey").alias("h"), F.explode(F.array(*[F.when(has_flag(F.col("p_partkey"), n), F.lit(n)) for n in chosen])).alias("name"))
    return rows.filter("name IS NOT NULL")


@query("c17", "SELECT p_partkey AS h, ((p_size & 1) <> 0 AND p_partkey % 3 = 0) OR ((p_size & 2) <> 0 AND p_partkey % 3 = 1) OR ((p_size & 4) <> 0 AND p_partkey % 3 = 2) AS forced FROM part")
def c17(b: Bridge):
    kind, flags = F.col("p_partkey") % 3, F.shiftleft("p_size", 12)
    forced = (has_flag(flags, "typedef_all_enums") & (kind == 0)) | (has_flag(flags, "typedef_all_structs") & (kind == 1)) | (has_flag(flags, "typedef_all_unions") & (kind == 2))
    return b.table("part").select(F.col("p_partkey").alias("h"), forced.alias("forced"))


@query("c18", "SELECT p_partkey AS h, CASE p_partkey % 6 WHEN 0 THEN 'constructor' WHEN 1 THEN 'constructor' WHEN 2 THEN 'destructor' WHEN 3 THEN 'destructor' WHEN 4 THEN 'assignment' ELSE 'other' END AS kind FROM part")
def c18(b: Bridge):
    own = F.concat(F.lit("T"), F.col("p_partkey").cast("string"))
    name = F.element_at(F.array(own, F.lit("__base_ctor"), F.concat(F.lit("~"), own), F.lit("__deleting_dtor"), F.lit("operator="), F.lit("get")), (F.col("p_partkey") % 6 + 1).cast("int"))
    return b.table("part").select(F.col("p_partkey").alias("h"), member_kind(name, F.concat(own, F.lit("<int>"))).alias("kind"))


@query("c20", "SELECT p_partkey AS h, p_partkey % 3 <> 2 AS is_vtable FROM part")
def c20(b: Bridge):
    name = F.element_at(F.array(F.lit("$vf1"), F.lit("_vptr$A"), F.lit("value")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return b.table("part").select(F.col("p_partkey").alias("h"), F.regexp_like(name, F.lit(r"^(\$vf|_vptr[$.])")).alias("is_vtable"))


@query("c21", f"WITH {FN} SELECT handle, CASE WHEN handle % 3 <> 0 THEN source_handle END AS type FROM fn")
def c21(b: Bridge):
    return b.functions.select("handle", F.when(F.col("handle") % 3 != 0, F.col("source_handle")).alias("type"))


@query("g03", f"WITH {FN} SELECT DISTINCT name FROM fn ORDER BY name")
def g03(b: Bridge):
    return b.functions.select("name").distinct().orderBy("name")


# Smaller rules.


@query("i02", "SELECT p_partkey AS h, p_partkey AS low, p_partkey + p_size AS high FROM part")
def i02(b: Bridge):
    """A type's live range suffix."""
    text = F.concat(F.lit("x:r(0,1);l(#"), F.col("p_partkey").cast("string"), F.lit(",#"), (F.col("p_partkey") + F.col("p_size")).cast("string"), F.lit(")"))
    rows = b.table("part").select(F.col("p_partkey").alias("h"), text.alias("t"))
    return tables.decoded(dealt(rows), lambda t: [dict(zip(("low", "high"), stabs.parse_symbol(t).type.attrs["live_range"]))], "low long, high long")


#: Mnemonics of the main instruction table by opcode; None where another table decides.
MNEMONICS = {2: "j", 3: "jal", 4: "beq", 5: "bne", 6: "blez", 7: "bgtz", 8: "addi", 9: "addiu", 10: "slti", 11: "sltiu", 12: "andi", 13: "ori", 14: "xori", 15: "lui", 20: "beql", 21: "bnel", 22: "blezl", 23: "bgtzl", 24: "daddi", 25: "daddiu", 26: "ldl", 27: "ldr", 30: "lq", 31: "sq", 32: "lb", 33: "lh", 34: "lwl", 35: "lw", 36: "lbu", 37: "lhu", 38: "lwr", 39: "lwu", 40: "sb", 41: "sh", 42: "swl", 43: "sw", 44: "sdl", 45: "sdr", 46: "swr", 49: "lwc1", 55: "ld", 57: "swc1", 63: "sd"}
SPECIAL = {0: "sll", 2: "srl", 3: "sra", 4: "sllv", 6: "srlv", 7: "srav", 8: "jr", 9: "jalr", 10: "movz", 11: "movn", 12: "syscall", 13: "break", 15: "sync", 16: "mfhi", 17: "mthi", 18: "mflo", 19: "mtlo", 24: "mult", 25: "multu", 26: "div", 27: "divu", 32: "add", 33: "addu", 34: "sub", 35: "subu", 36: "and", 37: "or", 38: "xor", 39: "nor", 42: "slt", 43: "sltu", 44: "dadd", 45: "daddu", 46: "dsub", 47: "dsubu"}


def mnemonic(word: Column) -> Column:
    op, func = C.mips_field(word, "opcode").cast("int"), C.mips_field(word, "func").cast("int")
    return F.when(op == 0, C.lookup(SPECIAL, func)).otherwise(C.lookup(MNEMONICS, op))


def signed_hex(value: Column) -> Column:
    return F.concat(F.when(value < 0, "-0x").otherwise("0x"), C.hex_plain(F.abs(value)))


def memory_operands(word: Column) -> Column:
    """``rt,immediate(rs)`` of loads and stores."""
    names, immed = F.array(*map(F.lit, cpp.GPR)), C.mips_field(word, "immed")
    value = F.when(immed > 0x7FFF, immed - 0x10000).otherwise(immed)
    reg = lambda n: F.element_at(names, (C.mips_field(word, n) + 1).cast("int"))
    return F.concat(reg("rt"), F.lit(","), signed_hex(value), F.lit("("), reg("rs"), F.lit(")"))


@query("i36", "SELECT p_partkey AS h, CASE p_partkey % 4 WHEN 0 THEN 'lw' WHEN 1 THEN 'sw' WHEN 2 THEN 'addu' ELSE 'addiu' END AS mnemonic FROM part")
def i36(b: Bridge):
    word = F.element_at(F.array(*[F.lit(x) for x in (35 << 26, 43 << 26, 33, 9 << 26)]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return b.table("part").select(F.col("p_partkey").alias("h"), mnemonic(word.cast("long")).alias("mnemonic"))


@query("i37", "SELECT p_partkey AS h, 'a0,' || CASE WHEN p_size % 2 = 0 THEN '0x' || lower(to_hex(p_size)) ELSE '-0x' || lower(to_hex(p_size)) END || '(sp)' AS operands FROM part")
def i37(b: Bridge):
    value = F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(65536 - F.col("p_size")).cast("long")
    word = F.lit((35 << 26) + (29 << 21) + (4 << 16)).cast("long") + value
    return b.table("part").select(F.col("p_partkey").alias("h"), memory_operands(word).alias("operands"))


@query("i43", "SELECT p_partkey AS h, p_size % 30 + 1 < 32 AND p_size % 30 + 1 <> 0 AS is_bitfield, CAST(p_partkey % 8 * 4 // 32 * 4 AS BIGINT) AS byte_offset, CAST(p_partkey % 8 * 4 % 32 AS BIGINT) AS bit FROM part")
def i43(b: Bridge):
    """A field narrower than its type is a bitfield in a storage unit of that type."""
    unit, bits, at = 32, F.col("p_size") % 30 + 1, F.col("p_partkey") % 8 * 4
    return b.table("part").select(F.col("p_partkey").alias("h"), ((bits < unit) & (bits != 0)).alias("is_bitfield"), (F.floor(at / unit) * (unit // 8)).cast("long").alias("byte_offset"), (at % unit).alias("bit"))


def _pair(left: str, right: str, lookup_: dict | None = None) -> str:
    trees = [ast.from_stabs(s.type, s.type.numbered()) | {"name": s.name} for s in map(stabs.parse_symbol, (left, right))]
    return ast.compare(*trees, (lambda n: lookup_.get(n)) if lookup_ else None)


@query("j08", "SELECT p_partkey AS h, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'matches' END AS outcome FROM part")
def j08(b: Bridge):
    """A field by the name of a type matches the plain type that the name stands for, and is preferred."""
    int_ = {(0, 1): {"kind": "builtin", "class": "signed_32"}}
    plain = "S:T(1,1)=s4m:(0,9)=r(0,9);-2147483648;2147483647;,0,32;;"

    def of(h):
        return [{"outcome": _pair("S:T(1,1)=s4m:(0,1),0,32;;", plain, int_) if h % 2 == 0 else _pair(plain, plain)}]

    return tables.decoded(dealt(b.table("part").select(F.col("p_partkey").alias("h"), F.col("p_partkey").alias("k"))), of, "outcome string")


@query("j10", "SELECT p_partkey AS h, p_partkey % 2 = 0 AS is_void FROM part")
def j10(b: Bridge):
    """A type that is itself is void."""
    text = F.when(F.col("p_partkey") % 2 == 0, "v:t(0,5)=(0,5)").otherwise("v:t(0,5)=r(0,1);0;255;")
    rows = b.table("part").select(F.col("p_partkey").alias("h"), text.alias("t"))
    return tables.decoded(dealt(rows), lambda t: [{"is_void": int(ast.from_stabs((s := stabs.parse_symbol(t)).type, s.type.numbered()).get("class") == "void")}], "is_void int").withColumn("is_void", F.col("is_void") == 1)


@query("j12", "SELECT p_partkey AS h, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 2 END AS members FROM part")
def j12(b: Bridge):
    """Types with generated member functions only have none."""
    more = F.when(F.col("p_partkey") % 2 == 0, "").otherwise("get::(1,3)=##(0,1);:_ZA;2A.;")
    text = F.concat(F.lit("A:T(1,1)=s1operator=::(1,2)=##(0,1);:_ZB;2A.;"), more, F.lit(";"))
    rows = b.table("part").select(F.col("p_partkey").alias("h"), text.alias("t"))
    return tables.decoded(dealt(rows), lambda t: [{"members": len(ast.from_stabs((s := stabs.parse_symbol(t)).type, s.type.numbered())["members"])}], "members int")


@query("j14", "SELECT p_partkey AS h, 'pointer' AS kind, CAST(p_size + 1 AS BIGINT) AS count FROM part")
def j14(b: Bridge):
    """A pointer to an array: modifiers around what the subscript data says."""
    block = F.concat(F.lit(b"\0\7\0\0\0\0\0"), C.le_bytes(F.col("p_size").cast("long"), 4), F.lit(b"\x08\x55\0\1\0"))

    def of(d):
        t = dwarf.tree({"mods": ["pointer_to"], "fund": None, "ref": 77}, {77: d})
        return [{"kind": t["kind"], "count": t["value"]["count"]}]

    return _block(b, block, of, "kind string, count long")


@query("j17", "SELECT p_partkey AS h, CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 4 ELSE 1 END AS bytes FROM part")
def j17(b: Bridge):
    """The storage unit behind a bitfield's type: an enum counts as four bytes."""
    text = F.element_at(F.array(F.lit("t:t(1,1)=eA:0,;"), F.lit("t:t(1,1)=r(1,1);-2147483648;2147483647;"), F.lit("t:t(1,1)=r(1,1);0;255;")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = b.table("part").select(F.col("p_partkey").alias("h"), text.alias("t"))
    return tables.decoded(dealt(rows), lambda t: [{"bytes": ast.storage((s := stabs.parse_symbol(t)).type, s.type.numbered())}], "bytes int")


@query("j18", "SELECT p_brand AS file, count(DISTINCT p_type) + count(*) AS lines, count(*) AS indented FROM part GROUP BY p_brand")
def j18(b: Bridge):
    """Entries as lines, indented by depth."""
    lines = tables.dwarf_entries(_forged(_brands(b), "file", _debug)).select("file", F.concat(F.expr("repeat('\t', CAST(depth AS INT))"), "tag").alias("line"))
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.startswith("line", F.lit("\t"))).alias("indented"))


@query("l07", f"WITH {P} SELECT file, 'f' || k AS name, k * 64 + 4096 AS address FROM p")
def l07(b: Bridge):
    """A function whose string has a greater address than its procedure takes it."""
    n = F.col("sym_idx") % 100
    moved = _symbols(b).withColumn("value", F.when(n == 3, F.col("value") + 4096).otherwise(F.col("value")))
    return analyse(moved).filter("entity = 'function'").select("file", "name", "address")


@query("l08", f"WITH {P} SELECT file, count(*) * 5 AS inside FROM p GROUP BY file")
def l08(b: Bridge):
    """What a function's end gives: its parameters and locals."""
    return analyse(_symbols(b)).filter("entity IN ('parameter', 'local')").groupBy("file").agg(F.count("*").alias("inside"))


@query("l13", f"WITH {P} SELECT file, 'T' || k AS name, 'struct' AS type_kind FROM p")
def l13(b: Bridge):
    return analyse(_symbols(b)).filter("entity = 'data_type'").select("file", "name", "type_kind")


@query("b03", f"WITH {GV} SELECT handle, 'sdata' AS location, address FROM gv")
def b03(b: Bridge):
    """A variable's place in its JSON, read again."""
    place = F.struct(F.lit("global").alias("type"), F.lit("sdata").alias("location"), "address").alias("storage")
    made = reports.symbol_json(b.globals, [place])
    return made.select("handle", F.get_json_object("json", "$.storage.location").alias("location"), F.get_json_object("json", "$.storage.address").cast("long").alias("address"))


@query("b05", f"WITH {FN} SELECT handle, name FROM fn")
def b05(b: Bridge):
    """Pretty JSON says the same as compact."""
    text = F.to_json(F.struct("name", "address"), {"pretty": "true"})
    return b.functions.select("handle", F.when(F.contains(text, F.lit("\n")), F.get_json_object(text, "$.name")).alias("name"))


@query("b07", "SELECT p_partkey AS h, 'unsigned_8 (*x)[' || (p_size + 1) || ']' AS text FROM part")
def b07(b: Bridge):
    text = F.concat(F.lit("x:t(1,1)=*(1,2)=ar(1,3)=r(1,3);0;4294967295;;0;"), F.col("p_size").cast("string"), F.lit(";(0,1)=r(0,1);0;255;"))
    rows = b.table("part").select(F.col("p_partkey").alias("h"), text.alias("t"))
    return tables.decoded(dealt(rows), lambda t: [{"text": ast.declaration(ast.from_stabs((s := stabs.parse_symbol(t)).type, s.type.numbered()), s.name)}], "text string")


@query("b08", "SELECT l_orderkey AS o, string_agg('int p' || l_linenumber, ', ' ORDER BY l_linenumber, l_partkey) AS params FROM lineitem WHERE l_linenumber <> 1 GROUP BY l_orderkey")
def b08(b: Bridge):
    """Parameter lists in order, without the first one, as this is left out."""
    rows = b.table("lineitem").filter("l_linenumber <> 1").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    return rows.select("o", F.array_join(F.transform("p", lambda s: F.concat(F.lit("int p"), s["l_linenumber"].cast("string"))), ", ").alias("params"))


@query("b09", "SELECT l_orderkey AS o, '{' || string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey) || '}' AS text FROM lineitem GROUP BY l_orderkey")
def b09(b: Bridge):
    """Initialisers: the literals of a variable in order, in braces."""
    rows = b.table("lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    return rows.select("o", F.concat(F.lit("{"), F.array_join(F.transform("p", lambda s: s["l_partkey"].cast("string")), ", "), F.lit("}")).alias("text"))


@query("b11", "SELECT string_agg(t, ', ' ORDER BY t) AS toolchains FROM (SELECT DISTINCT p_type AS t FROM part) q")
def b11(b: Bridge):
    return b.table("part").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ", ").alias("toolchains"))


@query("f09", "SELECT p_partkey AS type, CAST(p_partkey // 3 % 2 + 1 AS BIGINT) AS file FROM part WHERE p_partkey - p_partkey % 3 IN (SELECT p_partkey FROM part)")
def f09(b: Bridge):
    """Types of several files: each third one is settled and refers to the next, which then refers to the one after it."""
    k = F.col("p_partkey")
    own = (F.floor(k / 3) % 2 + 1).cast("long")
    rows = b.table("part").select(F.lit(0).alias("module"), k.alias("handle"), F.when(k % 3 == 0, F.array(own)).otherwise(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("files"))
    references = b.table("part").filter("p_partkey % 3 < 2").select(k.alias("src"), (k + 1).alias("dst"), F.lit(1).cast("long").alias("n"))
    return types.map_to_files(rows, references).select(F.col("handle").alias("type"), F.col("files")[0].alias("file"))


@query("b04", "SELECT p_partkey AS h, 'struct' AS kind, CAST(16 AS BIGINT) AS size, 'bitfield' AS last FROM part")
def b04(b: Bridge):
    """A type's tree as JSON, read again by paths."""
    from debuglens.plans.reports import _struct

    get = lambda p: F.get_json_object("tree", p)
    return _struct(b).select("h", get("$.kind").alias("kind"), get("$.size").cast("long").alias("size"), get("$.fields[4].kind").alias("last"))


@query("b22", "SELECT p_brand AS file, count(DISTINCT p_type) AS units FROM part GROUP BY p_brand")
def b22(b: Bridge):
    """Built sections have the siblings that their entries need."""
    entries = tables.dwarf_entries(_forged(_brands(b), "file", _debug))
    return entries.filter("depth = 0 AND sibling > die").groupBy("file").agg(F.count("*").alias("units"))


@query("j13", "SELECT p_partkey AS h, 'T' || p_partkey AS target FROM part")
def j13(b: Bridge):
    """A type inside its own member function is a reference to it by name."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("T"), k, F.lit(":T(1,1)=s1f::(1,2)=#(1,1),(0,1),(1,3)=*(1,1);:_ZT1f;2A.;;"))
    rows = b.table("part").select(F.col("p_partkey").alias("h"), text.alias("t"))
    return tables.decoded(dealt(rows), lambda t: [{"target": ast.from_stabs((s := stabs.parse_symbol(t)).type, s.type.numbered())["members"][0]["params"][0]["value"]["name"]}], "target string")


@query("l09", f"WITH {FN} SELECT count(*) AS n FROM fn")
def l09(b: Bridge):
    """Work under a tag by which it can be called off."""
    from debuglens.session import cancellable

    return cancellable(b.spark, "debuglens-import", lambda: b.functions.agg(F.count("*").alias("n")))
