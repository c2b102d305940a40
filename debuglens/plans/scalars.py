"""Scalar functions (I rows of the inventory) and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from debuglens.functions import columns as C
from debuglens.plans.registry import Bridge, query

MASK = 4294967295


@query("i06", "SELECT p_partkey AS h, CAST(p_partkey * 4294967 - 5000000000 AS BIGINT) AS s64, CAST(((p_partkey * 4294967 - 5000000000) % 4294967296 + 4294967296 + 2147483648) % 4294967296 - 2147483648 AS BIGINT) AS s32 FROM part")
def i06(b: Bridge):
    text = F.concat((F.col("p_partkey") * 4294967 - 5000000000).cast("string"), F.lit(";rest"))
    return b.table("part").select(F.col("p_partkey").alias("h"), C.number_prefix(text).alias("s64"), C.number_prefix(text, 32).alias("s32"))


@query("i07", "SELECT page_id AS id, CASE WHEN strpos(url, ':') > 0 THEN split_part(url, ':', 1) END AS value FROM pages")
def i07(b: Bridge):
    return b.table("pages").select(F.col("page_id").alias("id"), C.until(F.col("url"), ":").alias("value"))


@query("i12", "SELECT p_partkey AS h, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS value FROM part")
def i12(b: Bridge):
    return b.table("part").select(F.col("p_partkey").alias("h"), C.mangled_name(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), F.col("p_name")).alias("value"))


@query("i13", "SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN '/abs/' || page_id WHEN page_id % 3 = 1 THEN 'C:/w/' || page_id ELSE '/base/x/rel/' || page_id END AS value FROM pages")
def i13(b: Bridge):
    k = F.col("page_id")
    path = F.when(k % 3 == 0, F.concat(F.lit("/abs/./"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("c:/w/"), k.cast("string"))).otherwise(F.concat(F.lit("rel/"), k.cast("string")))
    return b.table("pages").select(k.alias("id"), C.merged_path(F.lit("/base//y/../x"), path).alias("value"))


@query("i14", "SELECT p_partkey AS h, 'D:' || chr(92) || 'src' || chr(92) || p_brand || chr(92) || p_size || '.c' AS value FROM part")
def i14(b: Bridge):
    path = F.concat(F.lit("d:\\src\\.\\tmp\\..\\"), F.col("p_brand"), F.lit("//"), F.col("p_size").cast("string"), F.lit(".c"))
    return b.table("part").select(F.col("p_partkey").alias("h"), C.normal_path(path, C.is_windows_path(path)).alias("value"))


@query("i15", "SELECT p_partkey AS h, p_size % 2 = 0 AS value FROM part")
def i15(b: Bridge):
    path = F.when(F.col("p_size") % 2 == 0, F.lit("a\\b/c")).when(F.col("p_size") % 3 == 0, F.lit("plain")).otherwise(F.lit("a/b\\c"))
    return b.table("part").select(F.col("p_partkey").alias("h"), C.is_windows_path(path).alias("value"))


@query("i16", "SELECT page_id AS id, CASE WHEN url LIKE '%/' THEN url ELSE regexp_extract(url, '[^/]*$') END AS value FROM pages")
def i16(b: Bridge):
    return b.table("pages").select(F.col("page_id").alias("id"), C.file_name(F.col("url")).alias("value"))


@query("i17", "SELECT p_partkey AS h, p_partkey * 4 AS address, p_size AS line FROM part WHERE p_partkey % 3 = 0")
def i17(b: Bridge):
    """Labels that start with a dollar sign are line numbers."""
    rows = b.table("part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("$LM"), "p_size")).otherwise(F.col("p_name")).alias("label"))
    lines = rows.filter(F.startswith("label", F.lit("$")))
    return lines.select(F.col("p_partkey").alias("h"), (F.col("p_partkey") * 4).alias("address"), F.regexp_extract("label", "[0-9]+", 0).cast("int").alias("line"))


@query("i18", "SELECT page_id AS id, regexp_replace(upper(url), '[^A-Z0-9]', '_', 'g') AS value FROM pages")
def i18(b: Bridge):
    return b.table("pages").select(F.col("page_id").alias("id"), C.include_guard(F.col("url")).alias("value"))


@query("i19", "SELECT p_partkey AS h, p_brand AS value FROM part")
def i19(b: Bridge):
    return b.table("part").select(F.col("p_partkey").alias("h"), C.without_template_arguments(F.concat("p_brand", F.lit("<"), "p_type", F.lit("<int> >"))).alias("value"))


@query("i20", "SELECT p_partkey AS h, 'error: ' || p_name || ' at ' || lpad(lower(to_hex(p_partkey)), 8, '0') AS value FROM part")
def i20(b: Bridge):
    return b.table("part").select(F.col("p_partkey").alias("h"), F.format_string("error: %s at %08x", F.col("p_name"), F.col("p_partkey")).alias("value"))


@query("i21", "SELECT p_partkey AS h, lpad(lower(to_hex(p_partkey * 4099)), 8, '0') AS wide, lower(to_hex(p_partkey * 4099)) AS plain FROM part")
def i21(b: Bridge):
    value = F.col("p_partkey") * 4099
    return b.table("part").select(F.col("p_partkey").alias("h"), C.hex8(value).alias("wide"), C.hex_plain(value).alias("plain"))


def _wide(b: Bridge):
    x = b.table("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    pair = lambda hi, lo: F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))
    return x.select(F.col("l_orderkey").alias("k"), pair(F.col("p"), F.col("s") * 1000003).alias("a"), pair(F.col("s"), F.col("p") * 7919).alias("b"))


WIDE = "w AS (SELECT l_orderkey AS k, min(l_partkey) AS ah, min(l_suppkey) * 1000003 AS al, min(l_suppkey) AS bh, min(l_partkey) * 7919 AS bl FROM lineitem GROUP BY l_orderkey)"
HEX = "lpad(lower(to_hex({0})), 16, '0') || lpad(lower(to_hex({1})), 16, '0')"


@query("i30", f"WITH {WIDE} SELECT k, {HEX.format('ah + bh', 'al + bl')} AS added, {HEX.format('ah & bh', 'al & bl')} AS anded, {HEX.format('ah | bh', 'al | bl')} AS ored, {HEX.format('xor(ah, bh)', 'xor(al, bl)')} AS xored, {HEX.format('al', '0')} AS up64, {HEX.format('0', 'ah')} AS down64, {HEX.format('ah * 256', 'al * 256')} AS up8 FROM w")
def i30(b: Bridge):
    a, c = F.col("a"), F.col("b")
    return _wide(b).select("k", *[C.hex128(e).alias(n) for n, e in (("added", C.add128(a, c)), ("anded", C.and128(a, c)), ("ored", C.or128(a, c)), ("xored", C.xor128(a, c)), ("up64", C.shl128(a, 64)), ("down64", C.shr128(a, 64)), ("up8", C.shl128(a, 8)))])


@query("i30_round_trip", f"WITH {WIDE} SELECT k, true AS same FROM w")
def i30_round_trip(b: Bridge):
    """(a + b) - b is a, carries and borrows included, with low halves close to overflow."""
    rows = _wide(b).select("k", F.struct("a.hi", F.bitwise_not("a.lo").alias("lo")).alias("a"), F.struct("b.hi", F.bitwise_not("b.lo").alias("lo")).alias("b"))
    return rows.select("k", (C.hex128(C.sub128(C.add128(F.col("a"), F.col("b")), F.col("b"))) == C.hex128(F.col("a"))).alias("same"))


@query("i31", f"WITH {WIDE} SELECT k, ah AS hi, al AS lo FROM w")
def i31(b: Bridge):
    return _wide(b).select("k", C.from_hex128(F.concat(C.hex128(F.col("a")), F.lit("xyz"))).alias("v")).select("k", "v.hi", "v.lo")


def _bits(b: Bridge):
    return b.table("part").select(F.col("p_partkey").alias("h"), F.col("p_size").cast("long").alias("v"), (F.col("p_partkey") % 20).cast("int").alias("off"), (F.col("p_partkey") % 7 + 2).cast("int").alias("n"))


@query("i32", "SELECT p_partkey AS h, p_size % CAST(power(2, p_partkey % 7 + 2) AS BIGINT) AS u, CAST((p_size + power(2, p_partkey % 7 + 1)) % power(2, p_partkey % 7 + 2) - power(2, p_partkey % 7 + 1) AS BIGINT) AS s FROM part")
def i32(b: Bridge):
    rows = _bits(b).withColumn("unit", C.pack_bitfield(F.col("v"), F.col("off"), F.col("n")))
    return rows.select("h", C.unpack_unsigned(F.col("unit"), F.col("off"), F.col("n")).alias("u"), C.unpack_signed(F.col("unit"), F.col("off"), F.col("n")).alias("s"))


@query("i33", "SELECT p_partkey AS h, CAST((p_size % CAST(power(2, p_partkey % 7 + 2) AS BIGINT)) * CAST(power(2, p_partkey % 20) AS BIGINT) AS BIGINT) AS packed, CAST(0 AS BIGINT) AS zeroed FROM part")
def i33(b: Bridge):
    rows = _bits(b).withColumn("packed", C.pack_bitfield(F.col("v"), F.col("off"), F.col("n")))
    return rows.select("h", "packed", C.zero_bitfield(F.col("packed"), F.col("off"), F.col("n")).alias("zeroed"))


WORDS = "ws AS (SELECT p_partkey AS h, (p_partkey * 2654435761) % 4294967296 AS w FROM part)"


def _words(b: Bridge):
    return b.table("part").select(F.col("p_partkey").alias("h"), F.pmod(F.col("p_partkey") * 2654435761, F.lit(MASK + 1)).alias("w"))


@query("i34", f"WITH {WORDS} SELECT h, w >> 26 AS opcode, (w >> 21) & 31 AS rs, (w >> 16) & 31 AS rt, (w >> 11) & 31 AS rd, (w >> 6) & 31 AS sa, w & 63 AS func, w & 65535 AS immed, (w & 67108863) * 4 AS target FROM ws")
def i34(b: Bridge):
    w = F.col("w")
    return _words(b).select("h", *[C.mips_field(w, n).alias(n) for n in C.FIELDS], C.mips_target(w).alias("target"))


@query("i35", f"WITH {WORDS}, f AS (SELECT h, w >> 26 AS o, (w >> 21) & 31 AS rs, w & 63 AS fn FROM ws) SELECT h, CASE o WHEN 0 THEN 'SPECIAL' WHEN 1 THEN 'REGIMM' WHEN 16 THEN CASE rs WHEN 8 THEN 'COP0_BC0' WHEN 16 THEN 'COP0_C0' ELSE 'COP0' END WHEN 17 THEN CASE rs WHEN 8 THEN 'COP1_BC1' WHEN 16 THEN 'COP1_S' WHEN 20 THEN 'COP1_W' ELSE 'COP1' END WHEN 18 THEN 'COP2' WHEN 28 THEN CASE fn WHEN 8 THEN 'MMI0' WHEN 40 THEN 'MMI1' WHEN 9 THEN 'MMI2' WHEN 41 THEN 'MMI3' ELSE 'MMI' END ELSE 'MIPS' END AS class FROM f")
def i35(b: Bridge):
    return _words(b).select("h", C.mips_class(F.col("w")).alias("class"))


@query("i38", "SELECT l_orderkey AS o, l_linenumber AS ln, CASE WHEN l_partkey % 80 <= 31 THEN 'GPR' WHEN l_partkey % 80 BETWEEN 38 AND 69 THEN 'FPR' ELSE 'INVALID' END AS class, CASE WHEN l_partkey % 80 <= 31 THEN l_partkey % 80 WHEN l_partkey % 80 BETWEEN 38 AND 69 THEN l_partkey % 80 - 38 END AS idx FROM lineitem")
def i38(b: Bridge):
    kind, index = C.dbx_register(F.col("l_partkey") % 80)
    return b.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), kind.alias("class"), index.alias("idx"))


@query("i39", "SELECT s_suppkey AS h, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey END AS zero, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey + 4096 END AS based, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 4 END AS some FROM supplier")
def i39(b: Bridge):
    k = F.col("s_suppkey")
    address = F.when(k % 3 != 0, k)
    return b.table("supplier").select(k.alias("h"), C.or_zero(address).alias("zero"), C.rebased(address, F.lit(4096)).alias("based"), C.non_zero(k % 4).alias("some"))


RANGE_ROWS = [("0", "255"), ("-128", "127"), ("0", "127"), ("0", "65535"), ("-32768", "32767"), ("0", "4294967295"), ("-2147483648", "2147483647"), ("2147483648", "2147483647"), ("000", "0377"), ("4", "0"), ("8", "0"), ("16", "0"), ("0", "-1"), ("0", "18446744073709551615"), ("1", "2"), ("01000000000000000000000", "0777777777777777777777")]
RANGE_CLASSES = ["unsigned_8", "signed_8", "unqualified_8", "unsigned_16", "signed_16", "unsigned_32", "signed_32", "signed_32", "unsigned_8", "float_32", "float_64", "float_128", "unqualified_128", "unsigned_64", None, "signed_64"]


@query("i40", "SELECT p_partkey AS h, CAST(list_extract([" + ", ".join("NULL" if c is None else f"'{c}'" for c in RANGE_CLASSES) + f"], CAST(p_partkey % {len(RANGE_ROWS)} + 1 AS INTEGER)) AS VARCHAR) AS class FROM part")
def i40(b: Bridge):
    low, high = (F.array(*[F.lit(r[k]) for r in RANGE_ROWS]) for k in (0, 1))
    at = (F.col("p_partkey") % len(RANGE_ROWS) + 1).cast("int")
    return b.table("part").select(F.col("p_partkey").alias("h"), C.range_class(F.element_at(low, at), F.element_at(high, at)).alias("class"))


@query("i41", "SELECT p_partkey AS h, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN 0 ELSE p_size + 1 END AS n FROM part")
def i41(b: Bridge):
    size = F.col("p_size").cast("long")
    low = F.when(F.col("p_size") % 10 == 0, 1).otherwise(0)
    return b.table("part").select(F.col("p_partkey").alias("h"), C.array_count(low, F.when(F.col("p_size") % 10 == 1, F.lit(MASK)).otherwise(size)).alias("n"))


@query("i42", "SELECT p_partkey AS h, CAST(ceil(log2(p_partkey + 1) / 4) AS INTEGER) AS digits FROM part")
def i42(b: Bridge):
    return b.table("part").select(F.col("p_partkey").alias("h"), C.offset_digits(F.col("p_partkey") + 1).alias("digits"))


@query("i44", "SELECT 1179403647 AS elf")
def i44(b: Bridge):
    """A four-character code is its bytes in little-endian order."""
    return b.spark.range(1).select(C.le_unsigned(F.lit(b"\x7fELF"), F.lit(0), 4).cast("int").alias("elf"))


@query("a17", "SELECT p_partkey AS h, p_size % 64 AS symbol_type, p_partkey % 32 AS symbol_class, p_partkey AS \"index\" FROM part")
def a17(b: Bridge):
    """Fields packed into words, written as bytes and read again; an index has 20 bits, so what a key has above them is the index of a second word."""
    key = F.col("p_partkey")
    word = lambda index: F.col("p_size") % 64 + F.shiftleft(key % 32, 6) + F.shiftleft(index.bitwiseAND(F.lit(0xFFFFF)), 12)
    data = F.concat(C.le_bytes(word(key), 4), C.le_bytes(word(F.shiftright(key, 20)), 4))
    fields, above = (C.packed_symbol(C.le_unsigned(data, F.lit(at), 4)) for at in (0, 4))
    index = fields["index"] + F.shiftleft(above["index"], 20)
    return b.table("part").select(key.alias("h"), fields["symbol_type"].cast("int").alias("symbol_type"), fields["symbol_class"].alias("symbol_class"), index.alias("index"))


@query("a18", "SELECT p_partkey AS h, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 256 END AS code FROM part")
def a18(b: Bridge):
    index = F.when(F.col("p_partkey") % 2 == 0, C.STABS_BASE + F.col("p_partkey") % 256).otherwise(F.col("p_partkey") % 1000)
    return b.table("part").select(F.col("p_partkey").alias("h"), C.stabs_code(index).alias("code"))


@query("a36", "SELECT p_partkey AS h, CASE p_partkey % 4 WHEN 0 THEN '.text' WHEN 1 THEN '.lit4' WHEN 2 THEN '.sdata' END AS section, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS is_code, CASE WHEN p_partkey % 4 < 3 THEN p_brand END AS symbol_name FROM part")
def a36(b: Bridge):
    head = F.element_at(F.array(F.lit(".text."), F.lit(".lit4."), F.lit(".sdata."), F.lit(".other.")), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = C.section_symbol(F.concat(head, "p_brand"))
    return b.table("part").select(F.col("p_partkey").alias("h"), *[v.alias(k) for k, v in parts.items()])


@query("a37", "SELECT p_partkey AS h, CASE p_partkey % 6 WHEN 0 THEN 'bss' WHEN 1 THEN 'data' WHEN 2 THEN 'sdata' WHEN 3 THEN 'sbss' WHEN 4 THEN 'text' END AS location, CASE WHEN p_partkey % 6 < 5 THEN p_brand END AS symbol_name FROM part")
def a37(b: Bridge):
    letter = F.element_at(F.array(*[F.lit(x) for x in ("b", "d", "s", "sb", "t", "q")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    parts = C.link_once(F.concat(F.lit(".gnu.linkonce."), letter, F.lit("."), "p_brand"))
    return b.table("part").select(F.col("p_partkey").alias("h"), parts["location"].alias("location"), parts["symbol_name"].alias("symbol_name"))


@query("a42", "SELECT p_partkey AS h, p_partkey % 256 AS u8, CASE WHEN p_partkey % 256 > 127 THEN p_partkey % 256 - 256 ELSE p_partkey % 256 END AS s8, CAST(p_size AS BIGINT) AS u32, CAST(NULL AS BIGINT) AS beyond FROM part")
def a42(b: Bridge):
    data = F.concat(C.le_bytes(F.col("p_partkey"), 4), C.le_bytes(F.col("p_size").cast("long"), 4))
    rows = b.table("part").select(F.col("p_partkey").alias("h"), data.alias("d"))
    d = F.col("d")
    return rows.select("h", C.le_unsigned(d, F.lit(0), 1).alias("u8"), C.le_signed(d, F.lit(0), 1).alias("s8"), C.le_unsigned(d, F.lit(4), 4).alias("u32"), C.le_unsigned(d, F.lit(6), 4).alias("beyond"))


@query("a43", "SELECT p_partkey AS h, p_brand AS first, p_type AS second, CAST(NULL AS VARCHAR) AS unterminated FROM part")
def a43(b: Bridge):
    data = F.concat("p_brand", F.lit("\0"), "p_type", F.lit("\0"), F.lit("tail")).cast("binary")
    rows = b.table("part").select(F.col("p_partkey").alias("h"), data.alias("d"), (F.length("p_brand") + 1).alias("o2"), (F.length("p_brand") + F.length("p_type") + 2).alias("o3"))
    d = F.col("d")
    return rows.select("h", C.string_at(d, F.lit(0)).alias("first"), C.string_at(d, F.col("o2")).alias("second"), C.string_at(d, F.col("o3")).alias("unterminated"))


@query("a45", "SELECT conv_id AS id, turn, CAST(pos - 1 AS INTEGER) AS pos, tok FROM (SELECT conv_id, turn, unnest(string_split_regex(trim(text), '\\s+')) AS tok, generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) AS pos FROM conversations WHERE trim(text) <> '') q")
def a45(b: Bridge):
    """Paths of a list, separated by white space, with their positions."""
    return b.table("conversations").filter("trim(text) <> ''").select(F.col("conv_id").alias("id"), "turn", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "tok"))
