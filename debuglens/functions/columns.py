"""Scalar functions as column expressions that stay inside the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = (1 << 32) - 1


def lookup(values: dict, key: Column) -> Column:
    """The value of a fixed table for key, null where it has none."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items())), key)


# Addresses: null is the invalid address.


def or_zero(address: Column) -> Column:
    return F.coalesce(address, F.lit(0))


def rebased(address: Column, base: Column) -> Column:
    """Null stays null."""
    return address + base


def non_zero(address: Column) -> Column:
    return F.nullif(address, F.lit(0))


def hex8(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def hex_plain(value: Column) -> Column:
    return F.lower(F.hex(value))


# Bytes: little-endian reads, null where they aren't all there.


def _swapped(digits: Column, width: int) -> Column:
    """Hex digits of width bytes in the other byte order."""
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))])


def le_unsigned(data: Column, offset: Column, width: int) -> Column:
    part = F.substring(data, offset + 1, F.lit(width))
    value = F.conv(_swapped(F.hex(part), width), 16, 10).cast("decimal(20,0)")
    value = value.cast("long") if width < 8 else value
    return F.when((offset >= 0) & (F.length(part) == width), value)


def le_signed(data: Column, offset: Column, width: int) -> Column:
    """Signed numbers of up to four bytes."""
    value, half = le_unsigned(data, offset, width), 1 << (8 * width - 1)
    return F.when(value >= half, value - 2 * half).otherwise(value)


def le_bytes(value: Column, width: int) -> Column:
    """A number of up to four bytes as little-endian bytes."""
    return F.unhex(_swapped(F.lpad(F.hex(value.bitwiseAND(F.lit((1 << 8 * width) - 1))), 2 * width, "0"), width))


def string_at(data: Column, offset: Column) -> Column:
    """The zero-terminated string at offset as Latin-1 text, null if it doesn't end."""
    rest = F.substring(F.decode(data, "ISO-8859-1"), offset + 1, F.length(data))
    end = F.instr(rest, "\0")
    return F.when((offset >= 0) & (offset < F.length(data)) & (end > 0), F.substring(rest, F.lit(1), end - 1))


# Packed fields of debugging symbols.


def packed_symbol(word: Column) -> dict[str, Column]:
    """Type, class, and index of a packed symbol header word."""
    return {"symbol_type": word.bitwiseAND(F.lit(0x3F)), "symbol_class": F.shiftright(word, 6).bitwiseAND(F.lit(0x1F)), "index": F.shiftright(word, 12).bitwiseAND(F.lit(0xFFFFF))}


#: Stabs symbols carry their code above this number in the index field.
STABS_BASE = 0x8F300


def stabs_code(index: Column) -> Column:
    """The stabs code, null for other symbols."""
    return F.when(index.bitwiseAND(F.lit(0xFFF00)) == STABS_BASE, index - STABS_BASE)


# 128-bit numbers as two signed longs.


def _unsigned_less(a: Column, b: Column) -> Column:
    flip = F.lit(-(1 << 63))
    return a.bitwiseXOR(flip) < b.bitwiseXOR(flip)


def wrapped_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64 without overflow errors: halves are added apart."""
    low = a.bitwiseAND(F.lit(MASK32)) + b.bitwiseAND(F.lit(MASK32))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(MASK32)))


def add128(a: Column, b: Column) -> Column:
    low = wrapped_add(a["lo"], b["lo"])
    carry = F.when(_unsigned_less(low, a["lo"]), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.struct(wrapped_add(wrapped_add(a["hi"], b["hi"]), carry).alias("hi"), low.alias("lo"))


def not128(a: Column) -> Column:
    return F.struct(F.bitwise_not(a["hi"]).alias("hi"), F.bitwise_not(a["lo"]).alias("lo"))


def sub128(a: Column, b: Column) -> Column:
    one = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(1).cast("long").alias("lo"))
    return add128(a, add128(not128(b), one))


def and128(a: Column, b: Column) -> Column:
    return F.struct(a["hi"].bitwiseAND(b["hi"]).alias("hi"), a["lo"].bitwiseAND(b["lo"]).alias("lo"))


def or128(a: Column, b: Column) -> Column:
    return F.struct(a["hi"].bitwiseOR(b["hi"]).alias("hi"), a["lo"].bitwiseOR(b["lo"]).alias("lo"))


def xor128(a: Column, b: Column) -> Column:
    return F.struct(a["hi"].bitwiseXOR(b["hi"]).alias("hi"), a["lo"].bitwiseXOR(b["lo"]).alias("lo"))


def shl128(a: Column, bits: int) -> Column:
    """Shifts of 128 or more give zero."""
    zero = F.lit(0).cast("long")
    if bits <= 0:
        return a if bits == 0 else F.struct(zero.alias("hi"), zero.alias("lo"))
    if bits >= 128:
        return F.struct(zero.alias("hi"), zero.alias("lo"))
    if bits >= 64:
        return F.struct(F.shiftleft(a["lo"], bits - 64).alias("hi"), zero.alias("lo"))
    return F.struct(F.shiftleft(a["hi"], bits).bitwiseOR(F.shiftrightunsigned(a["lo"], 64 - bits)).alias("hi"), F.shiftleft(a["lo"], bits).alias("lo"))


def shr128(a: Column, bits: int, signed: bool = False) -> Column:
    """Shifts of 128 or more give zero, or the sign."""
    zero = F.lit(0).cast("long")
    sign = F.shiftright(a["hi"], 63) if signed else zero
    shift = F.shiftright if signed else F.shiftrightunsigned
    if bits <= 0:
        return a
    if bits >= 128:
        return F.struct(sign.alias("hi"), sign.alias("lo"))
    if bits >= 64:
        return F.struct(sign.alias("hi"), shift(a["hi"], bits - 64).alias("lo"))
    return F.struct(shift(a["hi"], bits).alias("hi"), F.shiftleft(a["hi"], 64 - bits).bitwiseOR(F.shiftrightunsigned(a["lo"], bits)).alias("lo"))


def hex128(a: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(a["hi"])), 16, "0"), F.lpad(F.lower(F.hex(a["lo"])), 16, "0"))


def from_hex128(text: Column) -> Column:
    """The leading hex digits as a number, null if there are none."""
    digits = F.lpad(F.right(F.regexp_extract(text, "^[0-9A-Fa-f]*", 0), F.lit(32)), 32, "0")
    half = lambda s: F.conv(s, 16, -10).cast("long")
    value = F.struct(half(F.substring(digits, 1, 16)).alias("hi"), half(F.substring(digits, 17, 16)).alias("lo"))
    return F.when(F.regexp_like(text, F.lit("^[0-9A-Fa-f]")), value)


# Bitfields.


def unpack_unsigned(unit: Column, offset: Column, bits: Column) -> Column:
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return F.call_function("shiftright", unit, offset).bitwiseAND(mask)


def unpack_signed(unit: Column, offset: Column, bits: Column) -> Column:
    return F.call_function("shiftright", F.call_function("shiftleft", unit, (64 - offset - bits).cast("int")), (64 - bits).cast("int"))


def pack_bitfield(value: Column, offset: Column, bits: Column) -> Column:
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return F.call_function("shiftleft", value.bitwiseAND(mask), offset)


def zero_bitfield(unit: Column, offset: Column, bits: Column) -> Column:
    mask = F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, offset)
    return unit.bitwiseAND(F.bitwise_not(mask))


# MIPS instructions.

#: Bit position and mask of each field of an instruction word.
FIELDS = {"opcode": (26, 0x3F), "rs": (21, 0x1F), "rt": (16, 0x1F), "rd": (11, 0x1F), "sa": (6, 0x1F), "func": (0, 0x3F), "immed": (0, 0xFFFF)}


def mips_field(word: Column, name: str) -> Column:
    shift, mask = FIELDS[name]
    return F.shiftright(word, shift).bitwiseAND(F.lit(mask))


def mips_target(word: Column) -> Column:
    return word.bitwiseAND(F.lit(0x3FFFFFF)) * 4


def mips_class(word: Column) -> Column:
    """The table that an instruction is looked up in."""
    op, rs, func = (mips_field(word, n) for n in ("opcode", "rs", "func"))
    sub = lambda key, names, rest: F.coalesce(lookup(names, key), F.lit(rest))
    return (
        F.when(op == 0, "SPECIAL")
        .when(op == 1, "REGIMM")
        .when(op == 16, sub(rs, {8: "COP0_BC0", 16: "COP0_C0"}, "COP0"))
        .when(op == 17, sub(rs, {8: "COP1_BC1", 16: "COP1_S", 20: "COP1_W"}, "COP1"))
        .when(op == 18, "COP2")
        .when(op == 28, sub(func, {8: "MMI0", 40: "MMI1", 9: "MMI2", 41: "MMI3"}, "MMI"))
        .otherwise("MIPS")
    )


def dbx_register(index: Column) -> tuple[Column, Column]:
    """Register class and number of a debugger register: 0 to 31 general, 38 to 69 floating point."""
    gpr, fpr = index.between(0, 31), index.between(38, 69)
    return F.when(gpr, "GPR").when(fpr, "FPR").otherwise("INVALID"), F.when(gpr, index).when(fpr, index - 38)


# Types.

#: Fixed pairs of range bounds, as they stand in debugging strings, and the class that they mean.
RANGE_STRINGS = {
    "4;0": "float_32",
    "000000000000000000000000;001777777777777777777777": "unsigned_64",
    "00000000000000000000000000000000000000000000;00000000000000000000001777777777777777777777": "unsigned_64",
    "0000000000000;01777777777777777777777": "unsigned_64",
    "0;18446744073709551615": "unsigned_64",
    "001000000000000000000000;000777777777777777777777": "signed_64",
    "00000000000000000000001000000000000000000000;00000000000000000000000777777777777777777777": "signed_64",
    "01000000000000000000000;0777777777777777777777": "signed_64",
    "-9223372036854775808;9223372036854775807": "signed_64",
    "8;0": "float_64",
    "00000000000000000000000000000000000000000000;03777777777777777777777777777777777777777777": "unsigned_128",
    "02000000000000000000000000000000000000000000;01777777777777777777777777777777777777777777": "signed_128",
    "000000000000000000000000;0377777777777777777777777777777777": "unqualified_128",
    "16;0": "float_128",
    "0;-1": "unqualified_128",
}
RANGE_INTEGERS = (((0, 255), "unsigned_8"), ((-128, 127), "signed_8"), ((0, 127), "unqualified_8"), ((0, 65535), "unsigned_16"), ((-32768, 32767), "signed_16"), ((0, 4294967295), "unsigned_32"), ((-2147483648, 2147483647), "signed_32"))


def _bound(text: Column) -> Column:
    """A bound's number: octal after a leading zero."""
    octal = F.conv(F.regexp_extract(text, "^0[0-7]*", 0), 8, 10)
    return F.when(F.startswith(text, F.lit("0")), octal).otherwise(F.regexp_extract(text, "^-?[0-9]+", 0)).try_cast("decimal(38,0)")


def range_class(low: Column, high: Column) -> Column:
    """The built-in class of a range type, null if none fits; the low bound may be negated."""
    a, b = _bound(low), _bound(high)
    out = F.lit(None).cast("string")
    for (x, y), name in reversed(RANGE_INTEGERS):
        out = F.when(((a == x) | (a == -x)) & (b == y), name).otherwise(out)
    return F.coalesce(lookup(RANGE_STRINGS, F.concat_ws(";", low, high)), out)


def array_count(low: Column, high: Column) -> Column:
    """Elements of an array of these bounds: 4294967295 stands for an open end, and the low bound must be 0."""
    return F.when(low != 0, None).when(high == MASK32, 0).otherwise(high + 1)


def offset_digits(size: Column) -> Column:
    """Hex digits that an offset into size bytes needs."""
    return F.ceil(F.log2(size) / 4).cast("int")


# Paths and names.


def is_windows_path(path: Column) -> Column:
    """Whether the first separator is a backslash."""
    return F.regexp_extract(path, r"[/\\]", 0) == "\\"


def file_name(path: Column) -> Column:
    """What follows the last separator; a path that ends with one is returned whole."""
    last = F.regexp_extract(path, r"[^/\\]*$", 0)
    return F.when(last == "", path).otherwise(last)


def normal_path(path: Column, windows: Column) -> Column:
    """Separators made one kind, "." removed, ".." resolved against the part before it, drive letters in upper case."""
    drive = F.regexp_like(path, F.lit(r"^[A-Za-z]:[/\\]"))
    body = F.when(drive, F.substring(path, F.lit(3), F.length(path))).otherwise(path)
    absolute = F.regexp_like(body, F.lit(r"^[/\\]"))
    parts = F.split(F.when(absolute, F.regexp_replace(body, r"^[/\\]+", "")).otherwise(body), r"[/\\]+")
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = (part == "..") & last.isNotNull() & (last != "..")
        return F.when(part == ".", done).when(back, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    sign = F.when(windows, "\\").otherwise("/")
    head = F.concat(F.when(drive, F.concat(F.upper(F.substring(path, 1, 1)), F.lit(":"))).otherwise(""), F.when(absolute, sign).otherwise(""))
    return F.concat(head, _join(F.aggregate(parts, none, step), sign))


def _join(parts: Column, sign: Column) -> Column:
    return F.aggregate(parts, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, sign, x)), lambda a: F.coalesce(a, F.lit("")))


def merged_path(base: Column, path: Column) -> Column:
    """path below base, unless it is absolute or there is no base."""
    windows = F.when(base == "", is_windows_path(path)).otherwise(is_windows_path(base))
    whole = (base == "") | F.regexp_like(path, F.lit(r"^[/\\]|^.:[/\\]"))
    return normal_path(F.when(whole, path).otherwise(F.concat(base, F.lit("/"), path)), windows)


def include_guard(path: Column) -> Column:
    return F.regexp_replace(F.upper(path), "[^A-Z0-9]", "_")


def without_template_arguments(name: Column) -> Column:
    return F.substring_index(name, "<", 1)


def mangled_name(mangled: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(mangled, F.lit("")), name)


def number_prefix(text: Column, bits: int = 64) -> Column:
    """The leading decimal number of a text, wrapped to 32 bits if asked, null if there is none."""
    value = F.regexp_extract(text, "^-?[0-9]+", 0).try_cast("long")
    if bits == 64:
        return value
    low = value.bitwiseAND(F.lit(MASK32))
    return F.when(low > 0x7FFFFFFF, low - (MASK32 + 1)).otherwise(low)


def until(text: Column, terminator: str) -> Column:
    """The text before the first terminator, null if it never comes."""
    return F.when(F.contains(text, F.lit(terminator)), F.substring_index(text, terminator, 1))


#: Section prefixes of -ffunction-sections and -fdata-sections and whether they hold code.
KNOWN_SECTIONS = {".bss": False, ".data": False, ".lit": False, ".lita": False, ".lit4": False, ".lit8": False, ".rdata": False, ".rodata": False, ".sbss": False, ".sdata": False, ".text": True}
#: Letters of link-once sections and the place they stand for.
LINK_ONCE = {"b": "bss", "d": "data", "s": "sdata", "sb": "sbss", "t": "text"}


def link_once(name: Column) -> dict[str, Column]:
    pattern = r"^\.gnu\.linkonce\.(sb|[bdst])\.(.+)$"
    letter = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return {"is_text": letter == "t", "location": lookup(LINK_ONCE, letter), "symbol_name": F.nullif(F.regexp_extract(name, pattern, 2), F.lit(""))}


def section_symbol(name: Column) -> dict[str, Column]:
    """The symbol that a section of its own is named after."""
    pattern = "^(" + "|".join(s.replace(".", r"\.") for s in sorted(KNOWN_SECTIONS, key=len, reverse=True)) + r")\.(.+)$"
    known = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return {"is_code": lookup(KNOWN_SECTIONS, known), "section": known, "symbol_name": F.nullif(F.regexp_extract(name, pattern, 2), F.lit(""))}


def contains_code(section: Column) -> Column:
    return section == ".text"


def contains_data(section: Column) -> Column:
    return section.isin(*[s for s, code in KNOWN_SECTIONS.items() if not code])
